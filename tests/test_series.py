"""An id's frames in one pass against the window columns, bit by bit, over cut batches; ranks by date without exchanges of their own."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.config import Config
from quillon.operators import windows as W
from quillon.operators.series import own_features
from quillon.plans.features import add_features

CFG = Config(windows=(3, 30), horizons=(2, 9))


def _panel(spark):
    """Ids of 1 to 60 rows, with missing, equal and large returns."""
    rows = spark.range(12).selectExpr("id as k", "explode(sequence(1, cast(1 + id * id % 61 as int))) as n")
    ret = "case when k = 5 then 0.25 when hash(k, n) % 5 = 0 then null when k = 7 then 1e6 + hash(n) % 7 else hash(k, n) % 1000 / 3e4 end"
    return rows.selectExpr("date_add(date'2020-01-01', n) as date", "concat('i', k) as id", f"cast({ret} as double) as ret", "cast(k + 1 as double) as index_weight", "cast(hash(k, n) % 4 as double) as spread", "1 as active")


@pytest.mark.parametrize("batch", ["5", "10000"])
def test_same_bits_as_window_columns(spark, batch):
    ret = F.col("ret")
    own = {f"mom_w{w}": W.momentum(ret, w) for w in CFG.windows} | {"ret_vol20": W.rolling_std(ret, 20, 5), "ret_autocorr": W.autocorrelation(ret)}
    own |= {f"y_h{h}": W.forward_return(ret, h) for h in CFG.horizons}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        told, want = own_features(_panel(spark), CFG.windows, CFG.horizons), _panel(spark).withColumns(own)
        assert told.columns == want.columns and told.count() == want.count()
        assert sorted(map(str, told.collect())) == sorted(map(str, want.collect()))
        assert own_features(_panel(spark).limit(0), CFG.windows, CFG.horizons).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_dates_take_one_exchange(spark):
    # Ties by value used to be counted over an exchange by date and value, one for each ranked column.
    plan = add_features(_panel(spark), CFG)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(", plan)) == 2
