"""Tables, written intermediates and bounded sharing that the operators have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.intermediate import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again, so that its lineage ends there.

    Lost executors then cost a read of the table and no recomputation. `quillon.sources.intermediate.released`
    deletes what was written, `drop_cut` what nothing reads any more.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_cut(*tables: DataFrame | None) -> None:
    """Delete the files behind DataFrames that `cut` returned; None is passed over."""
    for df in tables:
        if df is not None:
            drop_path(df.sparkSession, df.cut_path)
