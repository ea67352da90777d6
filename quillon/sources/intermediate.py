"""Written intermediates: a table that a plan reads several times is written once to the shared folder.

What is written belongs to the application that wrote it. A result may still read it when a query returns,
so it is deleted by the caller, who knows when results are read: `released` does it for a stretch of work,
`release` for all so far.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths by application, in the order of writing.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, `spark.checkpoint.dir`; a temporary one on one machine where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which `release` knows."""
    path = f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again; a lost executor then costs a read of it."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what this application wrote after its first `since` intermediates; how many paths that were."""
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone, jvm = paths[since:], spark.sparkContext._jvm
    for path in gone:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del paths[since:]
    return len(gone)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Intermediates written inside are deleted at the end: read results, or write them, before it."""
    since = len(_written.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, since)
