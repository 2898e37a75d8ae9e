"""Intermediate tables: held where the driver and all executors can read them again after a loss, and deleted after use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may go without it, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="formledger-"))
    return context.getCheckpointDir()


#: Spark removes a query's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of the tables stored since the innermost scratch() began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def stored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and it is read column by column. by: columns to prune files by."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored within is deleted at the end, also after a failure; ``keep`` stores a table that outlives it.

    with scratch(spark) as keep: return keep(result). Within another scratch(), that one deletes what was kept.
    """
    made: list[str] = []
    mine = _made.set(made)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        kept.append(made.pop())
        return out

    try:
        yield keep
    except BaseException:
        made += kept
        kept = []
        raise
    finally:
        _made.reset(mine)
        if (outer := _made.get()) is not None:
            outer += kept
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        for folder in {file.rpartition("/table-")[0] + "/table-" + file.rpartition("/table-")[2].partition("/")[0] for file in df.inputFiles()}:
            delete(df.sparkSession, folder)
