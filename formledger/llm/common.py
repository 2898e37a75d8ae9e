"""What the training-text operators share: the word rule, hash folds, and cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formledger.sources.intermediate import discard, scratch, shared_folder, stored

__all__ = ["discard", "scratch", "shared_folder", "stored"]

#: The six white-space characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[\\x20\\x09-\\x0D]"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of other characters than SPACES; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CHARACTER + "+")).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: a lambda variable is bound, a repeated expression is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: The bytes of a batch between Spark and Python: both sides hold several of them beside all else.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4MB"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session, unless it has a bound of its own; Spark's default is 64 MB."""
    if spark.conf.get(_BATCH, "64MB").lower() in ("67108864b", "67108864", "64mb", "64m"):
        spark.conf.set(_BATCH, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, in parts of about ``size`` bytes of text; a longer text comes alone."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column(text).nbytes
        if total >= size:
            yield from _cut(held, size, text)
            held, total = [], 0
    yield from _cut(held, size, text)


def _cut(batches: list[pa.RecordBatch], size: int, text: str) -> Iterator[pa.RecordBatch]:
    for whole in pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else ():
        upto = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy().astype(np.int64) + 64)
        if not len(upto):
            continue
        step = int(upto[-1]) // max(1, round(int(upto[-1]) / size)) + 1  # equal parts
        at = 0
        while at < len(upto):
            until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + step, side="right")))
            yield whole.slice(at, until - at)
            at = until


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts, A-Z lower-cased: where each text's end (0 first), each word's number, and the distinct words by number."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    at, ends = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    word = at != pc.index(coded.dictionary, "").as_py()  # a split leaves empty strings at the ends
    return np.concatenate(([0], np.cumsum(word)))[ends - ends[0]], at[word], coded.dictionary.cast(pa.binary())


def summed_before(rows: DataFrame, at: str, value: str, name: str, by: str | None = None, height: int = 4096) -> DataFrame:
    """rows with name: the sum of value over the rows of a smaller at (a whole number), within each by, null being one.

    In two steps, so that no task holds all rows: sums of blocks of ``height`` values of at, then a window inside each.
    """
    keyed = rows.withColumn("__block", F.floor(F.col(at) / height))
    part = F.lit(0) if by is None else F.col(by)
    blocks = keyed.groupBy(part.alias("__by"), F.col("__block").alias("__of")).agg(F.sum(value).alias("__sum"))
    earlier = (W.unboundedPreceding, -1)
    blocks = blocks.withColumn("__ahead", F.coalesce(F.sum("__sum").over(W.partitionBy("__by").orderBy("__of").rowsBetween(*earlier)), F.lit(0))).drop("__sum")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(part, "__block").orderBy(at).rowsBetween(*earlier)), F.lit(0))
    joined = keyed.withColumn("__inside", inside).join(blocks, part.eqNullSafe(F.col("__by")) & (F.col("__block") == F.col("__of")))
    return joined.withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__block", "__by", "__of", "__ahead", "__inside")


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut, held where all executors can read it again after a loss."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
