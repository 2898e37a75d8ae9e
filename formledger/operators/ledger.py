"""Ledgers: append-only histories and summaries with one current row a key.

Ledger rows carry ``seq``, their position. A batch is upserted at once: the last row of a key wins and stands at the
place of its first. Rows without a key are never compared, so the window never sees one giant blank group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formledger.functions import fields as f
from formledger.functions import values as v
from formledger.operators import keyed
from formledger.operators.keyed import BUCKETS


def align_to_header(rows: DataFrame, header: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A2: exactly the header's columns: extra ones go, missing ones and nulls are ""."""
    have = set(rows.columns)
    return rows.select(*keep, *[(v.blank(v.column(c).cast("string")) if c in have else F.lit("")).alias(c) for c in header if c not in keep])


def upsert_summary(existing: DataFrame, batch: DataFrame, key: str = f.TAX_ID) -> DataFrame:
    """A1: existing and batch carry seq (batch seqs are larger); the existing ledger's header wins."""
    header = [c for c in existing.columns if c != "seq"]
    aligned = align_to_header(batch, header, keep=("seq",)).select(*[v.column(c) for c in existing.columns])
    rows = existing.withColumn("__new", F.lit(0)).unionByName(aligned.withColumn("__new", F.lit(1)))
    if key not in header:
        return rows.drop("__new")
    keyed, free = rows.where(v.blank(v.column(key)) != ""), rows.where(v.blank(v.column(key)) == "")
    same = W.partitionBy(v.column(key))
    latest = (
        keyed.withColumns({"__n": F.row_number().over(same.orderBy(F.desc("seq"), F.desc("__new"))), "__first": F.min("seq").over(same)})
        .where("__n = 1")
        .withColumn("seq", F.col("__first"))
    )
    return latest.drop("__n", "__first", "__new").unionByName(free.drop("__new"))


def upsert_rollup(existing: DataFrame, rollups: DataFrame, match: str | None = f.SUPPLIER, marker: str = f.UNIT, prefix: str = f.ROLLUP_PREFIX) -> DataFrame:
    """Each roll-up takes the place of the first marked row of its match value, else comes at its own seq.

    rollups: at most one row a match value. Other marked rows, and all unmarked ones, stay.
    """
    header = existing.columns
    marked = F.coalesce(v.column(marker).startswith(prefix), F.lit(False))
    on = v.column(match) if match and match in header else F.lit("")
    old = existing.where(marked).withColumn("__on", on).groupBy("__on").agg(F.min("seq").alias("__place"))
    new = rollups.withColumn("__on", on if match and match in rollups.columns else F.lit(""))
    placed = new.join(old, "__on", "left")
    replaced = placed.where("__place IS NOT NULL").select(F.col("__place").alias("seq"))
    come = placed.withColumn("seq", F.coalesce("__place", "seq")).select(*[v.column(c) for c in header])
    return existing.join(replaced, "seq", "left_anti").select(*[v.column(c) for c in header]).unionByName(come)


def eval_summary_table(units: DataFrame, rollups: DataFrame) -> DataFrame:
    """A10: all unit rows and one roll-up a supplier."""
    return units.unionByName(rollups.select(*[v.column(c) for c in units.columns]))


def append_history(rows: DataFrame, path: str, batch: str, buckets: int = BUCKETS) -> None:
    """Appends one batch by name. A batch of the same name is replaced as a whole, so a repeated or broken write does no harm.

    Files are split by a hash of the record key, not by key, so that they stay few; how many buckets there are is kept with them.
    """
    keyed.append(rows, path, batch, buckets)


def read_history(spark: SparkSession, path: str, schema: str, keys: DataFrame | None = None) -> DataFrame:
    """The history by name, nulls as ""; empty if there is none yet. keys (record_key): only these; other buckets are not opened."""
    folders = keyed.history_folders(spark, path, keys)
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch string, of int, bucket int").option("basePath", path).parquet(*folders)
    if keys is not None:
        rows = rows.join(keys.select("record_key").distinct(), "record_key", "left_semi")
    return rows.select(*[v.column(c) for c in spark.createDataFrame([], schema).columns]).na.fill("")


def summary_table(spark: SparkSession, path: str, schema: str, key: str = f.TAX_ID, buckets: int = BUCKETS) -> keyed.KeyedTable:
    """A summary as a table by key: a batch is one delta, and only the buckets that it touches are ever written anew.

    schema: seq and the header's columns; seqs grow from batch to batch. The last row of a key stands at the place of its first; rows
    without a key stay each, and are dealt by their place.
    """
    given = v.blank(v.column(key)) != ""

    def latest(rows: DataFrame) -> DataFrame:
        same = W.partitionBy(v.column(key))
        ranked = rows.where(given).withColumns({"__n": F.row_number().over(same.orderBy(F.desc("__order"), F.desc("seq"))), "__first": F.min("seq").over(same)})
        return ranked.where("__n = 1").withColumn("seq", F.col("__first")).drop("__n", "__first").unionByName(rows.where(~given))

    return keyed.KeyedTable(spark, path, schema, key, latest, buckets, F.when(given, v.column(key)).otherwise(F.col("seq").cast("string")))


def write_summary(rows: DataFrame, table: keyed.KeyedTable, batch: str) -> None:
    """Rows go into a summary under the batch's name, in the summary's own columns (A2)."""
    header = [c for c in table.columns if c != "seq"]
    table.add(align_to_header(rows, header, keep=("seq",)), batch)
    table.fold()
