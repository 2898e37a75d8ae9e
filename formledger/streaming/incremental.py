"""Re-scoring of only the suppliers that a batch touches, as a batch job and as a standing stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from formledger.functions import fields as f
from formledger.functions import values as v
from formledger.operators import keyed, ledger, scoring


def touched(batch: DataFrame) -> DataFrame:
    return batch.select(v.eval_record_key(v.column(f.SUPPLIER)).alias("record_key")).distinct()


def reaggregate_touched(history: DataFrame, batch: DataFrame) -> DataFrame:
    """Roll-ups of the record keys in the batch, from their whole history (record_key, seq, unit rows)."""
    return scoring.rollups(history.join(touched(batch), "record_key", "left_semi"))


def partial_table(spark: SparkSession, path: str, buckets: int = keyed.BUCKETS) -> keyed.KeyedTable:
    """A11 without the history: each batch's sums, counts and sets by record key, merged when read."""
    return keyed.KeyedTable(spark, path, scoring.PARTIAL, "record_key", scoring.merged_partials, buckets)


def rollup_table(spark: SparkSession, path: str, buckets: int = keyed.BUCKETS) -> keyed.KeyedTable:
    """The current roll-up of each record key: the last one written."""
    names = [c.split()[0].strip("`") for c in scoring.ROLLUP.split(", ") if not c.startswith("record_key")]

    def latest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy("record_key").agg(F.max_by(F.struct(*[v.column(c) for c in names]), "__order").alias("r"))
        return last.select("record_key", *[F.col("r").getField(c).alias(c) for c in names])

    return keyed.KeyedTable(spark, path, scoring.ROLLUP, "record_key", latest, buckets)


def rescored(table: keyed.KeyedTable, batch: DataFrame) -> DataFrame:
    """Roll-ups of the record keys in the batch, from their partials alone: the cost goes by the keys touched, not by their histories
    (but for the list of people, which a roll-up shows in full)."""
    return scoring.rollups_of(table.read(touched(batch)))


def ingest_stream(stream: DataFrame, history: str, partials: str, rollups: str, schema: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch of unit rows is one batch of the history and one delta of the partials; its suppliers are scored anew from these.

    A batch is written under its number, over whatever a broken attempt left, so a replay changes nothing. Small batches are merged as
    they pile up.
    """
    full = f"{schema}, record_key string"

    def take(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        name = f"{number:010}"
        rows = batch.withColumn("record_key", v.eval_record_key(v.column(f.SUPPLIER)))
        ledger.append_history(rows, history, name)
        sums, scored = partial_table(spark, partials), rollup_table(spark, rollups)
        sums.add(scoring.partials(rows), name)
        scored.add(rescored(sums, batch), name)
        keyed.compact(spark, history, full)
        sums.fold()
        scored.fold()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def ingest_suppliers(stream: DataFrame, summary: str, schema: str, checkpoint: str, key: str = f.TAX_ID) -> DataStreamWriter:
    """A12 for supplier records: each micro-batch is one delta of the summary (A1, S6), under its number."""

    def take(batch: DataFrame, number: int) -> None:
        ledger.write_summary(batch, ledger.summary_table(batch.sparkSession, summary, schema, key), f"{number:010}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)


def eval_summary(history: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """A10 on what the stream keeps: all unit rows, and the current roll-up of each supplier as a row of the ledger."""
    units = scoring.unit_rows(history).select(*[v.column(c) for c in columns])
    return ledger.eval_summary_table(units, scoring.as_rollup_rows(current, columns))
