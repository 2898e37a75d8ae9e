"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a schedule: its relative weight at training time 0, 1/2 and 1, linear between. The integral
of the schedule, scaled to the source's target, is its cumulative token demand; a document copy that stands at cumulative
word c of its source is trained at the time at which the demand reaches c (a quadratic, inverted in closed form). Copies
are range-sorted by that time.

Targets: all sources together get ``budget`` times all words, shared by weight; a source's target stays between ``least``
and ``most`` times its size, and what is cut off is shared again among the others (the level at which all meet the
budget has a closed form over the sorted break points). Source weights follow code-point order, null last.

A source's place of each document is a prefix sum of sizes in hash order. It is found in two steps, so that a hot source
is never one group: sums by (source, bucket), prefix sums over buckets, then a window inside each bucket.

Defined results: null text has size 0 and is never taken; a null source is a source of its own; repeated rows (and
repeated ids) are separate documents; an empty table gives an empty mix; extra columns stay, but
those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formledger.llm.common import durable, n_words, table

WEIGHTS = (3, 1, 2)
#: Relative weight at the start, the middle and the end of training, by turns like WEIGHTS; equal means make no change.
SCHEDULES = ((1.25, 1.0, 0.75), (0.5, 1.0, 1.5), (0.75, 1.25, 0.75))
BUDGET, LEAST, MOST = 1.5, 0, 2
#: Buckets a source is dealt over; each holds a 4096th of a source, so even 1e10 documents leave windows of millions.
BUCKETS = 4096


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with rank, weight and target. One row a source: the only window without partitions."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("rank", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    )
    size, weight = F.col("source_size"), F.col("weight")
    share = max(float(least), min(float(most), float(budget)))
    # The total at level x is the sum of clamp(x * weight, least * size, most * size): its slope grows by the weight at
    # least * size / weight and falls by it at most * size / weight.
    marks = ranked.withColumn(
        "m",
        F.explode(
            F.array(
                F.struct((least * size / weight).alias("at"), weight.alias("turn")),
                F.struct((most * size / weight).alias("at"), (-weight).alias("turn")),
            )
        ),
    )
    order = W.orderBy("m.at", "m.turn", "rank")
    upto, whole = order.rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    everything = F.sum("source_size").over(whole) / 2
    grown = (
        marks.withColumn("slope", F.sum("m.turn").over(upto))
        .withColumn("step", F.coalesce((F.col("m.at") - F.lag("m.at").over(order)) * F.lag("slope").over(order), F.lit(0.0)))
        .withColumn("total", F.sum("step").over(upto) + least * everything)
        # The level lies above every mark whose total still falls short of the budget.
        .withColumn("below", F.max(F.when(F.col("total") < share * everything, F.col("m.at"))).over(whole))
        .where("m.turn > 0")
    )
    full = most * size / weight <= F.col("below")
    free = (least * size / weight <= F.col("below")) & ~full
    fixed = F.when(full, most * size).when(free, F.lit(0)).otherwise(least * size)
    level = (share * F.sum("source_size").over(whole) - F.sum(fixed).over(whole)) / F.sum(F.when(free, weight)).over(whole)
    return grown.withColumn("level", level).select(
        "source",
        "source_size",
        "rank",
        "weight",
        F.greatest(least * size, F.least(F.when(free, F.col("level") * weight).otherwise(fixed), most * size)).cast("double").alias("target"),
    )


def when_reached(share: Column, rank: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """The time at which a source has met this share of its whole demand: its integrated schedule, inverted."""
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(schedules) + 1).cast("int"))
    area = [(a + 2 * b + c) / 4 for a, b, c in schedules]
    a, b, c = (pick([s[i] / n for s, n in zip(schedules, area, strict=True)]) for i in range(3))
    half = (a + b) / 4
    root = lambda start, slope, need: 2 * need / (start + F.sqrt(F.greatest(start * start + 2 * slope * need, F.lit(0.0))))
    early = root(a, 2 * (b - a), share)
    late = 0.5 + root(b, 2 * (c - b), share - half)
    return F.when(share <= 0, F.lit(0.0)).when(share <= half, early).otherwise(F.least(late, F.lit(1.0)))


def order_hash(doc_id: Column, size: Column) -> Column:
    """The first 60 bits of the md5 of id and size: the order of documents in their source. Rows without an id part by size."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    budget: float = BUDGET,
    least: int = LEAST,
    most: int = MOST,
    buckets: int = BUCKETS,
) -> DataFrame:
    """docs (doc_id, source, size, any others) -> with source_size, target, rank, at (words of the source before it)."""
    docs = docs.drop("source_size", "target", "rank", "at")  # names that this adds
    keyed = docs.withColumn("__hash", order_hash(F.col("doc_id"), F.col("size"))).withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(buckets)))
    sums = durable(keyed.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum")))
    sources = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, budget, least, most)
    # The window by source holds one row a bucket, never one a document.
    before = sums.withColumn(
        "__before", F.sum("__sum").over(W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    )
    plan = before.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    plan = plan.select(
        F.col("b.source").alias("__source"),
        F.col("b.__bucket").alias("__of"),
        F.coalesce("__before", F.lit(0)).alias("__before"),
        "source_size",
        "rank",
        "target",
    )
    inside = W.partitionBy("source", "__bucket").orderBy("__hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__bucket") == F.col("__of")))
    return joined.withColumn("at", F.col("__before") + F.col("__inside")).drop(
        "__hash", "__bucket", "__inside", "__before", "__source", "__of"
    )


def taken(lap: int) -> Column:
    """Words of a document that its source's demand covers in one lap over the source."""
    start = F.col("at") + lap * F.col("source_size")
    return F.greatest(F.lit(0), F.least(start + F.col("size"), F.round("target").cast("long")) - start)


def copies(mixed: DataFrame, schedules: Sequence[Sequence[float]] = SCHEDULES, most: int = MOST) -> DataFrame:
    """One row a whole copy, with its position, range-sorted by it. A copy is trained if its middle word is in demand."""
    middle = lambda lap: F.col("at") + lap * F.col("source_size") + F.col("size") / 2
    laps = F.array(*[F.when((F.col("size") > 0) & (middle(k) <= F.col("target")), F.lit(k)) for k in range(most)])
    each = mixed.withColumn("lap", F.explode(F.array_compact(laps)))
    share = (F.col("at") + F.col("lap") * F.col("source_size") + F.col("size") / 2) / F.col("target")
    return each.withColumn("position", when_reached(share, F.col("rank"), schedules)).orderBy("position", "doc_id", "lap")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = durable(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    mixed = mix(docs).withColumn("taken", taken(0) + taken(1))
    share = F.col("at") / F.greatest(F.col("target"), F.lit(1.0))
    return (
        mixed.withColumn("position", F.when(F.col("taken") > 0, F.round(when_reached(share, F.col("rank")), 6)))
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
        .select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "position")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents)
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank
  FROM d GROUP BY source
), w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), x AS (
  SELECT *, (SELECT level FROM l WHERE 2.0::DOUBLE * source_size / weight > level ORDER BY source_size / weight, rank LIMIT 1) AS top
  FROM l
), t AS (
  SELECT source, source_size, rank,
         CASE WHEN 2.0::DOUBLE * source_size / weight > top THEN top * weight ELSE 2.0::DOUBLE * source_size END AS target
  FROM x
), p AS (
  SELECT doc_id, size, source_size, target, rank,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h % 4096, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(pos + size, round(target)::BIGINT) - pos)
            + greatest(0, least(pos + source_size + size, round(target)::BIGINT) - pos - source_size) AS taken,
         pos / greatest(target, 1.0) AS share,
         [1.25, 0.5, 0.75][(rank % 3 + 1)::INT]::DOUBLE AS a, [1.0, 1.0, 1.25][(rank % 3 + 1)::INT]::DOUBLE AS b,
         [0.75, 1.5, 0.75][(rank % 3 + 1)::INT]::DOUBLE AS c
  FROM p
)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(CASE
         WHEN share <= 0 THEN 0
         WHEN share <= (a + b) / 4 THEN 2 * share / (a + sqrt(greatest(a * a + 4 * (b - a) * share, 0)))
         ELSE least(0.5 + 2 * (share - (a + b) / 4) / (b + sqrt(greatest(b * b + 4 * (c - b) * (share - (a + b) / 4), 0))), 1)
       END, 6) END AS position
FROM k
"""
QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": OP1_SQL}
