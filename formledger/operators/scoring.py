"""Roll-ups of several units' evaluations of a supplier into one total and grade: one aggregation by record key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formledger.functions import fields as f
from formledger.functions import values as v


def unit_rows(rows: DataFrame) -> DataFrame:
    """A3: without roll-up rows; a null unit stays."""
    return rows.where(~F.coalesce(v.column(f.UNIT).startswith(f.ROLLUP_PREFIX), F.lit(False)))


def item_means(rows: DataFrame, key: str, extra: tuple[Column, ...] = ()) -> DataFrame:
    """The mean of each item over the rows whose value is a number; bonuses are capped after averaging."""
    # least() would take the cap for a mean that is not there.
    capped = lambda mean: F.when(mean.isNotNull(), F.least(mean, F.lit(float(f.BONUS_CAP))))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(v.to_number(v.column(f"{i}_{f.SCORE}"))).alias(f"{i}_mean") for i in f.EVAL_ITEMS],
        *[capped(F.avg(v.to_number(v.column(f"{i}_{f.BONUS}")))).alias(f"{i}_mean") for i in f.BONUS_ITEMS],
        *extra,
    )


def min_units_gate(rolled: DataFrame, least: int = 2) -> DataFrame:
    """A4: rows count, not distinct units."""
    return rolled.where(F.col("n_rows") >= least)


def total_and_grade(rolled: DataFrame) -> DataFrame:
    """The total adds the means in form order; the grade goes by the unrounded total."""
    total = F.lit(0.0)
    for i in (*f.EVAL_ITEMS, *f.BONUS_ITEMS):
        total = total + F.coalesce(F.col(f"{i}_mean"), F.lit(0.0))
    graded = F.when(F.col("total") >= 90, "A").when(F.col("total") >= 70, "B").otherwise("C")
    return rolled.withColumn("total", total).withColumns({"total_shown": v.half_even(F.col("total")), "grade": graded})


def rollup_header(order: str = "seq") -> tuple[Column, ...]:
    """A8 as aggregates: name and category of the first row, distinct units, all people in row order, the latest date."""
    filled = lambda c: F.when(v.blank(v.column(c)) != "", v.column(c))
    units = F.array_join(F.array_sort(F.collect_set(filled(f.UNIT))), "、")
    people = F.transform(
        F.array_sort(F.collect_list(F.when(filled(f.PERSON).isNotNull(), F.struct(order, v.column(f.PERSON).alias("p"))))), lambda x: x["p"]
    )
    return (
        F.min_by(v.column(f.SUPPLIER), order).alias(f.SUPPLIER),
        F.min_by(v.column(f.CATEGORY), order).alias(f.CATEGORY),
        F.concat(F.lit(f.ROLLUP_PREFIX), units, F.lit(")")).alias(f.UNIT),
        F.array_join(people, "、").alias(f.PERSON),
        F.max(v.blank(v.column(f.DATE))).alias(f.DATE),
    )


def rollups(rows: DataFrame, key: str = "record_key", order: str = "seq") -> DataFrame:
    """A3 to A8 in one shuffle: unit rows in, one graded row a record key with two rows or more out."""
    means = item_means(unit_rows(rows), key, rollup_header(order))
    return total_and_grade(min_units_gate(means))


_ITEMS = [(i, f"{i}_{f.SCORE}") for i in f.EVAL_ITEMS] + [(i, f"{i}_{f.BONUS}") for i in f.BONUS_ITEMS]
PARTIAL = (
    "record_key string, n_rows long, first_seq long, supplier string, category string, units array<string>, people array<struct<seq:long,p:string>>, day string, "
    + ", ".join(f"{i}_sum double, {i}_n long" for i, _ in _ITEMS)
)


def partials(rows: DataFrame, key: str = "record_key", order: str = "seq") -> DataFrame:
    """A3, A5, A6, A8 as sums, counts and sets that can be merged: unit rows in, one row a record key out (PARTIAL)."""
    filled = lambda c: F.when(v.blank(v.column(c)) != "", v.column(c))
    number = lambda c: v.to_number(v.column(c))
    person = F.when(filled(f.PERSON).isNotNull(), F.struct(F.col(order).cast("long").alias("seq"), v.column(f.PERSON).alias("p")))
    return unit_rows(rows).groupBy(F.col(key).alias("record_key")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.col(order).cast("long")).alias("first_seq"), F.min_by(v.column(f.SUPPLIER), order).alias("supplier"),
        F.min_by(v.column(f.CATEGORY), order).alias("category"), F.collect_set(filled(f.UNIT)).alias("units"), F.collect_list(person).alias("people"), F.max(v.blank(v.column(f.DATE))).alias("day"),
        *[x for i, c in _ITEMS for x in (F.sum(number(c)).alias(f"{i}_sum"), F.count(number(c)).alias(f"{i}_n"))],
    )


def merged_partials(rows: DataFrame) -> DataFrame:
    """Partials of several batches, each row of the history being in one of them -> one row a record key."""
    return rows.groupBy("record_key").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first_seq").alias("first_seq"), F.min_by("supplier", "first_seq").alias("supplier"), F.min_by("category", "first_seq").alias("category"),
        F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"), F.flatten(F.collect_list("people")).alias("people"), F.max("day").alias("day"),
        *[F.sum(f"{i}_{x}").alias(f"{i}_{x}") for i, _ in _ITEMS for x in ("sum", "n")],
    )


def rollups_of(merged: DataFrame) -> DataFrame:
    """The same rows as rollups() gives, from merged partials alone."""
    mean = lambda i: F.when(F.col(f"{i}_n") > 0, F.col(f"{i}_sum") / F.col(f"{i}_n"))
    capped = lambda i: F.when(mean(i).isNotNull(), F.least(mean(i), F.lit(float(f.BONUS_CAP))))
    people = F.transform(F.array_sort("people"), lambda x: x["p"])
    made = min_units_gate(merged).select(
        "record_key", "n_rows", *[mean(i).alias(f"{i}_mean") for i in f.EVAL_ITEMS], *[capped(i).alias(f"{i}_mean") for i in f.BONUS_ITEMS],
        F.col("supplier").alias(f.SUPPLIER), F.col("category").alias(f.CATEGORY),
        F.concat(F.lit(f.ROLLUP_PREFIX), F.array_join(F.array_sort("units"), "、"), F.lit(")")).alias(f.UNIT), F.array_join(people, "、").alias(f.PERSON), F.col("day").alias(f.DATE),
    )
    return total_and_grade(made)


ROLLUP = (
    "record_key string, n_rows long, " + ", ".join(f"{i}_mean double" for i, _ in _ITEMS) + f", `{f.SUPPLIER}` string, `{f.CATEGORY}` string, `{f.UNIT}` string, `{f.PERSON}` string, "
    f"`{f.DATE}` string, total double, total_shown double, grade string"
)


def as_rollup_rows(rolled: DataFrame, columns: list[str]) -> DataFrame:
    """Roll-ups in the columns of the evaluation ledger: numbers as text with one decimal, all else ""."""
    text = lambda c: v.blank(v.half_even(F.col(c)).cast("string"))
    made = {f"{i}_{f.SCORE}": text(f"{i}_mean") for i in f.EVAL_ITEMS} | {f"{i}_{f.BONUS}": text(f"{i}_mean") for i in f.BONUS_ITEMS}
    made |= {f.TOTAL: F.col("total_shown").cast("string"), f.GRADE: F.col("grade")}
    made |= {c: v.blank(v.column(c)) for c in (f.SUPPLIER, f.CATEGORY, f.UNIT, f.PERSON, f.DATE)}
    return rolled.select("record_key", *[made.get(c, F.lit("")).alias(c) for c in columns])
