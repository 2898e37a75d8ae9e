"""Rule bitmask ledger: every quality rule is evaluated once a document, and its outcome stored as one bit.

``ledger`` keeps, for each document, the measurements and ``fail_bits`` (bit i set: rule i failed). A policy is a name
and the list of rules that reject; ``apply_policy`` ANDs its mask with the bits, so a new policy version never touches
the texts again. ``ablation`` counts, from the bits alone, how many documents each rule rejects, how many it alone
rejects, and what would be kept without it. Only DataFrame functions are used, and no row is shuffled but in
``ablation``, which aggregates distinct bit patterns first.

Defined results: a null or empty text has no words and fails ``too_few_words``; repeated rows are judged alike, each by
itself; null ids pass through; extra columns are kept unless their names clash with a measurement, which then wins.
Two different five-word windows count as equal if their 64-bit hashes are (about 1e-10 for 100,000 words).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import WORD_CHARACTER, let, table, words

SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bits in order; a rule keeps its bit for ever, new ones are added at the end.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "n_symbols > 10 AND 4 * n_symbols > n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "word_length": "n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)",
}
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def _repeat_words(tokens: Column) -> Column:
    """How many words lie in a window of WINDOW words that is found twice or more."""

    def windows(w: Column) -> Column:
        last = F.size(w) - WINDOW + 1
        at = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        return F.when(
            last >= 2,
            F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(WINDOW)])),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        # (hash, start) sorted brings equal windows together; starts of those with an equal neighbour, sorted, then
        # each cover WINDOW words less what the next one covers again.
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            same = lambda i, j: F.get(s, i).getField("h") == F.get(s, j).getField("h")
            hit = F.transform(
                s,
                lambda x, i: F.when(
                    F.coalesce((i > 0) & same(i, i - 1), F.lit(False))
                    | F.coalesce((i < n - 1) & same(i, i + 1), F.lit(False)),
                    x.getField("i"),
                ),
            )
            return F.sort_array(F.array_compact(hit))

        def total(p: Column) -> Column:
            steps = F.transform(
                p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(keyed, starts), total)

    # Most texts repeat no window at all; a set of longs tells so before anything is sorted.
    return let(
        let(tokens, windows),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    )


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(body, "\n"), lambda line: F.rlike(line, F.lit(WORD_CHARACTER)))
    return df.withColumns({"__w": words(F.col(text)), "__l": with_word}).select(
        *[c for c in df.columns if c not in MEASURES],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        let(F.col("__l"), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"),
    )


def mask(rules: Sequence[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(df: DataFrame, text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """df without clashing columns, plus the measurements and fail_bits."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured(df.drop("fail_bits"), text).withColumn("fail_bits", total)


def apply_policy(entries: DataFrame, policy: str = "v1", policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """kept: no rule of the policy failed. Reads the bits alone."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policies[policy]))) == 0)


def ablation(entries: DataFrame, policy: str = "v1", policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """One row a rule: documents it fails, documents that only it rejects, documents kept without it."""
    whole = F.lit(mask(policies[policy]))
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(whole).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in policies[policy]])
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    none = F.lit(0).cast("long")
    return (
        patterns.withColumn("r", F.explode(each))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(none)).alias("failed"),
            F.sum(F.when((left == 0) & (F.col("bits") != 0), F.col("n")).otherwise(none)).alias("only_this"),
            F.sum(F.when(left == 0, F.col("n")).otherwise(none)).alias("kept_without"),
        )
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES["base"])))
    return apply_policy(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (base != 0).alias("base_failed"), "kept", "fail_bits",
    )


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), r AS (SELECT row_number() OVER () AS rid, * FROM t),
g AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM r WHERE len(w) >= 6)
), d AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM d) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM r LEFT JOIN c USING (rid)
), f AS (
  SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1,
         n_symbols > 10 AND 4 * n_symbols > n_words AS f2, n_lines >= 4 AND 2 * n_dup_lines > n_lines AS f3,
         n_words >= 10 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) AS f4
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
       NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept,
       (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT)::BIGINT AS fail_bits
FROM f
"""


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy does to all documents, from their bits."""
    return ablation(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


ABLATION_SQL = f"""
WITH b AS ({OP10_SQL}), r AS (SELECT unnest({list(RULES)}) AS rule, unnest({[1 << i for i in range(len(RULES))]}) AS bit)
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits = bit) AS only_this,
       count(*) FILTER (WHERE fail_bits & ~bit = 0) AS kept_without
FROM b CROSS JOIN r GROUP BY rule
"""
QUERIES = {"op10_quality_rules": op10_quality_rules, "quality_rules_ablation": quality_rules_ablation}
ORACLES = {"op10_quality_rules": OP10_SQL, "quality_rules_ablation": ABLATION_SQL}
