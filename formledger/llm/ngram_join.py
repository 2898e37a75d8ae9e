"""Exact Jaccard self-join on word n-grams, by adaptive multi-match prefixes, reduced to its connected components.

Theorem used throughout: under one global order of shingles, two sets of sizes m and n that share at least o of them
share at least l within their first m - o + l and n - o + l. A set of size n needs o >= ceil(t n) with any partner.

1. Screen, in hash order: a document emits its first floor((1-t) n) + l shingles, with l a tenth of n. One pre-aggregated
   count by shingle says how many of them nobody else has; a document with fewer than l shared ones has no partner.
2. The others are read again; equal sets become one class, and shingles that only one class has are dropped. What is
   left bounds the overlap with any partner, which sets most documents aside once more.
3. Order by (document frequency, hash). Each class lengthens its prefix by l - 1 shingles, 1 <= l <= MATCHES, with the
   least estimated cost: postings visited, plus verifications, of which there are at most postings / l.
4. Each posting list first links its members to one hub, so a large group of copies costs one pair a member, not all
   pairs. Verified links give components. Then every pair of different components that shares at least the smaller l of
   prefix shingles, and whose sizes allow t, is verified as well: no link between components is missed, and links inside
   one change nothing.

Defined results: null or empty texts have no shingles and are linked with nothing; a text with fewer than n words is one
shingle; a null id comes last among ids; repeated rows and repeated ids are documents of their own; an empty table gives
no rows. Shingles are told apart by a 64-bit fold of
their words' XXH3 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import coded_words, discard, slices, stored, table
from formledger.llm.graph import components

NGRAM, PERCENT = 5, 80
#: The most matches that a prefix is lengthened for.
MATCHES = 6
#: Ids are broadcast to the scan up to so many, else joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Stands for a null id within; the largest long, so that real ids come first.
NO_ID = (1 << 63) - 1
#: Bytes of text that a task shingles at once.
SLICE_BYTES = 4 << 20
def folded(hashes: Sequence[np.ndarray]) -> np.ndarray:
    """One number for each row of equally long arrays of hashes, by turns of adding, multiplying and shifting: no sum of them,
    so that sequences whose differences cancel out stay apart."""
    out = np.full(len(hashes[0]), len(hashes), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for h in hashes:
        out = (out ^ h) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def shingle_sets(texts: pa.Array, n: int = NGRAM) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of the distinct n-word sequences of the whole of it, A-Z lower-cased."""
    ends, at, words = coded_words(texts)
    found = words.to_numpy(zero_copy_only=False).tolist()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))[at]
    whole = folded([each[i : len(each) - n + 1 + i] for i in range(n)]).view(np.int64) if len(each) >= n else np.empty(0, np.int64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        else:
            yield folded([each[i : i + 1] for i in range(a, b)]).view(np.int64) if b > a else np.empty(0, np.int64)


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def least_overlap(n, percent: int):
    """ceil(percent n / 100), for numbers and for columns of longs."""
    return F.floor((n * percent + 99) / 100) if isinstance(n, Column) else (n * percent + 99) // 100


def _screen_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + max(1, n // 10))


def _screen(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """(doc, n, u, rows): set size, how many of the emitted shingles nobody else emits, rows with this id."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes))],
                ["token", "doc", "n"],
            )

        for rows in slices(batches, SLICE_BYTES):
            for doc, mark, found in zip(rows.column("doc").to_pylist(), rows.column("mark").to_pylist(), shingle_sets(rows.column("text"), ngram), strict=True):
                part = np.append(found[: _screen_length(len(found), percent)], mark)
                tokens.append(part)
                ids.append(np.full(len(part), doc, np.int64))
                sizes.append(np.full(len(part), len(found), np.int32))
                held += len(part)
                if held >= 1 << 18:
                    yield out()
                    tokens, ids, sizes, held = [], [], [], 0
        if held:
            yield out()

    mark = F.xxhash64("doc")
    emitted = docs.select("doc", mark.alias("mark"), "text").mapInArrow(emit, "token long, doc long, n int")
    counted = emitted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("doc").alias("doc"), F.max("n").alias("n"))
    own = F.col("token") == mark  # each document's own mark, so that none is lost
    return (
        counted.where((F.col("c") == 1) | own)
        .groupBy("doc")
        .agg(
            F.max("n").alias("n"),
            F.sum(F.when(own, F.lit(0)).otherwise(F.lit(1))).alias("u"),
            F.max(F.when(own, F.col("c"))).alias("rows"),
        )
    )


def semi(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """df's rows whose key is among ids (or is not, left_anti); ids are broadcast only behind a count of them."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), on, how)


def _sets(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc, n, key, tokens) of each row."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            flat = np.concatenate([r[1] for r in rows])
            ends = np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.md5(r[1].tobytes()).digest() for r in rows], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["doc", "n", "key", "tokens"],
            )

        rows, held = [], 0
        for part in slices(batches, SLICE_BYTES):
            for doc, found in zip(part.column("doc").to_pylist(), shingle_sets(part.column("text"), ngram), strict=True):
                rows.append((doc, found))
                held += len(found) + 1
                if held >= 1 << 18:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return docs.select("doc", "text").mapInArrow(emit, "doc long, n long, key binary, tokens array<long>")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """(token, at, id, n, s, l): the adaptive prefix of each class that may have a partner; s of its n shingles are shared,
    and the token is the at-th of these."""
    each = classes.select("id", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = each.join(shared, "token").groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("t"))
    slack = (F.col("n") - least_overlap(F.col("n"), percent)).cast("int")
    viable = (
        lists.withColumn("s", F.size("t"))
        .where(F.col("n") - F.col("s") <= slack)
        .withColumn("t", F.sort_array("t"))
        .withColumn("own", (F.col("n") - F.col("s")).cast("int"))
    )
    length = lambda m: F.least(slack + m - F.col("own"), F.col("s"))
    visits = lambda m: F.aggregate(F.slice("t", F.lit(1), length(m)), F.lit(0).cast("long"), lambda a, x: a + x["df"])
    check = F.col("n") / 32  # a verification next to a visit
    costs = F.array(*[visits(m) * (1 + check / m) for m in range(1, MATCHES + 1)])
    chosen = viable.withColumn("costs", costs).withColumn("l", F.array_position("costs", F.array_min("costs")).cast("int"))
    return chosen.select("id", "n", "s", "l", F.posexplode(F.slice("t", F.lit(1), length(F.col("l")))).alias("at", "x")).select(
        F.col("x.token").alias("token"), (F.col("at") + 1).alias("at"), "id", "n", "s", "l"
    )


def _may_link(a: str, b: str, percent: int) -> Column:
    """Even if the smaller number of shared shingles were all common, would it do?"""
    return (100 + percent) * F.least(F.col(f"{a}.s"), F.col(f"{b}.s")) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _among_first(a: str, b: str, percent: int) -> Column:
    """Can the token be one of the first l common ones of a pair that reaches the threshold?"""
    after = lambda x: F.col(f"{x}.s") - F.col(f"{x}.at") + F.least(F.col(f"{a}.l"), F.col(f"{b}.l"))
    return (100 + percent) * F.least(after(a), after(b)) >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


#: Longs that hold the bits of what a set lacks of its hub.
LACKS = 4


def _differences(lists: DataFrame, hub: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, hub, size, e, m0 ...): a class next to one hub of its lists. e: shared shingles that the hub does not have;
    m: bits of the hub's shingles that it lacks."""
    near = lists.join(hub.select("token", "own", F.col("id").alias("hub")), "token").groupBy("id").agg(
        F.min(F.struct("own", "hub"))["hub"].alias("hub"), F.first(F.col("n") - F.col("s")).alias("alone")
    )
    sets = classes.select("id", "tokens")
    both = near.join(sets.withColumnRenamed("tokens", "tx"), "id").join(sets.select(F.col("id").alias("hub"), F.col("tokens").alias("th")), "hub")
    lacking = both.withColumn("m", F.array_except("th", "tx"))
    bits = lambda k: F.aggregate(
        F.filter("m", lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(LACKS - 1)) == k),
        F.lit(0).cast("long"),
        lambda a, t: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))),
    )
    return lacking.select(
        "id",
        "hub",
        F.size("th").alias("size"),
        (F.size(F.array_except("tx", "th")) - F.col("alone")).alias("e"),
        *[bits(k).alias(f"m{k}") for k in range(LACKS)],
    )


def _near_enough(a: str, b: str, percent: int) -> Column:
    """What two neighbours of one hub can have in common: its shingles that neither lacks, and shared ones it does not have.
    Bits that fall together only make the bound wider."""
    lacked = sum((F.bit_count(F.col(f"{a}.m{k}").bitwiseOR(F.col(f"{b}.m{k}"))) for k in range(LACKS)), F.lit(0))
    most = F.col(f"{a}.size") - lacked + F.least(F.col(f"{a}.e"), F.col(f"{b}.e"))
    return (F.col(f"{a}.hub") != F.col(f"{b}.hub")) | ((100 + percent) * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def _verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose Jaccard similarity reaches the threshold."""
    sets = classes.select("id", "n", "tokens")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb")), "b"
    )
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where((100 + percent) * common >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _links(classes: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between classes that give the same components as all links do, and the stored tables they are read from."""
    lists = stored(_prefixes(classes, percent))
    hub = lists.groupBy("token").agg(
        F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), "id", "n", "s")).alias("h")
    ).select("token", "h.own", "h.id", "h.n", "h.s")
    star = (
        lists.alias("x")
        .join(hub.alias("h"), (F.col("x.token") == F.col("h.token")) & (F.col("x.id") != F.col("h.id")) & _may_link("x", "h", percent))
        .select(F.least("x.id", "h.id").alias("a"), F.greatest("x.id", "h.id").alias("b"))
        .distinct()
    )
    first = stored(_verified(star, classes, percent))
    groups = components(first).select(F.col("node").alias("id"), "component")
    named = lists.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("token").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        # What most members of a group of copies belong to; its members need no pairs among themselves.
        F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), "id", "component"))["component"].alias("major"),
    ).where("low <> high").select("token", "major")
    rest = named.join(mixed, "token")
    rest = stored(rest.join(_differences(rest, hub, classes), "id"))
    x, y = rest.where("component <> major").alias("x"), rest.alias("y")
    across = (
        x.join(
            y,
            (F.col("x.token") == F.col("y.token"))
            & (F.col("x.component") != F.col("y.component"))
            & ((F.col("y.component") == F.col("y.major")) | (F.col("x.id") < F.col("y.id")))
            & _may_link("x", "y", percent)
            & _among_first("x", "y", percent)
            & _near_enough("x", "y", percent),
        )
        .groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .agg(F.count(F.lit(1)).alias("matches"), F.min(F.least("x.l", "y.l")).alias("l"))
        .where("matches >= l")
        .select("a", "b")
    )
    return first.unionByName(_verified(across, classes, percent)), [lists, first, rest, groups]


def ngram_join(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, any others) -> one row a row: doc_id, n_shingles, component_id (its group's smallest id)."""
    return _joined(docs, ngram, percent)[0]


def _joined(docs: DataFrame, ngram: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """As ngram_join(), and the stored tables that the result is read from."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    screened = stored(_screen(docs, ngram, percent))
    n, low = F.col("n"), least_overlap(F.col("n"), percent)
    emitted = F.least(n, n - low + F.greatest(F.lit(1), F.floor(n / 10)))
    enough = (emitted - F.col("u") >= F.greatest(F.lit(1), F.floor(low / 10))) & (n > 0)
    screened = screened.withColumn("active", (F.col("rows") > 1) | enough)
    rows = stored(
        _sets(semi(docs, screened.where("active").select("doc"), "doc"), ngram).withColumn("row", F.monotonically_increasing_id())
    )
    keys = stored(
        rows.where("n > 0").groupBy("key").agg(F.min(F.struct("doc", "row")).alias("r")).select("key", F.col("r.doc").alias("first"), F.col("r.row").alias("id"))
    )
    # Read from the one table of sets each time: a second copy of it would take more disk than the reading costs.
    classes = semi(rows.select(F.col("row").alias("id"), "n", "tokens"), keys.select("id"), "id")
    links, used = _links(classes, percent)
    groups = components(links).select(F.col("node").alias("id"), "component")
    discard(*used)
    named = keys.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("key", "component_id")
    found = (
        rows.select("doc", "n", "key")
        .join(named, "key", "left")
        .select("doc", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    )
    alone = screened.where("NOT active").select("doc", F.col("n").cast("long").alias("n"), F.col("doc").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = found.unionByName(alone).select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"))
    return out, [screened, rows, keys, groups]


def keep_first(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Rows of a repeated id stay or go together, equal texts among them once; rows without an id always stay.
    """
    joined, used = _joined(docs, ngram, percent)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = stored(joined.groupBy("doc_id").agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("rows")))
    discard(*used)
    kept = semi(docs, ids.where("NOT first").select("doc_id"), "doc_id", "left_anti")
    repeated = ids.where("first AND rows > 1 AND doc_id IS NOT NULL").select("doc_id")
    once = semi(kept, repeated, "doc_id").withColumn("__key", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "__key"]).drop("__key")
    return semi(kept, repeated, "doc_id", "left_anti").unionByName(once)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 180 * c >= 80 * (x.n + y.n)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = w.doc_id
"""
QUERIES = {"op7_ngram_join": op7_ngram_join}
ORACLES = {"op7_ngram_join": OP7_SQL}
