"""Hard negatives by inner product: length buckets, sorted coordinate lists, and feasible ranges of focus coordinates.

An anchor's request asks for the k best rows of its own label, or of other labels, whose score lies in [low, high]. Requests
meet all rows in blocks of bounded size: one task has one block of anchors and one slice of rows. There the slice is cut into
buckets of like length, longest first, and each request keeps the least score that still counts: low, or the k-th best so far.

* Bucket: if the product of the lengths cannot reach that score, the anchor is done with the slice.
* Coordinates: the least cosine within the bucket, and the angle between the anchor and an axis, bound what a partner can
  have on that axis. For the anchor's focus coordinates (its largest ones) these ranges are looked up in the bucket's sorted
  lists, and the candidates are what all of them have in common. An anchor whose narrowest range still holds most of the
  bucket is verified against all of it.
* Verification: whole-number products, exact: in the narrowest floating type that holds every sum without rounding.

Then a request's bests of all slices are merged. Buckets, ranges and blocks decide the work, never the result.

Defined results: a row takes no part if its label or vector is null, a component is null or not finite, or its squared length
does not fit in a long (its scores might not). Rows meet rows of their own dimension only. Null ids come last among equal
scores, then rows in the order they were stored in; rows of one id are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formledger.llm.common import scratch, stored, table

SCALE = 256
#: Components in a slice of rows and in a block of anchors, and rows in a bucket of like length.
SLICE_CELLS, BLOCK_CELLS, BUCKET_ROWS = 1 << 20, 1 << 20, 8192
#: A bucket ends where lengths fall below this share of its longest.
BUCKET_RATIO = 0.9
FOCUS = 5
#: Anchors that are verified together against a whole bucket.
TOGETHER = 256
NO_ID = (1 << 63) - 1
_LIMIT = float(1 << 62)


def scaled_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """rows (vec_id, label, embedding, any others) -> id, label, dim, length, v: whole numbers, as bytes of 2 or 8 each."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken)
    named = usable.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("e")
            ends = lists.offsets.to_numpy()
            flat = np.floor(lists.values.to_numpy(zero_copy_only=False) * float(scale))
            out = []
            for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                x = flat[a:b]
                squares = float(np.dot(x, x))
                if squares < _LIMIT:
                    small = np.abs(x).max(initial=0) < 1 << 15
                    out.append((i, b - a, np.sqrt(squares), x.astype("<i2" if small else "<i8").tobytes()))
            at, dim, length, v = zip(*out, strict=True) if out else ((), (), (), ())
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("label"), pa.array(dim, pa.int32()), pa.array(length, pa.float64()), pa.array(v, pa.binary())], ["id", "label", "dim", "length", "v"]
            )

    return named.mapInArrow(emit, "id long, label long, dim int, length double, v binary")


def matrix(values: list[bytes], dim: int) -> np.ndarray:
    """The vectors of scaled_vectors, one a row."""
    if dim == 0:
        return np.zeros((len(values), 0), np.int64)
    if all(len(x) == 2 * dim for x in values):
        return np.frombuffer(b"".join(values), "<i2").reshape(-1, dim).astype(np.int64)
    return np.stack([np.frombuffer(x, f"<i{len(x) // dim}").astype(np.int64) for x in values])


def exact_type(bound: float):
    """A floating type in which sums of products of vectors whose lengths multiply to the bound are never rounded."""
    return np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else np.longdouble


class Bucket:
    """Rows of like length: their vectors, and for each coordinate asked for the sorted list of its values over the length."""

    def __init__(self, vectors: np.ndarray, length: np.ndarray, at: np.ndarray):
        self.vectors, self.at, self.longest = vectors, at, float(length.max())
        self.unit = vectors / np.maximum(length, 1e-300)[:, None]
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._lists[f] = (order, self.unit[order, f])
        return self._lists[f]


def buckets(vectors: np.ndarray, length: np.ndarray) -> Iterator[Bucket]:
    order = np.argsort(-length, kind="stable")
    begin = 0
    while begin < len(order):
        tail = length[order[begin : begin + BUCKET_ROWS]]
        end = begin + max(1, int(np.searchsorted(-tail, -BUCKET_RATIO * tail[0], side="right")))
        at = order[begin:end]
        yield Bucket(vectors[at], length[at], at)
        begin = end


def feasible(axis: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of a coordinate of unit vectors whose cosine with an anchor is at least so much; axis: the anchor's own one."""
    phi, alpha = np.arccos(np.clip(axis, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    low = np.where(phi + alpha >= np.pi, -1.0, np.cos(np.minimum(np.pi, phi + alpha)))
    high = np.where(phi <= alpha, 1.0, np.cos(np.maximum(0.0, phi - alpha)))
    return low - 1e-6, high + 1e-6


class Best:
    """The best rows of each request so far."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.least = k, low.astype(np.longdouble)
        self.request, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, request: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        request, score = np.concatenate((self.request, request)), np.concatenate((self.score, score))
        ids, row = np.concatenate((self.id, ids)), np.concatenate((self.row, row))
        order = np.lexsort((row, ids, -score, request))
        request = request[order]
        place = np.arange(len(request)) - np.searchsorted(request, request)
        kept = order[place < self.k]
        self.request, self.score, self.id, self.row = request[place < self.k], score[kept], ids[kept], row[kept]
        full = place == self.k - 1
        self.least[request[full]] = np.maximum(self.least[request[full]], score[order[full]])


def search(anchors: dict, requests: dict, rows: dict, k: int, same: bool) -> Best:
    """anchors: vectors, length, label, row; requests: anchor (a place in these, ascending), low, high; rows: vectors, length,
    label, row, id. same: rows of the anchor's label are sought, else of others; never the anchor itself."""
    best = Best(requests["low"], k)
    if not len(requests["anchor"]) or not len(rows["length"]):
        return best
    kind = exact_type(float(anchors["length"].max()) * float(rows["length"].max()))
    q, of, high = anchors["vectors"].astype(kind), requests["anchor"], requests["high"].astype(np.longdouble)
    unit = anchors["vectors"] / np.maximum(anchors["length"], 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
    first = np.searchsorted(of, np.arange(len(q) + 1))

    def verify(some: np.ndarray, bucket: Bucket, among: np.ndarray | None) -> None:
        at = bucket.at if among is None else bucket.at[among]
        scores = q[some] @ (bucket.vectors if among is None else bucket.vectors[among]).astype(kind).T
        fit = (anchors["label"][some][:, None] == rows["label"][at]) == same
        if same:
            fit &= anchors["row"][some][:, None] != rows["row"][at]
        found = []
        for nth in range(int(np.diff(first).max())):
            has = first[some] + nth < first[some + 1]
            mine = (first[some] + nth)[has]
            if not len(mine):
                break
            s = np.where(fit[has], scores[has], -np.inf)
            s[s > high[mine][:, None]] = -np.inf
            least = best.least[mine]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            found.append((mine[i], s[i, j].astype(np.int64), at[j]))
        if found:
            request, score, at = (np.concatenate(x) for x in zip(*found, strict=True))
            best.add(request, score, rows["id"][at], rows["row"][at])

    for bucket in buckets(rows["vectors"], rows["length"]):
        reach = anchors["length"] * bucket.longest
        need = np.minimum.reduceat(best.least, first[:-1]).astype(float)
        live = np.flatnonzero(need <= reach * (1 + 1e-9))
        if not len(live):
            break
        cosine = np.clip(np.where(np.isfinite(need[live]), need[live] / np.maximum(reach[live], 1e-300), -1.0), -1.0, 1.0)
        # The ranges of each live anchor's focus coordinates, as places in the bucket's sorted lists.
        n = len(bucket.at)
        begin, end = np.zeros((len(live), focus.shape[1]), np.int64), np.full((len(live), focus.shape[1]), n)
        for f in np.unique(focus[live]):
            x, nth = np.nonzero(focus[live] == f)
            low, up = feasible(unit[live[x], f], cosine[x])
            values = bucket.coordinate(int(f))[1]
            begin[x, nth], end[x, nth] = np.searchsorted(values, low, side="left"), np.searchsorted(values, up, side="right")
        width = end - begin
        narrow = width.min(axis=1, initial=n)
        whole = live[2 * narrow > n]
        for at in range(0, len(whole), TOGETHER):
            verify(whole[at : at + TOGETHER], bucket, None)
        for x in np.flatnonzero((2 * narrow <= n) & (narrow > 0)):
            among = None
            for nth in np.argsort(width[x], kind="stable"):
                order, values = bucket.coordinate(int(focus[live[x], nth]))
                if among is None:
                    among = order[begin[x, nth] : end[x, nth]]
                elif len(among):
                    own = bucket.unit[among, focus[live[x], nth]]
                    among = among[(own >= values[begin[x, nth]]) & (own <= values[end[x, nth] - 1])] if width[x, nth] else among[:0]
            if len(among):
                verify(live[x : x + 1], bucket, among)
    return best


def _arrays(part: pd.DataFrame, dim: int) -> dict:
    return {"vectors": matrix(part["v"].tolist(), dim), **{c: part[c].to_numpy() for c in ("length", "label", "row") if c in part}}


def _sized(rows: DataFrame, by: list[str], cells: int, name: str) -> DataFrame:
    """rows with the number of parts (name) that their group's components make."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.first("dim"), F.lit(1)) / cells).cast("int").alias(name))
    return rows.join(sizes, by)


def _dealt(n: Column) -> Column:
    return F.pmod(F.xxhash64("row"), n).cast("int")


def best_of(requests: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """requests (anchor row: row, label, dim, length, v; asks: an array of (low, high)) against rows (row, id, label, dim, length, v) ->
    row, nth (of the asks), score, id, other: the k best of each, in no order. Everything meets in blocks of bounded size."""
    # Rows of one label stand together where that label is sought; small labels share a group.
    group = F.pmod(F.xxhash64("label"), F.lit(64)).cast("int") if same else F.lit(0)
    by = ["dim", "group"]
    # Slices are runs of length classes, so that short rows are never sent to anchors they cannot reach.
    classes = F.when(F.col("length") > 0, F.floor(F.log("length") / F.lit(-np.log(BUCKET_RATIO)))).otherwise(F.lit(-1)).cast("int")
    sliced = _sized(rows.withColumns({"group": group, "class": classes}), [*by, "class"], SLICE_CELLS, "slices").withColumn("slice", _dealt(F.col("slices")))
    reach = sliced.groupBy(*by, "class", "slice").agg(F.max("length").alias("longest"))
    blocks = _sized(requests.withColumn("group", group), by, BLOCK_CELLS, "blocks").withColumn("block", _dealt(F.col("blocks")))
    need = F.array_min(F.transform("asks", lambda x: x["low"]))
    cell = [*by, "class", "slice", "block"]
    asked = blocks.join(reach, by).where(need.isNull() | (need <= F.col("length") * F.col("longest") * (1 + 1e-9)))
    # A slice goes to the blocks that have a live anchor for it.
    pairs = asked.select(*cell).distinct()
    sent = sliced.drop("slices").join(pairs, [*by, "class", "slice"])

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("row", "nth", "score", "id", "other")})
        dim = int(left["dim"].iat[0])
        anchors, found = _arrays(left, dim), _arrays(right, dim) | {"id": right["id"].to_numpy()}
        counts = np.array([len(x) for x in left["asks"]])
        of = np.repeat(np.arange(len(left)), counts)
        each = [x for asks in left["asks"] for x in asks]
        bound = lambda name, none: np.array([none if x[name] is None else np.longdouble(x[name]) for x in each], np.longdouble)
        best = search(anchors, {"anchor": of, "low": bound("low", -np.inf), "high": bound("high", np.inf)}, found, k, same)
        nth = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
        return pd.DataFrame({"row": anchors["row"][of[best.request]], "nth": nth[best.request], "score": best.score, "id": best.id, "other": best.row})

    columns = [*cell, "row", "label", "length", "v"]
    named = lambda df, *more: df.select(*columns, *more).toDF(*columns, *more)
    met = named(asked, "asks").groupBy(*cell).cogroup(named(sent, "id").groupBy(*cell)).applyInPandas(one, "row long, nth int, score long, id long, other long")
    order = W.partitionBy("row", "nth").orderBy(F.desc("score"), "id", "other")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows (vec_id, label, embedding), anchors: which of them are (on id) -> anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each anchor and each of its best rows of its label, the best rows of other labels whose score is
    low to high hundredths of the positive's."""
    with scratch(rows.sparkSession) as keep:
        base = stored(scaled_vectors(rows).withColumn("row", F.monotonically_increasing_id()))
        chosen = base.where(F.col("id") != NO_ID).where(anchors)
        ask = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
        any_ = F.array(ask(F.lit(None), F.lit(None)))
        found = stored(best_of(chosen.withColumn("asks", any_), base, positives, True).select("row", "place", F.col("id").alias("positive"), F.col("score").alias("positive_score")))
        # low * p <= 100 n <= high * p, in whole numbers that a long holds.
        p = F.col("positive_score").cast("decimal(25,0)")
        asks = F.array_sort(F.collect_list(F.struct("place", ask(F.ceil(p * low / 100), F.floor(p * high / 100)).alias("ask"))))
        wanted = found.where(F.lit(low) * p <= F.lit(high) * p).groupBy("row").agg(asks.alias("a"))
        wanted = wanted.select("row", F.transform("a", lambda x: x["ask"]).alias("asks"), F.transform("a", lambda x: x["place"]).alias("places"))
        mined = best_of(chosen.join(wanted.select("row", "asks"), "row"), base, negatives, False)
        mined = mined.join(wanted.select("row", "places"), "row").withColumn("positive_place", F.element_at("places", F.col("nth") + 1))
        named = mined.alias("m").join(found.alias("f"), (F.col("m.row") == F.col("f.row")) & (F.col("m.positive_place") == F.col("f.place"))).join(
            chosen.select(F.col("row").alias("r"), F.col("id").alias("anchor_id")), F.col("m.row") == F.col("r")
        )
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
        return keep(named.select("anchor_id", real("positive").alias("positive_id"), F.col("m.place").cast("int").alias("rank"), real("m.id").alias("negative_id"), "positive_score", F.col("m.score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST, n.b)
QUALIFY row_number() OVER w <= 3
"""
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": OP11_SQL}
