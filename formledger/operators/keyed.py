"""Tables on disk that grow by named batches: histories that are only appended to, and keyed tables with one row a key.

Rows are dealt to buckets by a hash of their key, batches are folders, and a folder counts once its ``_SUCCESS`` file is there: what a
broken write left is never read, and the same batch written again replaces it. The driver lists batch folders and the buckets asked
for, never files; compaction keeps the folders few. Batch names sort in the order in which they came.

* History: ``compact`` copies a run of batches into one folder that names their span; folders within a span that is there are not
  read any more, so a break before, in or after the copy changes nothing.
* KeyedTable: deltas beside a base, merged by key when read. ``fold`` writes a new base of the touched buckets only; of each
  bucket the newest base counts, with the deltas after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.sources.intermediate import delete

BUCKETS = 64
#: Batches, or spans of them, that are left standing before they are merged.
FAN = 32


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []


def complete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _batches(spark: SparkSession, path: str, kind: str = "batch") -> list[str]:
    """The complete batches in a folder, by name."""
    names = [n.partition("=")[2] for n in children(spark, path) if n.startswith(f"{kind}=")]
    return [n for n in names if complete(spark, f"{path}/{kind}={n}")]


def _span(name: str) -> tuple[str, str]:
    first, _, last = name.partition("~")
    return first, last or first


# --- histories


def live_batches(spark: SparkSession, path: str) -> list[str]:
    """The folders to read: complete, and not within the span of another."""
    spans = {n: _span(n) for n in _batches(spark, path)}
    within = lambda a, b: a != b and "~" in b and spans[b][0] <= spans[a][0] and spans[a][1] <= spans[b][1]
    return [n for n in spans if not any(within(n, other) for other in spans)]


def history_folders(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "record_key") -> list[str]:
    """The bucket folders to read, of all keys or of those in keys (key)."""
    found = [(f"{path}/batch={n}/{of}", int(of[3:])) for n in live_batches(spark, path) for of in children(spark, f"{path}/batch={n}") if of.startswith("of=")]
    wanted: dict[int, set[int]] | None = None
    if keys is not None:
        counts = sorted({n for _, n in found})
        wanted = {n: set() for n in counts}
        if counts:
            each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), bucket_of(F.col(key), n).alias("b")) for n in counts]))
            for r in keys.select(each.alias("x")).distinct().collect():  # as many rows as there are buckets, at most
                wanted[r["x"]["n"]].add(r["x"]["b"])
    return [f"{folder}/{b}" for folder, n in found for b in children(spark, folder) if b.startswith("bucket=") and (wanted is None or int(b[7:]) in wanted[n])]


def _written(rows: DataFrame, path: str, buckets: int, key: Column) -> None:
    dealt = rows.withColumns({"of": F.lit(buckets), "bucket": bucket_of(key, buckets)})
    dealt.repartition("bucket").write.mode("overwrite").partitionBy("of", "bucket").parquet(path)


def append(rows: DataFrame, path: str, batch: str, buckets: int = BUCKETS, key: str = "record_key") -> None:
    """Adds a batch by name, or replaces it as a whole. A batch that a compaction has taken up stands as it is."""
    if "~" in batch:
        raise ValueError("~ parts the names of a span of batches")
    if any("~" in n and _span(n)[0] <= batch <= _span(n)[1] for n in _batches(rows.sparkSession, path)):
        raise ValueError(f"batch {batch} is part of a compacted span")
    _written(rows, f"{path}/batch={batch}", buckets, F.col(key))


def compact(spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS, key: str = "record_key", fan: int = FAN) -> str | None:
    """Copies the oldest ``fan`` batches, or spans of batches, into one span, if so many stand besides the newest batch, which a stream
    may write again; then deletes them. Returns the span's name. Spans are merged once ``fan`` of them stand, so a row is copied as
    often as the logarithm of the number of batches."""
    live = live_batches(spark, path)
    # What an earlier compaction could not delete goes first.
    for name in sorted(set(_batches(spark, path)) - set(live)):
        delete(spark, f"{path}/batch={name}")
    spans, single = [n for n in live if "~" in n], [n for n in live if "~" not in n][:-1]
    some = spans[:fan] if len(spans) >= fan else single[:fan] if len(single) >= fan else []
    if not some:
        return None
    name = f"{_span(some[0])[0]}~{_span(some[-1])[1]}"
    folders = [f"{path}/batch={n}" for n in some]
    rows = spark.read.schema(f"{schema}, of int, bucket int").option("basePath", path).parquet(*folders).drop("of", "bucket")
    _written(rows, f"{path}/batch={name}", buckets, F.col(key))
    for folder in folders:
        delete(spark, folder)
    return name


# --- tables with one row a key


class KeyedTable:
    """A table with one row a key, as a base and deltas. merge: rows of the schema with ``__order`` (by the batch they came in; less
    for a base) -> one row a key; merging what was merged before must change nothing.

    spread: what a row's bucket goes by, the key if it is not given; rows of one key must fall into one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS, spread: Column | None = None):
        self.spark, self.path, self.schema, self.key, self.merge, self.buckets = spark, path, schema, key, merge, buckets
        self.spread = F.col(f"`{key}`") if spread is None else spread
        self.columns = spark.createDataFrame([], schema).columns

    def add(self, rows: DataFrame, batch: str) -> None:
        """One more delta, under its batch's name: written again, it replaces what a broken attempt left. A batch that is in the base already
        changes nothing."""
        if any(batch <= n for n in _batches(self.spark, self.path, "base")):
            return
        self._write(rows.select(*[F.col(f"`{c}`") for c in self.columns]), f"{self.path}/delta={batch}")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.withColumn("__bucket", bucket_of(self.spread, self.buckets)).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(path)

    def _folders(self, wanted: set[int] | None, before: str | None = None, upto: str | None = None) -> dict[int, list[tuple[str, str]]]:
        """Bucket -> (kind, batch) of what holds its rows: its newest base, and the deltas after that."""
        out: dict[int, list[tuple[str, str]]] = {}
        for kind in ("base", "delta"):
            for batch in _batches(self.spark, self.path, kind):
                if (before is not None and batch >= before) or (kind == "delta" and upto is not None and batch > upto):
                    continue
                for name in children(self.spark, f"{self.path}/{kind}={batch}"):
                    bucket = int(name.partition("=")[2]) if name.startswith("__bucket=") else None
                    if bucket is None or (wanted is not None and bucket not in wanted):
                        continue
                    held = out.setdefault(bucket, [])
                    if kind == "base":
                        out[bucket] = [(kind, batch)]  # they come by name: the newest stays
                    elif not held or held[0][0] == "delta" or batch > held[0][1]:
                        held.append((kind, batch))
        return out

    def _rows(self, folders: dict[int, list[tuple[str, str]]]) -> DataFrame:
        out = None
        for kind in ("base", "delta"):
            paths = [f"{self.path}/{k}={batch}/__bucket={bucket}" for bucket, held in folders.items() for k, batch in held if k == kind]
            if paths:
                rows = self.spark.read.schema(f"{self.schema}, {kind} string, __bucket int").option("basePath", self.path).parquet(*paths)
                order = F.concat(F.lit("1"), F.col("delta")) if kind == "delta" else F.lit("0")
                rows = rows.select(*[F.col(f"`{c}`") for c in self.columns], order.alias("__order"))
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{self.schema}, __order string") if out is None else out

    def read(self, keys: DataFrame | None = None, before: str | None = None) -> DataFrame:
        """The table as it stands, or stood before a batch that is not in a base yet; with keys (the key's column), only their rows."""
        wanted = None
        if keys is not None:
            # As many rows as there are buckets, at most.
            wanted = {r[0] for r in keys.select(bucket_of(F.col(f"`{self.key}`"), self.buckets)).distinct().collect()}
        rows = self._rows(self._folders(wanted, before))
        if keys is not None:
            rows = rows.join(keys.select(F.col(f"`{self.key}`")).distinct(), self.key, "left_semi")
        return self.merge(rows).select(*[F.col(f"`{c}`") for c in self.columns])

    def fold(self, fan: int = FAN) -> list[int]:
        """If ``fan`` deltas stand besides the newest, a new base of the buckets that they touch; returns these. Other buckets keep theirs."""
        deltas = _batches(self.spark, self.path, "delta")
        bases = _batches(self.spark, self.path, "base")
        ripe = [n for n in deltas[:-1] if not bases or n > bases[-1]]
        done: list[int] = []
        if len(ripe) >= fan:
            upto = ripe[-1]
            folders = self._folders(None, upto=upto)
            done = sorted(b for b, held in folders.items() if any(kind == "delta" for kind, _ in held))
            merged = self.merge(self._rows({b: folders[b] for b in done}))
            self._write(merged.select(*[F.col(f"`{c}`") for c in self.columns]), f"{self.path}/base={upto}")
            bases.append(upto)
        self._clear(bases, deltas)
        return done

    def _clear(self, bases: list[str], deltas: list[str]) -> None:
        """Deletes the deltas that the newest base took up, and bases of buckets that have a newer one."""
        for n in deltas:
            if bases and n <= bases[-1]:
                delete(self.spark, f"{self.path}/delta={n}")
        newer: set[str] = set()
        for batch in reversed(bases):
            held = {n for n in children(self.spark, f"{self.path}/base={batch}") if n.startswith("__bucket=")}
            for name in held & newer:
                delete(self.spark, f"{self.path}/base={batch}/{name}")
            if held and held <= newer and batch != bases[-1]:
                delete(self.spark, f"{self.path}/base={batch}")
            newer |= held

