"""Fill-in-middle examples: each text is cut at two ranks of its units and laid out anew around sentinels.

The units of a text (lines, or single code points) are the nodes of an indexable skip list: lane 0 links each node to the
next, higher lanes skip ever more of them, and each link carries its widths in units, code points and bytes. A descent
adds up widths lane by lane and arrives at a cut rank exactly, with the code points and bytes before it; a text is never
rescanned for a cut. The coin that promotes a node is a hash of its number, so reruns agree.

Texts are dealt by Spark and each row is independent: no shuffle, and a task holds a few megabytes of text, or one text.

Defined results: a null or empty text has no units and is laid out plain, as is one that contains a sentinel; a null id
draws as the empty string; repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "character")
#: Of four nodes of a lane, about one is in the next lane too.
PROMOTE_BITS = 2
SLICE_BYTES = 4 << 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """An indexable skip list over units of the given widths in code points and bytes."""

    def __init__(self, chars: np.ndarray, size: np.ndarray):
        self.n = len(chars)
        #: From lane 0 up: of each node's link the widths (units, code points, bytes), and the node's place in the lane below.
        self.lanes: list[tuple[list[tuple[int, int, int]], list[int]]] = []
        nodes, below = np.arange(self.n), np.arange(self.n)
        height = _heights(self.n)
        while len(nodes):
            widths = np.stack((np.diff(np.append(nodes, self.n)), np.add.reduceat(chars, nodes), np.add.reduceat(size, nodes)), 1)
            self.lanes.append((widths.tolist(), below.tolist()))
            up = height[nodes] > len(self.lanes) - 1
            up[0] = True  # the head stands in every lane
            if up.sum() <= 1:
                break
            nodes, below = nodes[up], np.flatnonzero(up)

    def before(self, rank: int) -> tuple[int, int]:
        """The code points and bytes of the units before a rank (0 to n)."""
        units = chars = size = at = 0
        for links, below in reversed(self.lanes):
            while at < len(links) and units + links[at][0] <= rank:
                u, c, b = links[at]
                units, chars, size, at = units + u, chars + c, size + b, at + 1
            if units == rank:
                break
            at = below[at]
        return chars, size


def _heights(n: int) -> np.ndarray:
    """The lanes above lane 0 that each node stands in: geometric, by a hash of its number."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    lowest = x & (~x + np.uint64(1))  # the lowest set bit
    return np.log2(np.maximum(lowest, np.uint64(1)).astype(float)).astype(int) // PROMOTE_BITS


def unit_widths(text: bytes, unit: str = "line") -> tuple[np.ndarray, np.ndarray]:
    """Code points and bytes of each unit of a UTF-8 text. A line ends with its line feed."""
    raw = np.frombuffer(text, np.uint8)
    lead = (raw & 0xC0) != 0x80
    if unit == "character":
        size = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        return np.ones(len(size), np.int64), size
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    return (np.add.reduceat(lead.astype(np.int64), starts) if len(ends) else ends), ends - starts


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit draws of a document: the first groups of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, unit: str = "line") -> DataFrame:
    """docs (doc_id, text, any others) -> doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    rate: of a hundred texts, how many are rearranged; spm_rate: of these, how many with the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def one(text: bytes, a: int, b: int, c: int, d: int) -> tuple[int, str, int | None, int | None, bytes]:
        chars, size = unit_widths(text, unit)
        n = len(chars)
        if not text or c % 100 >= rate or any(x in text for x in marks):
            return n, "plain", None, None, text
        units = SkipList(chars, size)
        (c0, b0), (c1, b1) = (units.before(rank) for rank in sorted((a % (n + 1), b % (n + 1))))
        before, middle, after = text[:b0], text[b0:b1], text[b1:]
        if d % 100 < spm_rate:
            return n, "spm", c0, c1 - c0, b"".join((s, after, p, before, m, middle))
        return n, "psm", c0, c1 - c0, b"".join((p, before, s, after, m, middle))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            texts = part.column("text").cast(pa.binary()).to_pylist()
            drawn = zip(*(part.column(f"h{i}").to_pylist() for i in range(4)), strict=True)
            rows = [one(t or b"", *h) for t, h in zip(texts, drawn, strict=True)]
            n, form, before, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *drawn).mapInArrow(emit, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone. A text with a sentinel is never rearranged, so each stands once."""

    def between(a: str, b: str | None) -> Column:
        rest = F.substr(output, F.instr(output, F.lit(a)) + F.lit(len(a)))
        return rest if b is None else F.substr(rest, F.lit(1), F.instr(rest, F.lit(b)) - F.lit(1))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), r AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS y, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": OP12_SQL}
