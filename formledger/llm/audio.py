"""Chroma audio fingerprints, and alignment of recordings by offset histograms and bit errors.

A recording (PCM samples) is cut into overlapping frames; each frame's spectrum is folded onto twelve pitch classes. Over
the frame-by-class image an integral image is kept, so that each of 16 rectangle filters (contrasts in time, in pitch, or
both, in sizes given by a rule) costs four look-ups a frame; a filter's value is quantised to two bits with Gray coding,
16 filters pack into one 32-bit integer a frame.

Search: recordings with equal fingerprints are one class. For every query class, integers shared with another class vote
for an offset (query frame minus frame); every offset with MIN_VOTES or more is verified by the share of differing bits over
the overlap, and the best one of a pair counts. A run of one integer (silence, a held note) votes once, where it begins.
Only classes of queries meet all classes, never all with all. An integer that very many recordings hold is dealt over
several tasks by recording, and the queries that hold it go to each of them.

Defined results: null or short recordings have no integers and match nothing; repeated rows fall into one class; ties of
errors go to more votes, then to the smallest offset; an empty table gives no pairs; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import durable, table

RATE, FRAME, HOP = 4000, 1024, 256
LOWEST, HIGHEST = 100.0, 1600.0
MIN_VOTES, MAX_ERROR, MIN_OVERLAP = 6, 0.2, 24
#: Places of one integer that one task may hold.
HOT_PLACES = 50_000


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) by turns: contrasts in time, in pitch, and crosswise, on growing rectangles."""
    return [(k % 3, (5 * k) % 12, 2 + k % 5, 4 + 2 * (k % 6)) for k in range(16)]


FILTERS = _filters()


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12): energy by pitch class, each frame scaled to length 1, smoothed over five frames."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (freq >= LOWEST) & (freq <= HIGHEST)
    classes = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12
    out = power[:, use] @ np.eye(12)[classes]
    total = np.vstack((np.zeros((1, 12)), np.cumsum(out, axis=0)))
    at = np.arange(len(out))
    low, high = np.maximum(at - 2, 0), np.minimum(at + 3, len(out))
    out = (total[high] - total[low]) / (high - low)[:, None]
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One unsigned 32-bit integer a frame from the filters' widest window on."""
    image = chroma(samples, rate)
    widest = max(f[3] for f in FILTERS)
    n = len(image) - widest + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = np.hstack((image, image))  # pitch classes run round
    integral = np.zeros((len(wide) + 1, 25))
    integral[1:, 1:] = wide.cumsum(0).cumsum(1)
    t = np.arange(n)
    area = lambda a, b, c, d: integral[t + b, d] - integral[t + a, d] - integral[t + b, c] + integral[t + a, c]
    out = np.zeros(n, np.uint32)
    for kind, first, classes, frames in FILTERS:
        half, mid = frames // 2, first + max(1, classes // 2)
        if kind == 0:
            plus, minus = area(0, half, first, first + classes), area(half, frames, first, first + classes)
        elif kind == 1:
            plus, minus = area(0, frames, first, mid), area(0, frames, mid, first + classes)
        else:
            plus = area(0, half, first, mid) + area(half, frames, mid, first + classes)
            minus = area(0, half, mid, first + classes) + area(half, frames, first, mid)
        value = np.log1p(np.maximum(plus, 0)) - np.log1p(np.maximum(minus, 0))
        level = np.digitize(value, (-0.25, 0.0, 0.25)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(recordings: DataFrame) -> DataFrame:
    """recordings (id, pcm: little-endian 16-bit samples) -> id, key, prints."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(np.frombuffer(p.as_py() or b"", "<i2")).view(np.int32) for p in batch.column("pcm")]
            keys = [hashlib.md5(f.tobytes()).digest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(keys, pa.binary()), pa.array([f.tolist() for f in found], pa.list_(pa.int32()))],
                ["id", "key", "prints"],
            )

    return recordings.select("id", "pcm").mapInArrow(emit, "id long, key binary, prints array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """(id, class_id): recordings with equal fingerprints, named after the smallest id; silence and scraps stay alone."""
    named = prints.where(F.size("prints") > 0).groupBy("key").agg(F.min("id").alias("class_id"))
    return prints.join(named, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def align(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """prints (class_id, prints) of distinct classes; queries (class_id). -> query, other, offset, votes, overlap, error."""
    turns = F.filter(F.transform("prints", lambda x, i: F.struct(i.alias("at"), x.alias("value"), F.try_element_at("prints", F.greatest(i, F.lit(1))).alias("last"))), lambda t: (t["at"] == 0) | (t["value"] != t["last"]))
    frames = prints.select("class_id", F.explode(turns).alias("t")).select("class_id", "t.at", "t.value")
    # A frequent integer's places, and its queries' places, are both dealt over parts, which meet as a grid: no part of the join is large.
    mine = frames.join(queries, "class_id")
    parts = lambda c, name: F.ceil(F.col(c) / HOT_PLACES).cast("int").alias(name)
    often = frames.groupBy("value").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > HOT_PLACES)
    hot = often.join(mine.groupBy("value").agg(F.count(F.lit(1)).alias("asked")), "value").select("value", parts("places", "parts"), parts("asked", "rounds"))
    dealt = lambda rows: rows.join(hot, "value", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "rounds")})
    every, own = (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))), (lambda n: F.pmod(F.xxhash64("class_id"), n).cast("int"))
    asked = dealt(mine).select(F.col("class_id").alias("query"), F.col("at").alias("q"), "value", every("parts").alias("part"), own("rounds").alias("round"))
    held = dealt(frames).select(F.col("class_id").alias("other"), "at", "value", own("parts").alias("part"), every("rounds").alias("round"))
    best = (
        asked.join(held, ["value", "part", "round"])
        .where("query <> other")
        .groupBy("query", "other", (F.col("q") - F.col("at")).alias("offset"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .where(F.col("votes") >= MIN_VOTES)
    )
    left = prints.select(F.col("class_id").alias("query"), F.col("prints").alias("x"))
    right = prints.select(F.col("class_id").alias("other"), F.col("prints").alias("y"))
    both = best.join(left, "query").join(right, "other")
    start = F.greatest(F.lit(0), F.col("offset"))
    overlap = F.least(F.size("x") - start, F.size("y") - F.greatest(F.lit(0), -F.col("offset")))
    cut_x = F.slice("x", start + 1, F.col("overlap"))
    cut_y = F.slice("y", F.greatest(F.lit(0), -F.col("offset")) + 1, F.col("overlap"))
    wrong = F.aggregate(F.zip_with(cut_x, cut_y, lambda a, b: F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda s, v: s + v)
    good = (
        both.withColumn("overlap", overlap)
        .where(F.col("overlap") >= MIN_OVERLAP)
        .withColumn("error", wrong / (F.col("overlap") * 32))
        .where(F.col("error") <= MAX_ERROR)
    )
    first = F.min(F.struct("error", (-F.col("votes")).alias("v"), "offset", "overlap")).alias("m")
    return good.groupBy("query", "other").agg(first).select(
        "query", "other", "m.offset", (-F.col("m.v")).alias("votes"), "m.overlap", F.round("m.error", 6).alias("error")
    )


def played(vectors: DataFrame) -> DataFrame:
    """A recording for each vector: its elements are notes of a twelve-tone scale, a tenth of a second each.

    Every fourth is recorded again under the id -1 - vec_id: later in the piece, softer and with noise.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = RATE // 10
        t = np.arange(step) / RATE
        tones = np.array([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) + 0.5 * np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in range(12)])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, ids, pcm = batch.slice(at, 256), [], []
                for i, v in zip(part.column("vec_id"), part.column("embedding"), strict=True):
                    number, x = i.as_py(), np.array([e or 0.0 for e in v.as_py() or ()], float)
                    sound = tones[np.floor(np.abs(x) * 100).astype(int) % 12].ravel() * 9000
                    ids.append(number)
                    pcm.append(sound.astype("<i2").tobytes())
                    if number is not None and number % 4 == 0:
                        later = sound[HOP * (number % 16) :]
                        noise = np.random.default_rng(number).normal(0, 150, len(later))
                        ids.append(-1 - number)
                        pcm.append((0.6 * later + noise).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pcm, pa.binary())], ["id", "pcm"])

    return vectors.select("vec_id", "embedding").mapInArrow(emit, "id long, pcm binary")


def op2_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its class, and the classes of queries that it aligns with."""
    prints = durable(fingerprints(played(table(spark, sf_dir, "embeddings"))))
    member = durable(classes(prints))
    single = prints.join(member.where("id = class_id").dropDuplicates(["id"]).select("id"), "id").select(F.col("id").alias("class_id"), "prints").dropDuplicates(["class_id"])
    single = durable(single)
    asked = member.where("id % 100 = 0").select("class_id").distinct()
    found = durable(align(single, asked))
    best = found.groupBy(F.col("other").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("error", "query", "offset")).alias("m")
    )
    return member.join(best, "class_id", "left").select(
        F.col("id").alias("vec_id"),
        "class_id",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
        F.col("m.query").alias("best_query"),
        F.col("m.offset").alias("best_offset"),
        F.col("m.error").alias("best_error"),
    )


QUERIES = {"op2_audio_alignment": op2_audio_alignment}
ORACLES: dict[str, str] = {}
