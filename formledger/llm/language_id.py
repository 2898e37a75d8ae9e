"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters of the whole text, lower-cased, other characters a single blank; n-grams of 1 to 3 characters, hashed to
FEATURES columns; log-damped counts times inverse document frequencies, scaled to length 1. Document frequencies are
counted over all labelled training documents, in one pass that sums fixed-size vectors.

Training: follow the regularised leader with per-coordinate rates and an elastic net (L1 keeps the weights sparse), on a
bounded sample: an expected SAMPLE training rows, picked by a hash of the row below a threshold of each language's own, so that all
languages have alike many, or all that there are, whatever the table's size. It is dealt to SHARDS tasks; after
each of EPOCHS passes the shards' states are averaged. A temperature is then fitted on sampled documents that training
did not see.

Prediction reads the text alone. A text that is null or has no letter is ``und`` with score 0.

Defined results: rows without a language or text teach nothing; with no labelled row at all everything is ``und``;
repeated rows are scored alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import fold, table

FEATURES, ORDERS = 1 << 15, (1, 2, 3)
SAMPLE, SHARDS, EPOCHS = 6000, 4, 2
#: The languages that are learned, the most frequent ones: the driver holds a weight a feature for each.
CLASSES = 200
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Code point -> lower-case code point for letters, 32 for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def grams(text: str) -> np.ndarray | None:
    """The hashed n-grams of a text's letters, blanks once; None if it has no letter."""
    if not _FOLD:
        _FOLD.append(_letters())
    points = np.append(_FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], np.uint32(32))
    blank = points == 32
    if blank.all():
        return None
    keep = ~(blank & np.concatenate(([True], blank[:-1])))
    points = points[keep]
    out, h = [], np.zeros(len(points), np.uint32)
    for n in ORDERS:
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
        mixed = h ^ (h >> np.uint32(15))
        out.append((mixed * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(17))
    return np.concatenate(out)


def features(text: str | None, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and their weights; None for a text without letters."""
    found = grams(text) if text else None
    if found is None:
        return None
    counts = np.bincount(found, minlength=FEATURES)
    at = np.flatnonzero(counts)
    x = 1 + np.log(counts[at])
    if idf is not None:
        x = x * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Of the texts in docs: how many have letters, and in how many each column occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                text = t.as_py()
                found = grams(text) if text else None
                if found is not None:
                    n += 1
                    df += np.bincount(found, minlength=FEATURES) > 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, FEATURES)), pa.array(np.append(n, df))], ["at", "df"])

    sums = docs.select("text").mapInArrow(count, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(FEATURES + 1, np.int64)  # FEATURES + 1 numbers, whatever the input
    for row in sums:
        out[row["at"] + 1] = row["df"]
    return int(out[0]), out[1:]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over (columns, values, class) rows; z and n: (classes, FEATURES + 1), the last column a bias."""
    for at, x, label in rows:
        at, x = np.append(at, FEATURES), np.append(x, 1.0)
        w = _weights(z[:, at], n[:, at])
        p = _softmax(w @ x)
        p[label] -= 1.0
        g = p[:, None] * x
        sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / ALPHA
        z[:, at] += g - sigma * w
        n[:, at] += g * g
    return z, n


class Model:
    """What prediction needs: the class names, idf, sparse weights and the temperature; a few hundred KB."""

    def __init__(self, classes: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.classes, self.idf, self.weights, self.temperature = classes, idf, weights.astype(np.float32), temperature

    def scores(self, text: str | None) -> np.ndarray | None:
        found = features(text, self.idf)
        if found is None or not self.classes:
            return None
        at, x = found
        return self.weights[:, at] @ x + self.weights[:, FEATURES]

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.scores(text)
        if s is None:
            return UNKNOWN, 0.0
        p = _softmax(s / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """How many rows of each language are expected in a sample: alike many, all of those with fewer."""
    out, left = {}, sample
    for i, c in enumerate(sorted(sizes, key=lambda c: (sizes[c], c))):
        out[c] = min(sizes[c], -(-left // (len(sizes) - i)))
        left = max(0, left - out[c])
    return out


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> Model:
    """docs (doc_id, text, lang): the rows that may teach."""
    docs = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull())
    spark = docs.sparkSession
    total, df = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    sizes = {r[0]: r[1] for r in docs.groupBy(label).count().orderBy(F.desc("count"), label).limit(CLASSES).collect()}
    docs = docs.where(F.col(label).isin(*sizes)) if sizes else docs
    classes = sorted(sizes)
    if not classes or not total:
        return Model([], idf, np.zeros((0, FEATURES + 1)), 1.0)
    known = spark.sparkContext.broadcast((idf, {c: i for i, c in enumerate(classes)}))
    span = 1 << 40
    shares = F.create_map(*[F.lit(x) for c, n in quotas(sizes, sample).items() for x in (c, min(span, span * n // sizes[c]))])
    # The row is hashed too, so that one repeated or missing id is not picked, or left out, as a whole.
    picked = docs.select("text", F.col(label).alias("label"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("h"))
    picked = picked.where(F.pmod("h", F.lit(span)) < F.element_at(shares, F.col("label")))
    # A tenth is kept for the temperature; the rest is dealt to the shards.
    dealt = picked.withColumn("shard", F.when(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(10)) == 0, -1).otherwise(F.pmod(F.xxhash64("h"), F.lit(SHARDS))).cast("int"))
    vectors = dealt.repartitionByRange(SHARDS + 1, "shard").mapInPandas(_vectors(known), "shard int, label int, at array<int>, x array<double>").persist()
    z, n = np.zeros((len(classes), FEATURES + 1)), np.zeros((len(classes), FEATURES + 1))
    for epoch in range(EPOCHS):
        state = spark.sparkContext.broadcast((z, n))
        parts = vectors.where("shard >= 0").groupBy("shard").applyInPandas(_pass(state, epoch), "rows long, z binary, n binary").collect()
        if parts:
            share = np.array([p["rows"] for p in parts], float) / sum(p["rows"] for p in parts)
            z, n = (sum(s * np.frombuffer(p[k], np.float64).reshape(z.shape) for s, p in zip(share, parts, strict=True)) for k in ("z", "n"))
        state.unpersist()
    weights = _weights(z, n)
    held = vectors.where("shard < 0").select("label", "at", "x").toPandas()  # at most about a tenth of the sample
    vectors.unpersist()
    logits = [(weights[:, np.array(a, int)] @ np.array(x) + weights[:, FEATURES], y) for a, x, y in zip(held["at"], held["x"], held["label"], strict=True)]
    return Model(classes, idf, weights, temperature(logits))


def _vectors(known):
    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, number = known.value
        for part in parts:
            rows = [(s, number[y], f) for s, y, t in zip(part["shard"], part["label"], part["text"], strict=True) if (f := features(t, idf))]
            yield pd.DataFrame({"shard": [r[0] for r in rows], "label": [r[1] for r in rows], "at": [r[2][0] for r in rows], "x": [r[2][1] for r in rows]})

    return emit


def _pass(state, epoch: int):
    def train(part: pd.DataFrame) -> pd.DataFrame:
        z, n = (a.copy() for a in state.value)
        order = np.random.default_rng(epoch).permutation(len(part))
        rows = [(np.asarray(part["at"].iat[i]), np.asarray(part["x"].iat[i]), int(part["label"].iat[i])) for i in order]
        z, n = ftrl(rows, z, n)
        return pd.DataFrame({"rows": [len(part)], "z": [z.tobytes()], "n": [n.tobytes()]})

    return train


def temperature(logits: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss, by a search on a fixed grid; 1 if there is nothing to fit."""
    if not logits:
        return 1.0
    s, y = np.array([a for a, _ in logits]), np.array([b for _, b in logits])
    loss = lambda t: -np.log(np.maximum(_softmax(s / t)[np.arange(len(y)), y], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
