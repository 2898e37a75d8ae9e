"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each text gives a vector of damped counts and log-odds of shares (symbols, capitals, digits, punctuation, repeats ...).
For each class, count, sums and sums of products over all training rows give mean and covariance exactly; the covariance
is shrunk towards the pooled one and a scaled identity. Its Cholesky factor is computed once and kept; a score is the
difference of two Mahalanobis log-densities plus the prior log-odds, through a logistic curve whose slope and offset are
fitted on the training rows' summed score histogram (400 bins of margins from -40 to 40; what lies beyond counts in the end
bins, where the curve is flat). Scores use the margins as they are.

Defined results: null and empty texts have the statistics of an empty text and are scored as such; with fewer than two
classes in training every score is the share of label 1 (0.5 with none); repeated rows are scored alike; a document with
several labels counts once for each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import durable, fold, table

STATISTICS = (
    "words", "word_length", "word_length_spread", "line_words", "duplicate_lines", "distinct_words", "repeated_pairs",
    "capitals", "digits", "symbols", "exclamations", "bars", "punctuation", "line_ends", "long_words",
)
SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.05
CUT = 0.3
_BINS, _RANGE = 400, 40.0


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, smoothed by half an event each way."""
    return float(np.log((part + 0.5) / (whole - part + 0.5))) if whole >= part else float(np.log(2 * part + 1))


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    tokens = raw.split()
    n = len(tokens)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    dark = int(byte.sum() - byte[9:14].sum() - byte[32])
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    low = [t.lower() for t in tokens]
    pairs = len(set(zip(low[:-1], low[1:], strict=True))) if n > 1 else 0
    symbols = int(sum(byte[ord(c)] for c in "#*$%&<>@^~_=+\\"))
    points = int(sum(byte[ord(c)] for c in ".,;:'\"?()-"))
    return np.array(
        [
            np.log1p(n),
            np.log1p(lengths.mean()) if n else 0.0,
            np.log1p(lengths.std()) if n else 0.0,
            np.log1p(n / max(1, len(lines))),
            _odds(len(lines) - len(set(lines)), len(lines)),
            _odds(len(set(low)), n) / max(1.0, np.log1p(n)),
            _odds(n - 1 - pairs if n > 1 else 0, n),
            _odds(int(byte[65:91].sum()), dark),
            _odds(int(byte[48:58].sum()), dark),
            _odds(symbols, dark),
            _odds(int(byte[33]), dark),
            _odds(int(byte[124]), dark),
            _odds(points, dark),
            _odds(sum(x.rstrip()[-1:] in b".!?" for x in lines), len(lines)),
            _odds(int((lengths > 20).sum()), n),
        ]
    )


def measured(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, x."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, x array<double>")


class Discriminant:
    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """moments: for each label the count, the sums and the sums of products."""
        self.slope, self.offset = 1.0, 0.0
        n0, n1 = (moments[k][0] if k in moments else 0.0 for k in (0, 1))
        self.share = n1 / (n0 + n1) if n0 + n1 else 0.5
        self.ready = min(n0, n1) >= 2
        if not self.ready:
            return
        d = len(STATISTICS)
        means = {k: s / n for k, (n, s, _) in moments.items()}
        spreads = {k: p / n - np.outer(means[k], means[k]) for k, (n, _, p) in moments.items()}
        pooled = (n0 * spreads[0] + n1 * spreads[1]) / (n0 + n1)
        self.parts = {}
        for k, n in ((0, n0), (1, n1)):
            mixed = (1 - SHRINK_POOLED) * spreads[k] + SHRINK_POOLED * pooled
            scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
            shrunk = (1 - SHRINK_IDENTITY) * mixed + SHRINK_IDENTITY * scale + 1e-9 * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.parts[k] = (means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / (n0 + n1)))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-density differences of label 1 over label 0, prior included; x: (rows, statistics)."""
        out = 0.0
        for k, sign in ((1, 1.0), (0, -1.0)):
            mean, inverse, logdet, prior = self.parts[k]
            y = (x - mean) @ inverse.T
            out = out + sign * (prior - 0.5 * ((y * y).sum(1) + logdet))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(x) + self.offset, -30, 30)))


def _moments(train: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    d = len(STATISTICS)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, d)
            y = np.array(batch.column("label").to_pylist())
            for k in np.unique(y):
                part = np.hstack((np.ones((int((y == k).sum()), 1)), x[y == k]))
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * s.size), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["label", "at", "v"])

    rows = train.select("label", "x").mapInArrow(gather, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out = {k: np.zeros((d + 1) ** 2) for k in {r["label"] for r in rows}}  # (d + 1)^2 numbers a label
    for r in rows:
        out[r["label"]][r["at"]] = r["v"]
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, v in out.items() if (m := v.reshape(d + 1, d + 1))[0, 0]}


def _calibrate(model: Discriminant, train: DataFrame) -> None:
    """Slope and offset of the logistic curve, by Newton steps on a histogram of margins by label."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            bins = np.clip((shared.value.margins(x) + _RANGE) / (2 * _RANGE) * _BINS, 0, _BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bins)], ["label", "bin"])

    rows = train.select(F.col("label").cast("long").alias("label"), "x").mapInArrow(gather, "label long, bin long").groupBy("label", "bin").count().collect()
    m = np.array([(r["bin"] + 0.5) / _BINS * 2 * _RANGE - _RANGE for r in rows])
    y, w = np.array([float(r["label"]) for r in rows]), np.array([float(r["count"]) for r in rows])
    a = np.stack((m, np.ones_like(m)), 1)
    theta = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        g = a.T @ (w * (p - y)) + 1e-2 * (theta - [0.5, 0.0])
        h = (a * (w * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -0.5, 0.5)
    model.slope, model.offset = max(float(theta[0]), 0.01), float(theta[1])


def fit(train: DataFrame) -> Discriminant:
    """train (label 0 or 1, x)."""
    model = Discriminant(_moments(train))
    if model.ready:
        _calibrate(model, train)
    return model


def scored(rows: DataFrame, model: Discriminant) -> DataFrame:
    """rows (doc_id, x) -> doc_id, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(emit, "doc_id long, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(measured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("long").alias("label")).distinct()
    train = durable(rows.where(fold(F.col("doc_id"), 5) != 0).join(labels, "doc_id").select("label", "x"))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return scored(rows, fit(train)).select("doc_id", held, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict[str, str] = {}
