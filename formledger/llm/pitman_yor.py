"""Language-model scores from a hierarchical Pitman-Yor model, seated as Chinese restaurants by Gibbs sweeps.

Every word is a context: its restaurant seats the words that follow it (a text begins and ends with the end token). The
tables of all contexts are the customers of the word restaurant, the parent they share; its tables in turn are customers of
the spelling restaurants, which hold contexts of 2, 1 and 0 symbols, each with the context shortened by one as its parent. All
pairs of the context restaurants have one discount. A pair met once has one table whatever is drawn, so in the sweeps such pairs
need not be seated one by one: what a word or a context has of them is its count less that of its other pairs. In
predictions each has its own share, 1 - discount.

A sweep seats all customers of every dish again: the number of its tables is drawn from its conditional distribution given
the dish's parent probability and its restaurant's tables in the sweep before (all dishes at once, as parallel Gibbs
sampling does; each by random numbers of its own, so that partitions and batches do not matter), exactly up to EXACT customers and by its limit beyond. Tables of pairs, of words and
of spellings are stored and carried from sweep to sweep. After a first sweep, SAMPLES seatings are averaged; predictions
from the averages add up to 1.

The outcomes are the training words and one "unknown word", whose base probability is what the spelling model leaves to
all other spellings; so a score is the probability of the text as those tokens, comparable with the base score.

Distribution: words and pairs are counted by each task before they are summed, under 64-bit digests of the words. A pair of two of the most
frequent words, KNOWN_WORDS at most, is marked as near when it is stored; its words are looked up in arrays that Python's tasks share, so
that the driver builds no join tables. All other pairs get their words by a shuffle. Pairs on their way to be summed, and what texts
look up with the facts they look it up in, are shuffled packed: arrays of a slice and bucket in one row, a bucket having a bounded part of the tokens. A text's score is a sum of facts: one for
each token (its probability, and what its context leaves to the parent), and the gain of each pair that is kept. Facts of
frequent words and pairs are looked up in bounded arrays; the others bucket by bucket, where a bitmap of BITS positions
keeps out most pairs that are not kept. A pair of a training text has been met, so without a fact of its own it has been met once,
and its gain is worked out from its words where both are in the array. So where the texts to be scored are known, pairs met once are
kept only if another text may have them, or if a word of theirs may be beyond the array; bitmaps tell both. Only the bitmaps'
usefulness, not the result, depends on the corpus's size.

Defined results: null and empty texts are the end token alone; with an empty training set every token is the unknown word
(N = V = 0, score 0); repeated rows are scored and counted each; a null id counts as the empty text in the fold; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import coded_words, discard, fold, n_words, scratch, slices, stored, table

SAMPLES = 2
#: Concentrations of the word restaurant and of the context restaurants.
THETA, CONTEXT_THETA = 100.0, 1.0
#: Discount and concentration of the spelling restaurants, by context length.
SPELLING = ((0.3, 1.0), (0.5, 1.0), (0.6, 2.0))
#: The most words that are broadcast for lookups of pairs; the most words, and pairs, whose facts are broadcast for scoring; the positions
#: of the bitmap of all other kept pairs, as a power of two.
KNOWN_WORDS, SCORED_WORDS, SCORED_PAIRS, BITS = 300_000, 1_000_000, 2_000_000, 27
#: Bytes of text that a task counts, or scores, at once, and rows that it hands on at once.
COUNTED, SCORED, ROWS = 10 << 20, 4 << 20, 1 << 17
#: Bytes of rows that a task seats at once.
SEATED = 4 << 20
#: Tokens of the training texts whose pairs are summed at once, and whose facts are looked up at once.
BUCKET, LOOKED_UP = 1 << 18, 1 << 20
#: What packed arrays hold: pairs; what texts ask for; facts; what was found; a text's own part.
_PACKED = {"b": np.int64, "w": np.int64, "c": np.int32}
_ASKED = {"row": np.int64, "h": np.int64, "less": np.float32}
_FACTS = {"h": np.int64, "base": np.float64, "v": np.float64}
_FOUND = {"row": np.int64, "known": np.int8, "base": np.float64, "v": np.float64}
_OWN = np.dtype([("row", np.int64), ("doc_id", np.int64), ("named", np.bool_), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("v", np.float64)])
#: Customers up to which a dish's tables are drawn exactly.
EXACT = 128
END = b""


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Byte -> one of 64 symbol classes, and log10 of the size of its class; 0 is the end of a word."""
    out = np.full(256, 63, np.int64)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    out[0xA0:0xC0] = np.arange(28, 60)
    out[0x80:0xA0] = 60
    out[0xC0:0x100] = 62
    out[0xC3] = 61
    return out, np.log10(np.maximum(np.bincount(out, minlength=64), 1.0))[out]


_CLASS, _CLASS_SIZE = _classes()


def spelled(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all words together: the 18-bit code of each symbol with its two predecessors, the word it belongs to, and
    what log10 of the byte within its class takes off."""
    flat = np.frombuffer(b"\x00".join(tokens) + b"\x00", np.uint8)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    word = np.repeat(np.arange(len(tokens)), np.diff(ends, prepend=0))
    at = np.arange(len(flat)) - np.concatenate(([0], ends[:-1]))[word]
    last = np.zeros(len(flat), bool)
    last[ends - 1] = True
    s = np.where(last, 0, _CLASS[flat])
    code = s.copy()
    for k in range(1, len(SPELLING)):
        code[k:] |= np.where(at[k:] >= k, s[:-k], 0) << (6 * k)
    return code, word, np.where(last, 0.0, _CLASS_SIZE[flat])


# --- seating


@lru_cache(maxsize=8)
def _log_seatings(discount: float) -> np.ndarray:
    """[n, k]: log of the weight of all seatings of n customers at k tables, new tables' masses left out."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, EXACT):
        k = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - discount * k)
        out[n + 1, 2 : n + 2] = np.logaddexp(out[n + 1, 2 : n + 2], out[n, 1 : n + 1])
    return out


class Draws:
    """Random numbers of dishes, each by the dish's own number, the sweep and which draw it is: the same wherever and beside
    whatever other dishes it is seated."""

    def __init__(self, dishes: np.ndarray, sweep: int):
        self.dishes, self.sweep = np.asarray(dishes, np.int64).view(np.uint64), sweep

    def uniform(self, nth: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        x = self.dishes[at] + np.uint64((8 * self.sweep + nth + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def seat(c: np.ndarray, new: np.ndarray, discount: float, draws: Draws) -> np.ndarray:
    """Tables of dishes with c customers, all seated again; new: mass of a new table, (theta + discount * tables) * probability."""
    c, new = np.asarray(c, np.int64), np.maximum(new, 1e-300)
    t, draw, log_new = np.minimum(c, 1), draws.uniform(0), np.log(new)
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    numbers, first = np.unique(c[small], return_index=True)
    for n, group in zip(numbers.tolist(), np.split(small, first[1:]), strict=True) if len(small) else ():
        k = np.arange(1, n + 1)
        for begin in range(0, len(group), 1 << 15):
            rows = group[begin : begin + (1 << 15)]
            log = _log_seatings(discount)[n, 1 : n + 1] + log_new[rows, None] * k
            weight = np.exp(log - log.max(1, keepdims=True)).cumsum(1)
            t[rows] = 1 + (weight[:, :-1] < (draw[rows] * weight[:, -1])[:, None]).sum(1)
    large = np.flatnonzero(c > EXACT)
    t[large] = _seat_many(c[large], new[large], discount, *(draws.uniform(i, large) for i in (1, 2)))
    return t


def _seat_many(c: np.ndarray, new: np.ndarray, discount: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """As seat(), for many customers: tables come as in a Poisson process of sizes that is tilted to c customers in all.

    With y = 1 - z, the tilt z solves new * z * y^(discount - 1) = c; then lam = new * (1 - y^discount) / discount tables are
    expected. Few tables are one large one and a Poisson number of others; many are nearly normal, with the variance that
    the sum of their sizes, which is known, leaves.
    """
    low, high = np.full(len(c), -200.0), np.full(len(c), 200.0)
    for _ in range(60):
        x = (low + high) / 2  # log(y / z)
        log_y, log_z = -np.logaddexp(0, -x), -np.logaddexp(0, x)
        above = np.log(new) + log_z + (discount - 1) * log_y > np.log(np.maximum(c, 1))
        low, high = np.where(above, x, low), np.where(above, high, x)
    z = np.exp(log_z)
    f = np.maximum(-np.expm1(discount * log_y), 1e-300) / discount
    lam = new * f
    mean = z * np.exp((discount - 1) * log_y) / f
    square = mean + z * z * (1 - discount) * np.exp((discount - 2) * log_y) / f
    rest = np.clip(1 - mean * mean / square, 0.0, 1.0)
    many = np.rint(lam + rest + np.sqrt(lam * rest) * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    few, term = np.ones(len(c), np.int64), np.exp(-np.minimum(lam, 20.0))
    below = term.copy()
    for k in range(1, 120):  # the Poisson distribution turned around
        few += u > below
        term = term * np.minimum(lam, 20.0) / k
        below += term
    return np.clip(np.where(lam > 20, many, few), 1, np.maximum(c, 1)).astype(np.int64)


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


class Spelling:
    """The spelling restaurants: by level, sorted cells (context and symbol) with customers and tables; 64^3 cells at most."""

    def __init__(self) -> None:
        self.levels: list[tuple] = [(np.zeros(0, np.int64),) + (np.zeros(0),) * 2 + (np.zeros(0, np.int64),) + (np.zeros(0),) * 2 for _ in SPELLING]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(wanted))
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def probability(self, codes: np.ndarray, depth: int = len(SPELLING)) -> np.ndarray:
        """Of each code's last symbol after its context, from the first ``depth`` levels."""
        p = np.full(len(codes), 1 / 64)
        for k in range(depth):
            d, theta = SPELLING[k]
            cells, c, t, contexts, total, tables = self.levels[k]
            cell = codes & ((1 << (6 * (k + 1))) - 1)
            n = self._find(contexts, cell >> 6, total)
            there = self._find(cells, cell, c) - d * self._find(cells, cell, t)
            back = (theta + d * self._find(contexts, cell >> 6, tables)) * p
            p = np.where(n > 0, (there + back) / (theta + n), p)
        return p

    def swept(self, codes: np.ndarray, counts: np.ndarray, sweep: int) -> Spelling:
        """The next state: every level seated under the parents and tables of this one, longest contexts first."""
        out = Spelling()
        for k in range(len(SPELLING) - 1, -1, -1):
            d, theta = SPELLING[k]
            cells, at = np.unique(codes & ((1 << (6 * (k + 1))) - 1), return_inverse=True)
            c = np.bincount(at, counts, len(cells)).astype(np.int64)
            contexts, of = np.unique(cells >> 6, return_inverse=True)
            before = self._find(self.levels[k][3], contexts, self.levels[k][5])
            t = seat(c, (theta + d * before)[of] * self.probability(cells, k), d, Draws(cells | k << 32, sweep))
            out.levels[k] = (cells, c.astype(float), t.astype(float), contexts, np.bincount(of, c, len(contexts)), np.bincount(of, t, len(contexts)))
            codes, counts = cells, t
        return out

    def words(self, tokens: list[bytes]) -> np.ndarray:
        """Probability of each word's spelling, its end included."""
        code, word, within = spelled(tokens)
        cells, at = np.unique(code, return_inverse=True)
        return 10 ** np.maximum(np.bincount(word, np.log10(self.probability(cells))[at] - within, len(tokens)), -300.0)


# --- counting


def digests(words: pa.Array) -> np.ndarray:
    """A 64-bit digest of each word, and one more: of the end token."""
    found = words.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, [*found, END]), np.uint64, len(found) + 1).view(np.int64)


def sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many tokens each text has, the numbers of all tokens (every text closes with an end token, whose number is that
    of the words), and the distinct words by number."""
    ends, at, words = coded_words(texts)
    return np.diff(ends) + 1, np.insert(at.astype(np.int64), ends[1:], len(words)), words


def word_counts(docs: DataFrame) -> DataFrame:
    """Training texts -> (h, word, c): every word by its digest, and the end of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COUNTED):
            _, at, words = sequences(part.column("text"))
            c, number = np.bincount(at, minlength=len(words) + 1), digests(words)
            words = pa.concat_arrays([words, pa.array([END], pa.binary())])
            met = c > 0
            yield pa.RecordBatch.from_arrays([pa.array(number[met]), words.filter(pa.array(met)), pa.array(c[met])], ["h", "word", "c"])

    return docs.select("text").mapInArrow(count, "h long, word binary, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def _pairs_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: digests of the two words of each distinct pair of neighbours, and how often it is met; the end token stands at
    both ends of a text."""
    _, at, words = sequences(part.column("text"))
    # The end of a text is the beginning of the next.
    pairs, c = np.unique(np.concatenate(([len(words)], at[:-1])) << 32 | at, return_counts=True)
    number = digests(words)
    return number[pairs >> 32], number[pairs & 0xFFFFFFFF], c


def _met(docs: DataFrame) -> DataFrame:
    """Texts -> (h): numbers of the pairs they have."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COUNTED):
            b, w, _ = _pairs_of(part)
            for begin in range(0, len(b), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(_pair_numbers(b[begin : begin + ROWS], w[begin : begin + ROWS]))], ["h"])

    return docs.select("text").mapInArrow(emit, "h long")


def _bucket(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """Which of so many equal ranges of the 64-bit numbers each is in."""
    return ((numbers.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _pack(bucket: np.ndarray, columns: dict[str, np.ndarray], other: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """(bucket, the columns, and empty other ones): the values of each bucket as arrays in one row, some ROWS values at once."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    numbers, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first, len(order))
    at = 0
    while at < len(numbers):
        until = max(at + 1, int(np.searchsorted(ends, ends[at] + ROWS, side="right")) - 1)
        some, cut = order[ends[at] : ends[until]], ends[at : until + 1] - ends[at]
        arrays = [pa.Array.from_buffers(pa.binary(), until - at, [None, pa.py_buffer((cut * x.dtype.itemsize).astype(np.int32)), pa.py_buffer(x[some].tobytes())]) for x in columns.values()]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[at:until], pa.int32()), *arrays, *(pa.array([b""] * (until - at), pa.binary()) for _ in other)], ["bucket", *columns, *other])
        at = until


def _unpacked(group: pa.Table, kinds: dict[str, type | np.dtype]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(group.column(n).to_pylist()), kind) for n, kind in kinds.items()]


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts -> (bucket, b, w, c): for each slice of text and bucket of pair numbers, the slice's pairs as arrays, so that a shuffle
    moves some thousands of pairs a row. Nearly all pairs of a slice are rare, so that few rows would meet before it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, COUNTED):
            b, w, c = _pairs_of(part)
            yield from _pack(_bucket(_pair_numbers(b, w), buckets), dict(zip(_PACKED, (b, w, c.astype(np.int32)), strict=True)))

    return docs.select("text").mapInArrow(emit, "bucket int, b binary, w binary, c binary")


def _summed(b: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every distinct pair, with the sum of its counts."""
    number = _pair_numbers(b, w)
    order = np.argsort(number)
    same = number[order[1:]] == number[order[:-1]]
    if (b[order[1:]] != b[order[:-1]])[same].any():  # two pairs have one number
        order = np.lexsort((b, number))
        same = (number[order[1:]] == number[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    first = np.flatnonzero(np.append(True, ~same))
    return b[order[first]], w[order[first]], np.add.reduceat(c[order].astype(np.int64), first)


def pair_counts(docs: DataFrame, tokens: int | None = None, then: Callable[[pa.Table], pa.Table] = lambda counts: counts, more: str = "") -> DataFrame:
    """Training texts -> (b, w, c): digests of neighbouring words, and what then() makes of them, bucket by bucket. tokens: how
    many the texts have, if it is known; a bucket has pairs of BUCKET of them, and its count of each slice's is its own."""
    if tokens is None:
        tokens = docs.agg(F.sum(n_words(F.col("text")) + 1)).first()[0] or 0

    def add(group: pa.Table) -> pa.Table:
        return then(pa.Table.from_arrays([pa.array(x) for x in _summed(*_unpacked(group, _PACKED))], ["b", "w", "c"]))

    return _packed(docs, tokens // BUCKET + 1).groupBy("bucket").applyInArrow(add, f"b long, w long, c long{more}")


def _kept(docs: DataFrame, tokens: int, known: DataFrame, asked: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """pair_counts (b, w, c) of docs with near: whether both are words of known (h). asked: of pairs met once keeps only what may be
    in its first table (h: the pair's number), or may have a word of its second (h)."""
    context = docs.sparkSession.sparkContext
    # One after the other, so that the driver holds one at a time.
    words, *bits = shared = [context.broadcast(_array(known.select("h")))] + [context.broadcast(_bitmap(x)) for x in asked or ()]

    def mark(counts: pa.Table) -> pa.Table:
        (keys,) = words.value
        if bits:
            b, w, c = (counts.column(n).to_numpy() for n in ("b", "w", "c"))
            pairs, rare = (x.value for x in bits)
            counts = counts.filter(pa.array((c > 1) | _hit(pairs, _pair_numbers(b, w)) | _hit(rare, b) | _hit(rare, w)))
        near = _found(keys, counts.column("b").to_numpy())[1] & _found(keys, counts.column("w").to_numpy())[1]
        return counts.append_column("near", pa.array(near))

    kept = stored(pair_counts(docs, tokens, mark, ", near boolean"))
    for x in shared:
        x.destroy()
    return kept


def frequent(counts: DataFrame, most: int) -> int:
    """The least count such that no more than ``most`` rows of counts (c) have it or more."""
    step = F.floor(F.log2("c") * 8)
    left, least = most, 0
    # A row for each eighth of a power of two: a few hundred, whatever the corpus.
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("high")).collect(), key=lambda r: -r["step"]):
        left -= r["n"]
        if left < 0:
            return least or r["high"] + 1
        least = r["least"]
    return 0


# --- the model


class Fitted(NamedTuple):
    """words: (h, c, p, back), back: what the word's restaurant leaves to the parent; pairs: (b, w, c, t, near), with their average
    tables; unknown: probability of the unknown word; hot, scored: counts from which words are broadcast for near pairs, for
    scoring; whole: whether pairs has all that were met once."""

    words: DataFrame
    pairs: DataFrame
    tokens: int
    vocabulary: int
    unknown: float
    discount: float
    hot: int
    scored: int
    whole: bool


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, SEATED bytes at once at most, or one batch: seating has a cost by batch."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > SEATED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _stored_with_words(pairs: DataFrame, words: DataFrame, hot: int, of_word: tuple[str, ...], of_context: tuple[str, ...], then: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What then(batch of pairs, columns of words for w, those for b) makes of all pairs (b, w, near, any others), with near.
    Words of hot occurrences or more, KNOWN_WORDS at most, are broadcast for near pairs."""
    known = pairs.sparkSession.sparkContext.broadcast(_array(words.where(F.col("c") >= hot).select("h", *of_word, *of_context)))
    columns = [n for n in pairs.columns if n != "near"]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = known.value
        for batch in _together(batches):
            w, b = (_found(keys, batch.column(n).to_numpy())[0] for n in ("w", "b"))
            yield then(batch, *(v[w] for v in values[: len(of_word)]), *(v[b] for v in values[len(of_word) :]))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            yield then(batch, *(batch.column(n).to_numpy() for n in (*of_word, *of_context)))

    out = pairs.where("near").select(columns).mapInArrow(near, schema).withColumn("near", F.lit(True))
    if hot > 1:
        named = lambda key, wanted: words.select(F.col("h").alias(key), *wanted).hint("shuffle_hash")
        joined = pairs.where("NOT near").select(columns).join(named("w", of_word), "w").join(named("b", of_context), "b")
        out = out.unionByName(joined.select(*columns, *of_word, *of_context).mapInArrow(far, schema).withColumn("near", F.lit(False)))
    out = stored(out)
    known.destroy()
    return out


def _seat_words(words: DataFrame, spelling: Spelling, tables: float, discount: float, sweep: int) -> DataFrame:
    """words (h, word, k: customers, any others) -> with t: tables, q: probability of the spelling."""
    state = words.sparkSession.sparkContext.broadcast(spelling)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            q = state.value.words(batch.column("word").to_pylist())
            t = seat(batch.column("k").to_numpy(), (THETA + discount * tables) * q, discount, Draws(batch.column("h").to_numpy(), sweep))
            yield batch.append_column("t", pa.array(t, pa.int64())).append_column("q", pa.array(q))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(emit, f"{schema}, t long, q double")


def _cells(seats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(codes, customers) of the spelling restaurants: 64^3 at most, summed in the tasks."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << (6 * len(SPELLING)), np.int64)
        for batch in batches:
            if batch.num_rows:
                code, word, _ = spelled(batch.column("word").to_pylist())
                sums += np.bincount(code, batch.column("t").to_numpy()[word], len(sums)).astype(np.int64)
        if len(codes := np.flatnonzero(sums)):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums[codes])], ["code", "n"])

    rows = seats.select("word", "t").mapInArrow(emit, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def _seat_pairs(pairs: DataFrame, words: DataFrame, hot: int, discount: float, sweep: int) -> DataFrame:
    """pairs (b, w, c, t, near), words (h, c, p, tables) -> b, w, c, t: with this sweep's tables added, near, now: these alone."""

    def seated(batch: pa.RecordBatch, p: np.ndarray, tables: np.ndarray) -> pa.RecordBatch:
        b, w, c, t = (batch.column(n) for n in ("b", "w", "c", "t"))
        now = seat(c.to_numpy(), (CONTEXT_THETA + discount * tables) * p, discount, Draws(_pair_numbers(b.to_numpy(), w.to_numpy()), sweep))
        return pa.RecordBatch.from_arrays([b, w, c, pa.array(t.to_numpy() + now), pa.array(now)], ["b", "w", "c", "t", "now"])

    return _stored_with_words(pairs, words, hot, ("p",), ("tables",), seated, "b long, w long, c long, t long, now long")


def fit(docs: DataFrame, samples: int = SAMPLES, others: DataFrame | None = None) -> Fitted:
    """docs (text): the training texts. others (text): if it is known, all other texts that will be scored."""
    counted = stored(word_counts(docs))
    tokens, vocabulary = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    hot, scored = frequent(counted, KNOWN_WORDS), frequent(counted, SCORED_WORDS)
    asked = None if others is None else (_met(others), counted.where(F.col("c") < scored))
    met = _kept(docs, tokens, counted.where(F.col("c") >= hot), asked)
    pairs = met.where("c > 1").withColumn("t", F.lit(0).cast("long"))
    again, two = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") == 2, 1))).first()
    discount = _discount(tokens - again, two)

    def by(key: str, value: Column, name: str) -> DataFrame:
        return pairs.groupBy(F.col(key).alias("h")).agg(F.sum(value).alias(name)).hint("shuffle_hash")

    none = F.lit(0).cast("long")
    as_word = pairs.groupBy(F.col("w").alias("h")).agg(F.sum("c").alias("wc"), F.count(F.lit(1)).alias("wt"))
    as_context = pairs.groupBy(F.col("b").alias("h")).agg(F.sum("c").alias("bc"), F.count(F.lit(1)).alias("bt"))
    # Of what was met once: customers for the word restaurant, tables in the context's own. To begin with, one table a pair.
    words = stored(
        counted.join(as_word.hint("shuffle_hash"), "h", "left").join(as_context.hint("shuffle_hash"), "h", "left")
        .withColumns({"w1": F.col("c") - F.coalesce("wc", none), "b1": F.col("c") - F.coalesce("bc", none)})
        .select("h", "word", "c", "w1", "b1", (F.col("w1") + F.coalesce("wt", none)).alias("k"), (F.col("b1") + F.coalesce("bt", none)).alias("tables"),
                F.lit(0.0).alias("p_sum"), F.lit(0).cast("long").alias("tables_sum"))
    )
    discard(counted)
    spelling, total, unknown = Spelling(), 1, 0.0
    cells = _cells(words.withColumn("t", F.lit(1).cast("long")))
    for first in range(3):  # from nothing: one table a word
        spelling = spelling.swept(*cells, samples + 1 + first)
    for sweep in range(samples + 1):
        customers, one, two = words.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count(F.when(F.col("k") == 1, 1)), F.count(F.when(F.col("k") == 2, 1))).first()
        d = _discount(one, two)
        seats = stored(_seat_words(words, spelling, total, d, sweep))
        discard(words)
        total, share = seats.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0.0))).first()
        left = (THETA + d * total) / (THETA + customers)
        words = seats.withColumn("p", (F.col("k") - d * F.col("t")) / (THETA + customers) + left * F.col("q"))
        if sweep:
            unknown += left * (1 - share) / samples
            words = words.withColumns({"p_sum": F.col("p_sum") + F.col("p"), "tables_sum": F.col("tables_sum") + F.col("tables")})
        if sweep < samples:
            spelling = spelling.swept(*_cells(seats), sweep)
            before, pairs = pairs, _seat_pairs(pairs, words, hot, discount, sweep)
            if sweep:
                discard(before)
            more = words.drop("p", "q", "t", "k", "tables").join(by("w", F.col("now"), "wt"), "h", "left").join(by("b", F.col("now"), "bt"), "h", "left")
            words = stored(more.withColumns({"k": F.col("w1") + F.coalesce("wt", none), "tables": F.col("b1") + F.coalesce("bt", none)}).drop("wt", "bt"))
            discard(seats)
            pairs = pairs.drop("now")
    tables = F.col("tables_sum") / samples
    back = (CONTEXT_THETA + discount * tables) / (CONTEXT_THETA + F.col("c"))
    final = stored(words.select("h", "c", (F.col("p_sum") / samples).alias("p"), back.alias("back")))
    discard(seats)
    seated = pairs.withColumn("t", F.col("t") / samples).unionByName(met.where("c = 1").withColumn("t", F.lit(1.0)))
    return Fitted(final, seated, tokens, vocabulary, max(unknown, 1e-300) if tokens else 1.0, discount, hot, scored, others is None)


# --- scoring


def pair_number(b: Column, w: Column) -> Column:
    return b.bitwiseXOR(F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(w, 63)))


def _pair_numbers(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """As pair_number."""
    w = w.view(np.uint64)
    return (b.view(np.uint64) ^ (w << np.uint64(1) | w >> np.uint64(63))).view(np.int64)


def _array(rows: DataFrame) -> tuple[np.ndarray, ...]:
    """The columns of bounded rows as arrays, sorted by the first."""
    found = rows.toArrow()
    order = np.argsort(found.column(0).to_numpy())
    return tuple(c.to_numpy()[order] for c in found.columns)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands in the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The set of the first BITS bits of h; 2^BITS bits, whatever the rows."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    blocks = rows.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((max(1, 1 << (BITS - 15)), 4096), np.uint8)
    for block, bits in zip(blocks.column("block"), blocks.column("bits"), strict=True):
        out[block.as_py()] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a _bitmap may have h."""
    place = (h.view(np.uint64) >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _spread(rows: np.ndarray) -> np.ndarray:
    """Numbers of rows, spread over 64 bits."""
    return (rows.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def score(docs: DataFrame, model: Fitted, last: bool = False, held: list[Broadcast] | None = None) -> DataFrame:
    """docs (doc_id, text, and train: whether fit had the text, taken as no without it) -> doc_id, n_tokens, n_known, base_score,
    score by row. last: nothing else reads the model's pairs, so they are deleted as soon as their facts are stored.
    held: gets what the tasks share, to be destroyed once the scores are stored."""
    if not model.whole and "train" not in docs.columns:
        raise ValueError("a model that was fitted for certain other texts needs a column train")
    train = F.coalesce("train", F.lit(False)) if "train" in docs.columns else F.lit(False)
    discount = model.discount
    whole, unknown = float(np.log10(model.tokens + model.vocabulary + 1)), float(np.log10(model.unknown))
    # A word's fact: log10 of its count and 1, of its probability, and of what it leaves to the parent as a context; also the
    # share of a pair that it meets once, against what it leaves.
    once = ((1 - discount) / (CONTEXT_THETA + F.col("c")) / F.col("back")).alias("once")
    words = model.words.select("h", "c", F.log10(F.col("c") + 1).alias("base"), F.log10(F.col("p") * F.col("back")).alias("v"), "p", once)

    def gained(batch: pa.RecordBatch, p: np.ndarray, back: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        b, w, c, t = (batch.column(k).to_numpy() for k in ("b", "w", "c", "t"))
        own = (c - discount * t) / (CONTEXT_THETA + n)
        return pa.RecordBatch.from_arrays([pa.array(_pair_numbers(b, w)), batch.column("c"), pa.array(np.log10(1 + own / (back * p)).astype(np.float32))], ["h", "c", "v"])

    pairs = _stored_with_words(model.pairs, model.words.withColumn("n", F.col("c")), model.hot, ("p",), ("back", "n"), gained, "h long, c long, v float")
    if last:
        discard(model.pairs)
    often, hot = frequent(pairs, SCORED_PAIRS), model.scored
    rare_pairs = pairs.where(F.col("c") < often)
    facts = words.where(F.col("c") < hot).select("h", "base", (F.col("v") - unknown).alias("v")).unionByName(rare_pairs.select("h", F.lit(0.0).alias("base"), "v"))
    send = docs.sparkSession.sparkContext.broadcast
    # One after the other, so that the driver holds one at a time.
    shared = (
        send(_array(words.where(F.col("c") >= hot).select("h", "base", "v", "p", "once"))),
        send(_array(pairs.where(F.col("c") >= often).select("h", "v"))),
        send(_bitmap(rare_pairs.where("c > 1"))),
        send(_bitmap(rare_pairs.where("c = 1"))),
    )
    if held is not None:
        held += shared
    buckets = max(model.tokens // LOOKED_UP + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (word_keys, word_base, word_v, word_p, word_once), (pair_keys, pair_v), again, single = (x.value for x in shared)
        for part in slices(batches, SCORED):
            n, at, words = sequences(part.column("text"))
            number, doc = digests(words), np.repeat(np.arange(len(n)), n)
            where, known = _found(word_keys, number)
            base = np.where(known, word_base[where], 0.0) if len(word_keys) else np.zeros(len(number))
            v = np.where(known, word_v[where], unknown) if len(word_keys) else np.full(len(number), unknown)
            # Digests of pairs, each distinct one looked up once.
            before = np.concatenate(([len(words)], at[:-1]))
            pairs, pair_at = np.unique(_pair_numbers(number[before], number[at]), return_inverse=True)
            found, often = _found(pair_keys, pairs)
            gain = np.where(often, pair_v[found], 0.0) if len(pair_keys) else np.zeros(len(pairs))
            # What a pair met once gains: it is so in a training text, unless the join finds a fact.
            token = np.zeros(len(pairs), np.int64)
            token[pair_at] = np.arange(len(at))
            b, w, once = before[token], at[token], np.zeros(len(pairs), np.float32)
            near = np.flatnonzero(~often & known[b] & known[w])
            once[near] = np.log1p(word_once[where[b[near]]] / word_p[where[w[near]]]) / np.log(10)
            less = np.where(part.column("train").to_numpy(zero_copy_only=False)[doc], once[pair_at], np.float32(0))
            perhaps, alone = ~often & _hit(again, pairs), ~often & _hit(single, pairs)
            cold_words, cold_pairs = np.flatnonzero(~known[at]), np.flatnonzero(perhaps[pair_at] | (alone[pair_at] & (less == 0)))
            total = lambda values: np.bincount(doc, values, len(n))  # noqa: B023, E731
            rows, own = part.column("row").to_numpy(), np.empty(len(n), _OWN)
            own["row"], own["doc_id"], own["named"] = rows, part.column("doc_id").fill_null(0).to_numpy(), part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            own["n_tokens"], own["n_known"], own["base"], own["v"] = n, total(known[at].astype(float)), total(base[at]), total(v[at] + gain[pair_at] + less)
            # A text's own part has nothing to look up: it goes along with any bucket.
            yield from _pack(np.repeat(_bucket(_spread(rows[:1]), buckets), len(n)), {"own": own}, tuple(_ASKED))
            keys = np.concatenate((number[at[cold_words]], pairs[pair_at[cold_pairs]]))
            asked = rows[np.concatenate((doc[cold_words], doc[cold_pairs]))], keys, np.concatenate((np.zeros(len(cold_words), np.float32), less[cold_pairs]))
            yield from _pack(_bucket(keys, buckets), dict(zip(_ASKED, asked, strict=True)), ("own",))

    def packed_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches):
            columns = {n: batch.column(n).to_numpy() for n in _FACTS}
            yield from _pack(_bucket(columns["h"], buckets), columns)

    def look_up(asked: pa.Table, known: pa.Table) -> pa.Table:
        (row, h, less), (keys, base, v), (own,) = _unpacked(asked, _ASKED), _unpacked(known, _FACTS), _unpacked(asked, {"own": _OWN})
        order = np.argsort(keys)
        at, there = _found(keys[order], h)
        row, at = row[there], order[at[there]]
        found = row, (base[at] > 0).astype(np.int8), base[at], v[at] - less[there]
        parts = [*_pack(_bucket(_spread(row), buckets), dict(zip(_FOUND, found, strict=True)), ("own",)), *_pack(_bucket(_spread(own["row"]), buckets), {"own": own}, tuple(_FOUND))]
        names = ["bucket", *_FOUND, "own"]
        return pa.Table.from_batches([x.select(names) for x in parts], pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names[1:])]))

    def add(group: pa.Table) -> pa.Table:
        (row, known, base, v), (own,) = _unpacked(group, _FOUND), _unpacked(group, {"own": _OWN})
        own = own[np.argsort(own["row"])]
        of = np.searchsorted(own["row"], row)
        known, base, v = (own[n] + np.bincount(of, x, len(own)) for n, x in (("n_known", known), ("base", base), ("v", v)))
        columns = pa.array(own["doc_id"], mask=~own["named"]), own["n_tokens"], known.astype(np.int64), base - own["n_tokens"] * whole, v
        return pa.table(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), columns, strict=True)))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    binary = lambda names: "bucket int, " + ", ".join(f"{n} binary" for n in names)
    asked = rows.mapInArrow(lambda batches: (x.select(["bucket", *_ASKED, "own"]) for x in split(batches)), binary([*_ASKED, "own"]))
    known = facts.mapInArrow(packed_facts, binary(_FACTS))
    found = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(look_up, binary([*_FOUND, "own"]))
    return found.groupBy("bucket").applyInArrow(add, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", fold(F.col("doc_id"), 7) != 2)
    held: list[Broadcast] = []
    with scratch(spark) as keep:
        model = fit(docs.where("train"), others=docs.where("NOT train"))
        out = keep(
            score(docs, model, last=True, held=held).select(
                "doc_id",
                (fold(F.col("doc_id"), 7) == 2).alias("held_out"),
                "n_tokens",
                "n_known",
                F.lit(model.tokens).cast("long").alias("train_tokens"),
                "base_score",
                "score",
            )
        )
    for x in held:
        x.destroy()
    return out


QUERIES = {"op8_language_model": op8_language_model}
ORACLES: dict[str, str] = {}
