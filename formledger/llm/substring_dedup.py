"""Passages that stand in an earlier document go: suffix automata of reference shards, and matching statistics over them.

A window is ``length`` consecutive words of a document. Every window has one minimizer: the first of its word sequences of
``length // 2`` words with the least hash. Windows that follow each other and share it make up a passage; a passage is told
by its minimizer and its content alone, so equal windows always lie in passages of one minimizer.

1. Screen: minimizers that only one document has cannot be in a window of two. Passages of the others stay, told by hash.
2. Reference: of passages with equal content the one of the smallest id stands for all; its words are read again.
3. Shards: passages are dealt by minimizer, so that equal windows meet, into shards of bounded size; a minimizer with more
   contexts than that is dealt over slices, and all its slices stream through all others. A shard's passages become one
   suffix automaton in array form: states are the intervals of its prefixes sorted from their ends (the classes of equal
   end positions), with suffix links and transitions by binary search. It is broadcast to the tasks of its own shard only,
   as most documents share nothing with it; a broadcast to all of them would grow with the square of the corpus.
4. Stream: each passage runs through its automata word by word. The matching statistics say for each word how long a match
   ends there; where it is a window or longer, the state knows the smallest id among the documents that hold it.
5. A document loses the words of its windows that a smaller id holds: the maximal spans, judged on the input.

Defined results: null and empty texts have no words; ids that are null come last and never precede each other; rows of one
id do not precede each other; an empty table gives no rows; other columns are ignored. Words are told apart by XXH3 digests
of 64 bits, passages by a 64-bit fold of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import discard, slices, stored, table
from formledger.llm.ngram_join import NO_ID, folded

LENGTH = 13
#: Passages in a shard, or in a slice of a larger one.
SHARD_PASSAGES = 1 << 15
SLICE_BYTES = 4 << 20


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words end (0 first), and the hash of each word, unchanged."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    at, ends = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    found = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    word = at != pc.index(coded.dictionary, "").as_py()  # a split leaves empty strings at the ends
    return np.concatenate(([0], np.cumsum(word)))[ends - ends[0]], each[at[word]]


def passages(ends: np.ndarray, words: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, begin, windows, minimizer, content) of each passage: its first word's place and its number of windows."""
    n, part = len(words) - length + 1, max(1, length // 2)
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = folded([words[i : len(words) - part + 1 + i] for i in range(part)])
    span = length - part + 1  # sequences in a window
    least = grams[:n].copy()
    for i in range(1, span):
        np.minimum(least, grams[i : n + i], out=least)
    place = np.zeros(n, np.int64)
    for i in range(span - 1, -1, -1):  # the first one counts
        np.copyto(place, np.arange(i, n + i), where=grams[i : n + i] == least)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = np.flatnonzero(text[:n] == text[length - 1 :])
    if not len(inside):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.concatenate(([True], (place[inside[1:]] != place[inside[:-1]]) | (np.diff(inside) != 1)))
    begin, windows = inside[new], np.diff(np.append(np.flatnonzero(new), len(inside)))
    total = windows + length - 1
    # Sequences that cover the passage say what it holds.
    cover = [grams[begin + np.minimum(i, total - part)] for i in range(0, 2 * length - part, part)]
    content = folded([*cover, grams[begin + total - part], total.astype(np.uint64)])
    return text[begin], begin, windows, grams[place[begin]].view(np.int64), content.view(np.int64)


class Automaton:
    """A suffix automaton over sequences of words in array form.

    The prefixes of all sequences, sorted by their words from the last one back, stand in ``order``; a state is an interval of
    them that end alike. Two states of neighbours part where the common length is less: that gives each state's suffix link.
    A transition by a word is a search among the words that follow. owner: of each sequence, what ``owner_of`` gives the least of.
    """

    DEPTH = 5  # words beyond 2^DEPTH are not told apart: no stream is longer

    def __init__(self, sequences: list[np.ndarray], owner: np.ndarray, length: int):
        lengths = np.array([len(x) for x in sequences])
        if lengths.max(initial=0) >= 1 << self.DEPTH:
            raise ValueError("a passage is longer than the automaton tells apart")
        self.words, codes = np.unique(np.concatenate(sequences), return_inverse=True)
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]) + 1, np.int64)  # 0 parts the sequences
        inner = np.ones(len(text), bool)
        inner[np.concatenate(([0], ends))] = False
        text[inner] = codes + 1
        owners = np.append(np.repeat(owner, lengths + 1), np.int64(NO_ID))
        owners[1:] = owners[:-1]
        owners[~inner] = NO_ID
        self.n = len(text)
        ranks = [text]
        for k in range(self.DEPTH):
            back = np.zeros(self.n, np.int64)
            back[1 << k :] = ranks[k][: -(1 << k)] + 1 if 1 << k < self.n else 0
            both = ranks[k] * (int(back.max()) + 1) + back
            ranks.append(np.unique(both, return_inverse=True)[1])
        order = np.argsort(ranks[-1], kind="stable")
        # What neighbours have in common, from the highest power of two down.
        a, b = order[:-1], order[1:]
        common = np.where(ranks[-1][a] == ranks[-1][b], 1 << self.DEPTH, 0)
        open_ = common == 0
        for k in range(self.DEPTH - 1, -1, -1):
            x, y = a - common, b - common
            same = open_ & (x >= 0) & (y >= 0)
            same[same] = ranks[k][x[same]] == ranks[k][y[same]]
            common = common + np.where(same, 1 << k, 0)
        self.common = np.concatenate(([-1], common, [-1]))
        self.before, self.after = _nearest_smaller(self.common), self.n - _nearest_smaller(self.common[::-1])[::-1]
        follows = np.zeros(self.n, np.int64)
        inside = order + 1 < self.n
        follows[inside] = text[order[inside] + 1]
        self.steps = np.sort(np.where(inside, follows, len(self.words) + 1) * (self.n + 1) + np.arange(self.n))
        apart = self.common[: self.n] < length
        self.group = np.cumsum(apart) - 1
        self.least = np.minimum.reduceat(owners[order], np.flatnonzero(apart))

    def streamed(self, sequences: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """sequences: one a row, hashes of words, all streamed side by side -> after each word the length of the match that
        ends there, and the state's first prefix."""
        codes = np.searchsorted(self.words, sequences)
        known = self.words[np.minimum(codes, len(self.words) - 1)] == sequences
        codes = np.where(known, codes + 1, -1)
        low, high, matched = np.zeros(len(codes), np.int64), np.full(len(codes), self.n), np.zeros(len(codes), np.int64)
        for word in codes.T:
            trying = np.flatnonzero(word > 0)
            low[word < 0], high[word < 0], matched[word < 0] = 0, self.n, 0
            while len(trying):
                key = word[trying] * (self.n + 1)
                a, b = np.searchsorted(self.steps, key + low[trying]), np.searchsorted(self.steps, key + high[trying])
                hit = a < b
                on = trying[hit]
                low[on], high[on], matched[on] = a[hit] + 1, b[hit] + 1, matched[on] + 1  # place 0 follows nothing
                trying = trying[~hit]
                trying = trying[matched[trying] > 0]  # the root has no suffix link: the word starts anew
                l, h = low[trying], high[trying]  # noqa: E741
                edge = np.where(self.common[l] >= self.common[h], l, h)
                low[trying], high[trying], matched[trying] = self.before[edge], self.after[edge], self.common[edge]
            yield matched, low

    def owner_of(self, state: np.ndarray) -> np.ndarray:
        """The least owner of the sequences that hold the last ``length`` words of states matched so far or further."""
        return self.least[self.group[state]]


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, by doubling jumps; place 0 has the smallest."""
    at = np.maximum(np.arange(len(x)) - 1, 0)
    while True:
        far = (x[at] >= x) & (at > 0)
        if not far.any():
            return at
        at = np.where(far, at[at], at)


def _screened(docs: DataFrame, length: int) -> DataFrame:
    """(minimizer, content, doc, salt): the distinct passages of each row; salt tells the rows of a repeated id apart, mostly."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            text, _, _, minimizer, content = passages(*hashed_words(part.column("text")), length)
            if len(text):
                one = _first_of(text, content)
                at = pa.array(text[one])
                yield pa.RecordBatch.from_arrays([pa.array(minimizer[one]), pa.array(content[one]), part.column("doc").take(at), part.column("salt").take(at)], ["minimizer", "content", "doc", "salt"])

    return docs.mapInArrow(emit, "minimizer long, content long, doc long, salt int")


def _first_of(text: np.ndarray, content: np.ndarray) -> np.ndarray:
    order = np.lexsort((content, text))
    new = np.concatenate(([True], (np.diff(text[order]) != 0) | (content[order][1:] != content[order][:-1])))
    return order[new]


def _words_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(content, minimizer, doc, windows, words) of the wanted (doc, salt, content) passages."""
    lists = wanted.groupBy("doc", "salt").agg(F.collect_list("content").alias("wanted"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            ends, words = hashed_words(part.column("text"))
            text, begin, windows, minimizer, content = passages(ends, words, length)
            asked = part.column("wanted")
            of, keys = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy())), asked.flatten().to_numpy()
            one = _first_of(text, content)
            one = one[_among(text[one], content[one], of, keys)]
            cut = np.concatenate(([0], np.cumsum(windows[one] + length - 1))) * 8
            flat = words[_ranges(begin[one], windows[one] + length - 1)]
            raw = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(content[one]), pa.array(minimizer[one]), part.column("doc").take(pa.array(text[one])), pa.array(windows[one].astype(np.int32)), raw], ["content", "minimizer", "doc", "windows", "words"]
            )

    joined = docs.join(lists, ["doc", "salt"]).select("doc", "text", "wanted")
    return joined.mapInArrow(emit, "content long, minimizer long, doc long, windows int, words binary")


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... of so many numbers each."""
    return np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _among(text: np.ndarray, content: np.ndarray, of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (text, content) are among (of, keys)."""
    both = np.stack((np.concatenate((of, text)), np.concatenate((keys, content))), 1)
    order = np.lexsort((np.arange(len(both)), both[:, 1], both[:, 0]))
    same = np.concatenate(([0], np.cumsum((np.diff(both[order], axis=0) != 0).any(1)))) if len(order) else order
    number = np.empty(len(both), np.int64)
    number[order] = same
    return np.isin(number[len(of) :], number[: len(of)])


def first_holders(reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """reference (content, minimizer, doc, windows, words) -> content, first: of each of its windows the smallest document."""
    shards = max(1, -(-reference.count() // SHARD_PASSAGES))
    numbered = reference.withColumn("shard", F.pmod(F.xxhash64("minimizer"), F.lit(shards)).cast("int"))
    sizes = numbered.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD_PASSAGES)).cast("int").alias("parts"))
    dealt = numbered.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("content"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    kept = ["shard", "content", "doc", "words"]
    # A cell (part a of the reference, part b of the streams); with one part the same rows are both.
    single = dealt.where("parts = 1").select(*kept, F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(2).alias("role"))
    refs = dealt.where("parts > 1").select(*kept, F.col("own").alias("a"), F.explode(every).alias("b"), F.lit(0).alias("role"))
    streams = dealt.where("parts > 1").select(*kept, F.explode(every).alias("a"), F.col("own").alias("b"), F.lit(1).alias("role"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        sequences = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        role, content = rows["role"].to_numpy(), rows["content"].to_numpy()
        known = np.flatnonzero(role != 1)
        out = {"content": [], "at": [], "first": []}
        stream = np.flatnonzero(role != 0)
        if len(known) and len(stream):
            automaton = Automaton([sequences[i] for i in known], rows["doc"].to_numpy()[known], length)
            sizes = np.array([len(sequences[i]) for i in stream])
            for size in np.unique(sizes):
                at = stream[sizes == size]
                for t, (matched, state) in enumerate(automaton.streamed(np.stack([sequences[i] for i in at]))):
                    hit = np.flatnonzero(matched >= length)
                    out["content"].append(content[at[hit]])
                    out["at"].append(np.full(len(hit), t - length + 1, np.int32))
                    out["first"].append(automaton.owner_of(state[hit]))
        return pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in out.items()})

    found = single.unionByName(refs).unionByName(streams).groupBy("shard", "a", "b").applyInPandas(one, "content long, at int, first long")
    return found.groupBy("content", "at").agg(F.min("first").alias("first"))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, any others) -> doc_id, n_words, removed (array of (start, words): maximal spans), kept (the other words,
    joined by one space)."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text", F.hash("text").alias("salt"))
    found = stored(_screened(docs.select("doc", "salt", "text"), length))
    shared = stored(found.groupBy("minimizer").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("minimizer"))
    live = stored(found.join(shared, "minimizer", "left_semi").drop("minimizer"))
    discard(found, shared)
    owners = live.groupBy("content").agg(F.min(F.struct("doc", "salt")).alias("o")).select("content", "o.doc", "o.salt")
    reference = stored(_words_of(docs, owners, length).dropDuplicates(["content"]))
    firsts = stored(first_holders(reference, length))
    hits = live.join(firsts, "content").where("first < doc")
    lists = stored(hits.groupBy("doc", "salt", "content").agg(F.collect_list("at").alias("at")).groupBy("doc", "salt").agg(F.collect_list(F.struct("content", "at")).alias("hits")))
    discard(live, reference, firsts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            yield _cut(part, length)

    out = docs.join(lists, ["doc", "salt"], "left").select("doc", "text", "hits").mapInArrow(emit, "doc_id long, n_words long, removed array<struct<start:int,words:int>>, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _cut(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """doc_id, n_words, removed and kept of rows (doc, text, hits)."""
    texts, hits = part.column("text"), part.column("hits")
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    cuts = split.offsets.to_numpy().astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(word)))[cuts - cuts[0]]
    gone = np.zeros(int(ends[-1]), bool)
    having = np.flatnonzero(pc.is_valid(hits).to_numpy(zero_copy_only=False))
    if len(having):
        some = texts.take(pa.array(having))
        own, words = hashed_words(some)
        text, begin, _, _, content = passages(own, words, length)
        each = hits.take(pa.array(having))
        inner = each.flatten()
        keys, ats = inner.field("content").to_numpy(), inner.field("at")
        of = np.repeat(np.arange(len(having)), np.diff(each.offsets.to_numpy()))
        # (text, content) of each hit beside all of the text's passages with that content.
        left = pd.DataFrame({"text": np.repeat(of, np.diff(ats.offsets.to_numpy())), "content": np.repeat(keys, np.diff(ats.offsets.to_numpy())), "at": ats.flatten().to_numpy()})
        met = left.merge(pd.DataFrame({"text": text, "content": content, "begin": begin}), on=["text", "content"])
        start = (met["begin"] + met["at"]).to_numpy() - own[met["text"].to_numpy()] + ends[having[met["text"].to_numpy()]]
        step = np.bincount(start, minlength=len(gone) + length + 1) - np.bincount(start + length, minlength=len(gone) + length + 1)
        gone = np.cumsum(step)[: len(gone)] > 0
    kept = np.ones(len(word), bool)
    kept[word] = ~gone
    kept &= word
    upto = np.concatenate(([0], np.cumsum(kept)))[cuts - cuts[0]]
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), flat.filter(pa.array(kept))), " ")
    text_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    new = gone & np.concatenate(([True], ~gone[:-1] | (np.diff(text_of) != 0))) if len(gone) else gone
    last = gone & np.concatenate((~gone[1:] | (np.diff(text_of) != 0), [True])) if len(gone) else gone
    begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    spans = pa.StructArray.from_arrays([pa.array((begin - ends[text_of[begin]]).astype(np.int32)), pa.array((end - begin).astype(np.int32))], ["start", "words"])
    offsets = np.searchsorted(text_of[begin], np.arange(len(ends))).astype(np.int32)
    return pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(offsets), spans), joined], ["doc_id", "n_words", "removed", "kept"])


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removed_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, doc_id, i, hash(list_slice(w, i, i + 12)) AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)
), f AS (SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS first FROM g GROUP BY s),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (s) WHERE first < coalesce(doc_id, 9223372036854775807)),
k AS (
  SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) e LEFT JOIN x ON x.r = e.r AND x.k = e.k WHERE x.k IS NULL GROUP BY e.r
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.r = w.r LEFT JOIN (SELECT r, count(*) AS n FROM x GROUP BY r) n ON n.r = w.r
"""
QUERIES = {"op13_substring_dedup": op13_substring_dedup}
ORACLES = {"op13_substring_dedup": OP13_SQL}
