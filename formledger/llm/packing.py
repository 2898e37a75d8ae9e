"""Mixture-controlled packing: deficit round-robin over source queues fills fixed windows with tokens.

Documents are tokenised once and dealt by a hash of the id and the row into buckets of about BUCKET_TOKENS tokens. A bucket is one
task's work: its sources are queues, visited in turn; each visit adds the source's share of a window to its deficit and
serves pieces against it. A document goes whole if the deficit and OVERDRAW cover it, else in pieces of OVERDRAW tokens
or more, so that small sources wait for a fair turn and are not cut to crumbs. Deficits run on from window to window, and
from bucket to bucket: a bucket starts with what each source is owed by all buckets before it, a prefix sum over one row
a (bucket, source). Every id lies in one piece; the rest of a bucket is laid out in powers of two, so nothing is padded.

With a place (a training order: the pipeline's), buckets are ranges of it and queues stand in its order, so sequence ids follow
it up to a bucket. A source's share is then its share of the bucket, which serves all that it holds: nothing is owed beyond it.

Defined results: a null or empty text is its end id alone; a null source is a queue of its own; repeated rows and ids
are separate documents; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
from collections import deque
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formledger.llm.common import durable, slices, summed_before, table

WINDOW, END_ID = 2048, 1
BUCKET_TOKENS, OVERDRAW = 1 << 21, 256
#: Sequence ids of a bucket start at this multiple of its number.
STRIDE = 1 << 32
#: A place is the number of a file and, in the lower bits, of a row in it.
PLACE_BITS = 40
#: Bytes of text whose chunks are told apart at once, words that are encoded at once, and texts that are laid out at once.
SLICE_BYTES, BATCH_WORDS, SLICE_TEXTS = 8 << 20, 20_000, 256
BROADCAST_BLOCKS = 1_000_000
#: How the tokenizer parts a chunk without special tokens into words.
_WORD = regex.compile(r"(?i)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Marks that the tokenizer keeps together as one word.
_MARKS = ".,;:!?#$%&*"
_cache: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words on which the tokenizer with and without its normalizer and word rule must agree.
_PROBE = "the of straße naïve übergrößen señor kitab слово 漢字 日本語 zqxjkv"


def ids_by(model, text: str) -> list[int]:
    return model.encode_batch_fast([text], add_special_tokens=False)[0].ids


def encoder(path: str):
    """texts -> by parts of them: the first text's number, all ids as unsigned 16- or 32-bit numbers, and where each
    text's end; and that dtype.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its white-space-separated
    chunks; each distinct chunk of many texts is encoded once. (Only the six ASCII spaces part chunks: other ones stay within.)
    """
    if path not in _cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; Spark runs the others
        from tokenizers import Tokenizer, pre_tokenizers

        model = Tokenizer.from_file(path)
        last = np.zeros(model.get_vocab_size(), bool)
        for piece, number in model.get_vocab().items():
            last[number] = piece.endswith("</w>")
        # Words of lower-case letters in normal form need neither normalizer nor word rule.
        bare = Tokenizer(model.model)
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        bare = bare if ids_by(bare, _PROBE) == ids_by(model, _PROBE) else model
        _cache[path] = (model, bare, np.dtype("<u2" if len(last) <= 1 << 16 else "<u4"), last)
    model, bare, dtype, last = _cache[path]

    def cuts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each one's end (0 first)."""
        joined = "\n".join(texts)
        if "<|" not in joined:  # a special token is no word
            # A text of letters is one word of the tokenizer; others are split by its rule.
            counts = [1 if t.isalpha() and t.lower().isalpha() else len(_WORD.findall(unicodedata.normalize("NFC", t))) for t in texts]
            ids = np.array(ids_by(model, joined), dtype)
            ends = np.concatenate(([0], np.flatnonzero(last[ids]) + 1))  # a word's last piece says so
            bounds = np.cumsum([0, *counts])
            if len(ends) == bounds[-1] + 1 and ends[-1] == len(ids):
                return ids, ends[bounds]
        found = model.encode(joined, add_special_tokens=False)
        begins = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        return np.array(found.ids, dtype), np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts]))

    def words_of(words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """As cuts_of, for words of letters, or of marks, alone; None if the tokenizer sees them otherwise."""
        text = "\n".join(words)
        plain = unicodedata.is_normalized("NFC", text) and not any(c in text for c in _MARKS)
        ids = np.array(ids_by(bare if plain else model, text), dtype)
        ends = np.concatenate(([0], np.flatnonzero(last[ids]) + 1))
        return (ids, ends) if len(ends) == len(words) + 1 else None

    def pieces_of(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two numbers for each chunk, and the ids and lengths of what they stand for; 0 stands for nothing."""
        # Most chunks are letters with marks behind them: two words of the tokenizer, which drops case. (Not so with a
        # sigma, whose lower case depends on its place.)
        low = "\n".join(chunks).lower().split("\n") if chunks else []
        stems = [x.rstrip(_MARKS) for x in low]
        marks = [x[len(y) :] for x, y in zip(low, stems, strict=True)]
        plain = [(not y or y.isalpha()) and "\u03a3" not in c for c, y in zip(chunks, stems, strict=True)]
        ids, lengths, number = [np.zeros(0, dtype)], [np.zeros(1, np.int64)], {"": 0}
        for words in (set(compress(stems, plain)), set(compress(marks, plain))):
            words = list(words.difference(number))
            for at in range(0, len(words), BATCH_WORDS):
                some = words[at : at + BATCH_WORDS]
                if found := words_of(some):
                    number.update(zip(some, range(len(number), len(number) + len(some)), strict=True))
                    ids.append(found[0])
                    lengths.append(np.diff(found[1]))
        if len(ids) > 1 and len(number) < len(set(compress(stems, plain)).union(compress(marks, plain), [""])):
            plain = [p and y in number and m in number for p, y, m in zip(plain, stems, marks, strict=True)]
        is_plain = np.array(plain, bool)
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[is_plain] = np.fromiter(map(number.__getitem__, compress(stems, plain)), np.int64)
        second[is_plain] = np.fromiter(map(number.__getitem__, compress(marks, plain)), np.int64)
        other = [c for c, p in zip(chunks, plain, strict=True) if not p]
        first[~is_plain] = len(number) + np.arange(len(other))
        for at in range(0, len(other), BATCH_WORDS):
            found, ends = cuts_of(other[at : at + BATCH_WORDS])
            ids.append(found)
            lengths.append(np.diff(ends))
        return first, second, np.concatenate(ids), np.concatenate(lengths)

    def encode(texts: pa.Array, end_id: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        first, second, ids, lengths = pieces_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        if end_id is not None:
            first, second = np.append(first, len(lengths)), np.append(second, 0)
            ids, lengths = np.append(ids, np.array([end_id], dtype)), np.append(lengths, 1)
        starts = np.cumsum(lengths) - lengths
        offsets, indices = split.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy()
        offsets = offsets - offsets[0]
        for begin in range(0, len(texts), SLICE_TEXTS):
            some = offsets[begin : begin + SLICE_TEXTS + 1]
            at = indices[some[0] : some[-1]]
            some = some - some[0]
            if end_id is not None:  # one more chunk behind each text
                at = np.insert(at, some[1:], len(first) - 1)
                some = some + np.arange(len(some))
            each = np.stack((first[at], second[at]), 1).ravel()
            n = lengths[each]
            ends = np.concatenate(([0], np.cumsum(n)))
            yield begin, ids[np.repeat(starts[each] - ends[:-1], n) + np.arange(ends[-1])], ends[2 * some]

    return encode, dtype


def tokenized(docs: DataFrame, path: str, end_id: int | None = END_ID, place: Column | None = None) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, source, hash (or place), n, ids (with the end id)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, dtype = encoder(path)
        for part in slices(batches, SLICE_BYTES):
            for begin, ids, ends in encode(part.column("text"), end_id):
                n = np.diff(ends)
                raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * dtype.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                own = part.slice(begin, len(n))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("source"), own.column("hash"), pa.array(n), raw], ["doc_id", "source", "hash", "n", "ids"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", (F.xxhash64("doc_id", F.monotonically_increasing_id()) if place is None else place).alias("hash"), "text")
    return named.mapInArrow(emit, "doc_id long, source string, hash long, n long, ids binary")


def capacities(total: int, window: int = WINDOW) -> Iterator[int]:
    """Sequence lengths for so many tokens: full windows, then the powers of two that make up the rest."""
    for _ in range(total // window):
        yield window
    rest = total % window
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            yield 1 << bit


def round_robin(queues: list[deque], shares: list[float], owed: list[float], window: int, overdraw: int) -> Iterator[tuple]:
    """(document, start, length) until all queues are empty. queues: of [document, served, tokens]; owed: deficits to begin with."""
    owed = list(owed)
    live = [s for s in range(len(queues)) if queues[s]]
    while live:
        whole = sum(shares[s] for s in live) or 1.0
        for s in list(live):
            owed[s] += max(window * shares[s] / whole, 1.0 / window)
            queue = queues[s]
            while queue:
                doc, done, n = queue[0]
                if n - done <= owed[s] + overdraw and owed[s] > 0:
                    take = n - done
                    queue.popleft()
                elif owed[s] >= overdraw:
                    take = min(int(owed[s]), n - done)
                    queue[0][1] += take
                    if queue[0][1] == n:
                        queue.popleft()
                else:
                    break
                owed[s] -= take
                yield doc, done, take
            if not queue:
                live.remove(s)
        # If all are in debt, nobody can be served for a while: forgive alike.
        if live and (most := max(owed[s] for s in live)) < 0:
            for s in live:
                owed[s] -= most


def place_in_files() -> Column:
    """Where a row stands in a sorted table that Spark wrote: file after file, row after row."""
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return F.shiftleft(file, PLACE_BITS) + F.col("_metadata.row_index")


def _ranges(tokens: DataFrame, rows: int, total: int, bucket_tokens: int) -> DataFrame:
    """tokens with the bucket of their place: blocks of rows, about 16 a bucket, go to buckets by the tokens before them."""
    height = max(1, bucket_tokens * rows // (16 * max(total, 1)))
    file = F.shiftright("hash", PLACE_BITS)
    keyed = tokens.withColumn("file", file).withColumn("block", F.floor((F.col("hash") - F.shiftleft(file, PLACE_BITS)) / height))
    sums = keyed.groupBy("file", "block").agg(F.sum("n").alias("n"))
    ahead = summed_before(sums.groupBy("file").agg(F.sum("n").alias("n")), "file", "n", "ahead").drop("n")
    blocks = summed_before(sums, "block", "n", "inside", "file").join(ahead, "file")
    blocks = blocks.select("file", "block", F.floor((F.col("ahead") + F.col("inside")) / bucket_tokens).alias("bucket"))
    # About 16 rows a bucket: broadcast while they are few, else joined by a shuffle.
    return keyed.join(F.broadcast(blocks) if rows // height <= BROADCAST_BLOCKS else blocks.hint("merge"), ["file", "block"]).drop("file", "block")


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int | None = END_ID,
    overdraw: int = OVERDRAW,
    bucket_tokens: int = BUCKET_TOKENS,
    place: Column | None = None,
) -> DataFrame:
    """docs (doc_id, source, text) -> pieces, PIECES: ids are little-endian unsigned 32-bit numbers."""
    tokens = durable(tokenized(docs, tokenizer or default_tokenizer(), end_id, place))
    total, rows = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(1, -(-total // bucket_tokens))
    tokens = tokens.withColumn("bucket", F.pmod("hash", F.lit(buckets))) if place is None else _ranges(tokens, rows, total, bucket_tokens)
    sums = tokens.groupBy("bucket", "source").agg(F.sum("n").alias("n"))
    # One row a bucket and source, and a bucket holds millions of tokens: small next to the documents.
    ahead = summed_before(sums.groupBy("bucket").agg(F.sum("n").alias("all")), "bucket", "all", "before")
    shares = sums.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    # A source that skips a bucket is owed for it at its next one, so only the pairs that occur are needed.
    had = sums.join(ahead.select("bucket", "before"), "bucket").alias("a").join(
        shares.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source"))
    ).select("a.bucket", "a.source", "s.share", "a.before", "a.n")
    owed = summed_before(had, "bucket", "n", "served", "source").withColumn("owed", F.col("share") * F.col("before") - F.col("served"))
    if place is not None:
        owed = sums.join(ahead, "bucket").select("bucket", "source", (F.col("n") / F.greatest("all", F.lit(1))).alias("share"), F.lit(0.0).alias("owed"))
    owed = owed.select(F.col("bucket").alias("of"), F.col("source").alias("queue"), "share", "owed")

    def fill(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("queue", na_position="last", ignore_index=True)
        number = {None if pd.isna(s) else s: i for i, s in enumerate(right["queue"])}
        left = left.sort_values(["hash", "doc_id", "n"], ignore_index=True)
        sizes = left["n"].tolist()
        sources = [None if pd.isna(s) else s for s in left["source"]]
        queues: list[deque] = [deque() for _ in number]
        for i, s in enumerate(sources):
            queues[number[s]].append([i, 0, sizes[i]])
        lengths = capacities(sum(sizes), window)
        rows, sequence, offset, room = [], int(key[0]) * STRIDE - 1, 0, 0
        for doc, start, take in round_robin(queues, right["share"].tolist(), right["owed"].tolist(), window, overdraw):
            while take:
                if not room:
                    room, offset, sequence = next(lengths), 0, sequence + 1
                part = min(room, take)
                rows.append((doc, start, part, sequence, offset))
                start, take, room, offset = start + part, take - part, room - part, offset + part
        at, starts, parts, numbers, offsets = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 5
        raw = left["ids"].tolist()
        wide = [np.frombuffer(raw[d], f"<u{len(raw[d]) // max(1, sizes[d])}")[s : s + p].astype("<u4").tobytes() for d, s, p in zip(at, starts, parts, strict=True)]
        return pd.DataFrame(
            {
                "doc_id": left["doc_id"].take(at).reset_index(drop=True), "source": [sources[d] for d in at], "start": starts, "length": parts,
                "doc_tokens": [sizes[d] for d in at], "sequence_id": numbers, "offset": offsets, "ids": wide,
            }
        )

    return tokens.groupBy("bucket").cogroup(owed.groupBy("of")).applyInPandas(fill, PIECES)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


QUERIES = {"op9_packing": op9_packing}
ORACLES: dict[str, str] = {}
