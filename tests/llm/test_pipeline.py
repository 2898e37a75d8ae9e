"""The whole pipeline against a plain version of its stages, on the smallest tables."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from formledger.llm import packing, secret_scan
from tests.llm.test_operators import WORD, awkward, plain_components, plain_measures
from tests.oracle import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def plain_kept(text):
    w, chars, symbols, dup, repeat = plain_measures(text)
    lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
    bad = w < 10 or 100 * repeat > 20 * w or (symbols > 10 and 4 * symbols > w) or (lines >= 4 and 2 * dup > lines)
    return not (bad or (w >= 10 and not 2 * w <= chars <= 25 * w))


def test_stages_on_awkward_documents(spark, tmp_path):
    for rows in (awkward(spark), awkward(spark).limit(0)):
        docs = rows.withColumns({"rank": F.lit(1), "kept": F.lit("k"), "n_words": F.lit("w"), "ids": F.lit("i"), "first": F.lit(2)})
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).write.mode("overwrite").parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            if name != "packing":
                assert docs.columns == columns
                assert {r["kept"] for r in docs.collect()} <= {"k"}


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    kept = {d: r for d, r in rows.items() if plain_kept(r["text"] or "")}
    named = plain_components([(d, r["text"]) for d, r in kept.items()])
    want = {d for d, _, c in named if d == c}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            assert {r["doc_id"] for r in docs.collect()} == set(kept)
        if name == "ngram_join":
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "secret_scan":
            cleaned = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert cleaned == {d: secret_scan.redact(rows[d]["text"]) for d in want}
        if name == "mixing":
            copies = Counter(r["doc_id"] for r in docs.collect())
            assert set(copies) <= want and max(copies.values()) <= 2
    model = Tokenizer.from_file(packing.default_tokenizer())
    tokens = Counter()
    for r in docs.collect():
        tokens[r["doc_id"]] += r["length"]
    ids = {d: len(model.encode(cleaned[d], add_special_tokens=False).ids) + 1 for d in copies}
    assert tokens == Counter({d: n * ids[d] for d, n in copies.items()})
    assert not any(re.search("[0-9a-f]{24}", t) for t in cleaned.values())
    assert np.isfinite(len(tokens))


def test_packing_keeps_the_curriculum(spark, tmp_path):
    # Copies in training order, each twice, far apart; ids fall in no order.
    ids = [(i * 37) % 101 for i in range(1, 61)] * 2
    rows = [(d, f"word{d} " * 20, "ab"[n % 2]) for n, d in enumerate(ids)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string, source string")
    docs.where("source = 'a'").write.parquet(str(tmp_path / "one"))
    pieces = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "one")), SMALL).orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces if r["start"] == 0] == [d for d, _, s in rows if s == "a"]
    # In several buckets, each is a range of the order, and a document's copies part.
    docs.write.parquet(str(tmp_path / "two"))
    read = spark.read.parquet(str(tmp_path / "two"))
    pieces = packing.pack(read, bucket_tokens=800, place=packing.place_in_files()).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(ids)
    number = {b: i for i, b in enumerate(sorted({r["sequence_id"] // packing.STRIDE for r in pieces}))}
    buckets = [[] for _ in number]
    for r in pieces:
        if r["start"] == 0:
            buckets[number[r["sequence_id"] // packing.STRIDE]].append(r["doc_id"])
    assert len(buckets) > 3
    at = 0
    for b in buckets:
        assert Counter(b) == Counter(ids[at : at + len(b)])
        at += len(b)
