"""Fill-in-middle, hard negatives and substring dedup against plain versions, and on awkward tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formledger.llm import fill_in_middle, hard_negatives, substring_dedup
from tests.llm.test_operators import WORD, awkward, texts

# --- fill in middle


def plain_middle(doc_id, text, rate=100, spm_rate=50, unit="line"):
    text = text or ""
    units = list(text) if unit == "character" else text.splitlines(keepends=True) if not set(text) & set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") else [x + "\n" for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or c % 100 >= rate or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if d % 100 < spm_rate else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def lined(seed, count=60):
    rng = random.Random(seed)
    pieces = ["\n", "\n\n", "word ", "é漢\U0001f600", "\r\n", "<P", "<", "<S", ">", "a", " ", "\x0b"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(count)] + ["<P>x", "x\n<S>\ny", "<M>", "\n", "a", "a\n", "".join(f"line {i}\n" for i in range(20_000)), "z" * 300_000]


@pytest.mark.parametrize(("unit", "rate", "spm_rate"), [("line", 100, 50), ("character", 60, 0), ("line", 30, 100)])
def test_middle_as_plain(spark, unit, rate, spm_rate):
    docs = awkward(spark).select("doc_id", "text", "n", "token").union(spark.createDataFrame([(100 + i, t, 1, "x") for i, t in enumerate(lined(3))], "doc_id long, text string, n int, token string"))
    made = fill_in_middle.fill_in_middle(docs, rate=rate, spm_rate=spm_rate, unit=unit).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = [plain_middle(d, t, rate, spm_rate, unit) for d, t in texts(docs)]
    assert sorted((tuple(r)[:6] for r in made), key=repr) == sorted(want, key=repr)
    assert sorted(((r["doc_id"], r["back"]) for r in made), key=repr) == sorted(((d, t or "") for d, t in texts(docs)), key=repr)
    assert {r["form"] for r in made} >= {"plain"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, unit="page")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 400, 5000])
def test_skip_list_reaches_every_rank(n):
    rng = np.random.default_rng(n)
    chars, size = rng.integers(1, 9, n), rng.integers(1, 30, n)
    units = fill_in_middle.SkipList(chars, size)
    for rank in range(0, n + 1, max(1, n // 300)):
        assert units.before(rank) == (chars[:rank].sum(), size[:rank].sum())
    if n == 5000:  # a descent passes few links
        assert len(units.lanes) > 3
        assert max(len(links) for links, _ in units.lanes[-2:]) < 200


# --- hard negatives


def plain_negatives(rows, positives=5, negatives=3):
    kept = []
    for at, (i, label, e) in enumerate(rows):
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = [int(np.floor(256 * float(np.float32(x)))) for x in e]
        if sum(x * x for x in v) < 1 << 62:
            kept.append((at, i, label, v))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for at, i, label, v in kept:
        if i is None or i % 3:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, x, other) for x, j, other, w in kept if x != at and len(w) == len(v)]
        for p, j, _, _ in sorted((s for s in scored if s[3] == label), key=order)[:positives]:
            fit = sorted((s for s in scored if s[3] != label and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:negatives]
            out += [(i, j, k + 1, s[1], p, s[0]) for k, s in enumerate(fit)]
    return sorted(out, key=repr)


def vectors(seed, n=240, dim=6, long=1.0):
    """Clusters, copies, short and long vectors, ties, and rows that take no part."""
    rng, out = random.Random(seed), []
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    for i in range(n):
        c = rng.choice(centres)
        size = rng.choice((0.05, 0.3, 1.0, 1.0, 4.0)) * long
        out.append((i, rng.randrange(4), [size * (x + rng.gauss(0, rng.choice((0.0, 0.02, 0.4)))) for x in c]))
    nan, inf = float("nan"), float("inf")
    out += [(7, 1, out[7][2]), (None, 2, out[9][2]), (None, None, out[9][2]), (500, 1, None), (501, 1, [nan] * dim), (502, 1, [inf] + [0.0] * (dim - 1)), (503, 1, [None] * dim)]
    out += [(600, 1, []), (601, 1, []), (602, 2, []), (603, 1, [1.0, 2.0]), (604, 2, [0.9, 1.0]), (606, 1, [1.5, 1.0]), (609, 1, [0.0] * dim), (612, 3, [3.0e38] * dim)]
    return out


@pytest.mark.parametrize(("seed", "long", "cells", "bucket"), [(1, 1.0, 1 << 20, 8192), (2, 1.0, 60, 7), (3, 3.0e3, 200, 16), (4, 2.0e6, 1 << 20, 64)])
def test_negatives_as_plain(spark, monkeypatch, seed, long, cells, bucket):
    monkeypatch.setattr(hard_negatives, "SLICE_CELLS", cells)
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", cells)
    rows = vectors(seed, 120 if cells < 1000 else 240, long=long)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, id int, row string").coalesce(1)
    assert bucket  # rows a bucket are set in the worker by test_buckets
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("id") % 3 == 0).collect()), key=repr)
    assert got == plain_negatives(rows)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(empty, F.col("id") % 3 == 0).count() == 0


@pytest.mark.parametrize("size", [3, 40, 8192])
def test_buckets_prune_and_lose_nothing(monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", size)
    rng = np.random.default_rng(size)
    centres = rng.normal(0, 1, (12, 5))
    made = lambda n: np.floor(256 * rng.choice((0.2, 1.0, 3.0), (n, 1)) * (centres[rng.integers(0, 12, n)] + rng.normal(0, 0.02, (n, 5)))).astype(np.int64)
    rows, anchors = made(700), made(30)
    as_dict = lambda v, at: {"vectors": v, "length": np.sqrt((v * v).sum(1).astype(float)), "label": np.arange(at, at + len(v)) % 3, "row": np.arange(at, at + len(v)), "id": np.arange(at, at + len(v)) // 2}
    r, q = as_dict(rows, 1000), as_dict(anchors, 0)
    top = (anchors @ rows.T).max(axis=1)
    low, high = np.repeat(top * 0.8, 2), np.repeat(top * 0.95, 2)
    high[1::2] = np.inf
    looked = []
    plain = hard_negatives.Best.add
    monkeypatch.setattr(hard_negatives.Best, "add", lambda self, a, b, c, d: (looked.append(len(a)), plain(self, a, b, c, d)))
    best = hard_negatives.search(q, {"anchor": np.repeat(np.arange(30), 2), "low": low, "high": high}, r, 4, False)
    got = sorted(zip(best.request.tolist(), best.score.tolist(), best.row.tolist(), strict=True))
    want = []
    for n in range(60):
        s = anchors[n // 2] @ rows.T
        fit = [(-s[j], r["id"][j], r["row"][j]) for j in range(700) if low[n] <= s[j] <= high[n] and r["label"][j] != q["label"][n // 2]]
        want += [(n, int(-a), int(c)) for a, _, c in sorted(fit)[:4]]
    assert got == sorted(want)


def test_feasible_ranges_hold_all_partners():
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (4000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    for q in v[:20]:
        for least in (-0.9, -0.2, 0.0, 0.5, 0.95):
            near = v[v @ q >= least]
            for f in range(3):
                low, high = hard_negatives.feasible(q[f : f + 1], np.array([least]))
                assert len(near) == 0 or (low[0] <= near[:, f].min() and near[:, f].max() <= high[0])
                assert not len(near) or near[:, f].max() > high[0] - 0.2  # and no wider than need be


# --- substring dedup


def plain_dedup(rows, length=13):
    words = [WORD.findall(t or "") for _, t in rows]
    key = lambda d: (d is None, d or 0)
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            first[g] = min(first.get(g, key(d)), key(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < key(d) for j in range(i, i + length)}
        starts = sorted(j for j in gone if j - 1 not in gone)
        spans = [(s, next(k for k in range(s, len(w) + 1) if k not in gone) - s) for s in starts]
        out.append((d, len(w), spans, " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def sharing(seed, count=70):
    """Texts that share passages of all lengths around a window, copies with edits, repeats within, and few words."""
    rng = random.Random(seed)
    common = [[f"c{k}w{rng.randrange(60)}" for _ in range(rng.choice((12, 13, 14, 20, 26, 80)))] for k in range(9)]
    rows = []
    for i in range(count):
        w = []
        for _ in range(rng.randrange(6)):
            part = list(rng.choice(common))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            a = rng.randrange(3)
            w += [f"u{rng.randrange(40)}" for _ in range(rng.randrange(9))] + part[a : len(part) - rng.randrange(3)]
        rows.append((rng.choice((i, i, i, 3, None)), rng.choice((" ", "\n", " \t ")).join(w)))
    rows += [(200 + i, "the same line of ten words stands in all texts " + f"x{i} y{i % 7} z{i % 3} end of text {i} is here now ok") for i in range(40)]
    rows += [(300 + i, " ".join("ab"[rng.randrange(2)] for _ in range(200))) for i in range(6)] + [(400, "a " * 60), (401, "a " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "length", "passages"), [(1, 13, 1 << 15), (2, 13, 8), (3, 5, 50), (4, 8, 3)])
def test_dedup_as_plain(spark, monkeypatch, seed, length, passages):
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", passages)
    rows = sharing(seed) + texts(awkward(spark))
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, content int, minimizer string, doc int").repartition(3)
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["removed"]], r["kept"]) for r in substring_dedup.removed_spans(docs, length).collect()]
    assert sorted(got, key=repr) == plain_dedup(rows, length)
    if passages > 8:
        assert substring_dedup.removed_spans(docs.limit(0), length).count() == 0


@pytest.mark.parametrize("alphabet", [2, 5, 300])
def test_matching_statistics(alphabet):
    rng = np.random.default_rng(alphabet)
    known = [rng.integers(0, alphabet, rng.integers(1, 25)).astype(np.uint64) for _ in range(60)]
    asked = rng.integers(0, alphabet + 1, (50, 20)).astype(np.uint64)
    asked[:20, :12] = np.array([np.resize(known[i], 12) for i in range(20)])
    owner = rng.permutation(60).astype(np.int64)
    automaton = substring_dedup.Automaton(known, owner, 4)
    held = [{tuple(k[i:j].tolist()) for i in range(len(k)) for j in range(i + 1, len(k) + 1)} for k in known]
    for t, (matched, state) in enumerate(automaton.streamed(asked)):
        found = automaton.owner_of(state)
        for n, word in enumerate(asked):
            ends = [tuple(word[t + 1 - m : t + 1].tolist()) for m in range(1, t + 2)]
            longest = max((len(e) for e in ends if any(e in h for h in held)), default=0)
            assert matched[n] == longest
            if longest >= 4:
                assert found[n] == min(o for o, h in zip(owner, held, strict=True) if ends[3] in h)


def test_equal_windows_share_their_minimizer():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 50, 400).astype(np.uint64)
    words[250:330] = words[40:120]
    text, begin, windows, minimizer, content = substring_dedup.passages(np.array([0, 200, 200, 400]), words, 13)
    of = {int(b) + i: (int(m), int(c)) for b, n, m, c in zip(begin, windows, minimizer, content, strict=True) for i in range(n)}
    assert sorted(of) == [i for i in range(400 - 12) if not 188 <= i < 200]
    assert all(of[40 + i][0] == of[250 + i][0] for i in range(68))
    assert sum(of[40 + i] == of[250 + i] for i in range(68)) > 50
