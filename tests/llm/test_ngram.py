import collections
import math
import re
import zlib

import numpy as np
import pytest

from cellcube.llm import ngram
from cellcube.llm.eliasfano import WORD_BITS, EliasFano, Trie, from_code, mapped, to_code


@pytest.mark.parametrize("n,universe", [(0, 5), (1, 1), (10, 10), (1000, 1 << 40), (5000, 6000), (300, 1 << 64)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    e = EliasFano.build(v, universe)
    assert (e.access(np.arange(n)) == v).all()
    x = np.concatenate([rng.integers(0, universe - 1, 200, dtype=np.uint64, endpoint=True), v])
    assert (e.successor(x) == np.searchsorted(v, x)).all()
    if n >= 1000:
        assert len(e.low) + e.high.nbytes < n * (3 + np.log2(universe / n)) / 8 + 300


def test_trie_round_trip():
    rng = np.random.default_rng(3)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 800) * 10**15, rng.integers(0, 1 << WORD_BITS, 800))})
    c, w = (np.array(x, np.uint64) for x in zip(*pairs))
    p = rng.uniform(1e-6, 1, len(c))
    with mapped(Trie.build(c, w, p)) as trie:
        assert isinstance(trie.codes, np.memmap)
        assert (trie.codes_of(c, w) == to_code(p)).all()
        assert (trie.codes_of(c, w ^ np.uint64(1)) == [to_code(p[pairs.index(q)]) if (q := (int(a), int(b) ^ 1)) in pairs else 0 for a, b in pairs]).all()
        assert not trie.codes_of(c + np.uint64(5), w).any()
    assert np.abs(np.log10(from_code(to_code(p))) - np.log10(p)).max() <= 10 / 254 / 2 + 1e-9
    empty = np.zeros(0, np.uint64)
    assert Trie.build(empty, empty, empty.astype(float)).codes_of(c, w).sum() == 0


def brute(rows):
    text = [(i, re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [b""]) for i, t, *_ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in text]
    c, pair, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for (_, t), h in zip(text, held):
        if not h:
            c.update(t)
            for v, w in zip([b"\0", *t], t):
                pair[v, w] += 1
                ctx[v] += 1
    kinds = collections.Counter(v for v, _ in pair)
    n, size = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(text, held):
        p1 = [(c[w] + 1) / (n + size + 1) for w in t]
        score = sum(math.log10((pair[v, w] + kinds[v] * p) / (ctx[v] + kinds[v]) if ctx[v] else p) for v, w, p in zip([b"\0", *t], t, p1))
        out.append((str(i), h, len(t), sum(c[w] > 0 for w in t), n, sum(map(math.log10, p1)), score))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_scores(docs, rows, monkeypatch, small):
    if small:
        monkeypatch.setattr(ngram, "BLOCK", 3000)
        monkeypatch.setattr(ngram, "BUCKET", 6000)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in ngram.score(docs).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        # quantised probabilities; one tolerance for any number of shards
        assert a[6] == pytest.approx(b[6], abs=0.025 * a[2])


@pytest.mark.parametrize("bucket", [1 << 30, 20000, 4000])
def test_parted_contexts_are_smoothed_whole(spark, monkeypatch, bucket):
    """A context that half of all tokens follow: one tolerance for any number of shards."""
    monkeypatch.setattr(ngram, "BLOCK", 3000)
    monkeypatch.setattr(ngram, "BUCKET", bucket)
    rows = [(i, " ".join(f"the w{i * 37 + k * 5} of" if k % 3 else f"the v{k}" for k in range(60))) for i in range(80)]
    got = ngram.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["score"]) for r in got)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:3] == b[:3]
        assert a[3] == pytest.approx(b[6], abs=0.025 * a[2])


def test_probabilities_sum_to_one(spark):
    """Over all continuations of a context, by scoring one-word texts after the begin."""
    rows = [(i, t) for i, t in enumerate(["a b", "a c", "b", "a", "c c c", "", "b a"] * 3)]
    df = spark.createDataFrame(rows + [(100 + k, w) for k, w in enumerate("abc")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngram.score(df, 1, 5).collect()}
    assert all(r["score"] <= 0 and not r["held_out"] for r in got.values())
    assert got[100]["score"] > got[102]["score"]


def test_empty(none):
    assert ngram.score(none).count() == 0
