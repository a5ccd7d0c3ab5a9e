import hashlib
import random

import numpy as np
import pytest

from cellcube.llm import suffix


def brute(rows):
    first, out = {}, []
    known = [(np.iinfo(np.int64).max if i is None else i, i, (t or "").encode()) for i, t, *_ in rows]
    for key, _, t in known:
        for k in range(len(t) - 49):
            s = t[k:k + 50]
            first[s] = min(first.get(s, key), key)
    for key, i, t in known:
        m = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k:k + 50]] < key:
                m[k:k + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(t, m) if not x)
        out.append((str(i), len(t), sum(m), bytes(m).count(b"\0\1") + (m[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.digest(df).collect())


def test_fixture(docs, rows):
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_many_blocks_and_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix, "BLOCK", 1500)
    monkeypatch.setattr(suffix, "BUCKET", 4000)
    rng = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdefgh "
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(40, 130))) for _ in range(25)]
    rows = []
    for i in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(rng.randint(0, 5))]
        if rng.random() < 0.2:
            parts.append(rng.choice("xyz") * rng.randint(40, 300))
        rows.append((rng.choice([i, i, None, 7]), "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == brute(rows)


def test_multikey_sort():
    rng = np.random.default_rng(0)
    t = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    order, first = suffix.multikey_sort(t)
    got = [tuple(int(x[i]) for x in t) for i in order]
    assert got == sorted(got)
    assert first.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(500)]


def test_cut_keeps_whole_characters_and_columns(docs, rows):
    out = suffix.cut(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = out.collect()
    assert len(got) == len(rows)
    assert sum(r["text"] is None for r in got) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    want = {i: n for i, n in ((x[0], x[1] - x[2]) for x in brute(rows))}
    for r in got:
        if r["text"] is not None:
            assert want[str(r["doc_id"])] <= len(r["text"].encode()) <= want[str(r["doc_id"])] + 40


def test_empty(none):
    assert suffix.digest(none).count() == 0 and suffix.cut(none).count() == 0
