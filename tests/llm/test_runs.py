import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellcube.llm import queries, runs


def brute(w, least=24, repeats=3):
    """Runs of a list of words from the definition: every period, every stretch, the smallest period of each."""
    n, found = len(w), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, e - a, q) for (a, e), q in found.items())


def collapse(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def digest(doc_id, text):
    """One row of the query, with its planting, from the contract."""
    w = (text or "").split() if text is None or text.isascii() else [x for x in text.replace("\n", " ").replace("\t", " ").split(" ") if x]
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()      # noqa: E731
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapse(w, found)))


def made(rng):
    n, kinds = rng.choice([0, 3, 24, 30, 100, 400]), rng.choice([1, 2, 3, 30])
    w = [str(rng.randint(1, kinds)) for _ in range(n)]
    if n > 20 and rng.random() < .8:
        a, p = rng.randrange(n), rng.randint(1, 90)
        w = w[:a] + [w[a:a + p][i % len(w[a:a + p])] for i in range(n - a)]
        if rng.random() < .3:
            w[rng.randrange(n)] = "x"
    return w


@pytest.mark.parametrize("seed", range(4))
def test_against_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [made(rng) for _ in range(rng.randint(1, 6))]
        n, found, collapsed = runs._some(pa.array([rng.choice([" ", " \n ", "\t"]).join(w) for w in docs]), 24, 3)
        assert n.to_pylist() == list(map(len, docs))
        for w, got, text in zip(docs, found.to_pylist(), collapsed.to_pylist()):
            want = brute(w)
            assert [tuple(r.values()) for r in got] == want
            assert text == collapse(w, want)


def test_no_run_is_lost_at_any_period_and_place():
    for q in range(1, 70):
        for shift in (0, 1, 5, 13):
            n = max(24, 3 * q)
            w = [f"p{i}" for i in range(shift)] + [f"w{i % q}" for i in range(n)] + ["z"]
            _, found, _ = runs._some(pa.array([" ".join(w)]), 24, 3)
            assert [tuple(r.values()) for r in found.to_pylist()[0]] == [(shift, n, q)]
            _, found, _ = runs._some(pa.array([" ".join(w[:shift + n - 1])]), 24, 3)
            assert found.to_pylist() == [[]]


@pytest.mark.parametrize("p", list(runs.MODULI))
def test_transform(p):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, p, (3, 32), np.uint64), rng.integers(0, p, (3, 32), np.uint64)
    assert (runs.back(runs.transform(a, p), p) == a).all()
    got = runs.back(runs.transform(a, p) * runs.transform(b, p) % np.uint64(p), p)
    for x, y, z in zip(a.tolist(), b.tolist(), got.tolist()):
        assert z == [sum(x[i] * y[k - i] for i in range(32)) % p for k in range(32)]


def test_occurrences_need_every_word():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400)
    padded = np.concatenate([words, np.full(64, 3)])
    starts = np.arange(0, 400 - 16, 16)
    got = set(zip(*(x.tolist() for x in runs.occurrences(padded, starts, 16, 4))))
    assert got == {(s, d) for s in starts.tolist() for d in range(1, 32) if (padded[s:s + 16] == padded[s + d:s + d + 16]).all()}
    # values whose squared differences would vanish modulo one prime
    big = 2_013_265_921
    padded = np.array([0] * 8 + [big % (1 << 31)] * 8 + [7] * 32)
    assert runs.occurrences(padded, np.array([0]), 8, big + 1)[0].tolist() == []


def test_long_texts_of_few_words():
    assert runs._some(pa.array(["a " * 200_000]), 24, 3)[1].to_pylist() == [[{"start": 0, "length": 200_000, "period": 1}]]
    text = " ".join(str(i % 4001) for i in range(40_000))
    n, found, collapsed = runs._some(pa.array([text, None, "", text]), 24, 3)
    assert found.to_pylist() == [[{"start": 0, "length": 40_000, "period": 4001}], [], [], [{"start": 0, "length": 40_000, "period": 4001}]]
    assert collapsed[0].as_py() == " ".join(map(str, range(4001))) and n.to_pylist() == [40_000, 0, 0, 40_000]


def test_query_against_the_contract(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(made(rng))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, "a " * 40), (5, rows[5][1]), (5, rows[5][1]), (-3, "über naïve\nx " * 30), (None, None)]
    rows += [(i, " ".join(str(rng.randint(0, 40)) for _ in range(250))) for i in range(2000, 2100)]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], "doc_id long, text string, runs string, n int, h string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [digest(i, t) for i, t in rows]
    assert sum(w[1] > 0 for w in want) > 50
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_empty(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
