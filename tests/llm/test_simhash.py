import random
import re

import numpy as np
import pytest
import xxhash

from cellcube.llm import simhash
from cellcube.llm.components import components


def print_of(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    s = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def clustered(seed, n, bits=64):
    rng = random.Random(seed)
    base = [rng.getrandbits(bits) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(bits)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("seed,n,distance", [(1, 300, 2), (2, 700, 3), (3, 40, 0), (4, 200, 1)])
def test_near_pairs_match_brute_force(seed, n, distance):
    v = clustered(seed, n, 64 if seed != 4 else 12)
    got = {(int(a), int(b)) for x, y in simhash.near_pairs(v, None, distance) for a, b in zip(x, y)}
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if bin(int(v[i]) ^ int(v[j])).count("1") <= distance}
    assert got == want
    half = n // 2
    cross = {(int(a), int(b) + half) for x, y in simhash.near_pairs(v[:half], v[half:], distance) for a, b in zip(x, y)}
    assert cross == {(a, b) for a, b in want if a < half <= b}


def test_leaves_and_their_pairs_cover_all_links():
    v = clustered(7, 900)
    counts = np.bincount((v >> np.uint64(56)).astype(int), minlength=256)
    leaves = simhash.top_leaves(counts, 8, 20)
    where = [next(i for i, (d, p) in enumerate(leaves) if int(x) >> (64 - d) == p) for x in v]
    pairs = set(simhash.leaf_pairs(leaves, 2))
    for x, y in simhash.near_pairs(v, None, 2):
        for a, b in zip(x, y):
            assert tuple(sorted((where[a], where[b]))) in pairs
    assert len(pairs) < len(leaves) * (len(leaves) + 1) / 2


def test_forest():
    links = [(3, 1), (5, 4), (9, 8), (4, 3), (2, 2)]
    got = simhash.forest(10, iter([(np.array([a]), np.array([b])) for a, b in links]))
    assert got.tolist() == roots(10, links)


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 540)] + [(600, k) for k in range(601, 660)]
    want = roots(700, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(700))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("leaf", [4096, 4])
def test_documents(spark, docs, rows, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    more = [(300 + k, f"alpha beta gamma delta {k % 3} epsilon zeta eta theta iota kappa lambda mu nu xi", *[None] * 7) for k in range(12)]
    all_rows = rows + more
    table = spark.createDataFrame(all_rows, docs.schema).repartition(3)
    got = simhash.near_duplicates(table).collect()
    want_print = {i: print_of(t) for i, t, *_ in all_rows}
    assert len(got) == len(all_rows)
    assert all(r["fp"] % (1 << 64) == want_print[r["doc_id"]] for r in got)
    v = [print_of(t) for _, t, *_ in all_rows]
    n = len(v)
    root = roots(n, [(i, j) for i in range(n) for j in range(i + 1, n) if bin(v[i] ^ v[j]).count("1") <= 2])
    least = {}
    for (i, *_), r in zip(all_rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), least.get(r)) for (i, *_), r in zip(all_rows, root))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == want
    kept = simhash.deduplicate(table)
    assert kept.schema.simpleString() == table.schema.simpleString()
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*map(str, set(least.values())), "None"])


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0
