import math

import numpy as np
import pytest

from cellcube.llm import negatives


def brute(rows, every=100, k=5, low=80, high=100):
    """anchor, positive, rank, negative, scores; plain whole numbers."""
    ok = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        w = [math.floor(256.0 * c) for c in v]
        if sum(c * c for c in w) < 2 ** 62:
            ok.append((i, label, w))
    out = []
    for i, label, w in ok:
        if i % every:
            continue
        near = [(-sum(a * b for a, b in zip(w, x)), j, m) for j, m, x in ok if j != i and len(x) == len(w)]
        for p, j, _ in sorted(n for n in near if n[2] == label)[:k]:
            best = sorted(n for n in near if n[2] != label and low * -p <= 100 * -n[0] <= high * -p)[:k]
            out += [(i, j, r + 1, b, -p, -s) for r, (s, b, _) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, m, v, "x") for i, m, v in rows], "vec_id long, label int, embedding array<double>, no string").repartition(3)
    return sorted(tuple(r) for r in negatives.mine(df, **options).collect())


@pytest.mark.parametrize("tile", [4 << 20, 256 * 8])
def test_against_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(30, 16))
    x = np.float32(centre[rng.integers(0, 30, 900)] + .2 * rng.normal(size=(900, 16))).astype(float)
    rows = [(i, int(i * 7 % 4), v) for i, v in enumerate(x.tolist())]
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, rows, tile_bytes=tile) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [float(i % 5), 1.0]) for i in range(60)]                     # many ties
    rows += [(100, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 1, [nan, 1.0]), (500, 1, [inf, 1.0]),
             (600, 1, [1e200, 1.0]), (700, 1, []), (701, 1, []), (702, 2, []), (800, 0, [1.0]), (801, 0, [2.0]), (802, 1, [1.7]), (900, 1, [-3.0, 0.5]),
             (1000, 2, [-1e6, 3e6]), (1001, 2, [-1e6, 3e6 - 1]), (1002, 1, [-1e6, 2.9e6]), (1003, 1, [-9e5, 2.9e6]),
             (20, 2, [0.0, 1.0]), (20, 2, [0.0, 1.0]), (21, 0, [1.0, 1.0])]         # repeated rows, as partner and as anchor
    assert run(spark, rows, every=20) == brute(rows, every=20)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == []
    assert run(spark, [(None, None, None)]) == []


@pytest.mark.parametrize("size", [3, 300, 10 ** 6, 2 * 10 ** 8])
def test_scores_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (20, 150)), rng.integers(-size, size + 1, (31, 150))
    a[0], b[0] = size, -size
    by = negatives.primes(int(150 * size * size))
    got = negatives.scores([negatives.residues(a, p) for p in by], [negatives.residues(b, p) for p in by], by)
    want = a.astype(object) @ b.T.astype(object)
    assert all(abs(int(w)) < 2 ** 63 for w in want.ravel())
    assert (got == want).all()


def test_shares_at_the_ends_of_64_bits():
    score = np.array([0, 1, 5, 99, 101, -1, -99, 2 ** 62, -2 ** 62, 2 ** 62 - 1], np.int64)
    for share in (80, 100):
        assert negatives._share(score, share, True).tolist() == [-(-int(s) * share // 100) for s in score]
        assert negatives._share(score, share, False).tolist() == [int(s) * share // 100 for s in score]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, size):
    import duckdb

    from cellcube.llm import queries

    folder = f"/root/testdata/{size}"
    want = duckdb.sql(queries.ORACLES["op13_hard_negatives"].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'"))
    got = queries.op13_hard_negatives(spark, folder)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and len(rows) > 20
