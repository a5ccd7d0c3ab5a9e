import numpy as np
import pytest

from cellcube.llm import hnsw


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, float)
    out = {}
    for q in (i for i in ok if i % every == 0):
        near = sorted((-float((ok[q] * x).sum() / (np.sqrt((x * x).sum()) * np.sqrt((ok[q] * ok[q]).sum()))), i)
                      for i, x in ok.items() if i != q and len(x) == len(ok[q]))[:k]
        out[q] = near
    return out


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, 3000)] + .25 * rng.normal(size=(3000, 24))
    rows = [(i, v) for i, v in enumerate(np.float32(x).astype(float).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, 5, 50, shard_size=700).toPandas()
    want = brute(rows, 5, 50)
    hit = sum(len({i for _, i in want[q]} & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit >= .95 * sum(map(len, want.values()))
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert list(g["rank"]) == [1, 2, 3, 4, 5]
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))


@pytest.mark.parametrize("size", [8192, 8])
def test_small_tables_are_exact(spark, size):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]          # many equal vectors
    rows += [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [nan, 1.0, 1.0]), (105, [inf, 0.0, 1.0]), (None, [1.0, 2.0, 3.0]),
             (110, [1.0, 2.0]), (120, [2.0, 4.1]), (20, [6.0, 1.0, 2.0]), (130, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in hnsw.nearest(df, 5, 10, shard_size=size).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, 5, 10)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        if size > 100:
            assert [s for _, s in near] == pytest.approx([-s for s, _ in want[q]], abs=1e-12)
            assert [i for i, _ in near] == [i for s, i in sorted((round(s, 12), i) for s, i in want[q])]
        assert len(near) == len(want[q])


def test_empty(spark):
    assert hnsw.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_very_small_and_very_large_vectors(spark):
    """Finite vectors near the ends of double precision take part; their cosines are those of the directions."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        v = rng.normal(size=4)
        rows.append((i, (v * 10.0 ** [-300, -200, 0, 200, 300][i % 5]).tolist()))
    rows += [(100, [5e-324, 0.0, 0.0, 0.0]), (101, [1.7e308, 1.7e308, 0.0, 0.0])]
    got = {}
    for r in hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = {}
    for i, v in rows:
        x = np.array(v) / np.abs(v).max()
        unit[i] = x / np.sqrt((x * x).sum())
    assert set(got) == {0, 10, 20, 30, 40, 50, 100}
    for q, near in got.items():
        want = sorted((-float(unit[q] @ x), i) for i, x in unit.items() if i != q)[:5]
        assert [i for i, _ in near] == [i for _, i in want]
        assert [s for _, s in near] == pytest.approx([-s for s, _ in want], abs=1e-12)
