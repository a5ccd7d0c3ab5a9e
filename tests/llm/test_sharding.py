import zlib

from cellcube.llm import sharding


def test_lpt():
    assert sharding.lpt([7, 5, 4, 3], 2) == [0, 1, 1, 0]
    assert sharding.lpt([], 3) == []
    loads = [0] * 5
    sizes = [(k * 37) % 91 + 1 for k in range(300)]
    for s, at in zip(sizes, sharding.lpt(sizes, 5)):
        loads[at] += s
    assert max(loads) - min(loads) <= max(sizes)


def test_rows(docs, rows):
    out = sharding.shard_rows(docs, 4).toPandas()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, *_ in rows}
    shard = {}
    for r in out.itertuples():
        t = text[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode())
        assert shard.setdefault(t, r.shard) == r.shard
    for _, s in out.groupby("shard").slot:
        assert sorted(s) == list(range(len(s)))
    load = out.groupby("shard")["size"].sum()
    groups = out.groupby("text_crc32")["size"].sum()
    assert load.max() - load.min() <= groups.max()


def test_one_group_of_a_third(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " + "x" * (i % 50)) for i in range(3000)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    same = out[out.doc_id % 3 == 0]
    assert same.shard.nunique() == 1
    load = out.groupby("shard")["size"].sum()
    assert load.max() <= 1.02 * max(out["size"].sum() / 4, same["size"].sum())


def test_empty(none):
    assert sharding.shard_rows(none).count() == 0


def test_splits_follow_the_rows(spark, monkeypatch):
    """The same shards and gapless slots however finely a unit's rows are split."""
    rows = [(i // 2, "same text" if i % 3 else f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = []
    for each in (1_000_000, 7):
        monkeypatch.setattr(sharding, "EACH", each)
        out = sharding.shard_rows(df, 3).toPandas()
        assert len(out) == 900
        for _, s in out.groupby("shard").slot:
            assert sorted(s) == list(range(len(s)))
        shards.append(sorted(zip(out.doc_id, out.text_crc32, out["shard"])))
    assert shards[0] == shards[1]
