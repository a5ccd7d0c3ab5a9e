import re

import pytest
from pyspark.sql import functions as F

from cellcube.llm import mixing


def test_targets_share_all_words_and_stop_at_the_cap():
    got = mixing.targets({"a": 100, "b": 100, "c": 100, None: 1})
    assert got[None] == 3                       # weight 1 again, capped
    assert got["a"] == pytest.approx(298 / 6) and got["c"] == pytest.approx(149)
    assert sum(got.values()) == pytest.approx(301)
    assert mixing.targets({"a": 10}) == {"a": 10}
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 5}) == {"a": 0, "b": 5}
    assert list(mixing.targets({"é": 1, "z": 1, None: 1, "Z": 1})) and mixing.targets({"b": 4, "a": 4, None: 0})["b"] == pytest.approx(16 / 3)


def test_mix(docs, rows):
    out = mixing.mix_digest(docs).toPandas()
    assert len(out) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows if i is not None}
    assert all(size[int(i)] == s for i, s in zip(out.doc_id, out["size"]) if i == i)
    assert (out.taken == out.copies * out["size"]).all() and out.copies.max() <= 3
    per = out.groupby(["target", "source_size"]).taken.sum().reset_index()
    longest = out["size"].max()
    assert ((per.taken - per.target).abs() <= longest).all()
    again = mixing.mix_digest(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_even_sizes_come_within_one_copy(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    out = mixing.mix_digest(table).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 3 for r in out)


def test_repeated_keeps_columns_and_copies(docs):
    out = mixing.repeated(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() == mixing.mix_digest(docs).agg(F.sum("copies")).first()[0]


def test_empty(none):
    assert mixing.mix_digest(none).count() == 0 and mixing.repeated(none).count() == 0


@pytest.mark.parametrize("target", [0.0, 9.0, 33.0, 57.0, 77.0, 120.0, 171.0])
def test_classes_come_near_the_target(target):
    n, words = [1, 2, 1, 8, 4], [20, 18, 7, 8, 4]       # longest first
    got = mixing.class_copies(n, words, target)
    assert all(0 <= k <= 3 * m for k, m in zip(got, n))
    assert abs(sum(k * w / m for k, m, w in zip(got, n, words)) - target) <= 0.5
    assert mixing.class_copies([], [], 0.0) == [] and mixing.class_copies([3], [0], 0.0) == [0]


def test_sources_come_near_their_targets(spark):
    """A few documents of 20,000 words decide no source: each class is drawn as often as planned."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix_digest(table.select("doc_id", "text", "source"))
    per = out.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()
    assert len(per) > 10 and all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] and r["most"] <= 3 for r in per)


def test_copies_against_a_plain_version(docs, rows, monkeypatch):
    """Copies of every class from the plan, drawn by walking the documents in order."""
    monkeypatch.setattr(mixing, "EACH", 10 ** 9)        # one split a class, so that the order is known
    import collections
    import math
    import random

    out = mixing.mix_digest(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").select("doc_id", "source", "size", "copies").collect()
    size = collections.defaultdict(lambda: collections.defaultdict(list))
    for i, t, _, source, *_ in rows:
        s = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[source][math.floor(8 * math.log2(s + 1))].append((s, i))
    goal = mixing.targets({s: sum(x for c in v.values() for x, _ in c) for s, v in size.items()})
    for source, classes in size.items():
        order = sorted(classes, reverse=True)
        planned = mixing.class_copies([len(classes[c]) for c in order], [sum(x for x, _ in classes[c]) for c in order], goal[source])
        start = random.Random(f"{mixing.SEED} {source!r}").random()
        for c, k in zip(order, planned):
            rate = k / len(classes[c])
            drawn = sorted(math.floor(j * rate + start) - math.floor((j - 1) * rate + start) for j in range(1, len(classes[c]) + 1))
            ids = {i for _, i in classes[c] if i is not None}
            got = [r["copies"] for r in out if r["source"] == source and r["doc_id"] in ids and math.floor(8 * math.log2(r["size"] + 1)) == c]
            assert sum(drawn) == k
            if len(ids) == len(classes[c]) and len(got) == len(drawn):
                assert sorted(got) == drawn
