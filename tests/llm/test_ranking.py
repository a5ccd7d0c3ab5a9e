import numpy as np
from pyspark.sql import functions as F

from cellcube.llm import ranking


def _table(spark, n=400):
    good = "The river runs past the old mill and the people of the town walk there in the evening. "
    rows = [(i, (good * 6 + f"number {i}") if i % 2 else "zx## qq$$ %%% " * 30 + f"number {i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")


def _right(out):
    rows = out.filter("held_out").collect()
    return np.mean([r["predicted"] == r["doc_id"] % 2 for r in rows])


def test_labels_without_documents(spark, monkeypatch):
    """Labels whose documents are not there don't use up the bounded sample."""
    monkeypatch.setattr(ranking, "SAMPLE", 50)
    docs, labels = _table(spark)
    assert _right(ranking.rank(docs, labels)) == 1
    strangers = spark.range(1_000_000, 1_050_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    out = ranking.rank(docs, labels.unionByName(strangers))
    assert _right(out) == 1 and out.select("score").distinct().count() > 1


def test_one_id_on_very_many_rows(spark):
    docs, labels = _table(spark)
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words of a text that is often there "), F.col("id").cast("string")).alias("text"))
    out = ranking.rank(docs.unionByName(same), labels.unionByName(labels))
    assert out.count() == 3400 and _right(out.filter("doc_id <> 7")) == 1


def test_no_label_at_all(spark):
    docs, labels = _table(spark, 20)
    out = ranking.rank(docs, labels.limit(0)).collect()
    assert len(out) == 20 and len({r["score"] for r in out}) == 1
    assert ranking.rank(docs.limit(0), labels).count() == 0
