"""One query for each operator, by the contract that fixes its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.llm import counts, hnsw, mixing, negatives, ngram, ordering, packing, quality, ranking, runs, sharding, simhash, suffix
from cellcube.llm.common import WORD

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark, sf_dir):
    """All documents packed into sequences of 2048 ids by column generation."""
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op3_mixing(spark, sf_dir):
    """Systematic sampling of all documents to the sources' targets."""
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


@query
def op7_sharding(spark, sf_dir):
    """All documents in 24 shards of near equal bytes; equal texts together (law ``bytes``)."""
    out = sharding.shard_rows(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_simhash(spark, sf_dir):
    """SimHash fingerprints of all documents and their components at 2 or fewer differing bits."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), 3, 2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_quality(spark, sf_dir):
    """Base rules and Jensen-Shannon verdict of all documents."""
    return quality.judge(_table(spark, sf_dir, "documents"))


@query
def op9_ranking(spark, sf_dir):
    """Bradley-Terry quality scores of all documents, learned from the labels' training part."""
    return ranking.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op4_suffix_dedup(spark, sf_dir):
    """Bytes of all documents left after cutting 50-byte strings that an earlier document has."""
    return suffix.digest(_table(spark, sf_dir, "documents"))


@query
def op5_lm_scoring(spark, sf_dir):
    """Bigram scores of all documents, learned from the training part of all documents."""
    return ngram.score(_table(spark, sf_dir, "documents"), 7, 2)


@query
def op10_hnsw(spark, sf_dir):
    """Five nearest vectors of every row of ``embeddings`` whose vec_id is divisible by 50."""
    return hnsw.nearest(_table(spark, sf_dir, "embeddings"), 5, 50)


@query
def op2_training_order(spark, sf_dir):
    """All documents as sequences of 2048 ids, written at their slots of a keyed permutation; one row a sequence."""
    return ordering.digest(_table(spark, sf_dir, "documents"))


@query
def op11_runs(spark, sf_dir):
    """Periodic runs of all documents; a tenth of them, by a hash of doc_id, made periodic from some word on."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("w"))
    words = words.withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    words = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    words = words.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))     # noqa: E731
    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    found = runs.periodic_runs(words.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    # lengths and periods are whole numbers: the greatest quotient by cross-multiplication
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda acc, r: F.when(acc.isNull() | (r["length"] * acc["period"] > acc["length"] * r["period"]), r).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256")


@query
def op12_token_counts(spark, sf_dir):
    """Tokens of all documents by the byte-level tokenizer, through a digest cache that is empty at first."""
    return counts.count_tokens(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every row of ``embeddings`` whose vec_id is divisible by 100; every seventh label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")
    return negatives.mine(rows, positives=5, negatives=5, every=100, low=80, high=100, scale=256.0)


ORACLES["op13_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
         n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT * FROM ranked WHERE rank <= 5
"""
