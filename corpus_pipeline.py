"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared folder
and reads it back as the next stage's documents.  All stages but the last keep the
columns of ``documents``.

- quality: documents that the quality rules reject go.
- simhash: of each component of near-duplicates (3-word shingles, 2 bits or fewer) the
  document of least doc_id stays.
- suffix: every 50-byte string that a document of smaller doc_id has is cut from the
  text (whole characters only); n_chars counts what is left.
- mixing: documents come as often as the mix takes them.
- packing: pieces of sequences of 2048 ids (columns of the packing operator).

Null and empty texts have fewer than 50 words, so the quality rules reject them; a null
doc_id counts as the last one, a null language is compared with all documents together,
a null source is a source of its own.  Rows that occur twice are near-duplicates of each
other: one stays.  Very long texts go through whole.  Columns beside those of ``documents``,
also ones named like an operator's own, pass through the stages but the last.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellcube.llm import mixing, packing, quality, simhash, suffix
from cellcube.llm.common import prepare, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, 3, 2)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.cut(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_rules),
    ("simhash", simhash_dedup),
    ("suffix", suffix_dedup),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]

#: the stages are not expressible in SQL; tests hold each against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
