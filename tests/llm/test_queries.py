import re

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_simhash import print_of, roots
from tests.llm.test_suffix import brute

COLUMNS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op2_training_order": "sequence slot shard row n_tokens ids_crc32",
    "op3_mixing": "doc_id size source_size target taken",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_ranking": "doc_id held_out score predicted",
    "op10_hnsw": "query_id rank vec_id score",
    "op11_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}


def test_registered_columns(spark):
    queries = entry.queries()
    for name, columns in COLUMNS.items():
        df = queries[name](spark, SF_SMALL)
        assert set(columns.split()) <= set(df.columns), name
        assert df.count() > 0, name


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = [(r["doc_id"], r["text"], r) for r in corpus_pipeline.quality_rules(spark, docs, SF_SMALL).collect()]
    verdict = {r["doc_id"] for r in entry.queries()["op6_quality"](spark, SF_SMALL).filter("kept").collect()}
    assert {i for i, _, _ in kept} == verdict

    table = spark.createDataFrame([r for _, _, r in kept], docs.schema)
    v = [print_of(t) for _, t, _ in kept]
    root = roots(len(v), [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(v[i] ^ v[j]).count("1") <= 2])
    least = {}
    for (i, _, _), r in zip(kept, root):
        least[r] = min(least.get(r, i), i)
    one = corpus_pipeline.simhash_dedup(spark, table, SF_SMALL).collect()
    assert {r["doc_id"] for r in one} == set(least.values()) and len(one) == len(least)

    table = spark.createDataFrame(one, docs.schema)
    cut = {r["doc_id"]: r for r in corpus_pipeline.suffix_dedup(spark, table, SF_SMALL).collect()}
    for i, n_bytes, n_removed, _, _ in brute([(r["doc_id"], r["text"]) for r in one]):
        assert n_bytes - n_removed <= len(cut[int(i)]["text"].encode()) <= n_bytes - n_removed + 3 * 2 * 5
    table = spark.createDataFrame(list(cut.values()), docs.schema)
    mixed = corpus_pipeline.source_mixing(spark, table, SF_SMALL)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert max(map([r["doc_id"] for r in rows].count, {r["doc_id"] for r in rows})) <= 3
    pieces = corpus_pipeline.sequence_packing(spark, spark.createDataFrame(rows, docs.schema), SF_SMALL).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in rows}
    assert sum(r["start"] == 0 for r in pieces) == len(rows)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "suffix", "mixing", "packing"]
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and re.match("doc_id", out.columns[0])


def test_pipeline_on_odd_rows(spark, docs, rows, none, tmp_path):
    """Nulls in any column, empty and repeated rows, a long text and clashing column names go through all stages."""
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    long = {r[0] for r in rows if r[1] and len(r[1].split()) >= 50}
    assert out and {r["doc_id"] for r in out} <= long
    table = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, f"{tmp_path}/odd")
        assert table.dtypes == docs.dtypes
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
