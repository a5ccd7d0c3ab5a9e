import random

import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellcube.llm import counts

NAME = "byte_bpe_50k.json"


def whole(texts, name=NAME):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [len(x.ids) for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fragments_add_up(rows):
    rng = random.Random(3)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", "'", "1", "é", " ", "\x1c", "　", "!", "...", "don't", "<|endo", "\r", "\x85", "_", "ʒ", "\U0001f600"]
    texts = [r[1] for r in rows] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert counts.token_counts(pa.array(texts), NAME).tolist() == whole(texts)
    assert counts.token_counts(pa.array(texts).slice(7, 900), NAME).tolist() == whole(texts[7:907])


def test_known_fragments_are_bounded(monkeypatch):
    monkeypatch.setattr(counts, "KNOWN_BYTES", 2_000)
    monkeypatch.setattr(counts, "_counters", {})
    texts = [" ".join(f"word{i}x{j}," for j in range(9)) for i in range(200)]
    for a in range(0, 200, 20):
        assert counts.token_counts(pa.array(texts[a:a + 20]), NAME).tolist() == whole(texts[a:a + 20])
    assert counts._counters[NAME].size < 60_000


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_take_whole_texts(rows, name):
    texts = [r[1] for r in rows[:60]] + ["a  b ", "", None]
    got = counts.token_counts(pa.array(texts), name).tolist()
    if name.endswith(".json"):
        assert got == whole(texts, name)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        assert got == [len(model.encode(t or "")) for t in texts]


def test_rows_against_the_tokenizer(docs, rows):
    got = counts.count_tokens(docs, NAME, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = whole([r[1] for r in rows])
    want = [(r[0], len((r[1] or "").encode()), k, k > 100) for r, k in zip(rows, n)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_cache_is_joined_and_grows_by_misses_only(spark, docs, rows, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    counts.count_tokens(docs.filter("doc_id < 60"), NAME, cache).collect()
    first = {bytes(r["digest"]): r["n_tokens"] for r in spark.read.parquet(cache).collect()}
    assert len(first) == len({r[1] or "" for r in rows if r[0] is not None and r[0] < 60})
    # a stored count is taken as it is
    fake = spark.createDataFrame([("planted text",)], "t string").select(F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(777).cast("long").alias("n_tokens"),
                                                                         F.lit(counts.tokenizer_digest(NAME)).alias("tokenizer"))
    fake.write.mode("append").partitionBy("tokenizer").parquet(cache)
    more = docs.unionByName(spark.createDataFrame([(-1, "planted text")], "doc_id long, text string"), allowMissingColumns=True)
    want = None
    for few in (counts.FEW, 0):         # misses sent to the texts, or texts brought together first
        monkeypatch.setattr(counts, "FEW", few)
        got = sorted(map(str, map(tuple, counts.count_tokens(more, NAME, cache).collect())))
        want = want or got
        assert got == want and any("777" in x for x in got)
        table = spark.read.parquet(cache)
        assert table.count() == table.select("digest").distinct().count() == len({r[1] or "" for r in rows}) + 1
    # another version of the tokenizer has counts of its own
    monkeypatch.setattr(counts, "tokenizer_digest", lambda name: "other")
    assert not any("777" in str(r) for r in counts.count_tokens(more, NAME, cache).collect())


def test_hot_and_rare_digests(spark, monkeypatch):
    monkeypatch.setattr(counts, "HOT_SHARE", 10)
    rows = [(i, "same text here" if i % 3 == 0 else f"text {i // 2}") for i in range(300)] + [(None, None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = counts.count_tokens(df, NAME).collect()
    n = whole([t for _, t in rows])
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, len(t or ""), k, False)) for (i, t), k in zip(rows, n))


def test_empty(none):
    assert counts.count_tokens(none).collect() == []


def test_version_digest():
    a, b = counts.tokenizer_digest(NAME), counts.tokenizer_digest("word_bpe_49k.json")
    assert a != b and len(a) == 64 and a == counts.tokenizer_digest(NAME)
