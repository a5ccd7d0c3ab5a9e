import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcube.llm import quality, ranking
from cellcube.llm.textstats import CLASSES, TextStats
from tests.conftest import SF_SMALL


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if three[tuple(w[k:k + 3])] >= 2 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_base_columns(docs, rows):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeat = want = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(docs).count() == len(rows)


@pytest.mark.parametrize("text", ["", "a", "a a a a", "x y z x y z", "a\na\n\n \na\n", "é é é\r\né é é", "b c\x1cd b c\x1cd b", "\n".join(["p q r"] * 9)])
def test_repeats(text):
    s = TextStats(text.encode())
    assert (s.n_words, s.word_chars, s.n_symbols, s.dup_lines()[0], s.repeat_words()) == brute(text)
    assert s.common().sum() == s.n_words and s.classes().sum() == len(text)
    assert len(s.classes()) == len(CLASSES)


def test_js_distance():
    assert quality.js_distance([1, 1], [[5, 5], [1, 0], [0, 0]])[0] == 0
    assert quality.js_distance([1, 0], [[0, 1]])[0] == pytest.approx(1)
    p, q = np.array([.2, .8]), np.array([.6, .4])
    m = (p + q) / 2
    want = np.sqrt((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)
    assert quality.js_distance(2 * p, [3 * q])[0] == pytest.approx(want)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(2)
    common = "the of and to in a is that it for on was be as with by this are".split()
    word = lambda: rng.choice(common) if rng.random() < .45 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    good = [" ".join(word() for _ in range(rng.randint(160, 300))) + "." for _ in range(150)]
    bad = ["".join(rng.choice("#*$%&|<>") for _ in range(4)).join(word().upper() + " " for _ in range(200)) for _ in range(20)]
    bad += [" | ".join("".join(rng.choice("xkqzv") for _ in range(7)) for _ in range(200)) for _ in range(20)]
    rows = [(i, t, "en", int(i < len(good))) for i, t in enumerate(good + bad)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")


def test_divergence_rejects_junk_and_keeps_prose(prose):
    got = {r["doc_id"]: r["kept"] for r in quality.judge(prose).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 190))
    kept = quality.keep_good(prose)
    assert kept.columns == prose.columns and kept.count() == 150


def test_keep_good_passes_columns(docs, none):
    assert quality.keep_good(docs).schema.simpleString() == docs.schema.simpleString()
    verdict = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == verdict
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


def test_ranking_on_held_out_rows(prose):
    out = ranking.rank(prose.select("doc_id", "text"), prose.select("doc_id", "quality")).toPandas().merge(prose.select("doc_id", "quality").toPandas())
    held = out[out.held_out]
    assert 10 < len(held) < 80 and out.score.between(0, 1).all()
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    assert (held.predicted == held.quality).mean() > 0.95


def test_ranking_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (999, 0)], "doc_id long, quality int")
    out = ranking.rank(docs, labels).collect()      # one class only: every score is the threshold
    assert len(out) == len(rows) and all(r["score"] == pytest.approx(0.3) and r["predicted"] == 1 for r in out)
    assert ranking.rank(none, labels).count() == 0


def test_pairs_fit_finds_the_direction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2, -1, 0] + rng.normal(scale=.3, size=400) > 0).astype(int)
    m = ranking.fit(x, y)
    w = m["weights"]
    assert w[0] > 0 > w[1] and abs(w[2]) < .3 * abs(w[1])
    assert ((((x - m["mean"]) / m["scale"]) @ w >= m["cut"]) == y).mean() > .93


def test_rare_tags_have_no_reference_of_their_own(spark, prose):
    """Junk under a tag that occurs once or a few times is measured by all documents, and keeps no junk elsewhere."""
    rng = random.Random(4)
    junk = [" | ".join("".join(rng.choice("xkqzv") for _ in range(7)) for _ in range(200)) for _ in range(12)]
    tags = ["aa", "bb", *["cc"] * 9, "en"]
    rows = [(1000 + i, t, lang, 0) for i, (t, lang) in enumerate(zip(junk, tags))]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(prose.union(spark.createDataFrame(rows, prose.schema))).collect()}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(12))


def test_a_language_keeps_no_junk_of_another(spark, prose):
    """A tag with enough documents, all junk, is no measure for documents of other tags."""
    rng = random.Random(6)
    junk = [" | ".join("".join(rng.choice("xkqzv") for _ in range(7)) for _ in range(200)) for _ in range(30)]
    rows = [(1000 + i, t, "cc" if i else "en", 0) for i, t in enumerate(junk)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(prose.union(spark.createDataFrame(rows, prose.schema))).collect()}
    assert not got[1000] and all(got[i] for i in range(150))


def test_short_and_diluted_junk_goes(spark):
    """Letter salad of any length and with some common words among it goes, and no prose does."""
    rng = random.Random(8)
    common = "the of and to in a is that it for on was be as with by this are".split()
    salad = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9)))
    text = lambda n, share: " ".join(rng.choice(common) if rng.random() < share else salad() for _ in range(n)) + "."
    good = [text(rng.choice([60, 90, 130, 200, 350, 800]), .3) for _ in range(1200)]
    junk = [text(n, share) for n, share in [(60, 0), (90, 0), (130, 0)] * 4 + [(200, 0), (350, .03), (800, .06), (800, .05)] * 4]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string").repartition(4)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert not any(kept[i] for i in range(1200, len(kept)))
    assert sum(kept[i] for i in range(1200)) >= 1195


def test_languages_that_travel_by_a_join_are_judged_alike(spark):
    """However many references travel with the tasks, every verdict and distance is the same."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("ref", F.lit("x"))
    some = docs.withColumn("lang", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 13 == 0, F.lit("rare")).otherwise(F.col("lang")))
    want = sorted(map(str, quality.judge(some).collect()))
    rows = sorted(map(str, quality.keep_good(some).collect()))
    assert len(want) == docs.count() and 0 < len(rows) < len(want)
    for languages in (1, 2, 3):
        assert sorted(map(str, quality.judge(some, languages).collect())) == want
        kept = quality.keep_good(some, languages)
        assert kept.columns == some.columns and sorted(map(str, kept.collect())) == rows


def test_texts_are_read_three_times(spark, tmp_path):
    """References, limits and verdicts: a pass each, the references' sums are not made twice."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(1).write.parquet(str(tmp_path / "d"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    table = spark.read.parquet(str(tmp_path / "d")).mapInArrow(count, docs.schema)
    n = quality.judge(table).count()
    assert n == docs.count() and seen.value == 3 * n
