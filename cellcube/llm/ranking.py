"""Quality classifier (op 9): Bradley-Terry pairwise ranking.

Preference pairs put a document labelled 1 above one labelled 0.  The score is linear
in features of the text; its weights minimise the logistic loss on the feature
differences of the pairs (ridge penalty, Newton steps, no intercept).  A quantile of
the training scores, the one with the best balanced accuracy, is the cut; scores are
mapped to 0..1 so that the cut lies at the decision threshold.

Features of all documents are computed in one pass; only ``SAMPLE`` labelled rows of
each class (least hash first) come to the driver for the fit, a documented bound.

Null and empty texts get a score like any other (their counts are 0); null labels and
labels without a document are left out; repeated label rows each count; without both
classes every score is the threshold; a null id counts as held out; an empty table
has an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcube.llm.common import inverse, prepare, stored, text_bytes
from cellcube.llm.textstats import CLASSES, TextStats

SAMPLE = 20_000
PAIRS = 200_000
THRESHOLD = 0.3
RIDGE = 1e-3
WINDOW = 60     # words in a window of the local features


def features(text: bytes) -> list[float]:
    """Length, variety, repetition and character shares of a whole text, and its worst windows."""
    s = TextStats(text)
    n, chars = max(s.n_words, 1), max(len(text), 1)
    dup, lines = s.dup_lines()
    classes = s.classes() / chars
    common = s.common()
    ends = sum(w[-1] in b"#*$%&|<>!" for w in s.words) / n
    share = {c: float(classes[i]) for i, c in enumerate(CLASSES)}
    # local features: the share of odd words in the worst window
    odd = np.fromiter((w[-1] in b"#*$%&|<>!" or (len(w) > 1 and w.isupper()) for w in s.words), bool, s.n_words)
    same = np.concatenate([[False], np.diff(s.ids) == 0]) if s.n_words else odd
    worst = [_worst(odd), _worst(same)]
    out = [np.log1p(s.n_words), s.word_chars / n, s.distinct() / n, s.repeat_words() / n, dup / max(lines, 1), lines / n,
           s.longest_run() / n, np.log1p(s.longest_run()), ends, common[-1] / n, *worst]
    out += [share[c] for c in CLASSES]
    out += [np.sqrt(x) for x in (ends, share["symbol"], share["upper"], share["sentence"], s.repeat_words() / n, dup / max(lines, 1))]
    return [float(x) for x in out]


def _worst(flags: np.ndarray) -> float:
    if not len(flags):
        return 0.0
    width = min(WINDOW, len(flags))
    sums = np.concatenate([[0], np.cumsum(flags)])
    return float((sums[width:] - sums[:-width]).max() / width)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict:
    """Mean, scale, weights and cut from features and 0/1 labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (0.0, 1.0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    if not len(good) or not len(bad):
        return {"mean": mean, "scale": scale, "weights": None, "cut": 0.0}
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = min(PAIRS, 20 * len(x))
    d = z[rng.choice(good, n)] - z[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ w)).mean() + RIDGE / 2 * (w @ w))

    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))            # chance that the pair is ranked wrongly
        slope = RIDGE * w - (d * p[:, None]).mean(axis=0)
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = inverse(curve) @ slope
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    s = z @ w
    # the quantile of all scores that parts the labels best
    cuts = np.quantile(s, np.linspace(0.005, 0.995, 199))
    right = [((s[good] >= c).mean() + (s[bad] < c).mean()) / 2 for c in cuts]
    return {"mean": mean, "scale": scale, "weights": w, "cut": float(cuts[int(np.argmax(right))])}


def held_out(doc_id: Column, modulus: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == part


def rank(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, part: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    prepare(spark)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    table = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(extract, "doc_id long, x array<double>"), "ranking-features")
    known = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, part)))
    # labels of documents that are there, each once; only then the bounded sample
    known = known.distinct().join(table.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", "y"))
    bounded = [known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(SAMPLE) for y in (0, 1)]
    # of several documents with one id the least features stand for all
    sample = bounded[0].unionByName(bounded[1]).join(table, "doc_id").groupBy("h", "doc_id", "y").agg(F.min("x").alias("x"))
    sample = sample.orderBy("h", "doc_id", "y").select("x", "y").toArrow()
    x = np.array(sample.column("x").to_pylist(), float) if sample.num_rows else np.zeros((0, 1))
    model = fit(x, sample.column("y").to_numpy())
    shift = float(np.log(threshold / (1 - threshold)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model["weights"] is None:
                s = np.zeros(n)
            else:
                x = batch.column("x").values.to_numpy().reshape(n, -1) if n else np.zeros((0, len(model["weights"])))
                s = ((x - model["mean"]) / model["scale"]) @ model["weights"] - model["cut"]
            p = 1 / (1 + np.exp(-np.clip(s + shift, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    out = table.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, part).alias("held_out"), "score", "predicted")
