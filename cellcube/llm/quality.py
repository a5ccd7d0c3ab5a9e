"""Quality rules (op 6): distribution divergence.

One pass over all documents sums, for every language, the shares of character
classes and of common words, each document alike; these are the language references (one row each
language, over the whole corpus).  A second pass compares each document's own
histograms with the reference of its own language and with the one of all documents
by the Jensen-Shannon distance (base 2, 0 to 1).  A document is rejected when both are
farther than the limit, and the document is long enough for the comparison of classes
(``MIN_CHARS`` characters); common words are compared in every document that passes the
base rules.  How far a good document's common words lie from the reference depends on its
length, so the word limits are taken from the corpus: a pass between the two counts the
distances in bands of length (each 1.41 times as long as the last), and a band's limit is
the median and ``SPREADS`` times the way from the first decile to the median.  A band of
fewer than ``BAND_LEAST`` documents has the limit of the next shorter one.  No limit is above
``SHORT_LIMIT``, or ``WORD_LIMIT`` from ``LONG`` words on, whatever the corpus holds.  Texts under 50 words, and texts of which more than half the
words lie in repeated three-word windows, fail the base rules.

A language has a reference of its own from ``LEAST`` documents with words on; documents of
rarer ones are compared with all documents together, so that no document is its own
measure.  The references that travel to the workers are bounded: those of the ``LANGUAGES``
languages with the most documents and the pooled one; documents of the other languages get
theirs by a join, so that every language is judged alike.

Null text has no words and fails the base rules; a null or unlisted language only
adds to the pooled reference; repeated rows are judged alike; an empty table has an
empty result; other columns never matter and pass through the filter untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.common import free_name, freeing, prepare, stored, text_bytes
from cellcube.llm.textstats import CLASSES, WORDS, TextStats

MIN_WORDS = 50
MIN_CHARS = 200
CLASS_LIMIT = 0.28
LONG = 150
SHORT_LIMIT = 0.34
WORD_LIMIT = 0.32
SPREADS = 4
LEAST_SPREAD = 0.01
BANDS = 64              # of length; the last one is open
BAND_LEAST = 100
STEPS = 1000            # of the distance, for the quantiles
LEAST = 10              # documents that make a reference
LANGUAGES = 256

DIGEST = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, class_distance double, word_distance double")


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of ``p`` from each row of ``q``; counts need not be normalised."""
    p, q = np.atleast_2d(p).astype(float), np.atleast_2d(q).astype(float)
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / np.maximum(q.sum(axis=1, keepdims=True), 1)
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    """The histogram in millionths, so that sums are whole numbers and do not depend on their order."""
    return np.rint(counts * (1_000_000 / max(1, counts.sum()))).astype(np.int64)


def references(docs: DataFrame, languages: int = LANGUAGES) -> tuple[References, DataFrame | None]:
    """The histograms of character classes and common words of all documents and of each language: those of the
    ``languages`` most frequent ones and the pooled ones at hand, the others as a table (None: there are none).

    Each document has the same weight, so that a few very long ones don't make the reference."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                stats = TextStats(text)
                if stats.n_words:
                    both = np.concatenate([[1], _shares(stats.classes()), _shares(stats.common())])
                    for key in (lang, None):
                        sums[key] = sums[key] + both if key in sums else both
                    if lang is None:            # counted once in the pooled row
                        sums[None] -= both
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))],
                                             ["lang", "counts"])

    width = 1 + len(CLASSES) + len(WORDS) + 1
    sums = (docs.select("lang", "text").mapInArrow(freeing(run), "lang string, counts array<long>")
            .groupBy("lang").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(width)]).alias("counts")))
    # written once, so that the texts are read once for both uses
    sums = stored(sums.filter(f"lang IS NULL OR counts[0] >= {LEAST}"), "quality-references")
    own = sums.filter("lang IS NOT NULL")
    top = own.orderBy(F.desc(F.col("counts")[0]), "lang").limit(languages).collect()
    pooled = sums.filter("lang IS NULL").collect()
    refs = References({r["lang"]: np.array(r["counts"], np.int64) for r in top}, np.array(pooled[0]["counts"], np.int64) if pooled else None)
    # languages that did not fit travel by a join
    rest = own.filter(~F.col("lang").isin(list(refs.own))) if len(top) == languages else None
    return refs, rest


class References:
    """Histograms (classes, common words) of the languages that travel with the task, and the pooled ones."""

    def __init__(self, own: dict[str, np.ndarray], pooled: np.ndarray | None):
        self.own, self.pooled, self._stacked = own, pooled, {}

    def __bool__(self) -> bool:
        return self.pooled is not None

    def of(self, lang: str | None, joined: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The references that a document of this language is compared with; ``joined`` is its language's, when the row brings it."""
        own = self.own.get(lang) if joined is None else np.array(joined, np.int64)
        if own is None or joined is not None:
            return _parts(self.pooled[None] if own is None else np.stack([own, self.pooled]))
        if lang not in self._stacked:
            self._stacked[lang] = _parts(np.stack([own, self.pooled]))
        return self._stacked[lang]


def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return counts[:, 1:1 + len(CLASSES)], counts[:, 1 + len(CLASSES):]


def _with_rest(docs: DataFrame, lang: str, refs: References, rest: DataFrame | None, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the reference of a language that does not travel with the tasks, else null.

    Rows of the other languages pass the join by; those that meet it have rarer languages than
    any that travels, so no key of the join is a hot one."""
    kind = "array<bigint>"
    if rest is None:
        return docs.withColumn(name, F.lit(None).cast(kind))
    here = F.col(f"`{lang}`")
    known = here.isNull() | here.isin(list(refs.own))
    other = docs.filter(~known).join(rest.select(F.col("lang").alias(f"{name}_lang"), F.col("counts").alias(name)), here == F.col(f"{name}_lang"), "left").drop(f"{name}_lang")
    return docs.filter(known).withColumn(name, F.lit(None).cast(kind)).unionByName(other)


def _band(n_words: int) -> int:
    return min(BANDS - 1, int(2 * math.log2(n_words / MIN_WORDS)))


def _base_failed(n_words: int, repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeat > 50 * n_words


def limits(docs: DataFrame, refs: References, rest: DataFrame | None) -> list[float]:
    """The word limit of each band of length, from the distances of all documents that pass the base rules."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, lang, joined in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), batch.column("ref").to_pylist()):
                stats = TextStats(text)
                if not _base_failed(stats.n_words, stats.repeat_words()):
                    far = js_distance(stats.common(), refs.of(lang, joined)[1]).min()
                    seen[_band(stats.n_words), math.ceil(far * STEPS)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in seen], pa.int32()), pa.array([d for _, d in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                                             ["band", "step", "n"])

    counts = np.zeros((BANDS, STEPS + 1), np.int64)
    if refs:
        # at most BANDS x STEPS sums
        for r in _with_rest(docs.select("text", "lang"), "lang", refs, rest, "ref").mapInArrow(freeing(run), "band int, step int, n long").groupBy("band", "step").agg(F.sum("n").alias("n")).collect():
            counts[r["band"], r["step"]] = r["n"]
    out, last = [], 1.0
    for below in counts.cumsum(axis=1):
        if below[-1] >= BAND_LEAST:
            first, median = (int(np.searchsorted(below, share * below[-1])) / STEPS for share in (0.1, 0.5))
            last = median + SPREADS * max(median - first, LEAST_SPREAD)
        out.append(last)
    return out


def _judge(text: bytes, lang: str | None, joined: list[int] | None, refs: References, word_limits: list[float]) -> tuple:
    stats = TextStats(text)
    repeat, (dup, _) = stats.repeat_words(), stats.dup_lines()
    failed = _base_failed(stats.n_words, repeat)
    far_class = far_words = None
    kept = not failed
    if kept and refs:
        class_refs, word_refs = refs.of(lang, joined)
        classes, common = stats.classes(), stats.common()
        if classes.sum() >= MIN_CHARS:
            far_class = float(js_distance(classes, class_refs).min())
            kept = far_class <= CLASS_LIMIT
        far_words = float(js_distance(common, word_refs).min())
        kept = kept and far_words <= min(word_limits[_band(stats.n_words)], WORD_LIMIT if stats.n_words >= LONG else SHORT_LIMIT)
    return stats.n_words, stats.word_chars, stats.n_symbols, dup, repeat, failed, kept, far_class, far_words


def judge(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """The statistics, distances and verdict of every document."""
    prepare(docs.sparkSession)
    refs, rest = references(docs, languages)
    word_limits = limits(docs, refs, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            rows = [_judge(t, lang, joined, refs, word_limits)
                    for t, lang, joined in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), batch.column("ref").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], names)

    return _with_rest(docs.select(F.col("doc_id").cast("long"), "text", "lang"), "lang", refs, rest, "ref").mapInArrow(freeing(run), DIGEST)


def keep_good(docs: DataFrame, languages: int = LANGUAGES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    prepare(docs.sparkSession)
    refs, rest = references(docs, languages)
    word_limits = limits(docs, refs, rest)
    at, lang = docs.columns.index("text"), docs.columns.index("lang")
    name = free_name(docs, "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_judge(t, k, joined, refs, word_limits)[6]
                    for t, k, joined in zip(text_bytes(batch.column(at)), batch.column(lang).to_pylist(), batch.column(name).to_pylist())]
            yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(kept, pa.bool_()))

    return _with_rest(docs, "lang", refs, rest, name).mapInArrow(freeing(run), docs.schema)
