"""Periodic run detection (op 11): block convolution by an exact integer transform.

A run is a stretch of words with smallest period q, of at least ``max(least, repeats * q)``
words, that no neighbouring word extends.  Texts are cut into aligned blocks at dyadic
sizes B = 8, 16, 32, ...  A run with period q (B <= q < 2 B; every q below 16 for B = 8)
holds a whole block and that block again q words on.  So for each block the squared
differences to all places of the following window are computed, as two sums of squares
less twice a correlation; the correlation is a number-theoretic transform modulo as
many primes as hold the greatest possible sum.  A zero is an exact occurrence; its
distance and the block seed an extension to both sides by comparing words at that
distance.  Of the stretches found over one and the same interval the least distance is
the period (the others are its multiples).

Left out before the transform, without loss: blocks with a word that does not come again
within the window, and blocks whose window lies in a run already found with a period up
to B (every distance there is a multiple of that period).

Documents are independent rows: several texts are handled in one array, parted by words
that occur once.  Null and empty texts have no words and no runs.  Rows are kept one for
one, repeated rows too; an empty table gives an empty result; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.common import byte_lengths, chunks, prepare

SMALLEST = 8                # block of the first scale
AT_ONCE = 1 << 19           # transformed numbers held at once
#: prime: primitive root; all have transforms up to 2**26 numbers
MODULI = {2_013_265_921: 31, 3_221_225_473: 5, 469_762_049: 3}

RUNS = "array<struct<start: long, length: long, period: long>>"

_roots: dict = {}


def _twiddles(size: int, p: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root for each level, widest first."""
    if (size, p, inverse) not in _roots:
        levels, half = [], size // 2
        while half:
            w = pow(MODULI[p], (p - 1) // (2 * half), p)
            w = pow(w, -1, p) if inverse else w
            powers = np.ones(1, np.uint64)
            while len(powers) < half:       # doubling: w^0..w^(m-1), then times w^m
                powers = np.concatenate([powers, powers * np.uint64(pow(w, len(powers), p)) % np.uint64(p)])
            levels.append(powers)
            half //= 2
        if len(_roots) > 64:
            _roots.clear()
        _roots[size, p, inverse] = levels
    return _roots[size, p, inverse]


def _sum(a: np.ndarray, b: np.ndarray, p: np.uint64) -> np.ndarray:
    s = a + b
    return np.where(s >= p, s - p, s)


def transform(x: np.ndarray, p: int) -> np.ndarray:
    """Number-theoretic transform of each row (bit-reversed order)."""
    rows, size = x.shape
    m = np.uint64(p)
    for w in _twiddles(size, p, False):
        v = x.reshape(rows, -1, 2, len(w))
        a, b = v[:, :, 0], v[:, :, 1]
        x = np.stack([_sum(a, b, m), (a + m - b) * w % m if p < 1 << 31 else _sum(a, m - b, m) * w % m], axis=2).reshape(rows, size)
    return x


def back(x: np.ndarray, p: int) -> np.ndarray:
    """Inverse of ``transform``."""
    rows, size = x.shape
    m = np.uint64(p)
    for w in reversed(_twiddles(size, p, True)):
        v = x.reshape(rows, -1, 2, len(w))
        a, b = v[:, :, 0], v[:, :, 1] * w % m
        x = np.stack([_sum(a, b, m), _sum(a, m - b, m)], axis=2).reshape(rows, size)
    return x * np.uint64(pow(size, -1, p)) % m


def moduli(bound: int) -> list[int]:
    """Primes whose product is above ``bound``."""
    out, product = [], 1
    for p in MODULI:
        out.append(p)
        product *= p
        if product > bound:
            return out
    raise ValueError("sums of squares too large for the transforms")


def occurrences(words: np.ndarray, starts: np.ndarray, block: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of every exact occurrence of a block ``block`` words long, from one of ``starts``,
    1 to 2 * block - 1 words later.  ``words`` are 0 to ``values`` - 1, followed by at least 4 * block others."""
    size = 4 * block
    by = moduli(block * values * values)
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    each = max(1, AT_ONCE // size)
    for a in range(0, len(starts), each):
        s = starts[a:a + each]
        window = words[s[:, None] + np.arange(size)].astype(np.uint64)
        # the block backwards round zero, so that the product is a correlation
        reverse = np.zeros_like(window)
        reverse[:, 0] = window[:, 0]
        reverse[:, size - block + 1:] = window[:, block - 1:0:-1]
        zero = np.ones((len(s), 2 * block - 1), bool)
        for p in by:
            m = np.uint64(p)
            both = back(transform(window % m, p) * transform(reverse % m, p) % m, p)[:, 1:2 * block]
            squares = np.zeros((len(s), size + 1), np.uint64)
            np.cumsum(window * window % m, axis=1, out=squares[:, 1:])
            place = np.arange(1, 2 * block)
            total = squares[:, place + block] - squares[:, place] + squares[:, block:block + 1]
            zero &= (total + 2 * (m - both)) % m == 0
        row, d = np.nonzero(zero)
        found.append((s[row], d + 1))
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def _reach(words: np.ndarray, at: int, distance: int, step: int, limit: int) -> int:
    """How many places from ``at`` on (``step`` 1 or -1, at most ``limit``) have the same word ``distance`` later."""
    done, look = 0, 64
    while done < limit:
        n = min(look, limit - done)
        lo = at + done if step > 0 else at - done - n + 1
        differ = words[lo:lo + n] != words[lo + distance:lo + distance + n]
        if step < 0:
            differ = differ[::-1]
        hit = int(differ.argmax())
        if differ[hit]:
            return done + hit
        done += n
        look *= 2
    return limit


class _Found:
    """Runs found so far, with a look-up of the one that reaches farthest from a place."""

    def __init__(self):
        self.period: dict[tuple[int, int], int] = {}
        self._sorted = None

    def add(self, start: int, end: int, period: int) -> None:
        if self.period.get((start, end), period + 1) > period:
            self.period[start, end] = period
            self._sorted = None

    def covered(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Period of a run that holds the interval, 0 where the farthest one does not."""
        if not self.period:
            return np.zeros(len(start), np.int64)
        if self._sorted is None:
            runs = np.array([(a, e, q) for (a, e), q in sorted(self.period.items())], np.int64)
            farthest = np.maximum.accumulate(runs[:, 1])
            which = np.maximum.accumulate(np.where(runs[:, 1] == farthest, np.arange(len(runs)), 0))
            self._sorted = runs[:, 0], farthest, runs[which, 2]
        begins, farthest, periods = self._sorted
        i = np.searchsorted(begins, start, "right") - 1
        return np.where((i >= 0) & (farthest[i] >= end), periods[i], 0)


def find(words: np.ndarray, values: int, longest: int, least: int = 24, repeats: int = 3) -> np.ndarray:
    """Runs (start, length, period) by start and period in ``words`` (0 to ``values`` - 1, stretches of at most ``longest`` words)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    ahead = np.full(n, n, np.int64)             # words until the same word comes again
    same = words[order[1:]] == words[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs = _Found()
    block = SMALLEST
    while block == SMALLEST or repeats * block <= longest:
        first, last = (1 if block == SMALLEST else block), 2 * block - 1
        blocks = n // block
        starts = np.flatnonzero((ahead[:blocks * block] <= last).reshape(blocks, block).all(axis=1)) * block
        period = runs.covered(starts, starts + 3 * block - 1)
        starts = starts[(period == 0) | (period > block)]
        if len(starts):
            padded = np.concatenate([words, np.full(4 * block, values, words.dtype)])
            s, d = occurrences(padded, starts, block, values + 1)
            s, d = s[d >= first], d[d >= first]
            period = runs.covered(s, s + block + d)
            new = (period == 0) | (d % np.maximum(period, 1) != 0)
            s, d = s[new], d[new]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            change = np.flatnonzero(np.diff(d, prepend=-1))
            for i, j in zip(change.tolist(), np.append(change[1:], len(d)).tolist()):
                at, distance = s[i:j], int(d[i])
                period = runs.covered(at, at + block + distance)       # also by what this scale has found
                at = at[(period == 0) | (distance % np.maximum(period, 1) != 0)]
                end = -1
                for x in at.tolist():
                    if x + block + distance <= end:
                        continue
                    start = x - _reach(words, x - 1, distance, -1, x)
                    begin = x + block
                    end = begin + _reach(words, begin, distance, 1, n - distance - begin) + distance
                    if end - start >= max(least, repeats * distance):
                        runs.add(start, end, distance)
        block *= 2
    out = np.array([(a, e - a, q) for (a, e), q in runs.period.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _some(texts: pa.Array, least: int, repeats: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each of some texts."""
    parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    bounds = parts.offsets.to_numpy()
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds - bounds[0]]
    coded = flat.filter(full).dictionary_encode()
    n_docs, n = len(texts), len(coded)
    # one word of its own after each text
    ids = np.zeros(n + n_docs, np.int64)
    place = np.arange(n) + np.repeat(np.arange(n_docs), np.diff(ends))
    ids[place] = coded.indices.to_numpy()
    ids[ends[1:] + np.arange(n_docs)] = len(coded.dictionary) + np.arange(n_docs)
    found = find(ids, len(coded.dictionary) + n_docs, int(np.diff(ends).max(initial=0)), least, repeats)
    begin = ends[:-1] + np.arange(n_docs)
    doc = np.searchsorted(begin, found[:, 0], "right") - 1
    # an empty text's place holds its parting word only, which is in no run
    cut = np.zeros(n + n_docs + 1, np.int64)
    np.add.at(cut, found[:, 0] + found[:, 2], 1)
    np.add.at(cut, found[:, 0] + found[:, 1], -1)
    keep = (np.cumsum(cut)[:-1] == 0)[place]
    kept = np.concatenate([[0], np.cumsum(keep)])[ends]
    words = coded.dictionary.take(coded.indices.filter(pa.array(keep)))
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words), pa.scalar(" ", pa.large_string()))
    fields = [pa.array(x, pa.int64()) for x in (found[:, 0] - begin[doc], found[:, 1], found[:, 2])]
    per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    runs = pa.ListArray.from_arrays(pa.array(per_doc, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.array(np.diff(ends), pa.int64()), runs, collapsed.cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """id, n_words, runs (by start, then period; start counts words from 0) and collapsed: the words
    joined by one space, without those that a run holds after its first period."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in chunks(byte_lengths(texts), 4 << 20):
                n, runs, collapsed = _some(texts.slice(a, b - a), least, repeats)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), n, runs, collapsed], [id_name, "n_words", "runs", "collapsed"])

    rows = docs.select(id_name, F.col(text_name).alias("text"))
    return rows.mapInArrow(run, f"`{id_name}` {rows.schema[0].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")
