"""Hard-negative mining (op 13): exact integer scores by a residue-number-system matrix product.

Components become whole numbers (``floor(scale * x)``).  The anchors (rows whose id is
divisible by ``every``) meet all rows in square tiles: anchors are dealt to groups, rows
to slices, and each (group, slice) is one Spark group of bounded bytes.  Inside a tile
the component matrices are multiplied modulo several small primes in float32; residues
lie around zero and at most ``2**24 / (p // 2)**2`` columns are summed at once, so every
float32 sum is a whole number below 2**24 and exact.  Balanced mixed-radix digits
(Chinese remaindering) give the signed score.  The number of primes follows from the
largest squared length of all rows, which bounds every score.

A first pass over the tiles finds each anchor's positives (its best rows of the same
label), a second one, for each positive, the best rows of other labels in the window
``low% .. high%`` of the positive's score.  Tiles return their best few, a window over
(anchor, positive) merges them; higher scores come first, ties by smaller id.

Rows take part if id, label and vector are there, no component is null or not finite,
and the squared length of the whole-number vector is below 2**62 (so that every score
fits a long).  Vectors of different lengths are not compared; empty vectors score 0
among each other.  Rows with an anchor's own id are not its partners.  A row that occurs
twice counts twice, as partner and as anchor.  An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellcube.llm.common import prepare, stored

TILE_BYTES = 4 << 20        # of whole-number vectors on each side of a tile
LARGEST = 1_022             # primes are below this: 64 columns are exact in one float32 product
AT_ONCE = 1 << 20           # scores computed at once inside a tile
LEAST = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """Largest primes below ``LARGEST``, as many as tell all whole numbers from ``-bound`` to ``bound`` apart."""
    out, product, p = [], 1, LARGEST
    while product <= 2 * bound + 1 or not out:
        p -= 1
        if all(p % d for d in range(2, math.isqrt(p) + 1)):
            out.append(p)
            product *= p
    return out


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """``x`` modulo ``p`` as float32 from ``-(p // 2)`` to ``p // 2``."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` (int64, 0 to p - 1) of residue matrices."""
    step = max(1, (1 << 24) // (p // 2) ** 2)
    total = np.zeros((len(a), len(b)), np.int64)
    for c in range(0, a.shape[1], step):
        total += (a[:, c:c + step] @ b[:, c:c + step].T).astype(np.int64)
        total %= p
    return total


def signed(parts: list[np.ndarray], by: list[int]) -> np.ndarray:
    """The whole numbers with these residues: balanced mixed-radix digits, the last first."""
    digits: list[np.ndarray] = []
    for part, p in zip(parts, by):
        value, weight = np.zeros_like(part), 1
        for digit, q in zip(digits, by):
            value = (value + digit * weight) % p
            weight = weight * q % p
        digit = (part - value) * pow(weight, -1, p) % p
        digits.append(np.where(digit > p // 2, digit - p, digit))
    out = np.zeros_like(parts[0])
    for digit, p in zip(reversed(digits), reversed(by)):
        out = out * p + digit           # wraps past 2**63 on the way, the result fits
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], by: list[int]) -> np.ndarray:
    """Exact inner products of two sets of rows given by their residues."""
    return signed([_product(x, y, p) for x, y, p in zip(a, b, by)], by)


def _best(value: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed columns of each row: higher value, then smaller id."""
    masked = np.where(ok, value, LEAST)
    if masked.shape[1] > k:
        limit = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k][:, None]
        ok = ok & (masked >= limit)
    row, col = np.nonzero(ok)
    order = np.lexsort((ids[col], -value[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _whole(rows: DataFrame, id_name: str, label_name: str, vector_name: str, scale: float) -> DataFrame:
    """id, label, dim, v (64-bit components), size (squared length) of the rows that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, lists = batch.columns
            at = lists.offsets.to_numpy().astype(np.int64)
            x = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)       # null is NaN
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                square = np.concatenate([x * x, [0.0]])
            # a range that ends where it begins would give reduceat's next element
            size = np.where(np.diff(at) > 0, np.add.reduceat(square, at[:-1]), 0.0) if len(at) > 1 else np.zeros(0)
            ok = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            ok &= lists.is_valid().to_numpy(zero_copy_only=False) & (size < 2.0 ** 62)           # NaN and infinity are not
            v = np.where(np.abs(x) < 2.0 ** 32, x, 0).astype("<i8")
            data = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at * 8), pa.py_buffer(v)])
            cols = [ids, labels, pa.array(np.diff(at).astype(np.int32)), data, pa.array(size)]
            out = pa.table(cols, ["id", "label", "dim", "v", "size"]).filter(pa.array(ok))
            yield from out.cast(pa.schema([("id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary()), ("size", pa.float64())])).to_batches()

    cols = rows.select(F.col(id_name).cast("long"), F.col(label_name).cast("long"), F.col(vector_name).cast("array<double>"))
    return cols.mapInArrow(run, "id long, label long, dim int, v binary, size double")


def _matrix(table: pa.Table) -> np.ndarray:
    dim = table.column("dim")[0].as_py()
    v = table.column("v").combine_chunks().cast(pa.large_binary())
    at = np.frombuffer(v.buffers()[1], np.int64)[v.offset:v.offset + len(v) + 1]
    data = v.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view("<i8").reshape(len(v), dim) if dim else np.zeros((len(v), 0), np.int64)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _tiles(left: pa.Table, right: pa.Table, by: list[int]) -> Iterator[tuple[slice, np.ndarray]]:
    """Ranges of the tile's anchors and their scores against all its rows."""
    x, y = _matrix(left), _matrix(right)
    b = [residues(y, p) for p in by]
    step = max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        part = x[at:at + step]
        yield slice(at, at + len(part)), scores([residues(part, p) for p in by], b, by)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, low: int = 80, high: int = 100, scale: float = 256.0,
         id_name: str = "vec_id", label_name: str = "label", vector_name: str = "embedding", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    prepare(rows.sparkSession)
    whole = stored(_whole(rows, id_name, label_name, vector_name, scale).withColumn("no", F.monotonically_increasing_id()), "negatives-rows")
    is_anchor = F.col("id") % every == 0
    n, asked, size, dim = whole.agg(F.count("*"), F.count_if(is_anchor), F.max("size"), F.max("dim")).first()
    by = primes(int(size or 0) + 1)
    side = max(256, tile_bytes // (8 * max(dim or 1, 1)))
    slices, groups = max(1, -(-n // side)), max(1, -(-asked // side))
    deal = F.xxhash64("no")
    # one copy of a row for each group of anchors, one copy of an anchor for each slice of rows
    dealt = (whole.withColumn("slice", F.pmod(deal, F.lit(slices)).cast("int"))
             .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("dim", "grp", "slice", "id", "label", "v"))
    anchors = whole.filter(is_anchor).withColumn("grp", F.pmod(deal, F.lit(groups)).cast("int"))

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("dim", "grp", "slice")

    def look_same(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        if left.num_rows and right.num_rows:
            own, label, no = _numbers(left, "id"), _numbers(left, "label"), _numbers(left, "no")
            ids, labels = _numbers(right, "id"), _numbers(right, "label")
            for at, s in _tiles(left, right, by):
                ok = (labels == label[at, None]) & (ids != own[at, None])
                row, col = _best(s, ok, ids, positives)
                out.append(np.stack([no[at][row], ids[col], s[row, col]], axis=1))
        found = np.concatenate(out)
        return pa.table({name: pa.array(found[:, j]) for j, name in enumerate(("no", "positive_id", "positive_score"))})

    def look_other(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((0, 6), np.int64)]
        if left.num_rows and right.num_rows:
            own, label, no = _numbers(left, "id"), _numbers(left, "label"), _numbers(left, "no")
            ids, labels = _numbers(right, "id"), _numbers(right, "label")
            chosen = left.column("positives").to_pylist()
            place, pid, top = (np.array([[p[f] if p else 0 for p in c + [None] * (positives - len(c))] for c in chosen], np.int64) for f in ("place", "positive_id", "positive_score"))
            floor, ceiling = _share(top, low, up=True), _share(top, high, up=False)
            for at, s in _tiles(left, right, by):
                other = (labels != label[at, None]) & (ids != own[at, None])
                for j in range(positives):
                    ok = other & (s >= floor[at, j, None]) & (s <= ceiling[at, j, None]) & (place[at, j, None] > 0)
                    row, col = _best(s, ok, ids, negatives)
                    out.append(np.stack([no[at][row], place[at, j][row], pid[at, j][row], top[at, j][row], ids[col], s[row, col]], axis=1))
        found = np.concatenate(out)
        names = ("no", "place", "positive_id", "positive_score", "negative_id", "negative_score")
        return pa.table({name: pa.array(found[:, j]) for j, name in enumerate(names)})

    same = spread(anchors).cogroup(dealt.groupBy("dim", "grp", "slice")).applyInArrow(look_same, "no long, positive_id long, positive_score long")
    place = F.row_number().over(W.partitionBy("no").orderBy(F.desc("positive_score"), "positive_id"))
    same = same.withColumn("place", place.cast("long")).filter(F.col("place") <= positives)
    same = same.groupBy("no").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives"))
    second = stored(anchors.join(same, "no"), "negatives-positives")
    found = (spread(second).cogroup(dealt.groupBy("dim", "grp", "slice"))
             .applyInArrow(look_other, "no long, place long, positive_id long, positive_score long, negative_id long, negative_score long"))
    rank = F.row_number().over(W.partitionBy("no", "place").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return found.join(second.select("no", F.col("id").alias("anchor_id")), "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` hundredths of whole numbers, rounded up or down, without passing 64 bits."""
    whole, rest = np.divmod(score, 100)
    part = rest * percent
    return whole * percent + (-(-part // 100) if up else part // 100)
