"""Packing (op 1): cutting stock by column generation.

Each document is tokenised and cut into whole sequences and one tail; that gives a
histogram of piece lengths in classes of ``GRAIN`` tokens.  The linear program over
patterns (how many pieces of each class one sequence holds) is solved by the revised
simplex method; a knapsack dynamic programme over the capacity prices new columns.
Pattern counts are rounded down, what is left over goes first-fit decreasing, and the
ranked documents of each class are dealt to the patterns' places by arithmetic.

The driver sees the histogram alone (at most ``length / GRAIN`` rows).  Ranks are
taken inside (class, hash split), so that no task holds a class.

Null text is empty; an empty text still has the closing id, one piece of length 1;
texts longer than a sequence become several pieces; repeated rows and ids are packed
each by itself; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellcube.llm.common import byte_lengths, chunks, inverse, prepare, splits, stored
from cellcube.llm.tokens import document_ids

LENGTH = 2048
GRAIN = 8
TOKENIZER = "word_bpe_49k.json"
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best total of ``value[k - 1]`` for pieces of k units, any number of each, within ``capacity``."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    gain = np.concatenate([[0.0], value])   # index = units
    for w in range(1, capacity + 1):
        m = min(w, len(value))
        totals = best[w - m:w][::-1] + gain[1:m + 1]    # piece of k units: best[w - k] + gain[k]
        k = int(totals.argmax())
        if totals[k] > best[w - 1]:
            best[w], took[w] = totals[k], k + 1
        else:
            best[w] = best[w - 1]
    counts, w = np.zeros(len(value), np.int64), capacity
    while w > 0:
        if took[w]:
            counts[took[w] - 1] += 1
            w -= took[w]
        else:
            w -= 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, capacity: int, gap: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """Patterns and their fractional numbers: least sequences that hold ``demand[k - 1]`` pieces of k units.

    Stops when no pattern prices in, or when the pricing bound proves the value within ``gap``."""
    rows = np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows].astype(float)
    columns = np.diag(capacity // (rows + 1)).astype(float)
    cost = np.ones(len(rows))
    basis = np.diag(1 / np.diag(columns))     # inverse of the basis
    amount = basis @ need
    for step in range(50 * len(rows) + 200):
        price = cost @ basis
        low = int(price.argmin())
        if price[low] < -1e-9:              # a surplus column brings a negative price back to zero
            entering, entering_cost = np.zeros(len(rows)), 0.0
            entering[low] = -1.0
        else:
            value = np.zeros(len(demand))
            value[rows] = price
            worth, counts = knapsack(value, capacity)
            # price / worth is feasible for the dual: a lower bound of the programme
            if worth <= 1 + 1e-9 or (price @ need) / worth >= (1 - gap) * (cost @ amount):
                break
            entering, entering_cost = counts[rows].astype(float), 1.0
        direction = basis @ entering
        able = direction > 1e-10
        if not able.any():
            break
        ratio = np.full(len(rows), np.inf)
        ratio[able] = amount[able] / direction[able]
        out = int(ratio.argmin())
        columns[:, out], cost[out] = entering, entering_cost
        if step % 200 == 199:
            basis = inverse(columns)
        else:
            row = basis[out] / direction[out]
            basis -= np.outer(direction, row)
            basis[out] = row
        amount = np.maximum(basis @ need, 0)
    out = []
    for j in range(len(rows)):
        if cost[j] and amount[j] > 0:
            pattern = np.zeros(len(demand), np.int64)
            pattern[rows] = columns[:, j].round().astype(np.int64)
            out.append((pattern, float(amount[j])))
    return out


def patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that hold every piece: rounded down, the rest first-fit decreasing."""
    left = demand.astype(np.int64).copy()
    out = []
    for pattern, amount in column_generation(demand, capacity):
        used = pattern > 0
        n = min(int(amount + 1e-6), int((left[used] // pattern[used]).min()))
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    # rounding leaves less than one pattern each, a number bounded by the classes
    room: list[int] = []
    held: list[Counter] = []
    for k in range(len(left), 0, -1):
        for _ in range(int(left[k - 1])):
            at = next((i for i, r in enumerate(room) if r >= k), None)
            if at is None:
                at = len(room)
                room.append(capacity)
                held.append(Counter())
            room[at] -= k
            held[at][k] += 1
    alike = Counter(tuple(sorted(h.items())) for h in held)
    for items, n in sorted(alike.items()):
        pattern = np.zeros(len(left), np.int64)
        for k, c in items:
            pattern[k - 1] = c
        out.append((pattern, n))
    return out


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """The whole sequences and the tail of every document, with the CRC-32 of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            out: list[tuple] = []
            for a, b in chunks(byte_lengths(texts)):
                ids, sizes = document_ids(texts.slice(a, b - a), tokenizer)
                ends = np.cumsum(sizes)
                ids = memoryview(np.insert(ids, ends, end_id).astype("<u4")).cast("B")
                begin = 0
                for doc, total in zip(docs[a:b], (sizes + 1).tolist()):
                    body = ids[4 * begin:4 * (begin + total)]
                    begin += total
                    for start in range(0, total, length):
                        piece = body[4 * start:4 * (start + length)]
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), total))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Every piece with its sequence_id and offset; offsets are gapless from 0 in each sequence."""
    spark = docs.sparkSession
    prepare(spark)
    cut = (stored(pieces(docs, tokenizer, end_id, length), "pack-pieces")
           .withColumn("cls", F.ceil(F.col("length") / grain).cast("int"))
           .withColumn("h", F.xxhash64("doc_id", "start", "ids_crc32")))
    counted = {r["cls"]: r["n"] for r in cut.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    units = -(-length // grain)
    demand = np.array([counted.get(k, 0) for k in range(1, units + 1)], np.int64)

    # places[cls]: ranks from first on go, `each` to a sequence, to the sequences from `sequence` on
    places, sequence, dealt = [], 0, np.zeros(units, np.int64)
    for pattern, n in patterns(demand, length // grain):
        for k in np.flatnonzero(pattern):
            each = int(pattern[k])
            places.append((int(k) + 1, int(dealt[k]), int(dealt[k]) + each * n, each, sequence))
            dealt[k] += each * n
        sequence += n
    places = spark.createDataFrame(places, "cls int, first long, until long, each long, sequence long")

    parts = spark.createDataFrame([(c, splits(n)) for c, n in counted.items()], "cls int, parts int")    # a row for each class
    cut = cut.join(F.broadcast(parts), "cls").withColumn("part", F.pmod("h", "parts").cast("int"))
    before = (cut.groupBy("cls", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("cls").orderBy("part")) - F.col("n")).drop("n"))
    order = ["h", "doc_id", "start", "ids_crc32", "doc_tokens"]
    rank = F.row_number().over(W.partitionBy("cls", "part").orderBy(*order)) - 1
    placed = (cut.withColumn("rank", rank).join(before, ["cls", "part"])
              .withColumn("rank", F.col("rank") + F.col("before"))
              .join(F.broadcast(places), "cls").filter("rank >= first AND rank < until")
              .withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))))
    within = W.partitionBy("sequence_id").orderBy(F.desc("length"), "cls", "rank")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         (F.sum("length").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).alias("offset"))
