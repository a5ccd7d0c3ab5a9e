"""Training-order materialisation (op 2): keyed Feistel permutation over all sequences.

1. Documents are tokenised once and joined, each with its closing id, into streams; a
   stream (a few megabytes of text) is cut into sequences of ``length`` ids, the last
   padded.  Sequences are stored, numbered inside the task that made them.
2. The tasks' counts are prefix-summed, so that sequence numbers are dense; that table has
   one row a task, fewer than the driver itself keeps of its tasks.
3. A keyed Feistel network over the next even power of two, walked along its cycle
   until it lands below the number of sequences, gives every sequence its global
   slot: a permutation that needs no sort and no memory, and can be inverted.
4. Sequences are range-partitioned by shard, a column; a shard is ``stride`` of them, each
   ``4 * length`` bytes.  The ranges come from a sample, so a (compressed Parquet) file may
   hold several shards or none, whole and in slot order: slot s is row ``s % stride`` of shard
   ``s // stride`` and a reader resumes anywhere.

Null and empty texts still bring their closing id; texts longer than a sequence run
over several; repeated rows and ids come as often as they are; an empty table writes
nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.blobs import squeeze, unsqueeze
from cellcube.llm.common import byte_lengths, chunks, prepare, stored
from cellcube.llm.packing import END_ID, LENGTH, TOKENIZER
from cellcube.llm.tokens import document_ids
from cellcube.session import scratch_path

KEY = 20_26
STRIDE = 4096       # sequences in a shard
PAD_ID = 0
ROUNDS = 4

SEQUENCES = "task int, part long, n_tokens int, tokens binary"


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Compressed unpadded ids of each sequence, numbered within its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in chunks(byte_lengths(texts)):
                ids, sizes = document_ids(texts.slice(a, b - a), tokenizer)
                body = memoryview(np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")).cast("B")
                parts = [body[i:i + 4 * length] for i in range(0, len(body), 4 * length)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * n, pa.int32()), pa.array(range(made, made + n), pa.int64()), pa.array([len(x) // 4 for x in parts], pa.int32()),
                     pa.array([_narrow(x) for x in parts], pa.binary())], [c.split()[0] for c in SEQUENCES.split(", ")])
                made += n

    return docs.select("text").mapInArrow(run, SEQUENCES)


def _narrow(ids: memoryview) -> bytes:
    """The ids as byte planes, compressed: low bytes, then the next, and so on."""
    return squeeze(np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes())


def _wide(data: bytes, length: int, pad_id: int) -> bytes:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(4, -1)
    out = np.full(length, pad_id, "<u4")
    out[:planes.shape[1]] = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return out.tobytes()


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def _round(x: np.ndarray, key: int, r: int) -> np.ndarray:
    """Keyed mixing of 64-bit numbers (the finaliser of SplitMix64)."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (key * ROUNDS + r + 1)) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def network(x: np.ndarray, half: int, key: int, back: bool = False) -> np.ndarray:
    """The Feistel network on numbers of ``2 * half`` bits, forward or back."""
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for r in range(ROUNDS):
        if back:
            left, right = right ^ (_round(left, key, ROUNDS - 1 - r) & mask), left
        else:
            left, right = right, left ^ (_round(right, key, r) & mask)
    return (left << bits) | right


def walk(x: np.ndarray, n: int, half: int, key: int, back: bool = False) -> np.ndarray:
    """The network applied until the number is below n."""
    x = network(x, half, key, back)
    while (out := x >= n).any():
        x[out] = network(x[out], half, key, back)
    return x


def permuted(df: DataFrame, source: str, target: str, n: int, key: int = KEY, back: bool = False) -> DataFrame:
    """``df`` with column ``target``: the slot of the dense number in ``source`` (or the number of a slot, ``back``).

    The domain is at most four times n (or four numbers), so a walk takes four steps on
    average.  Each is one look at the row in a task, and a walk always ends: it comes
    back to its own number, which is below n."""
    half = _half_bits(n)

    def slots(x: pa.Array) -> pa.Array:
        return pa.array(walk(x.to_numpy(zero_copy_only=False).astype(np.uint64), n, half, key, back).astype(np.int64))

    return df.withColumn(target, F.arrow_udf(slots, "long")(F.col(source)))


def materialise(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, length: int = LENGTH, stride: int = STRIDE,
                key: int = KEY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """Writes the shards (Parquet: shard, slot, n_tokens, tokens) and returns them as a table with the sequence's number."""
    spark = docs.sparkSession
    prepare(spark)
    cut = stored(sequences(docs, tokenizer, length, end_id), "order-sequences")
    counts = sorted((r["task"], r["n"]) for r in cut.groupBy("task").agg(F.count("*").alias("n")).collect())     # one row a task
    firsts, total = [], 0
    for task, n in counts:
        firsts.append((task, total))
        total += n
    first = F.broadcast(spark.createDataFrame(firsts, "task int, first long"))
    placed = permuted(cut.join(first, "task").withColumn("sequence", F.col("first") + F.col("part")), "sequence", "slot", max(1, total), key)
    shards = max(1, -(-total // stride))
    placed = (placed.select("sequence", "slot", (F.col("slot") / stride).cast("long").alias("shard"), "n_tokens", "tokens")
              .repartitionByRange(min(shards, 20_000), "shard").sortWithinPartitions("slot"))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            for lo in range(0, batch.num_rows, 256):        # padded rows are large: few at once
                some = batch.slice(lo, 256)
                yield some.set_column(at, "tokens", pa.array([_wide(t, length, pad_id) for t in some.column(at).to_pylist()], pa.binary()))

    path = path or scratch_path(spark, "llm-order")
    (placed.mapInArrow(widen, "sequence long, slot long, shard long, n_tokens int, tokens binary")
     .write.option("compression", "zstd").parquet(path))
    return spark.read.schema("sequence long, slot long, shard long, n_tokens int, tokens binary").parquet(path)


def resume(shards: DataFrame, slot: int) -> DataFrame:
    """What is left to read from ``slot`` on: whole shards, then rows of the first one (statistics skip the files before)."""
    return shards.filter(F.col("slot") >= slot)


def digest(docs: DataFrame, **options) -> DataFrame:
    """sequence, slot, shard, row, n_tokens and the CRC-32 of the bytes of every sequence that was written."""
    stride = options.get("stride", STRIDE)
    return materialise(docs, **options).select("sequence", "slot", "shard", (F.col("slot") % stride).alias("row"), "n_tokens", F.crc32("tokens").alias("ids_crc32"))
