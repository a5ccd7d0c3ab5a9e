"""Sharding (op 7): longest-processing-time scheduling of groups that must stay together.

Groups are the rows with equal text.  A group larger than ``1 / (shards * 64)``
of all bytes is scheduled by itself; there are at most ``shards * 64`` of those.
All other groups are hashed into ``shards * 256`` bundles, so the scheduler sees a
table whose size depends on the number of shards alone, whatever the input.  Units
go, largest first, to the least-loaded shard through a heap.

Slots are gapless in each shard without a task that holds a shard: rows are ranked
inside (unit, hash split), and the counts of the splits and of the units are prefix-summed.
The number of splits follows the unit's rows, also that of one very frequent text.

Null text counts as empty (null and empty texts form one group, size 8); repeated
rows each take a slot; an empty table gives an empty result; null ids are ranked
like any other value; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellcube.llm.common import prepare, splits, stored

HEAVY = 64      # a group above 1 / (shards * HEAVY) of the bytes is a unit of its own
BUNDLES = 256   # bundles of small groups for each shard
EACH = 1_000    # rows of a unit ranked together


def lpt(sizes: Sequence[int], shards: int) -> list[int]:
    """Shard of each unit: largest first, to the least-loaded shard (ties: smaller shard, earlier unit)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + sizes[i], s))
    return out


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; equal texts share a shard."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"),
    ), "shard-rows")
    groups = stored(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    heavy_at = total // (shards * HEAVY)
    # at most shards * HEAVY groups can be that large
    heavy = groups.filter(F.col("bytes") > heavy_at).orderBy("grp").collect()
    n_bundles = shards * BUNDLES
    bundle = F.pmod(F.xxhash64("grp"), F.lit(n_bundles)).cast("int")
    light = (groups.filter(F.col("bytes") <= heavy_at).groupBy(bundle.alias("unit"))
             .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("unit").collect())
    units = [(r["unit"], r["bytes"], r["n"]) for r in light] + [(n_bundles + i, r["bytes"], r["n"]) for i, r in enumerate(heavy)]
    placed = lpt([b for _, b, _ in units], shards)
    shard_of = spark.createDataFrame([(u, s, splits(n, EACH)) for (u, _, n), s in zip(units, placed)], "unit int, shard int, parts int")
    own = spark.createDataFrame([(r["grp"], n_bundles + i) for i, r in enumerate(heavy)], "grp binary, own int")

    part = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")).cast("int")
    rows = (rows.join(F.broadcast(own), "grp", "left")
            .withColumn("unit", F.coalesce("own", bundle)).drop("own", "grp")
            .join(F.broadcast(shard_of), "unit").withColumn("part", part))
    # prefix sums in two levels: units of a shard (bounded by the number of shards), splits of a unit
    counts = stored(rows.groupBy("shard", "unit", "part").agg(F.count("*").alias("n")), "shard-splits")
    ahead = (counts.groupBy("shard", "unit").agg(F.sum("n").alias("n"))
             .select("unit", (F.sum("n").over(W.partitionBy("shard").orderBy("unit")) - F.col("n")).alias("ahead")))
    base = (counts.withColumn("base", F.sum("n").over(W.partitionBy("unit").orderBy("part")) - F.col("n"))
            .join(F.broadcast(ahead), "unit").select("unit", "part", (F.col("base") + F.col("ahead")).alias("base")))
    rank = F.row_number().over(W.partitionBy("unit", "part").orderBy("doc_id", "size", "text_crc32"))
    return (rows.withColumn("rank", rank).join(base, ["unit", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).alias("slot")))
