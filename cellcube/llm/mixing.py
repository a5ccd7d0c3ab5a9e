"""Mixing sources to target weights (op 3): systematic sampling within each source.

Documents are put in one order per source (size class, hash split, size, hash), their
expected copies are prefix-summed from one random offset, and a copy is emitted for every
integer boundary crossed.  The documents of one size class (eight to a doubling) expect
the same copies, near ``target / source size``: from the longest class down, each class
expects a whole number of copies in all, the one nearest to what is still to be taken
that leaves the shorter classes a target they can meet.  So a class's copies are known,
long documents don't decide the total by chance, and what their rounding leaves is
settled by short ones.

The prefix sum needs no task that holds a source: a class begins at a whole number, ranks
are taken inside (source, size class, hash split) and the splits' counts are prefix-summed;
the number of splits follows each class's size.  The plan of a source is made from its
classes in one group of at most some hundred rows; only the table of sources (one row
each) goes through the driver.

Null text has size 0; a null source is a source of its own, last in order; a source
of size 0 has target 0 and takes nothing; repeated rows are sampled each by itself;
an empty table gives an empty result; ties fall to the hash and the id.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellcube.llm.common import free_name, n_words, prepare, stored

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
SEED = 20_26
EACH = 1_000        # rows ranked together


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = MAX_REPEATS) -> dict[str | None, float]:
    """Words to take from each source: a share of all words by weight, at most
    ``cap`` times the source; what is above is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > cap * sizes[s]]
        if not full:
            out |= {s: per * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(cap * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def class_copies(n: Sequence[int], words: Sequence[int], target: float, cap: float = MAX_REPEATS) -> list[int]:
    """Copies that each size class of a source takes, longest documents first, so that the words
    come near the target: ``n`` documents with ``words`` words each class."""
    left, rest, out = target, float(sum(words)), []
    for m, w in zip(n, words):
        wanted = m * left / rest if rest else 0.0
        rest -= w
        most = math.floor(cap * m)
        if not w:
            out.append(0)
            continue
        each = w / m
        # the shorter classes can take from nothing to cap times their words
        low, high = math.ceil((left - cap * rest) / each - 1e-9), math.floor(left / each + 1e-9)
        k = math.floor(wanted + 0.5)
        k = min(max(k, low), high) if low <= high else k
        k = min(max(k, 0), most)
        out.append(k)
        left -= k * each
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with a struct ``mix`` (size, source_size, target, copies) for every row.

    Where ``docs`` has a column of that name, the struct's name starts with an underscore."""
    prepare(docs.sparkSession)
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size = n_words(F.col("text"))
    # eight classes for each doubling of the size
    rows = docs.select(kept.alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("src"), size.alias("size"))
    rows = (rows.withColumn("cls", F.floor(8 * F.log2(F.col("size") + 1)).cast("int"))
            .withColumn("h", F.xxhash64("id", F.lit(seed))))
    return _sample(rows, weights, cap, seed).select("row.*", F.col("mix").alias(free_name(docs, "mix")))


def mix_digest(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row, without carrying the texts."""
    prepare(docs.sparkSession)
    slim = stored(docs.select("doc_id", F.col("source").alias("src"), n_words(F.col("text")).alias("size")), "mix-sizes")
    rows = (slim.select(F.struct("doc_id").alias("row"), F.col("doc_id").alias("id"), "src", "size")
            .withColumn("cls", F.floor(8 * F.log2(F.col("size") + 1)).cast("int"))
            .withColumn("h", F.xxhash64("id", F.lit(seed))))
    out = _sample(rows, weights, cap, seed)
    return out.select("row.doc_id", "mix.size", "mix.source_size", "mix.target", "mix.copies",
                      (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def _sample(rows: DataFrame, weights: Sequence[float], cap: float, seed: int) -> DataFrame:
    spark = rows.sparkSession
    counts = stored(rows.groupBy("src", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
    by_source = {r["src"]: r["words"] for r in counts.groupBy("src").agg(F.sum("words").alias("words")).collect()}
    goal = targets(by_source, weights, cap)
    plan = spark.createDataFrame(
        [(s, i, by_source[s], goal[s], random.Random(f"{seed} {s!r}").random()) for i, s in enumerate(goal)],
        "p_src string, sid int, source_size long, target double, start double")
    classes = (counts.select(F.col("src").alias("c_src"), F.col("cls").alias("c_cls"), "n", "words")
               .join(F.broadcast(plan), F.col("c_src").eqNullSafe(F.col("p_src"))).drop("p_src"))

    def share(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("c_cls", "descending")])
        n, words = rows.column("n").to_pylist(), rows.column("words").to_pylist()
        copies = class_copies(n, words, rows.column("target")[0].as_py(), cap) if n else []
        rate = [k / m for k, m in zip(copies, n)]
        return rows.drop_columns(["words"]).append_column("rate", pa.array(rate, pa.float64()))

    # a row for each source and size class: bounded by the sources
    plan = classes.groupBy("sid").applyInArrow(share, "c_src string, c_cls int, n long, sid int, source_size long, target double, start double, rate double")
    plan = stored(plan, "mix-plan").withColumn("parts", F.ceil(F.col("n") / EACH)).drop("n")
    rows = (rows.join(F.broadcast(plan), F.col("src").eqNullSafe(F.col("c_src")) & (F.col("cls") == F.col("c_cls"))).drop("c_src", "c_cls", "src")
            .withColumn("part", F.pmod("h", F.col("parts"))))
    before = (rows.groupBy("sid", "cls", "part").agg(F.count("*").alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("sid", "cls").orderBy("part")) - F.col("n"))
              .drop("n"))
    rank = F.row_number().over(W.partitionBy("sid", "cls", "part").orderBy("size", "h", "id"))
    rows = rows.withColumn("rank", rank).join(before, ["sid", "cls", "part"])
    last = F.col("before") + F.col("rank")
    copies = F.floor(last * F.col("rate") + F.col("start")) - F.floor((last - 1) * F.col("rate") + F.col("start"))
    return rows.select("row", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies, same columns."""
    name = free_name(docs, "mix")
    out = mix(docs, **options).filter(F.col(f"{name}.copies") > 0)
    return out.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies")))).drop(name)
