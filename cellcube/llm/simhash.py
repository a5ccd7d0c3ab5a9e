"""SimHash near-duplicates (op 8): binary trie self-join.

Fingerprints are 64 majority bits over the XXH64 values of word shingles.  The
distinct fingerprints form a binary trie.  Its top is split on the driver from counts
alone until the leaves are small (a bounded number); pairs of top leaves are found by
traversing node pairs together, adding up differing bits and pruning above the error
budget.  Leaves are packed into one row each, and each surviving pair of leaves is one
row of a Spark job that goes on with the same traversal below them, level by level
over arrays of node pairs.

A pair of leaves returns a spanning forest of the links it found (linear in its fingerprints),
which keeps every connection; components then come from alternating stars.

Bits are first put in order of balance (most even first), which leaves distances as
they are and keeps the trie's top even when many bits are nearly constant.

Null text counts as empty; a text with fewer words than a shingle is one shingle of
all its words; a text without words has fingerprint zero and links like any other;
repeated rows and equal texts share a component; rows with a null id get the least
known id of their component (null if it has none); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.common import freeing, one_by_one, prepare, stored, text_bytes
from cellcube.llm.components import components

SHINGLE = 3
DISTANCE = 2
SEED = 42
LEAF = 4_096        # fingerprints in a leaf of the trie's top, or more when there would be too many leaves
LEAVES = 4_096
TOP = 16            # levels of the trie's top


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text (A-Z lower-cased); a bit is set if over half the shingles set it."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[words[i:] for i in range(shingle)])
    values = np.fromiter([digest(join(r), SEED) for r in runs], np.uint64, len(words) - shingle + 1)
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    half = 2 * bits.sum(axis=0, dtype=np.int64) > len(values)
    return int(np.packbits(half, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freeing(run), "doc_id long, fp long")


# ---------------------------------------------------------------- trie

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def near_pairs(left: np.ndarray, right: np.ndarray | None, distance: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted unsigned values at most ``distance`` bits apart, found by
    walking the two tries together from bit ``depth`` on; ``right`` None joins a trie with itself.

    A node is a range of the sorted values.  A pair of nodes splits into pairs of
    children; a pair whose prefixes differ in more than ``distance`` bits is dropped.
    Small pairs of nodes end in a comparison of their values."""
    own = right is None
    other = left if own else right
    if not len(left) or not len(other):
        return
    # a0, a1, b0, b1, differing bits so far
    todo = [(depth, np.array([[0, len(left), 0, len(other), int(_popcount((left[:1] ^ other[:1]) >> np.uint64(64 - depth))[0]) if depth else 0]], np.int64))]
    while todo:
        level, nodes = todo.pop()
        nodes = nodes[nodes[:, 4] <= distance]
        if own:
            nodes = nodes[nodes[:, 0] <= nodes[:, 2]]       # each pair of nodes once
        if not len(nodes):
            continue
        if len(nodes) > 200_000:                            # bounds the memory of the frontier
            todo += [(level, part) for part in np.array_split(nodes, 1 + len(nodes) // 100_000)]
            continue
        work = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = (work <= 16) if level < 64 else np.ones(len(nodes), bool)
        for part in _batches(nodes[done], work[done]):
            a, b = _members(part)
            if own:
                keep = a < b
                a, b = a[keep], b[keep]
            near = _popcount(left[a] ^ other[b]) <= distance
            if near.any():
                yield a[near], b[near]
        nodes = nodes[~done]
        if len(nodes):
            bit = np.uint64(63 - level)
            mid_a = _split(left, nodes[:, 0], nodes[:, 1], bit)
            mid_b = _split(other, nodes[:, 2], nodes[:, 3], bit)
            out = []
            for x in (0, 1):
                for y in (0, 1):
                    a0, a1 = (nodes[:, 0], mid_a) if x == 0 else (mid_a, nodes[:, 1])
                    b0, b1 = (nodes[:, 2], mid_b) if y == 0 else (mid_b, nodes[:, 3])
                    kids = np.stack([a0, a1, b0, b1, nodes[:, 4] + (x != y)], axis=1)
                    out.append(kids[(a0 < a1) & (b0 < b1)])
            todo.append((level + 1, np.concatenate(out)))


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index in each range whose value has ``bit`` set (ranges share all higher bits)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        is_set = (values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & is_set, mid, hi)
        lo = np.where(open_ & ~is_set, mid + 1, lo)


def _batches(nodes: np.ndarray, work: np.ndarray, limit: int = 4_000_000) -> Iterator[np.ndarray]:
    cuts = np.flatnonzero(np.diff(np.cumsum(work) // limit)) + 1
    for part in np.split(nodes, cuts):
        if len(part):
            yield part


def _members(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of small node pairs."""
    wide = nodes[:, 3] - nodes[:, 2]
    n = (nodes[:, 1] - nodes[:, 0]) * wide
    at = np.repeat(np.arange(len(nodes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return nodes[at, 0] + k // wide[at], nodes[at, 2] + k % wide[at]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least index connected with each of n nodes, by the given links; memory linear in n."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def top_leaves(counts: np.ndarray, levels: int, leaf: int) -> list[tuple[int, int]]:
    """Nodes (depth, prefix) of the trie's top: split while a node has more than ``leaf`` members and levels last."""
    sums = [counts]
    while len(sums[-1]) > 1:
        sums.append(sums[-1].reshape(-1, 2).sum(axis=1))
    out, todo = [], [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        n = sums[levels - depth][prefix]
        if not n:
            continue
        if n <= leaf or depth == levels:
            out.append((depth, prefix))
        else:
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return sorted(out, key=lambda x: x[1] << (levels - x[0]))


def leaf_pairs(leaves: list[tuple[int, int]], distance: int) -> list[tuple[int, int]]:
    """Pairs of leaves whose shared levels differ in at most ``distance`` bits, by walking node pairs together."""
    number = {leaf: i for i, leaf in enumerate(leaves)}
    inner = {(d, p >> (depth - d)) for depth, p in leaves for d in range(depth)}
    out, todo = [], [((0, 0), (0, 0), 0)]
    while todo:
        a, b, differing = todo.pop()
        if differing > distance:
            continue
        if a in number and b in number:
            out.append((number[a], number[b]))
            continue
        # a leaf above the other's level stays as it is and compares no further bits
        kids_a = [(a, None)] if a in number else [((a[0] + 1, 2 * a[1] + x), x) for x in (0, 1)]
        kids_b = [(b, None)] if b in number else [((b[0] + 1, 2 * b[1] + x), x) for x in (0, 1)]
        for i, (ka, x) in enumerate(kids_a):
            for j, (kb, y) in enumerate(kids_b):
                if a == b and i > j:
                    continue
                if (ka in number or ka in inner) and (kb in number or kb in inner):
                    todo.append((ka, kb, differing + (x is not None and y is not None and x != y)))
    return sorted(set(out))


# ---------------------------------------------------------------- Spark

def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """A spanning forest (a, b) of the links between the distinct fingerprints in column ``fp``."""
    spark = distinct.sparkSession
    stats = distinct.agg(F.count("*").alias("n"), *[F.sum(F.getbit("fp", F.lit(i)).cast("long")).alias(f"b{i}") for i in range(64)]).first()
    n = stats["n"]
    order = sorted(range(64), key=lambda i: (abs(2 * (stats[f"b{i}"] or 0) - n), i))     # most even bit first
    mixed = F.lit(0).cast("long")
    for place, i in enumerate(order):
        mixed = mixed.bitwiseOR(F.shiftleft(F.getbit("fp", F.lit(i)).cast("long"), 63 - place))
    mixed = stored(distinct.select("fp", mixed.alias("key")), "simhash-keys")
    prefix = F.shiftrightunsigned("key", 64 - TOP).cast("int")
    counts = np.zeros(1 << TOP, np.int64)
    for r in mixed.groupBy(prefix.alias("p")).count().collect():        # at most 2 ** TOP rows
        counts[r["p"]] = r["count"]
    leaves = top_leaves(counts, TOP, max(LEAF, n // LEAVES))
    pairs = leaf_pairs(leaves, distance)
    # at most 2 ** TOP rows: the leaf of each prefix
    bounds = [(i, p << (TOP - d), (p + 1) << (TOP - d)) for i, (d, p) in enumerate(leaves)]
    table = spark.createDataFrame(bounds, "leaf int, lo int, hi int").select("leaf", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("prefix"))

    def gather(group: pa.Table) -> pa.Table:
        key = group.column("key").to_numpy().view(np.uint64)
        at = np.argsort(key)
        return pa.table({"leaf": group.column("leaf")[:1], "keys": pa.array([key[at].tobytes()], pa.binary()),
                         "fps": pa.array([group.column("fp").to_numpy()[at].tobytes()], pa.binary())})

    packed = stored(mixed.withColumn("prefix", prefix).join(F.broadcast(table), "prefix").select("leaf", "fp", "key")
                    .groupBy("leaf").applyInArrow(gather, "leaf int, keys binary, fps binary"), "simhash-leaves")
    side = [packed.select(F.col("leaf").alias(x), F.col("keys").alias(f"keys_{x}"), F.col("fps").alias(f"fps_{x}")) for x in "ab"]
    tasks = spark.createDataFrame(pairs, "a int, b int").join(side[0], "a").join(side[1], "b")

    def join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in one_by_one(batch):
                key, fp = np.frombuffer(r["keys_a"], np.uint64), np.frombuffer(r["fps_a"], np.int64)
                if r["a"] == r["b"]:
                    found = near_pairs(key, None, distance)
                else:
                    other = np.frombuffer(r["keys_b"], np.uint64)
                    found = ((x, y + len(key)) for x, y in near_pairs(key, other, distance))
                    fp = np.concatenate([fp, np.frombuffer(r["fps_b"], np.int64)])
                root = forest(len(fp), found)
                linked = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

    return tasks.mapInArrow(freeing(join_leaves), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over fingerprints ``distance`` or fewer bits apart)."""
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, shingle), "simhash-fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    linked = components(fingerprint_links(first.select("fp"), distance))
    rooted = stored(first.join(linked, first.fp == linked.node, "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the row of its least doc_id (one of them, if the id repeats).
    Rows with a null id cannot be named by a component and stay."""
    keep = stored(near_duplicates(docs, shingle, distance).filter("component_id IS NOT NULL")
                  .select(F.col("component_id").alias("doc_id")).distinct(), "simhash-kept")
    named = docs.filter("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns)
