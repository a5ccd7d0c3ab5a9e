"""Approximate nearest neighbours (op 10): a hierarchical navigable small-world graph per shard.

Vectors are dealt to shards by hash.  Each shard is small enough for exact candidate
lists, from which a graph is built level by level: a node keeps candidates that are
nearer to it than to any neighbour already kept, then reverse links are added.  The
levels are flat neighbour arrays in one stored row a shard.  Groups of queries are
searched in every shard, a beam at a time, and the shards' results are merged by
cosine in double precision on the original vectors.

Equal vectors are one node that holds their least ids, so a vector that a third of the
rows share weighs one node and every tie is resolved by id.  Queries and shards meet in
groups of bounded size; the number of groups grows with both.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id.  Vectors of other lengths are in other shards and are not
compared.  Repeated rows with one id count once; fewer candidates than asked give all;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellcube.llm.common import prepare, stored

LINKS = 16          # kept neighbours above the ground level; twice that on it
CANDIDATES = 64     # nearest nodes looked at when links are chosen
BEAM = 96
SHARD = 8_192       # nodes in a shard
GROUP = 1_024       # queries searched together

INDEX = "shard long, dim int, n int, vectors binary, ids binary, counts binary, entry int, levels array<struct<nodes: binary, links: binary>>"


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to 0.5 .. 1: same
    directions and digits, and squares that neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar other rows of each row, nearest first (ties: smaller index)."""
    n = len(x)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, 512):
        sim = x[a:a + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -np.inf
        part = np.argpartition(-sim, min(k, n - 1) - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
        out[a:a + 512] = np.take_along_axis(part, order, 1)
    return out


def _links(x: np.ndarray, width: int, keep: int) -> np.ndarray:
    """Neighbour array (n, width) of one level, -1 where there is none."""
    n = len(x)
    out = np.full((n, width), -1, np.int32)
    if n < 2:
        return out
    near = _nearest(x, min(CANDIDATES, n - 1))
    chosen = np.zeros(near.shape, bool)
    for a in range(0, n, 256):
        c = x[near[a:a + 256]]
        own = np.einsum("ncd,nd->nc", c, x[a:a + 256])
        between = c @ c.transpose(0, 2, 1)
        kept = np.zeros(own.shape, bool)
        closest = np.full(own.shape, -np.inf, x.dtype)      # to any kept candidate
        for j in range(own.shape[1]):
            take = (own[:, j] > closest[:, j]) & (kept.sum(axis=1) < keep)
            kept[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        # places that are left go to the nearest of the others
        free = keep - kept.sum(axis=1)
        rest = ~kept & (np.cumsum(~kept, axis=1) <= free[:, None])
        chosen[a:a + 256] = kept | rest
    src, at = np.nonzero(chosen)
    dst = near[src, at]
    # links both ways; own links first, then reverse links by similarity, up to the width
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    back = np.repeat([0, 1], len(src))
    sim = np.einsum("ed,ed->e", x[a], x[b])
    order = np.lexsort((b, -sim, back, a))
    a, b = a[order], b[order]
    _, first = np.unique(a.astype(np.int64) * n + b, return_index=True)
    only = np.sort(first)
    a, b = a[only], b[only]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < width
    out[a[fits], place[fits]] = b[fits]
    return out


def build(vectors: np.ndarray, seed: int = 11) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Levels (nodes, links by place among all nodes) from the ground up, and the entry node."""
    n = len(vectors)
    x = _unit(vectors)
    draw = np.random.default_rng(seed).random(n)
    height = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int)
    levels = []
    for level in range(int(height.max(initial=0)) + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        links = _links(x[nodes], 2 * LINKS if level == 0 else LINKS, LINKS if level == 0 else LINKS // 2)
        levels.append((nodes, np.where(links >= 0, nodes[links], -1).astype(np.int32)))
    return levels, int(levels[-1][0][0])


def _beam(x: np.ndarray, place: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    """Best ``beam`` nodes found for each query from its start nodes; -1 pads."""
    q, n = len(queries), len(x)
    seen = np.zeros((q, n + 1), bool)
    rows = np.arange(q)[:, None]
    ids = np.full((q, beam), -1, np.int32)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    fresh = start
    active = np.arange(q)
    while True:
        # fresh: nodes to look at, for the active queries
        new = np.where(seen[active[:, None], fresh] | (fresh < 0), -1, fresh)
        seen[active[:, None], new] = True           # -1 marks the spare column
        s = np.where(new >= 0, np.einsum("qkd,qd->qk", x[new], queries[active]), -np.inf).astype(np.float32)
        all_ids, all_sims = np.concatenate([ids[active], new], 1), np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([done[active], new < 0], 1)
        # a node may come twice in one batch: only the first counts
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[active], sims[active] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)
        left = ~done
        active = np.flatnonzero(left.any(axis=1))
        if not len(active):
            return ids
        pick = left[active].argmax(axis=1)          # sorted: the first open one is the best
        done[active, pick] = True
        fresh = links[place[ids[active, pick]]]


def search(vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], entry: int, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes found for each query (q, beam), -1 pads."""
    x = _unit(vectors)
    q = _unit(queries)
    at = np.full((len(q), 1), entry, np.int32)
    for level in range(len(levels) - 1, -1, -1):
        nodes, links = levels[level]
        place = np.zeros(len(x) + 1, np.int32)
        place[nodes] = np.arange(len(nodes))
        at = _beam(x, place, links, q, at, beam if level == 0 else 16)
    return at


def _usable(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    """id and key (the vector's doubles as bytes) of the rows that take part, equal vectors in a batch already together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, np.float64) + 0.0       # one zero
                if np.isfinite(x).all() and x.any():
                    found.setdefault(x.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([sorted(set(x)) for x in found.values()], pa.list_(pa.int64()))], ["key", "ids"])

    return vectors.select(F.col(id_name).cast("long"), F.col(vector_name)).mapInArrow(run, "key binary, ids array<long>")


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.float64).reshape(len(keys), -1) if keys else np.zeros((0, 0))


def index(nodes: DataFrame, shard_size: int = SHARD) -> DataFrame:
    """The stored graphs: one row a shard."""
    n = nodes.count()
    shards = max(1, -(-n // shard_size))

    def make(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)      # the graph does not depend on the order of arrival
        keys = [keys[i] for i in order]
        ids = [group.column("ids")[i].as_py() for i in order]
        x = _matrix(keys)
        levels, entry = build(x)
        row = {"shard": group.column("shard")[0].as_py(), "dim": x.shape[1], "n": len(x), "vectors": x.tobytes(),
               "ids": np.array([i for v in ids for i in v], np.int64).tobytes(), "counts": np.array([len(v) for v in ids], np.int32).tobytes(), "entry": entry,
               "levels": [{"nodes": a.tobytes(), "links": b.tobytes()} for a, b in levels]}
        level = pa.struct([("nodes", pa.binary()), ("links", pa.binary())])
        schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()),
                            ("entry", pa.int32()), ("levels", pa.list_(level))])
        return pa.Table.from_pylist([row], schema)

    shard = (F.octet_length("key").cast("long") * shards + F.pmod(F.xxhash64("key"), F.lit(shards)))
    return stored(nodes.withColumn("shard", shard).groupBy("shard").applyInArrow(make, INDEX), "hnsw-index")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_name: str = "vec_id", vector_name: str = "embedding", shard_size: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    prepare(vectors.sparkSession)
    usable = stored(_usable(vectors, id_name, vector_name), "hnsw-vectors")
    # k + 1 least ids stand for equal vectors: one of them may be the query
    nodes = stored(usable.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice("ids", 1, k + 1))))), 1, k + 1).alias("ids")), "hnsw-nodes")
    graphs = index(nodes, shard_size)
    asked = usable.select("key", F.explode("ids").alias("query_id")).filter(F.col("query_id") % every == 0).distinct()
    groups = max(1, -(-asked.count() // GROUP))
    asked = asked.withColumn("grp", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("dim", (F.octet_length("key") / 8).cast("int"))
    each = graphs.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = asked.join(graphs.select(F.col("shard").alias("target"), "dim"), "dim")          # each query once to each shard of its length

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
            width = [2 * LINKS] + [LINKS] * len(row["levels"])
            levels = [(np.frombuffer(v["nodes"], np.int32), np.frombuffer(v["links"], np.int32).reshape(-1, w)) for v, w in zip(row["levels"], width)]
            counts, ids = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["ids"], np.int64)
            begins = np.concatenate([[0], np.cumsum(counts)])
            q = _matrix(right.column("key").to_pylist())
            found = search(x, levels, row["entry"], q)
            x, q = _scaled(x), _scaled(q)
            norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for i, query in enumerate(right.column("query_id").to_pylist()):
                at = np.unique(found[i][found[i] >= 0])
                score = (x[at] * q[i]).sum(axis=1) / (norm[at] * q_norm[i])
                n = counts[at]
                vec = ids[np.repeat(begins[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                score = np.repeat(score, n)
                score, vec = score[vec != query], vec[vec != query]
                best = np.lexsort((vec, -score))[:k]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += vec[best].tolist()
                out["score"] += score[best].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = each.groupBy("shard", "grp").cogroup(sent.select(F.col("target").alias("shard"), "grp", "query_id", "key").groupBy("shard", "grp")).applyInArrow(look, "query_id long, vec_id long, score double")
    # an id with several vectors is found once, at its best
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
