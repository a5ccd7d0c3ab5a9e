"""LM scoring (op 5): interpolated bigrams in Elias-Fano tries.

The corpus model is a Witten-Bell bigram over a unigram with one added to each count:
``p(w | v) = c(v, w) / (c(v) + T(v)) + rest(v) * p(w)``, ``rest`` being the mass the
first part leaves, so that the probabilities sum to one.

1. Documents are indexed once in blocks of a few megabytes: distinct words, distinct
   pairs (sorted by context, then word), training counts, and the documents in which
   each pair occurs.  The index is stored, bucketed by block.
2. Each block sends its distinct words and pairs with training counts to shards, pairs
   by sampled splitters over (context, word), so a context that a third of all
   tokens follow is parted among shards.  A block sends a pair once, however often it
   occurs.
3. A shard adds up the counts and builds its trie: context and successor levels as
   Elias-Fano sequences with monotone pointers, quantised smoothed probabilities, in a
   flat file that is memory-mapped and queried by successor search relative to the
   context.  It answers each block with codes for pairs and the mass of each context.
4. A shard holds at most two parted contexts (those of its two bounding splitters) and
   reports the trained successors of its part.  Their sums over the shards are T(v); the
   share of a part is smoothed with that part's number, so blocks rescale it to T(v).
5. Blocks add up the log probabilities of their documents.

Words are known by 64-bit hashes (40 bits for a word after its context).

Null text counts as empty: one end token; a null id trains and is scored like the id
with no digits; repeated rows are counted and scored each; with no training text
counts are 0 and all scores are 0 or less; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.blobs import get, put
from cellcube.llm.common import bucketed, chunks, prepare, stored, text_bytes
from cellcube.llm.eliasfano import WORD_BITS, Trie, from_code, mapped
from cellcube.llm.suffix import multikey_sort

BLOCK = 4 << 20         # bytes of text in a block
BUCKET = 8 << 20        # bytes of text for each shard
CACHED = 200_000        # words whose hash a worker keeps
SAMPLES = 20_000
EACH = 32               # sampled leads for each shard, where that is more
SEED = 5
END = 0x9E3779B97F4A7C15        # fixed values: stand for the end token and for the begin of a text
BEGIN = 0xC2B2AE3D27D4EB4F
SHORT = np.uint64(64 - WORD_BITS)

INDEX = "block long, n_bytes long, ids binary, nulls binary, words binary, trained binary, follow binary, second binary, times binary, counted binary, doc binary, sample array<struct<v: long, w: long>>"
REQUEST = "block long, bucket int, u binary, uc binary, v binary, vn binary, vc binary, w binary, wc binary"
ANSWER = "block long, bucket int, uc binary, mass binary, code binary, n_tokens long, n_distinct long, parted array<struct<v: long, c: long, t: long>>"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


class _Hashes(dict):
    """64-bit hash of a word; keeps a bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_hashes = _Hashes()


def _sum_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.flatnonzero(first)) if len(values) else values


def _index(ids: list, texts: list[bytes], modulus: int, part: int) -> dict:
    """The index of one block."""
    words = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    token = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    look = _hashes.__getitem__
    for ws, end in zip(words, ends.tolist()):
        token[end - 1 - len(ws):end - 1] = np.fromiter(map(look, ws), np.uint64, len(ws))
        token[end - 1] = END
    doc = np.repeat(np.arange(len(texts)), sizes)
    train = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus != part for i in ids], bool)
    known, at = np.unique(np.concatenate([token, np.array([BEGIN], np.uint64)]), return_inverse=True)
    begin, at = at[-1], at[:-1]
    before = np.concatenate([[begin], at[:-1]])
    before[ends[:-1]] = begin
    in_train = train[doc]
    trained = np.bincount(at[in_train], minlength=len(known))
    as_context = np.bincount(before[in_train], minlength=len(known))
    order = np.argsort(before * len(known) + at, kind="stable")
    v, w = before[order], at[order]
    first = np.ones(len(order), bool)
    first[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    heads = np.flatnonzero(first)
    some = heads[np.linspace(0, len(heads) - 1, min(64, len(heads))).astype(int)] if len(heads) else heads
    return {"words": put(known, 8, True), "trained": put(np.concatenate([trained, as_context]), 4),
            "follow": put(np.bincount(v[heads], minlength=len(known)), 4), "second": put(w[heads], 4),
            "times": put(np.diff(np.concatenate([heads, [len(order)]])), 4),
            "counted": put(_sum_runs(in_train[order].astype(np.int64), first), 4), "doc": put(doc[order], 4),
            "sample": [{"v": int(a), "w": int(b)} for a, b in zip(known[v[some]].view(np.int64), known[w[some]].view(np.int64))]}


class _Read:
    """The index of a block, read back, with its slices for the shards."""

    def __init__(self, row: dict):
        self.words = get(row["words"], 8, True)
        both = get(row["trained"], 4).astype(np.int64)
        self.trained, self.as_context = both[:len(self.words)], both[len(self.words):]
        self.follow = get(row["follow"], 4).astype(np.int64)
        self.second = get(row["second"], 4).astype(np.int64)
        self.counted = get(row["counted"], 4).astype(np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.follow)])
        self.first = np.repeat(np.arange(len(self.words)), self.follow)

    def slices(self, splitters: np.ndarray) -> Iterator[tuple[int, slice, slice, np.ndarray, np.ndarray]]:
        """For each shard the block has to do with: its words, its pairs, its contexts and their numbers of pairs.

        ``splitters`` are (context, word) pairs in order; a pair's shard is the number of
        splitters not above it.  The work follows the block, not the number of shards."""
        n, sv, sw = len(splitters) + 1, splitters[:, 0], splitters[:, 1]
        shard = np.searchsorted(sv, self.words[self.first], side="right")
        contexts, of, counts = [], [], []
        # a context that splitters part goes to every shard that may hold a part of it
        for i in np.flatnonzero(np.isin(self.words, sv)).tolist():
            a, b = int(self.begins[i]), int(self.begins[i + 1])
            lo, hi = int(np.searchsorted(sv, self.words[i], side="left")), int(np.searchsorted(sv, self.words[i], side="right"))
            shard[a:b] = lo + np.searchsorted(sw[lo:hi], self.words[self.second[a:b]], side="right")
            of.append(np.arange(lo, hi + 1))
            contexts.append(np.full(hi + 1 - lo, i))
            counts.append(np.zeros(hi + 1 - lo, np.int64))
        if len(shard):
            at = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (self.first[1:] != self.first[:-1])]))
            of.append(shard[at])
            contexts.append(self.first[at])
            counts.append(np.diff(np.concatenate([at, [len(shard)]])))
        of, contexts, counts = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (of, contexts, counts))
        order = np.lexsort((contexts, of))
        of, contexts, counts = of[order], contexts[order], counts[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (contexts[1:] != contexts[:-1])
        of, contexts, counts = of[first], contexts[first], _sum_runs(counts, first)
        home = ((self.words >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        for k in np.union1d(of, home.astype(np.int64)).tolist():
            w0, w1 = np.searchsorted(home, [k, k + 1])
            p0, p1 = np.searchsorted(shard, [k, k + 1])
            c0, c1 = np.searchsorted(of, [k, k + 1])
            yield k, slice(int(w0), int(w1)), slice(int(p0), int(p1)), contexts[c0:c1], counts[c0:c1]


def _shard(group: pa.Table, parted: np.ndarray) -> pa.Table:
    """Adds up what the blocks sent, builds the shard's trie and answers each block.

    The first answer also tells, for each of the contexts ``parted``, its count and how many trained successors are here."""
    rows = group.to_pylist()
    # words
    u = [get(r["u"], 8, True) for r in rows]
    counts = np.concatenate([get(r["uc"], 4) for r in rows]).astype(np.int64)
    order, first = multikey_sort([np.concatenate(u)])
    total = _sum_runs(counts[order], first)
    per_word = np.empty(len(order), np.int64)
    per_word[order] = total[np.cumsum(first) - 1] if len(total) else total
    # contexts: counts over all blocks
    vs, vns = [get(r["v"], 8, True) for r in rows], [get(r["vn"], 4).astype(np.int64) for r in rows]
    v = np.concatenate(vs)
    order, first = multikey_sort([v])
    contexts = v[order][first]
    c_total = _sum_runs(np.concatenate([get(r["vc"], 4) for r in rows]).astype(np.int64)[order], first)
    number = np.empty(len(v), np.int64)
    number[order] = np.cumsum(first) - 1
    # pairs
    vn = np.concatenate(vns)
    pair_context = np.repeat(number, vn)
    word = np.concatenate([get(r["w"], 5) for r in rows])
    order, first = multikey_sort([pair_context, word])
    c_pair = _sum_runs(np.concatenate([get(r["wc"], 4) for r in rows]).astype(np.int64)[order], first)
    heads = order[first]
    p_context, p_word = pair_context[heads], word[heads]
    seen = c_pair > 0
    kinds = np.bincount(p_context[seen], minlength=len(contexts))
    below = np.maximum(c_total + kinds, 1)
    mass = np.bincount(p_context[seen], weights=c_pair[seen], minlength=len(contexts)) / below
    with mapped(Trie.build(contexts[p_context[seen]], p_word[seen], c_pair[seen] / below[p_context[seen]])) as trie:
        code = trie.codes_of(contexts[p_context], p_word)
    per_pair = np.empty(len(order), np.uint8)
    per_pair[order] = code[np.cumsum(first) - 1]
    per_context = np.floor(mass * 65535).astype(np.int64)[number]

    def parts(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return np.split(values, np.cumsum(sizes)[:-1])

    answers = zip(parts(per_word, [len(x) for x in u]), parts(per_context, [len(x) for x in vs]), parts(per_pair, [int(x.sum()) for x in vns]))
    answers = [(put(a, 5), put(b, 2), put(c.astype(np.int64), 1)) for a, b, c in answers]
    n = len(rows)
    at = np.flatnonzero(np.isin(contexts, parted))
    told = [{"v": v, "c": c, "t": t} for v, c, t in zip(contexts[at].view(np.int64).tolist(), c_total[at].tolist(), kinds[at].tolist())]
    return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                     **{k: pa.array([a[i] for a in answers], pa.binary()) for i, k in enumerate(("uc", "mass", "code"))},
                     "n_tokens": pa.array([int(total.sum())] * n, pa.int64()), "n_distinct": pa.array([int((total > 0).sum())] * n, pa.int64()),
                     "parted": pa.array([told, *[[]] * (n - 1)], pa.list_(pa.struct([("v", pa.int64()), ("c", pa.int64()), ("t", pa.int64())])))})


def _whole(answered: DataFrame) -> dict[int, list[tuple[int, float, float]]]:
    """For each shard its parted contexts: the context, the factor that takes a share smoothed
    with the part's successors to one smoothed with all T(v), and the mass of the whole context.

    At most two rows a shard, as many as there are splitters."""
    rows = answered.select("bucket", F.explode("parted").alias("p")).select("bucket", "p.v", "p.c", "p.t").collect()
    kinds: dict = {}
    for r in rows:
        kinds[r["v"]] = kinds.get(r["v"], 0) + r["t"]
    out: dict = {}
    for r in rows:
        below = max(r["c"] + kinds[r["v"]], 1)
        out.setdefault(r["bucket"], []).append((r["v"] % (1 << 64), max(r["c"] + r["t"], 1) / below, r["c"] / below))
    return out


def _splitters(index: DataFrame, n: int) -> np.ndarray:
    """Pairs (context, word) that part a bounded sample of the distinct pairs evenly."""
    wanted = max(SAMPLES, EACH * n)
    share = min(1.0, wanted / max(1, 64 * index.count()))
    rows = (index.sample(share, seed=1) if share < 1 else index).select("sample").limit(wanted // 16).collect()
    pairs = sorted((s["v"] % (1 << 64), s["w"] % (1 << 64)) for r in rows for s in r["sample"])
    picked = sorted(set(pairs[len(pairs) * i // n] for i in range(1, n))) if pairs else []
    return np.array(picked, np.uint64).reshape(-1, 2)


def score(docs: DataFrame, modulus: int = 7, part: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Documents whose crc32(doc_id as text) has remainder ``part`` modulo ``modulus`` are held out of training."""
    spark = docs.sparkSession
    prepare(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        kinds = {"sample": pa.list_(pa.struct([("v", pa.int64()), ("w", pa.int64())]))}
        names = ["words", "trained", "follow", "second", "times", "counted", "doc", "sample"]
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
            for a, b in chunks(list(map(len, texts)), BLOCK):
                row = _index(ids[a:b], texts[a:b], modulus, part)
                numbers = np.array([0 if i is None else i for i in ids[a:b]], np.int64)
                nulls = np.packbits([i is None for i in ids[a:b]]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([sum(map(len, texts[a:b]))], pa.int64()), pa.array([put(numbers)], pa.binary()), pa.array([nulls], pa.binary()),
                     *[pa.array([row[k]], kinds.get(k, pa.binary())) for k in names]], ["block", "n_bytes", "ids", "nulls", *names])
                number += 1

    index = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, INDEX), "block", "ngram-index")
    n_bytes = index.agg(F.sum("n_bytes")).first()[0] or 0
    splitters = _splitters(index, max(1, math.ceil(n_bytes / BUCKET)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REQUEST.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                x = _Read(row)
                out = []
                for k, words, pairs, contexts, counts in x.slices(splitters):
                    if len(contexts) or words.stop > words.start:
                        out.append((row["block"], k, put(x.words[words], 8, True), put(x.trained[words], 4), put(x.words[contexts], 8, True), put(counts, 4),
                                    put(x.as_context[contexts], 4), put(x.words[x.second[pairs]] >> SHORT, 5), put(x.counted[pairs], 4)))
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    asked = index.select("block", "words", "trained", "follow", "second", "counted").mapInArrow(ask, REQUEST)
    parted = np.unique(splitters[:, 0])

    def shard(group: pa.Table) -> pa.Table:
        return _shard(group, parted)

    answered = stored(asked.groupBy("bucket").applyInArrow(shard, ANSWER), "ngram-answers")
    sums = (answered.groupBy("bucket").agg(F.max("n_tokens").alias("n"), F.max("n_distinct").alias("v"))
            .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first())
    n_train, n_kinds = int(sums["n"] or 0), int(sums["v"] or 0)
    whole = _whole(answered)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _Read(row)
                answers = {r["bucket"]: r for r in row["answers"] or []}
                count, mass, code = np.zeros(len(x.words), np.int64), np.zeros(len(x.words)), np.zeros(len(x.second), np.uint8)
                scale, exact = np.ones(len(x.second)), {}
                for k, words, pairs, contexts, _ in x.slices(splitters):
                    if k in answers:
                        r = answers[k]
                        count[words] = get(r["uc"], 5).astype(np.int64)
                        mass[contexts] += get(r["mass"], 2).astype(float) / 65535
                        code[pairs] = get(r["code"], 1).astype(np.uint8)
                        for v, factor, full in whole.get(k, []):
                            i = int(np.searchsorted(x.words, np.uint64(v)))
                            if i < len(x.words) and int(x.words[i]) == v:
                                a, b = pairs.start + np.searchsorted(x.first[pairs], [i, i + 1])
                                scale[a:b] = factor
                                exact[i] = full
                p1 = (count + 1) / (n_train + (n_kinds + 1))
                for i, full in exact.items():
                    mass[i] = full
                p = from_code(code) * scale + (1 - mass[x.first]) * p1[x.second]
                times, doc = get(row["times"], 4).astype(np.int64), get(row["doc"], 4).astype(np.int64)
                ids = get(row["ids"]).view(np.int64)
                missing = np.unpackbits(np.frombuffer(row["nulls"], np.uint8))[:len(ids)].astype(bool)

                def per_doc(values: np.ndarray) -> np.ndarray:
                    return np.bincount(doc, weights=np.repeat(values, times), minlength=len(ids))

                held = [zlib.crc32(b"" if gone else str(i).encode()) % modulus == part for i, gone in zip(ids.tolist(), missing)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=missing), pa.array(held, pa.bool_()), pa.array(np.bincount(doc, minlength=len(ids)).astype(np.int64)),
                     pa.array(per_doc((count > 0)[x.second].astype(float)).astype(np.int64)), pa.array(per_doc(np.log10(p1)[x.second])),
                     pa.array(per_doc(np.log10(np.minimum(p, 1))))], [c.split()[0] for c in SCORES.split(", ")])

    own = answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "uc", "mass", "code")).alias("answers"))
    out = index.drop("sample").join(own.hint("shuffle_merge"), "block", "left").mapInArrow(finish, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
