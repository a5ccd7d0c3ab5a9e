"""Suffix-array dedup (op 4): removes every byte covered by a 50-byte string that an earlier document has.

Sorting all suffixes of a corpus moves fifty times its size, so the suffix array is
sparse.  In each 50-byte window the 16-byte gram of least hash (leftmost if equal) is
its anchor; equal windows have equal anchors at equal places, whatever surrounds them,
so suffixes that start at anchors (about one byte in eighteen) find every repeat.  A
run of consecutive windows with one anchor is one entry: the anchor suffix's two
leading 8-byte tokens and a hash of the bytes that the run's windows span.

1. Documents are stored once as blocks of a few megabytes, bucketed by block.
2. Each block sorts its entries, keeps one of each kind with its least document, and
   sends them to the bucket that sampled splitters give for the leading tokens.
3. Buckets sort by multikey quicksort over the tokens and compare neighbours: equal
   entries get the least document.  Entries that share an anchor and the 17 bytes on
   one side of it, but not their span (repeats end inside one of them), are handed back.  Equal tokens never lie on both
   sides of a splitter.
4. For entries handed back, blocks send the hash of each 50-byte window, which is
   resolved in the same way, so that results are exact to the byte.
5. Blocks mark what is covered and cut it out.

A block sends each kind of entry once, so a passage that a third of all documents
share weighs one entry a block.  Spans are told apart by 64 bits beside 128 bits of
plain tokens, windows by 64 bits.

Null text counts as empty (and stays null in ``cut``); null ids come after all others;
rows with equal ids never remove from each other; texts under 50 bytes stay whole; very
long texts are a block of their own; empty tables give empty results; extra columns
pass through ``cut`` untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.llm.blobs import get, put, squeeze, unsqueeze
from cellcube.llm.common import bucketed, chunks, freeing, give_back, one_by_one, prepare, stored, text_bytes

SPAN = 50               # bytes of a string that counts as repeated
GRAM = 16               # bytes of an anchor: two leading tokens
WIDTH = SPAN - GRAM + 1
HALF = (SPAN - GRAM) // 2   # a window holds that many bytes before its anchor's gram, or after it
BLOCK = 4 << 20         # bytes of text in a block
BUCKET = 16 << 20       # bytes of text for each bucket
SAMPLES = 20_000        # tokens sampled for the splitters, at most about so many
EACH = 32               # sampled leads for each shard, where that is more
LAST = np.iinfo(np.int64).max
STEP = 60_000           # windows handled at once

BLOCKS = "block long, n_bytes long, rest binary, lengths binary, absent binary, text binary, tokens array<long>"
REQUEST = "block long, bucket int, a binary, b binary, c binary, doc binary"
ANSWER = "block long, bucket int, at binary, doc binary, open binary"

# fixed values: odd multipliers that mix 64-bit words
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
S29, S32 = np.uint64(29), np.uint64(32)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each offset as one big-endian number (a view of every byte offset)."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S29)) * M3
    return x ^ (x >> S32)


def _span_hash(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from ``start``, ``length`` each."""
    h = length.astype(np.uint64) * M1
    for k in range(0, int(length.max(initial=0)), 8):
        left = length - k
        w = words[np.minimum(start + k, len(words) - 1)].astype(np.uint64)
        cut = np.clip(8 * (8 - left), 0, 63).astype(np.uint64)
        w = np.where(left > 0, (w >> cut) << cut, np.uint64(0))
        h = np.where(left > 0, _mix((h ^ w) * M2), h)
    return h


class Block:
    """The entries of one block: runs of windows with one anchor."""

    def __init__(self, text: bytes, lengths: np.ndarray, ids: np.ndarray):
        self.data = np.frombuffer(text + b"\0" * 96, np.uint8)
        self.n = len(text)
        self.lengths, self.ids = lengths, ids
        self.ends = np.cumsum(lengths)
        self.words = _words(self.data)
        self._runs()

    def _anchors(self) -> np.ndarray:
        """Anchor of the window at each offset; -1 where the window leaves its document."""
        n = self.n - SPAN + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out = np.empty(n, np.int32)
        low = np.uint64(0xFFFF)
        for c in range(0, n, STEP):
            m = min(STEP, n - c) + WIDTH - 1
            w0, w1 = self.words[c:c + m].astype(np.uint64), self.words[c + 8:c + 8 + m].astype(np.uint64)
            key = (_mix(w0 * M1 + _mix(w1 * M2)) & ~low) | np.arange(m, dtype=np.uint64)
            wide = 1
            while 2 * wide <= WIDTH:
                key = np.minimum(key[:-wide], key[wide:])
                wide *= 2
            if wide < WIDTH:
                key = np.minimum(key[:len(key) - (WIDTH - wide)], key[WIDTH - wide:])
            out[c:c + len(key)] = (key & low).astype(np.int32) + np.int32(c)
        # the last 49 offsets of each document
        tail = (self.ends[:, None] - np.arange(1, SPAN)).ravel()
        starts = np.repeat(self.ends - self.lengths, SPAN - 1)
        out[tail[(tail >= starts) & (tail < n)]] = -1
        return out

    def _runs(self) -> None:
        anchor = self._anchors()
        if len(anchor):
            begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            stops = np.concatenate([begins[1:], [len(anchor)]])
            used = anchor[begins] >= 0
            self.start, self.windows = begins[used], (stops - begins)[used]
            at = anchor[self.start].astype(np.int64)
        else:
            self.start = self.windows = at = np.zeros(0, np.int64)
        self.at = at
        doc_at = np.searchsorted(self.ends, self.start, side="right")
        self.doc = self.ids[doc_at] if len(self.ids) else np.zeros(0, np.int64)
        t0, t1 = self.words[at].astype(np.uint64), self.words[at + 8].astype(np.uint64)
        span = _span_hash(self.words, self.start, self.windows + SPAN - 1) ^ ((at - self.start).astype(np.uint64) * M2)
        # 40 bits for the whole span, 12 each for the bytes just before and just after the gram (0: the span ends sooner)
        n = np.full(len(at), HALF)
        before = np.where(at - self.start >= HALF, 1 + _span_hash(self.words, np.maximum(at - HALF, 0), n) % np.uint64(4095), np.uint64(0))
        after = np.where(self.start + self.windows + SPAN - 1 - at - GRAM >= HALF, 1 + _span_hash(self.words, at + GRAM, n) % np.uint64(4095), np.uint64(0))
        span = (before << np.uint64(52)) | (after << np.uint64(40)) | (_mix(span) >> np.uint64(24))
        order, first = multikey_sort([t0, t1, span])
        self.kind = np.empty(len(order), np.int64)          # entry -> its kind
        self.kind[order] = np.cumsum(first) - 1
        lead = order[first]
        self.t0, self.t1, self.span = t0[lead], t1[lead], span[lead]
        self.least = np.minimum.reduceat(self.doc[order], np.flatnonzero(first)) if len(order) else np.zeros(0, np.int64)

    def open_windows(self, kinds: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and document's id of each window of the given kinds that holds the shared side (1 before, 2 after, 3 either)."""
        picked = np.zeros(len(self.t0), np.int64)
        picked[kinds] = sides
        e = np.flatnonzero(picked[self.kind])
        n = self.windows[e]
        at = np.repeat(self.start[e], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lead, side = np.repeat(self.at[e], n) - at, np.repeat(picked[self.kind[e]], n)
        keep = ((side & 1 > 0) & (lead >= HALF)) | ((side & 2 > 0) & (lead <= HALF))
        return at[keep], np.repeat(self.doc[e], n)[keep]

    def window_kinds(self, kinds: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
        """Offsets, documents and kinds of the windows; hash and least document of each kind."""
        at, doc = self.open_windows(kinds, sides)
        h = _span_hash(self.words, at, np.full(len(at), SPAN))
        order, first = multikey_sort([h])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(first) - 1
        least = np.minimum.reduceat(doc[order], np.flatnonzero(first)) if len(order) else np.zeros(0, np.int64)
        return at, doc, kind, h[order[first]], least


def multikey_sort(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their tokens, and a mark on the first of equal rows.

    Multikey quicksort a token at a time: rows are sorted by the first token, and only
    runs that are still equal go on to the next."""
    n = len(tokens[0])
    order = np.argsort(tokens[0])
    first = np.ones(n, bool)
    if n:
        head = tokens[0][order]
        first[1:] = head[1:] != head[:-1]
    for token in tokens[1:]:
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows, run = order[at], np.cumsum(first)[at]
        value = token[rows]
        by = np.lexsort((value, run))
        order[at] = rows[by]
        value, run = value[by], run[by]
        first[at[1:]] |= (run[1:] == run[:-1]) & (value[1:] != value[:-1])
    return order, first


# ---------------------------------------------------------------- blocks

def _blocks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The documents as stored blocks, bucketed by block; and their bytes of text."""
    names = docs.columns
    text_at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_bytes(batch.column(text_at))
            absent = np.asarray(batch.column(text_at).is_null())
            rest = batch.select([i for i in range(len(names)) if i != text_at])
            for a, b in chunks(list(map(len, texts)), BLOCK):
                body = b"".join(texts[a:b])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as writer:
                    writer.write_batch(rest.slice(a, b - a))
                lengths = np.array([len(t) for t in texts[a:b]], np.int64)
                n = len(body) - GRAM
                some = np.linspace(0, n, 64).astype(np.int64) if n > 0 else np.zeros(0, np.int64)
                tokens = _words(np.frombuffer(body, np.uint8))[some].astype(np.uint64).view(np.int64) if len(some) else some
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([len(body)]), pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary()),
                     pa.array([put(lengths)], pa.binary()), pa.array([np.packbits(absent[a:b]).tobytes()], pa.binary()),
                     pa.array([squeeze(body)], pa.binary()), pa.array([tokens.tolist()], pa.list_(pa.int64()))],
                    [x.split()[0] for x in BLOCKS.split(", ")])
                number += 1

    blocks = bucketed(docs.mapInArrow(freeing(run), BLOCKS), "block", "blocks")
    return blocks, blocks.agg(F.sum("n_bytes")).first()[0] or 0


def _open(row: dict, id_at: int) -> tuple[Block, pa.RecordBatch, np.ndarray]:
    rest = pa.ipc.open_stream(unsqueeze(row["rest"])).read_next_batch()
    lengths = get(row["lengths"]).view(np.int64)
    column = rest.column(id_at)
    ids = column.fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    absent = np.unpackbits(np.frombuffer(row["absent"], np.uint8))[:len(lengths)].astype(bool)
    return Block(unsqueeze(row["text"]), lengths, ids), rest, absent


def _splitters(blocks: DataFrame, n: int) -> np.ndarray:
    """Leading tokens that part a bounded sample into n even ranges."""
    count = blocks.count()
    wanted = max(SAMPLES, EACH * n)
    share = min(1.0, wanted / max(1, 64 * count))
    sample = blocks.select("tokens").sample(share, seed=1) if share < 1 else blocks.select("tokens")
    rows = sample.limit(wanted // 16).collect()
    tokens = np.sort(np.array([t for r in rows for t in r["tokens"]], np.int64).view(np.uint64))
    return np.unique(tokens[np.linspace(0, len(tokens) - 1, n + 1).astype(int)[1:-1]]) if len(tokens) and n > 1 else np.zeros(0, np.uint64)


def _requests(block: int, bucket: np.ndarray, columns: list[tuple[np.ndarray, int, bool]]) -> pa.RecordBatch:
    """One row for each bucket that gets entries; entries are sorted by bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    bounds = [0, *cuts.tolist(), len(bucket)] if len(bucket) else [0]
    ranges = list(zip(bounds[:-1], bounds[1:]))
    fields = [pa.array([put(v[a:b], width, rising) for a, b in ranges], pa.binary()) for v, width, rising in columns]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(ranges), pa.int64()), pa.array([int(bucket[a]) for a, _ in ranges], pa.int32()), *fields],
                                      [x.split()[0] for x in REQUEST.split(", ")])


def _resolve(read: Callable, split_spans: bool) -> Callable[[pa.Table], pa.Table]:
    """The work of a bucket: sort, compare neighbours, answer each block."""
    def run(group: pa.Table) -> pa.Table:
        asked = group.select(["block", "bucket"])
        parts = [read(r) for r in one_by_one(group)]
        sizes = np.array([len(p[-1]) for p in parts])
        columns = list(map(list, zip(*parts)))
        del parts
        *keys, doc = (np.concatenate(columns.pop(0)) for _ in range(len(columns)))
        order, first = multikey_sort(keys)
        heads = np.flatnonzero(first)
        least = np.minimum.reduceat(doc[order], heads)          # of equal entries
        run_of = np.cumsum(first) - 1
        best = np.empty(len(doc), np.int64)
        best[order] = least[run_of]
        unsure = np.zeros(len(doc), np.int64)
        if split_spans:
            a, b, c = (k[order[heads]] for k in keys)
            anchor = np.cumsum(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) - 1
            sides = [_several(anchor, c >> np.uint64(52), least), _several(anchor, (c >> np.uint64(40)) & np.uint64(4095), least)]
            unsure[order] = (sides[0] + 2 * sides[1])[run_of]
        better = best < doc
        out: dict[str, list] = {"at": [], "doc": [], "open": []}
        for lo, hi in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
            at = np.flatnonzero(better[lo:hi])
            out["at"].append(put(at, 4, True))
            out["doc"].append(put(best[lo:hi][at]))
            at = np.flatnonzero(unsure[lo:hi])
            out["open"].append(put(4 * at + unsure[lo:hi][at], 5, True))
        del keys, doc, best, unsure, order, first, run_of
        give_back()
        return pa.table([*asked.columns, *[pa.array(v, pa.binary()) for v in out.values()]], ["block", "bucket", *out])

    return run


def _several(anchor: np.ndarray, side: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Kinds that share their anchor and the bytes on one side of it with a kind of another least document.

    Two kinds have a window in common only if they agree on one of the sides."""
    key = (anchor.astype(np.uint64) << np.uint64(12)) | side
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    ranked = least[order]
    mixed = np.minimum.reduceat(ranked, at) != np.maximum.reduceat(ranked, at)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(mixed, np.diff(np.concatenate([at, [len(key)]])))
    return out & (side > 0)


def _read_entries(r: dict) -> tuple[np.ndarray, ...]:
    return get(r["a"], 8, True), get(r["b"]), get(r["c"]), get(r["doc"]).view(np.int64)


def _read_windows(r: dict) -> tuple[np.ndarray, ...]:
    return get(r["a"], 8, True), get(r["doc"]).view(np.int64)


def _apply(answers: list[dict], bucket: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least documents after the answers; the kinds that the buckets left open and their shared sides."""
    least, open_, sides = least.copy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in answers or []:
        base = int(np.searchsorted(bucket, r["bucket"]))
        at = get(r["at"], 4, True).astype(np.int64) + base
        least[at] = get(r["doc"]).view(np.int64)
        both = get(r["open"], 5, True).astype(np.int64)
        open_.append((both >> 2) + base)
        sides.append(both & 3)
    return least, np.concatenate(open_), np.concatenate(sides)


def _bucket_of(values: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    return np.searchsorted(splitters, values, side="right")


def _with_answers(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Blocks with the answers for them; the blocks stay where their bucket is."""
    out = blocks.drop("tokens")
    for k, a in enumerate(answers):
        own = a.groupBy("block").agg(F.collect_list(F.struct("bucket", "at", "doc", "open")).alias(f"answers{k}"))
        out = out.join(own.hint("shuffle_merge"), "block", "left")
    return out


def _covered(docs: DataFrame, finish: Callable, schema) -> DataFrame:
    """``finish(block, rest, absent, mask)`` of every block, mask marking the bytes to remove."""
    spark = docs.sparkSession
    prepare(spark)
    rest_names = [c for c in docs.columns if c.lower() != "text"]
    id_at = [c.lower() for c in rest_names].index("doc_id")
    blocks, n_bytes = _blocks(docs)
    n = max(1, math.ceil(n_bytes / BUCKET))
    splitters = _splitters(blocks, n)

    def evenly(h: np.ndarray) -> np.ndarray:        # window hashes are spread evenly
        return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                b, _, _ = _open(row, id_at)
                yield _requests(row["block"], _bucket_of(b.t0, splitters),
                                [(b.t0, 8, True), (b.t1, 8, False), (b.span, 8, False), (b.least, 8, False)])

    asked = blocks.select("block", "rest", "lengths", "absent", "text").mapInArrow(freeing(entries), REQUEST)
    answered = stored(asked.groupBy("bucket").applyInArrow(_resolve(_read_entries, True), ANSWER), "suffix-answers")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                b, _, _ = _open(row, id_at)
                _, open_, sides = _apply(row["answers0"], _bucket_of(b.t0, splitters), b.least)
                _, _, _, h, least = b.window_kinds(open_, sides)
                none = np.zeros(len(h), np.uint64)
                yield _requests(row["block"], evenly(h), [(h, 8, True), (none, 1, True), (none, 1, True), (least, 8, False)])

    asked = _with_answers(blocks, answered).mapInArrow(freeing(windows), REQUEST)
    exact = stored(asked.groupBy("bucket").applyInArrow(_resolve(_read_windows, False), ANSWER), "suffix-windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in one_by_one(batch):
                b, rest, absent = _open(row, id_at)
                best, open_, sides = _apply(row["answers0"], _bucket_of(b.t0, splitters), b.least)
                edge = np.zeros(b.n + 1, np.int32)
                gone = best[b.kind] < b.doc
                np.add.at(edge, b.start[gone], 1)
                np.add.at(edge, (b.start + b.windows + SPAN - 1)[gone], -1)
                at, doc, kind, h, least = b.window_kinds(open_, sides)
                best, _, _ = _apply(row["answers1"], evenly(h), least)
                at = at[best[kind] < doc] if len(at) else at
                np.add.at(edge, at, 1)
                np.add.at(edge, at + SPAN, -1)
                mask = np.cumsum(edge[:-1], dtype=np.int32) > 0
                yield from finish(b, rest, absent, mask)

    return _with_answers(blocks, answered, exact).mapInArrow(freeing(cut), schema)


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[np.concatenate([[0], ends])]
    return np.diff(total)


def digest(docs: DataFrame) -> DataFrame:
    """n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    def finish(b: Block, rest: pa.RecordBatch, absent: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = b.data[:b.n][~mask].tobytes()
        removed = _sums(mask, b.ends)
        rise = mask.copy()
        rise[1:] &= ~mask[:-1]
        starts = (b.ends - b.lengths)[b.lengths > 0]
        rise[starts] = mask[starts]
        stops = np.cumsum(b.lengths - removed)
        shas = [hashlib.sha256(kept[lo:hi]).hexdigest() for lo, hi in zip((stops - (b.lengths - removed)).tolist(), stops.tolist())]
        yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(b.lengths), pa.array(removed), pa.array(_sums(rise, b.ends)), pa.array(shas, pa.string())],
                                         [x.split()[0] for x in DIGEST.split(", ")])

    return _covered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), finish, DIGEST)


def cut(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text; a character is cut only when all its bytes are.
    ``n_chars``, where there is one, counts what is left."""
    names = docs.columns
    text_at = [c.lower() for c in names].index("text")
    count_at = next((i for i, c in enumerate(names) if c.lower() == "n_chars"), None)

    def finish(b: Block, rest: pa.RecordBatch, absent: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        data = b.data[:b.n]
        head = (data & 0xC0) != 0x80            # first byte of a character
        if b.n:
            begins = np.flatnonzero(head)
            begins = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
            whole = np.minimum.reduceat(mask, begins)
            mask = np.repeat(whole, np.diff(np.concatenate([begins, [b.n]])))
        kept = data[~mask].tobytes()
        left = b.lengths - _sums(mask, b.ends)
        stops = np.cumsum(left)
        texts = [None if gone else kept[lo:hi].decode("utf-8", "replace") for gone, lo, hi in zip(absent, (stops - left).tolist(), stops.tolist())]
        columns = list(rest.columns)
        columns.insert(text_at, pa.array(texts, pa.string()))
        if count_at is not None:
            columns[count_at] = pa.array([None if t is None else len(t) for t in texts], columns[count_at].type)
        yield pa.RecordBatch.from_arrays(columns, names)

    return _covered(docs, finish, docs.schema)
