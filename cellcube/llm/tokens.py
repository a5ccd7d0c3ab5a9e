"""Token ids of whole texts by an installed public tokenizer.

The tokenizer lower-cases, splits at white space and parts letters from punctuation
before anything else, so the ids of a text are those of its words in order, and those
of an ASCII word with closing punctuation are those of the letters and then those of
the punctuation.  A worker therefore encodes each distinct part once and keeps the ids
of the parts it has seen lately between batches.

What is kept lies in two byte buffers (parts and ids) with offsets, found by binary search
over 64-bit hashes and compared byte by byte; there is no Python object for a part.  The
buffers are bounded by bytes: when they outgrow the bound, the parts used longest ago go.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN_BYTES = 48 << 20      # of kept parts, ids, offsets and hashes, for each worker and tokenizer
CLOSING = '.,;:!?#*$%&|<>()-"'

_known: dict[str, _Known] = {}
_tokenizers: dict = {}


def _tokenizer(name: str):
    if name not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # the cores are Spark's
        _tokenizers[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _tokenizers[name]


def _body(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large string or binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    body = words.buffers()[2] if len(words) else None
    return offsets, np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's length and its first and last eight bytes."""
    offsets, body = _body(words)
    length = np.diff(offsets)
    reach = np.minimum(length, 8)[:, None]
    out = length.astype(np.uint64)
    if not len(body):
        return out
    place = np.arange(8)
    for begin in (offsets[:-1], offsets[1:] - reach[:, 0]):
        at = np.minimum(begin[:, None] + place, len(body) - 1)
        eight = np.where(place < reach, body[at], 0).astype(np.uint8).view("<u8").ravel()
        out = (out ^ eight) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Known:
    """Parts and their ids, by hash; bounded by bytes."""

    def __init__(self):
        self.words = self.ids = pa.array([], pa.large_binary())
        self.hashes, self.used, self.turn = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Place of each word, -1 where it is not kept."""
        self.turn += 1
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        rows = np.flatnonzero(same)
        equal = pc.equal(self.words.take(pa.array(at[rows])), words.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        place = np.full(len(words), -1)
        place[rows[equal]] = at[rows[equal]]
        self.used[place[place >= 0]] = self.turn
        return place

    def add(self, words: pa.Array, hashes: np.ndarray, ids: pa.Array) -> None:
        """Keep new words; of several with one hash the first."""
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        hashes = np.concatenate([self.hashes, hashes])
        used = np.concatenate([self.used, np.full(len(words), self.turn, np.int32)])
        keep = np.unique(hashes, return_index=True)[1]
        size = 36 * len(keep) + self.words.nbytes + self.ids.nbytes
        if size > KNOWN_BYTES:
            # about half the bound stays: the words used last
            stay = np.argsort(-used[keep], kind="stable")[:int(len(keep) * KNOWN_BYTES / 2 / size)]
            keep = keep[np.sort(stay)]
        self.words, self.ids = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep))
        self.hashes, self.used = hashes[keep], used[keep]


def _encoded(words: pa.Array, tokenizer: str) -> pa.Array:
    """Ids of each distinct word as little-endian 32-bit bytes."""
    coded = _tokenizer(tokenizer).encode_batch_fast([w.decode("utf-8", "replace") for w in words.to_pylist()], add_special_tokens=False)
    return pa.array([np.array(c.ids, "<u4").tobytes() for c in coded], pa.large_binary())


def _ids(words: pa.Array, tokenizer: str) -> pa.Array:
    """Ids of distinct words, asking the tokenizer for those that are not kept."""
    known = _known.setdefault(tokenizer, _Known())
    hashes = _hashes(words)
    place = known.find(words, hashes)
    missing = np.flatnonzero(place < 0)
    found = known.ids.take(pa.array(np.where(place < 0, None, place), pa.int64()))
    if len(missing):
        new = words.take(pa.array(missing))
        ids = _encoded(new, tokenizer)
        found = pc.replace_with_mask(found, pa.array(place < 0), ids)
        known.add(new, hashes[missing], ids)
    return found


def _word_ids(words: pa.Array, tokenizer: str) -> pa.Array:
    """Ids of distinct words (large strings): those of the letters and of the punctuation that closes them."""
    letters = pc.utf8_rtrim(words, CLOSING)
    plain = pc.ascii_is_alpha(letters)
    core = pc.if_else(plain, pc.ascii_lower(letters), words)
    # what follows the letters, by its length in bytes
    rest = pc.subtract(pc.binary_length(words), pc.binary_length(core)).to_numpy(zero_copy_only=False)
    parts = core.cast(pa.large_binary()).dictionary_encode()
    out = _ids(parts.dictionary, tokenizer).take(parts.indices)
    closed = np.flatnonzero(rest)
    if len(closed):
        offsets, body = _body(words)
        ends, n = offsets[1:][closed], rest[closed].astype(np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(ends - n, n)
        closing = pa.Array.from_buffers(pa.large_binary(), len(closed), [None, pa.py_buffer(at), pa.py_buffer(body[where])]).dictionary_encode()
        tail = _ids(closing.dictionary, tokenizer).take(closing.indices)
        both = pc.binary_join_element_wise(out.take(pa.array(closed)), tail, pa.scalar(b"", pa.large_binary()))
        mask = np.zeros(len(words), bool)
        mask[closed] = True
        out = pc.replace_with_mask(out, pa.array(mask), both)
    return out


def document_ids(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 32-bit ids of all texts in a row (null: none), without special tokens, and the number of each text's ids."""
    texts = texts.cast(pa.large_string()).fill_null("")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    ids = _word_ids(coded.dictionary, tokenizer).take(coded.indices)
    ends = _body(ids)[0] // 4
    flat = np.frombuffer(ids.buffers()[2], "<u4")[:int(ends[-1])] if len(ids) and ids.buffers()[2] is not None else np.zeros(0, "<u4")
    bounds = split.offsets.to_numpy()
    return flat, np.diff(ends[bounds - bounds[0]])
