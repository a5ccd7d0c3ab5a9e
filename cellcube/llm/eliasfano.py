"""Elias-Fano sequences and the two-level n-gram trie built from them."""

from __future__ import annotations

import contextlib
import tempfile

import numpy as np

BLOCK = 8       # words of the high bits between two counts


class EliasFano:
    """Rising numbers in about 2 + log2(universe / n) bits each; vectorised access and search."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.n, self.bits = low, high, ones, n, bits
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * BLOCK) - ones
        self._words = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = min(56, max(0, (max(int(universe), 1) // max(n, 1)).bit_length() - 1))
        place = np.arange(bits, dtype=np.uint64)
        parts = [np.packbits(((v[i:i + 8192, None] >> place) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 8192)]
        low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        top = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        # one zero after every high value keeps select0 defined up to the universe's end
        length = n + (max(int(universe), 1) >> bits) + 2
        words = -(-length // (64 * BLOCK)) * BLOCK
        flags = np.zeros(words * 64, np.uint8)
        flags[top] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(axis=1)
        return cls(low, high, np.concatenate([[0], np.cumsum(counts)]), n, bits)

    def _select(self, k: np.ndarray, value: int) -> np.ndarray:
        """Place of the k-th bit (from 0) equal to ``value``."""
        counts = self.ones if value else self.zeros
        block = np.searchsorted(counts, k, side="right") - 1
        left = k - counts[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            bits = np.bitwise_count(self.high[word]).astype(np.int64)
            n = bits if value else 64 - bits
            on = left >= n
            left = np.where(on, left - n, left)
            word = word + on
        w = self.high[word] if value else ~self.high[word]
        at = np.zeros(len(w), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count(w & np.uint64((1 << step) - 1)).astype(np.int64)
            on = left >= n
            left = np.where(on, left - n, left)
            w = np.where(on, w >> np.uint64(step), w)
            at += on * step
        return word * 64 + at

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = (self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.bits)
        return high | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self._words[at >> 3].astype(np.uint64) >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below each x (n where there is none)."""
        x = np.asarray(x, np.uint64)
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        rest = x & np.uint64((1 << self.bits) - 1)
        # numbers with a smaller high part, then those with the same and a smaller low part
        at = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) + 1 - top, 0)
        end = self._select(top, 0) - top
        while True:
            on = at < end
            if on.any():
                on[on] = self._low(at[on]) < rest[on]
            if not on.any():
                return at
            # halve what is left of each range of equal high parts
            mid = (at + end) >> 1
            less = np.zeros(len(at), bool)
            less[on] = self._low(mid[on]) < rest[on]
            end = np.where(on & ~less, mid, end)
            at = np.where(on & less, mid + 1, at)


CODES = 255
LOWEST = -10.0      # log10 of the least probability that has a code of its own


def to_code(p: np.ndarray) -> np.ndarray:
    """Quantised log10 probability: 1 to 255, 0 for none."""
    with np.errstate(divide="ignore"):
        x = np.log10(p)
    return np.where(p > 0, np.clip(np.rint((x / LOWEST) * (CODES - 1)), 0, CODES - 1) + 1, 0).astype(np.uint8)


def from_code(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 1) / (CODES - 1) * LOWEST), 0.0)


WORD_BITS = 40


class Trie:
    """Contexts and their successors as memory-mapped levels.

    Level 1 holds the contexts' hashes and, as rising pointers, where each context's
    successors begin; level 2 holds the successors of all contexts as one rising
    sequence (context's number, then word) and a code for each.  A word is looked up by
    successor search relative to its context's pointers."""

    FIELDS = ("ctx", "ptr", "suc")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray):
        self.levels, self.codes = levels, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> Trie:
        """From the sorted pairs of context hash (64 bits) and word hash (``WORD_BITS`` bits) and their probabilities."""
        first = np.ones(len(context), bool)
        first[1:] = context[1:] != context[:-1]
        heads = np.flatnonzero(first)
        number = (np.cumsum(first) - 1).astype(np.uint64)
        rising = (number << np.uint64(WORD_BITS)) | word
        levels = {"ctx": EliasFano.build(context[heads], 1 << 64),
                  "ptr": EliasFano.build(np.concatenate([heads, [len(context)]]), len(context) + 1),
                  "suc": EliasFano.build(rising, max(1, len(heads)) << WORD_BITS)}
        return cls(levels, to_code(p))

    def save(self, file) -> None:
        """All levels, one after the other, in a file."""
        for name in self.FIELDS:
            e = self.levels[name]
            np.save(file, np.array([e.n, e.bits], np.int64))
            for part in (e.low, e.high, e.ones):
                np.save(file, part)
        np.save(file, self.codes)
        file.flush()

    @classmethod
    def open(cls, file) -> Trie:
        """The levels as maps of the file."""
        def array():
            np.lib.format.read_magic(file)
            shape, _, kind = np.lib.format.read_array_header_1_0(file)
            at = file.tell()
            out = np.memmap(file, kind, "r", at, shape) if np.prod(shape) else np.zeros(shape, kind)
            file.seek(at + int(np.prod(shape)) * kind.itemsize)
            return out

        file.seek(0)
        levels = {}
        for name in cls.FIELDS:
            n, bits = array().tolist()
            levels[name] = EliasFano(array(), array(), array(), n, bits)
        return cls(levels, array())

    def codes_of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair, 0 where the trie does not hold it."""
        out = np.zeros(len(context), np.uint8)
        ctx, ptr, suc = (self.levels[x] for x in self.FIELDS)
        if not ctx.n:
            return out
        c = ctx.successor(context)
        known = c < ctx.n
        known[known] = ctx.access(c[known]) == context[known]
        at = np.flatnonzero(known)
        if not len(at):
            return out
        c = c[at]
        target = (c.astype(np.uint64) << np.uint64(WORD_BITS)) | word[at]
        i = suc.successor(target)
        inside = i < ptr.access(c + 1).astype(np.int64)
        inside[inside] = suc.access(i[inside]) == target[inside]
        out[at[inside]] = self.codes[i[inside]]
        return out


@contextlib.contextmanager
def mapped(trie: Trie):
    """The trie read back from a file without a name, which is the task's alone and goes with it."""
    with tempfile.TemporaryFile() as file:
        trie.save(file)
        yield Trie.open(file)
