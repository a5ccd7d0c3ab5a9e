"""Counts over the words, lines and characters of one text; shared by the quality operators."""

from __future__ import annotations

import numpy as np

#: character classes of the histograms
CLASSES = ("lower", "upper", "digit", "space", "sentence", "quote", "symbol", "other")
SYMBOLS = b"#*$%&|<>"

# fixed values: frequent function words of the languages the rules know
COMMON = {
    "en": "the of and to in a is that it for on was be as with by this are or an from at not have which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
    "fr": "de la le et les des en un une est que dans pour qui au par sur il ne pas se du avec ce".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo como más pero sus".split(),
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.int64)
    for name, chars in (("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                        ("digit", b"0123456789"), ("space", b" \t\n\r\v\f"), ("sentence", b".,;:!?"),
                        ("quote", b"'\"()-"), ("symbol", b"#*$%&|<>@[]{}=+_~^\\/`")):
        table[list(chars)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)     # continuation bytes of a character counted by its first byte
    return table


_TABLE = _class_table()
_SPELT = [(w.encode(), w.capitalize().encode(), w.upper().encode()) for w in WORDS]


class TextStats:
    """Statistics of one UTF-8 text; everything counts the whole text."""

    def __init__(self, text: bytes):
        self.text = text
        self.words = words = text.split()
        self.n_words = len(words)
        joined = b"".join(words)
        self.word_chars = len(joined.decode("utf-8", "replace"))
        self.n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        self._ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.ids = np.fromiter(map(self._ids.__getitem__, words), np.int64, len(words))

    def dup_lines(self) -> tuple[int, int]:
        """Lines with a word that equal an earlier line; lines with a word."""
        lines = [x for x in self.text.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines)), len(lines)

    def repeat_words(self) -> int:
        """Words in three-word windows that the text has twice or more."""
        n = self.n_words - 2
        if n < 2:
            return 0
        ids, wide = self.ids, len(self._ids)
        if wide == self.n_words:
            return 0
        key = (ids[:-2] * wide + ids[1:-1]) * wide + ids[2:] if wide < 2_000_000 else \
            np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(self.n_words, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        return int(covered.sum())

    def classes(self) -> np.ndarray:
        """Characters of each class."""
        return np.bincount(_TABLE[np.frombuffer(self.text, np.uint8)], minlength=len(CLASSES) + 1)[:len(CLASSES)]

    def common(self) -> np.ndarray:
        """Counts of the common words, then of all other words."""
        out = np.zeros(len(WORDS) + 1, np.int64)
        ids, found = self._ids, []
        for k, forms in enumerate(_SPELT):
            for form in forms:
                i = ids.get(form)
                if i is not None:
                    found.append((k, i))
        if found:
            counts = np.bincount(self.ids, minlength=len(ids))
            for k, i in dict.fromkeys(found):
                out[k] += counts[i]
        out[-1] = self.n_words - out[:-1].sum()
        return out

    def longest_run(self) -> int:
        """Most equal words in a row."""
        if not self.n_words:
            return 0
        cuts = np.flatnonzero(np.diff(self.ids)) + 1
        return int(np.diff(np.concatenate([[0], cuts, [self.n_words]])).max())

    def distinct(self) -> int:
        return len(self._ids)
