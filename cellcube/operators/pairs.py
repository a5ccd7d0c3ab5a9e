"""Statistics over all pairs of a series without listing them.

Mann–Kendall's S is a difference of two inversion counts, and a merge sort counts the
inversions of n values in n log n steps and linear memory.  Sen's slope is the median of
(y_j - y_i) / (j - i).  A slope is at most theta exactly when y - theta * position is not
in rising order at that pair, so "how many slopes are at most theta" is an inversion
count as well.  The median is selected by narrowing an interval of slopes with such
counts; when few pairs are left in it, those alone are listed (they are the pairs whose
order differs between the interval's two ends) and the wanted rank is read off their
exact quotients.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LISTED = 8      # pairs listed at the end of a selection, for each value of the series


def _levels(x: np.ndarray, ties: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bottom-up merges of the rows of ``x`` (their number of columns a power of two): for each
    level its half width, the halves' values before the merge as (rows, blocks, 2, width),
    and the merging order over both halves, the right one first where ``ties`` count."""
    rows, n = x.shape
    width = 1
    while width < n:
        halves = x.reshape(rows, n // (2 * width), 2, width)
        both = halves[:, :, ::-1] if ties else halves
        both = both.reshape(rows, n // (2 * width), 2 * width)
        order = np.argsort(both, axis=2, kind="stable")
        yield width, halves, order
        x = np.take_along_axis(both, order, 2).reshape(rows, n)
        width *= 2


def _padded(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    size = 1 << max(0, (n - 1).bit_length())
    return np.concatenate([x, np.full((len(x), size - n), np.inf)], axis=1)


def inversions(x: np.ndarray, ties: bool = False) -> np.ndarray:
    """For each row of finite values, the pairs i < j with x_i > x_j (``ties``: x_i >= x_j)."""
    x = np.atleast_2d(np.asarray(x, float))
    more = (1 << max(0, (x.shape[1] - 1).bit_length())) - x.shape[1]
    total = np.zeros(len(x), np.int64)
    for width, halves, order in _levels(_padded(x), ties):
        # places of the right half's values after the merge: each had (place - own rank) left ones before it
        right = order < width if ties else order >= width
        places = np.where(right, np.arange(2 * width), 0).sum(axis=2, dtype=np.int64)
        blocks = halves.shape[1]
        total += blocks * (width * width + width * (width - 1) // 2) - places.sum(axis=1)
    return total - (more * (more - 1) // 2 if ties else 0)


def kendall_s(x: np.ndarray) -> np.ndarray:
    """S of each row: rising pairs less falling pairs."""
    return inversions(-x) - inversions(x)


def crossing_pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of the pairs with ``low`` rising and ``high`` not rising."""
    n = len(low)
    # in the order of low they are the inversions of high; of equal values the later position comes first in
    # both, so that only an earlier position counts as not rising
    order = np.lexsort((-np.arange(n), low))
    rank = np.empty(n)
    rank[np.lexsort((-np.arange(n), high))] = np.arange(n)
    value = _padded(rank[order][None])[0]
    ids = np.concatenate([order, np.arange(n, len(value))])
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width, halves, merged in _levels(value[None], False):
        left, right = halves[0, :, 0], halves[0, :, 1]
        named = ids.reshape(-1, 2, width)
        for block in range(len(left)):
            begin = np.searchsorted(left[block], right[block], "right")      # from here on the left values are larger
            count = width - begin
            hit = np.flatnonzero((count > 0) & np.isfinite(right[block]))
            if len(hit):
                reach = count[hit]
                place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(begin[hit], reach)
                first.append(named[block, 0][place])
                second.append(np.repeat(named[block, 1][hit], reach))
        ids = np.take_along_axis(named.reshape(-1, 2 * width), merged[0], 1).ravel()
    i, j = np.concatenate(first), np.concatenate(second)
    kept = (i < n) & (j < n) & (i < j)
    return i[kept], j[kept]


class _Slopes:
    """Ranks among the slopes of one series."""

    def __init__(self, y: np.ndarray):
        self.y, self.t = y, np.arange(len(y), dtype=float)
        self.known: dict[float, int] = {}

    def up_to(self, theta: float) -> int:
        """How many slopes are at most ``theta``."""
        if theta not in self.known:
            self.known[theta] = int(inversions(self.y - theta * self.t, ties=True)[0])
        return self.known[theta]

    def select(self, rank: int, low: float, high: float) -> float:
        """The slope of this rank (from 0), which lies in (low, high]."""
        before, through = self.up_to(low), self.up_to(high)
        while through - before > LISTED * len(self.y):
            middle = low + (high - low) / 2
            if not low < middle < high:
                return high                     # as many equal slopes
            n = self.up_to(middle)
            if n > rank:
                high, through = middle, n
            else:
                low, before = middle, n
        i, j = crossing_pairs(self.y - low * self.t, self.y - high * self.t)
        slopes = np.sort((self.y[j] - self.y[i]) / (j - i))
        return float(slopes[min(max(rank - before, 0), len(slopes) - 1)]) if len(slopes) else high


def sen_slope(y: np.ndarray, seed: int = 7) -> float:
    """Median slope over all pairs of a series at positions 0..n-1, n log n for each count."""
    y = np.asarray(y, float)
    n = len(y)
    pairs = n * (n - 1) // 2
    step = np.diff(y)
    # every slope is a mean of neighbours' steps
    low, high = float(step.min()), float(step.max())
    low -= max(abs(low), abs(high), 1e-300) * 1e-9
    ranks = sorted({(pairs - 1) // 2, pairs // 2})
    slopes = _Slopes(y)
    # a sample of pairs gives a first interval; it is widened when the counts show that it misses a rank
    rng = np.random.default_rng(seed)
    i = rng.integers(0, n, 2048)
    j = (i + rng.integers(1, n, 2048)) % n
    sample = np.sort((y[j] - y[i]) / (j - i))
    for near, far in ((sample[960], sample[1088]), (sample[820], sample[1228])):
        if low < near and near < far < high and slopes.up_to(near) <= ranks[0] and slopes.up_to(far) > ranks[-1]:
            low, high = float(near), float(far)
            break
    return float(np.mean([slopes.select(r, low, high) for r in ranks]))
