"""Cell keys along the Morton (Z-order) curve, and the key ranges of a box.

A cell's key interleaves the bits of its row and column, so cells of one square have one
range of keys.  A box is covered by a few such ranges: squares of the quadtree that lie
in it, and the squares across its border where splitting further would take too many.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks that keep one half-word in two, then one byte in two, and so on: bits move apart step by step.
_STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _apart(c: Column) -> Column:
    """The 31 low bits of a number, one place left free after each."""
    x = c.cast("long")
    for shift, mask in _STEPS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    """Key of a cell (long); rows and columns from 0 to 2**31 - 1."""
    return F.shiftleft(_apart(row), 1).bitwiseOR(_apart(col))


def morton_key(row: int, col: int) -> int:
    """``morton`` of one cell."""
    return sum((row >> b & 1) << (2 * b + 1) | (col >> b & 1) << (2 * b) for b in range(31))


def box_ranges(r0: int, r1: int, c0: int, c1: int, limit: int = 32) -> list[tuple[int, int]]:
    """Ranges of keys (both ends in) that hold all cells of rows r0..r1 and columns c0..c1, in order.

    At most about ``limit`` ranges; they may hold cells outside the box, never miss one inside."""
    if r0 > r1 or c0 > c1:
        return []
    bits = max(r1, c1).bit_length()
    whole: list[tuple[int, int]] = []
    border = [(0, 0, bits)]                 # squares (row, col, bits) across the box's edge
    while border and len(whole) + 4 * len(border) <= max(limit, 4):
        parts = []
        for r, c, b in border:
            if b == 0 or (r0 <= r and r + (1 << b) - 1 <= r1 and c0 <= c and c + (1 << b) - 1 <= c1):
                whole.append((r, c, b))
                continue
            half = 1 << (b - 1)
            parts += [(y, x, b - 1) for y in (r, r + half) for x in (c, c + half)
                      if y <= r1 and y + half - 1 >= r0 and x <= c1 and x + half - 1 >= c0]
        border = parts
    keys = sorted((morton_key(r, c), morton_key(r, c) + (1 << (2 * b)) - 1) for r, c, b in whole + border)
    out: list[tuple[int, int]] = []
    for low, high in keys:
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out
