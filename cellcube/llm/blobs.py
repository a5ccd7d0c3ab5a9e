"""Compact columns: numbers as byte planes, compressed; sorted numbers as differences."""

from __future__ import annotations

import numpy as np
import zstandard


# made once in each process: a context costs more than a small blob
_tools: dict = {}


def squeeze(data: bytes) -> bytes:
    if "in" not in _tools:
        _tools["in"] = zstandard.ZstdCompressor(level=1)
    return _tools["in"].compress(data)


def unsqueeze(data: bytes) -> bytes:
    if "out" not in _tools:
        _tools["out"] = zstandard.ZstdDecompressor()
    return _tools["out"].decompress(data)


def put(values: np.ndarray, width: int = 8, rising: bool = False) -> bytes:
    """Unsigned or signed 64-bit numbers, the low ``width`` bytes of each; ``rising`` stores differences."""
    v = np.ascontiguousarray(values).view(np.uint64)
    if rising and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return squeeze(np.ascontiguousarray(planes).tobytes())


def get(data: bytes, width: int = 8, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(width, -1)
    v = np.zeros((planes.shape[1], 8), np.uint8)
    v[:, :width] = planes.T
    v = v.view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if rising else v
