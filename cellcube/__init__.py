"""cellcube — space-time grid analytics on Spark DataFrames.

A gridded observation is an ordinary table with one row per (cell, month):
``pixel_idx`` is the row-major flat index ``row * width + col`` and ``t`` a
calendar month index.  Every operator takes and returns DataFrames, so Catalyst
plans the whole chain (pruning, pushdown, exchange reuse) in one go.
"""

from cellcube.config import GridConfig, SplitConfig
from cellcube.session import get_spark, checkpoint_dir

__all__ = ["GridConfig", "SplitConfig", "get_spark", "checkpoint_dir"]
