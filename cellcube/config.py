"""Grid, split and sentinel configuration.

Everything here is a plain frozen value object: it parameterises plans, it does
not hold data.  Row bounds derived from it (cells per grid, months per calendar)
are what lets an operator prove a side is small enough to broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridConfig:
    """A row-major affine grid of ``height`` x ``width`` cells.

    ``west``/``north`` are the outer corner of the top-left cell and
    ``xres``/``yres`` the cell size in degrees (positive numbers).  When no
    geo-reference is known the fallback extent below is used.
    """

    height: int
    width: int
    west: float = 36.5
    north: float = 1.0
    xres: float | None = None
    yres: float | None = None
    # first calendar year of the month index: t = (year - origin_year) * 12 + month
    origin_year: int = 2006

    @property
    def n_cells(self) -> int:
        return self.height * self.width

    @property
    def x_res(self) -> float:
        # fallback extent: 36.5 .. 37.75 east, 1.0 .. -0.25 north
        return self.xres if self.xres is not None else (37.75 - 36.5) / self.width

    @property
    def y_res(self) -> float:
        return self.yres if self.yres is not None else 1.25 / self.height


@dataclass(frozen=True)
class SplitConfig:
    """Chronological split by calendar year: train <= train_end < val <= val_end < test."""

    train_end: int = 2021
    val_end: int = 2023


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Per-variable validity rules (a value failing its rule is missing):
#   ndvi         valid iff value > 0
#   lst          missing iff value < -100
#   precip       missing iff value < 0
#   pop_density  missing iff value < 0
#   twi, soil    only NaN is missing
# Layer nodata value written by trend maps: -9999.0
# Trend test: alpha 0.05, at least 12 valid observations per cell.
# Sequence window: 12 months.  Default grid 159 x 181.
# Acquisition periods: 2006-2014, 2015-2022, 2023-2025.
# Study box: north 1.1, west 36.20, south -0.4, east 37.9.
# ---------------------------------------------------------------------------
NODATA = -9999.0
TREND_ALPHA = 0.05
TREND_MIN_VALID = 12
SEQUENCE_WINDOW = 12
DEFAULT_GRID = GridConfig(height=159, width=181)
ACQUISITION_PERIODS = ((2006, 2014, "2006_2014"), (2015, 2022, "2015_2022"), (2023, 2025, "2023_2025"))
STUDY_BOX = {"north": 1.1, "west": 36.20, "south": -0.4, "east": 37.9}

# rule name -> kind; see cellcube.operators.mask.rule_expr
SENTINEL_RULES: dict[str, str] = {
    "ndvi": "positive",
    "lst": "lst",
    "precip": "non_negative",
    "pop_density": "non_negative",
    "twi": "nan_only",
    "soil_snum": "nan_only",
}

# the training table's schema (one row per valid cell-month)
TRAINING_COLUMNS = [
    "year", "month", "pixel_idx", "log_ndvi",
    "lst_driver_lag1", "lst_driver_lag2", "lst_driver_lag3",
    "log_precip_driver_lag1", "log_precip_driver_lag2", "log_precip_driver_lag3",
    "ndvi_spatial_lag", "pop_density", "twi", "soil_snum",
]

# The dynamic feature set of the sequence models (target first)
DYNAMIC_COLUMNS = [
    "log_ndvi",
    "lst_driver_lag1", "lst_driver_lag2", "lst_driver_lag3",
    "log_precip_driver_lag1", "log_precip_driver_lag2", "log_precip_driver_lag3",
    "ndvi_spatial_lag",
    "pop_density",
]

# The continuous feature set of the tabular baselines (spatial lag excluded)
BASELINE_CONTINUOUS = [
    "lst_driver_lag1", "lst_driver_lag2", "lst_driver_lag3",
    "log_precip_driver_lag1", "log_precip_driver_lag2", "log_precip_driver_lag3",
    "pop_density", "twi",
    "month_sin", "month_cos", "year_trend",
]
INTERACTIONS = ["lst_x_precip", "twi_x_precip", "twi_x_lst"]


@dataclass(frozen=True)
class GbtParams:
    """Boosted-tree settings of the baseline (rounds, depth, step, sampling)."""

    max_iter: int = 400
    max_depth: int = 8
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    seed: int = 42


@dataclass(frozen=True)
class RfParams:
    """Forest settings of the baseline."""

    num_trees: int = 400
    max_depth: int = 20
    min_instances_per_node: int = 75
    feature_subset: str = "0.3"
    bootstrap: bool = True
    seed: int = 42


# Random-search space of the tuning step, as far as Spark's boosted
# trees have the parameters (4 * 3**3 = 108 combinations; the L1/L2 leaf penalties
# have no counterpart), 30 draws, 3 expanding folds, 300 trees, seed 42.
SEARCH_SPACE: dict[str, list] = {
    "max_depth": [6, 8, 10, 12],
    "learning_rate": [0.03, 0.05, 0.1],
    "subsample": [0.7, 0.8, 0.9],
    "colsample_bytree": [0.6, 0.8, 1.0],
}
SEARCH_DRAWS = 30
SEARCH_FOLDS = 3
SEARCH_TREES = 300
