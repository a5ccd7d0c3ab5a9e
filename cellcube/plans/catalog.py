"""Import every query module so the registry is complete."""

from cellcube.plans import q_align, q_features, q_models, q_prep, q_summary, q_trend  # noqa: F401
from cellcube.plans.registry import DOCS, ORACLES, QUERIES  # noqa: F401
