"""Import every query module so they register, and expose the registry."""

from depthkit.plans import q_attribution, q_eval, q_explore, q_features, q_hot, q_mlprep, q_models, q_more, q_outliers, q_prep, q_quality, q_runs, q_selection, q_sources  # noqa: F401
from depthkit.plans.common import ORACLES, REGISTRY


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(ORACLES)
