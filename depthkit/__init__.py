"""depthkit: DataFrame operators for grouped, depth-ordered measurement series on Spark.

A series is a group (``well_api`` by default) of rows ordered by ``DEPTH``; every other
numeric column is a curve.  All operators take and return Spark DataFrames and are built
from Spark SQL expressions, window functions and aggregates.
"""

from depthkit.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
