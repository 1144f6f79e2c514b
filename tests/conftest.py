import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from depthkit.session import checkpoint_dir
    checkpoint_dir(s)
    yield s


def series(spark, values, depths=None, well=1, name="GR"):
    """One-well frame (well_api, src_row, DEPTH, <name>) from a Python list."""
    depths = depths or [float(100 + i) for i in range(len(values))]
    rows = [(well, i, float(d), None if v is None else float(v)) for i, (d, v) in enumerate(zip(depths, values))]
    return spark.createDataFrame(rows, f"well_api long, src_row long, DEPTH double, {name} double")
