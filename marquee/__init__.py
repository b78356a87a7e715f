"""Jobs over event listings and text corpora, on Spark DataFrames."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def on_workers(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it, unless PYTHONPATH names another place."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), ROOT) if x)
