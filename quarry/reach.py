"""Workers find this package where the driver has it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reach(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' path. On a cluster the package is installed, or sent with the application, at the same place."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    given = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in given:
        env["PYTHONPATH"] = os.pathsep.join([root, *given])
    return spark
