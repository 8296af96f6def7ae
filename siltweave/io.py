"""Reading the engine's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
