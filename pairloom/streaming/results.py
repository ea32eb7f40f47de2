"""Results as they come: a running summary over a folder into which experiments write fact files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.model import FACT
from pairloom.plans import stats


def running_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming table: mean, deviation and interval by scenario, strategy and seed count. For output mode complete."""
    facts = spark.readStream.schema(FACT).parquet(folder)
    return stats.accuracy_ci(facts, ["scenario", "strategy", "seed_count"])
