"""Physical layout of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spreads a batch input over more tasks before heavy per-row work, if the session asks for it.

    A file with few row groups feeds few tasks. ``spark.tallyloom.spread`` names the number of
    tasks wanted; unset, as it should be for large tables, nothing is shuffled.
    """
    parts = None if df.isStreaming else df.sparkSession.conf.get("spark.tallyloom.spread", None)
    return df.repartition(int(parts), *keys) if parts else df
