"""Comparison of two runs of the same job: ids, duplicates, columns, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def except_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids of one side only, with the side; set semantics."""
    left = a.select(key).subtract(b.select(key)).withColumn("side", F.lit("a_only"))
    right = b.select(key).subtract(a.select(key)).withColumn("side", F.lit("b_only"))
    return left.unionByName(right)


def _one_each(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """One row per key with the compared columns and the number of copies."""
    body = F.struct(*columns)
    return df.groupBy(key).agg(F.min(body).alias(f"{prefix}_row"), F.count("*").alias(f"{prefix}_n"))


def column_agreement(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(column, differing)`` over shared keys, nulls equal; one pass counts every column."""
    shared = _one_each(a, key, columns, "a").join(_one_each(b, key, columns, "b"), key)
    differs = [F.count_if(~F.col(f"a_row.{c}").eqNullSafe(F.col(f"b_row.{c}"))).alias(c) for c in columns]
    return shared.agg(*differs).unpivot([], columns, "column", "differing")


def parity(batch: DataFrame, stream: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows, residual duplicates, one-sided ids, differing cells and the verdict, one row.

    A full join of one row per id on each side gives every figure in one pass. Rows or
    duplicates found only in the stream fail the verdict too.
    """
    both = _one_each(batch, key, columns, "a").join(_one_each(stream, key, columns, "b"), key, "full_outer")
    cells = F.lit(0)
    for c in columns:
        cells = cells + (~F.col(f"a_row.{c}").eqNullSafe(F.col(f"b_row.{c}"))).cast("int")
    here, there = F.col("a_n").isNotNull(), F.col("b_n").isNotNull()
    sums = both.agg(
        F.coalesce(F.sum("a_n"), F.lit(0)).alias("batch_rows"),
        F.coalesce(F.sum("b_n"), F.lit(0)).alias("stream_rows"),
        F.coalesce(F.sum(F.col("a_n") - 1), F.lit(0)).alias("batch_duplicates"),
        F.coalesce(F.sum(F.col("b_n") - 1), F.lit(0)).alias("stream_duplicates"),
        F.count_if(here & ~there).alias("batch_only"),
        F.count_if(there & ~here).alias("stream_only"),
        F.coalesce(F.sum(F.when(here & there, cells)), F.lit(0)).alias("differing_cells"),
    )
    faults = F.col("batch_duplicates") + F.col("stream_duplicates") + F.col("batch_only") + F.col("stream_only") + F.col("differing_cells")
    return sums.withColumn("verdict", F.when(faults == 0, "PASS").otherwise("FAIL"))
