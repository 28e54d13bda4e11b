"""Writes: compacted partitions, full refresh, upsert by date, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_FILE_MB = 200
FALLBACK_BYTES_PER_ROW = 70.0


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def bytes_per_row(spark: SparkSession, path: str) -> float:
    """Compressed bytes per row of an earlier output, on whatever file system it lies."""
    hadoop, fs = _path(spark, path)
    if not fs.exists(hadoop):
        return FALLBACK_BYTES_PER_ROW
    size = fs.getContentSummary(hadoop).getLength()
    rows = spark.read.parquet(path).count() if size else 0
    return size / rows if rows else FALLBACK_BYTES_PER_ROW


def write_compact(
    df: DataFrame, path: str, partition: str = "event_date", mode: str = "overwrite", target_mb: int = TARGET_FILE_MB
) -> None:
    """Parquet by date with few files.

    Rows per file follow from the measured row size. Large dates are spread over
    several tasks: the shuffle key is the date and a salt whose range is the number of
    files that date needs, so one hot date never passes through one task.
    """
    spark = df.sparkSession
    rows_per_file = max(1, int(target_mb * 1024 * 1024 / bytes_per_row(spark, path)))
    sizes = df.groupBy(partition).agg(F.ceil(F.count("*") / F.lit(rows_per_file)).alias("_files"))
    # One row per date: bounded by the calendar.
    sized = df.join(F.broadcast(sizes), df[partition].eqNullSafe(sizes[partition])).drop(sizes[partition])
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != partition]), F.col("_files")))
    out = salted.repartition(partition, "_salt").drop("_files", "_salt")
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(partition).parquet(path)


def full_refresh(df: DataFrame, path: str) -> None:
    """Replaces the whole table; running it twice gives the same table."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_daily(new: DataFrame, path: str, key: str = "date", partition: str = "month") -> None:
    """Insert-or-replace by date: only the touched partitions are rewritten.

    ``new`` may hold several rows per date as long as they belong together. The merged
    rows go to a staging folder first, as a table cannot be read and replaced in one job.
    """
    spark = new.sparkSession
    stamped = new.withColumn(partition, F.date_format(key, "yyyy-MM"))
    if exists(spark, path):
        old = spark.read.parquet(path).withColumn(partition, F.col(partition).cast("string"))
        touched = stamped.select(partition).distinct()
        kept = old.join(touched, partition, "left_semi").join(stamped.select(key).distinct(), key, "left_anti")
        stamped = stamped.unionByName(kept.select(*stamped.columns))
    staging = f"{path.rstrip('/')}__staging"
    stamped.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A result table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
