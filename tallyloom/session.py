"""Session settings the jobs are designed for.

Nothing here is sized for one machine: shuffle parallelism is left to adaptive
execution, which coalesces small partitions and splits skewed ones at run time.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app: str, master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the project defaults; ``overrides`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in overrides.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder executors share, named by ``spark.checkpoint.dir``.

    Only a session without one (a local test) falls back to a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    local = spark.sparkContext.master.startswith("local")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder()


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _LOCAL[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one run of ``label``."""
    import uuid

    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def frozen(df, label: str = "frozen"):
    """``df`` computed once into a table in the shared folder and read back.

    Cuts the lineage and survives lost executors. Later passes read columns of the
    written table instead of repeating the work, and all see the same values.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
