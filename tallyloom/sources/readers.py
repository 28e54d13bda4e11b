"""Bounded and unbounded reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.valuation import FACTS_SCHEMA

BROKER_SCHEMA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"
OFFSETS_PER_TRIGGER = 200_000


def broker_batch(spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest") -> DataFrame:
    """A topic between two offsets; needs the Kafka connector on the class path."""
    return (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("endingOffsets", end)
        .load()
        .select("key", "value", "topic", "partition", "offset", "timestamp")
    )


def broker_stream(
    spark: SparkSession, servers: str, topic: str, start: str = "earliest", per_trigger: int = OFFSETS_PER_TRIGGER
) -> DataFrame:
    """A topic as a stream with bounded micro-batches; needs the Kafka connector."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
        .option("maxOffsetsPerTrigger", per_trigger)
        .option("failOnDataLoss", "false")
        .load()
        .select("key", "value", "topic", "partition", "offset", "timestamp")
    )


def landed_batch(spark: SparkSession, path: str) -> DataFrame:
    """Landed broker rows with the broker's columns."""
    return spark.read.schema(BROKER_SCHEMA).parquet(path)


def landed_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Landed broker rows as a stream, oldest files first."""
    return spark.readStream.schema(BROKER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def csv_with_schema(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Several CSV files with headers and a declared schema."""
    return spark.read.csv(paths, header=True, schema=schema)


def csv_null_vs_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV in which a bare field is null, ``""`` is empty text, and quoted fields may span lines."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True)
    return reader.option("quote", '"').option("escape", '"').option("nullValue", "\\N").option("emptyValue", "").csv(path)


def csv_union(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """All CSV files that have the required columns, by column name; other columns may differ.

    All fields are read as text, so the header alone decides the schema.
    """
    frames = []
    for path in paths:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        if set(required) <= set(df.columns):
            frames.append(df)
    if not frames:
        raise ValueError(f"no file has the columns {required}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def jdbc_table(
    spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, properties: dict | None = None
) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=properties or {}
    )


def extract_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per extracted table."""
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, rows)


def nested_facts(spark: SparkSession, path: str) -> DataFrame:
    """Company fact files ``{"ticker": ..., "facts": {...}}``, one object per line."""
    return spark.read.schema(f"ticker string, facts {FACTS_SCHEMA}").json(path)


def load_projection(df: DataFrame, types: dict[str, str], date_from: tuple[str, str] | None = None) -> DataFrame:
    """Column-by-column cast of a landed file; the partition date is derived from the data again.

    ``date_from`` is ``(date column, timestamp column)``.
    """
    typed = df.select(*[F.col(c).cast(kind).alias(c) for c, kind in types.items()])
    return typed if date_from is None else typed.withColumn(date_from[0], F.to_date(date_from[1]))
