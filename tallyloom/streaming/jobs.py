"""Streaming runs of the event cleaning: two sinks, watermark, progress figures.

The transforms are those of the batch job. Clean and rejected rows are two queries
with their own checkpoints, so one can fail or be replayed without the other; late rows
get a third.
"""

from __future__ import annotations

import json
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyloom.operators.events import cast_valid, classify, clean_events, parse, split
from tallyloom.operators.ordered import first_by
from tallyloom.streaming.dedupe import dedupe_by_partition, with_state_store


#: The three sinks of a cleaning run.
SINKS = ("clean", "quarantine", "late")


@dataclass(frozen=True)
class Targets:
    """Where a cleaning run writes: data and checkpoints below one root."""

    root: str

    def data(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"


def to_parquet(df: DataFrame, targets: Targets, name: str, partition: str | None = None) -> StreamingQuery:
    """Starts an append-only Parquet query that drains what is available and stops by itself."""
    writer = (
        df.writeStream.queryName(name)
        .format("parquet")
        .outputMode("append")
        .option("path", targets.data(name))
        .option("checkpointLocation", targets.checkpoint(name))
        .trigger(availableNow=True)
    )
    return (writer.partitionBy(partition) if partition else writer).start()


def start_cleaning(
    messages: DataFrame, dim_items: DataFrame, targets: Targets, watermark: str = "3 days", suffix: str = "", by_partition: bool = False
) -> dict[str, StreamingQuery]:
    """Starts the clean, quarantine and late queries over one stream of messages.

    ``by_partition`` gives each broker partition a watermark of its own, so one that lags loses nothing.
    """
    unique = (lambda typed: dedupe_by_partition(typed, "event_id", delay=watermark)) if by_partition else None
    parts = clean_events(messages, dim_items, watermark=watermark, unique=unique)
    with with_state_store(messages.sparkSession) if by_partition else nullcontext():
        clean = to_parquet(parts.clean, targets, f"clean{suffix}", "event_date")
    return {
        "clean": clean,
        "quarantine": to_parquet(parts.quarantined, targets, f"quarantine{suffix}"),
        "late": to_parquet(parts.late, targets, f"late{suffix}"),
    }


def drain(queries: dict[str, StreamingQuery]) -> None:
    """Waits until every query has drained its input; a failed query raises."""
    for q in queries.values():
        q.awaitTermination()


def recover_dropped(messages: DataFrame, targets: Targets, suffix: str = "") -> None:
    """Writes to the ``recovered`` folder every valid row whose id neither the clean nor the late sink holds.

    A watermark follows the largest event time seen so far, whatever the partition. Rows of a
    partition that lags behind by more than the watermark are dropped by the stateful step even if
    their id is new and the broker stored them on time. ``messages`` are the same landed messages
    as a batch, read after the drain. Rerunning replaces the folder, so nothing doubles.
    """
    spark = messages.sparkSession
    valid, _ = split(classify(parse(messages)))
    kept = [written(spark, targets, f"{name}{suffix}").select("event_id") for name in ("clean", "late")]
    lost = cast_valid(valid).join(kept[0].unionByName(kept[1]), "event_id", "left_anti")
    once = first_by(lost, ["event_id"], [F.col("kafka_partition"), F.col("kafka_offset")])
    once.write.mode("overwrite").parquet(targets.data(f"recovered{suffix}"))


def late_rows(spark: SparkSession, targets: Targets, suffix: str = "") -> DataFrame:
    """Rows that came too late for the clean sink: late by broker time, or recovered."""
    late, recovered = (written(spark, targets, f"{name}{suffix}") for name in ("late", "recovered"))
    return late.unionByName(recovered.select(*late.columns))


def progress(spark: SparkSession, queries: dict[str, StreamingQuery]) -> DataFrame:
    """A look at the latest batches that each query still remembers: rows in, rate, rows dropped behind the watermark.

    Totals over a whole run come from ``progress.recorded``, which keeps every batch.
    """
    rows = []
    for name, q in queries.items():
        for p in q.recentProgress:
            body = json.loads(p.json) if hasattr(p, "json") else dict(p)
            dropped = sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in body.get("stateOperators", []))
            rows.append((name, int(body["batchId"]), int(body["numInputRows"]), float(body.get("processedRowsPerSecond") or 0.0), dropped))
    return spark.createDataFrame(rows, "query string, batch long, rows_in long, rows_per_second double, dropped_late long")


def reset(spark: SparkSession, targets: Targets, names: list[str]) -> None:
    """Removes the output and checkpoints of the named queries, for a run from scratch."""
    jvm = spark.sparkContext._jvm
    for name in names:
        for path in (targets.data(name), targets.checkpoint(name)):
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if fs.exists(hadoop):
                fs.delete(hadoop, True)


def written(spark: SparkSession, targets: Targets, name: str) -> DataFrame:
    return spark.read.parquet(targets.data(name))


def late_summary(figures: DataFrame) -> DataFrame:
    """Totals per query over its micro-batches."""
    return figures.groupBy("query").agg(
        F.count("*").alias("batches"), F.sum("rows_in").alias("rows_in"), F.sum("dropped_late").alias("dropped_late")
    )
