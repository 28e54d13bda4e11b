"""Funnel, coverage and volume measures over typed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordered import running


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part`` in percent of ``whole``; null when the whole is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def _is(kind: str, column: str = "event_type") -> Column:
    return F.col(column) == kind


def event_funnel(events: DataFrame, steps: list[str]) -> DataFrame:
    """Events per step and the rate from each step to the next, one row."""
    counts = events.agg(*[F.count_if(_is(s)).alias(s) for s in steps])
    rates = [pct(F.col(b), F.col(a)).alias(f"{a}_to_{b}_pct") for a, b in zip(steps, steps[1:])]
    return counts.select(*steps, *rates)


def visitor_funnel(events: DataFrame, visitor: str, steps: list[str]) -> DataFrame:
    """Visitors reaching each step: per-visitor flags first, then their sums."""
    flags = events.groupBy(visitor).agg(*[F.max(_is(s).cast("int")).alias(s) for s in steps])
    sums = flags.agg(F.count("*").alias("visitors"), *[F.sum(s).alias(s) for s in steps])
    rates = [pct(F.col(b), F.col(a)).alias(f"{a}_to_{b}_pct") for a, b in zip(steps, steps[1:])]
    return sums.select("visitors", *steps, *rates)


def funnel_kpis(events: DataFrame, visitor: str, steps: list[str]) -> DataFrame:
    """Total events, distinct visitors, and distinct visitors per step.

    Flags per visitor give every distinct count from one shuffle on the visitor.
    """
    flags = events.groupBy(visitor).agg(
        F.count("*").alias("_n"), *[F.max(_is(s).cast("int")).alias(s) for s in steps]
    )
    return flags.agg(
        F.sum("_n").alias("total_events"),
        F.count(visitor).alias("visitors"),
        *[F.sum(F.when(F.col(visitor).isNotNull(), F.col(s))).alias(f"{s}_visitors") for s in steps],
    )


def category_funnel(
    events: DataFrame, category: str, steps: list[str], min_first: int = 0, exclude: int | None = -1
) -> DataFrame:
    """Step counts by category, without the unknown member and thin categories."""
    kept = events if exclude is None else events.filter(F.col(category) != exclude)
    counts = kept.groupBy(category).agg(*[F.count_if(_is(s)).alias(s) for s in steps])
    first = F.col(steps[0])
    rates = [pct(F.col(s), first).alias(f"{s}_pct") for s in steps[1:]]
    return counts.filter(first >= min_first).select(category, *steps, *rates)


def unknown_rate(events: DataFrame, by: list[str], known: Column | None = None) -> DataFrame:
    """Events without item metadata, in percent, overall or by ``by``."""
    known = F.col("has_item_metadata") if known is None else known
    return (
        events.groupBy(*by)
        .agg(F.count("*").alias("events"), F.count_if(known).alias("with_metadata"))
        .withColumn("pct_unknown", pct(F.col("events") - F.col("with_metadata"), F.col("events"), 2))
    )


def daily_volume(events: DataFrame, day: Column) -> DataFrame:
    """Events per day."""
    return events.groupBy(day.alias("event_date")).agg(F.count("*").alias("events"))


def daily_volume_summary(daily: DataFrame) -> DataFrame:
    """Day count, first and last day with their volumes, median day. The input has one row per day."""
    return daily.agg(
        F.count("*").alias("days"),
        F.min("event_date").alias("first_day"),
        F.max("event_date").alias("last_day"),
        F.min_by("events", "event_date").alias("first_day_events"),
        F.max_by("events", "event_date").alias("last_day_events"),
        F.median("events").alias("median_day_events"),
    )


def fault_matrix(quarantined: DataFrame) -> DataFrame:
    """Detected reason against injected fault."""
    return quarantined.groupBy("dq_reason", "injected_fault").agg(F.count("*").alias("rows"))


def out_of_order(
    df: DataFrame, *, partition: str, offset: str, event_time: str, block: int = 1_000_000
) -> DataFrame:
    """Per broker partition: rows older than an earlier arrival, and the worst lag.

    The running maximum goes by blocks of offsets, so a partition of any length is
    spread over many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(offset) / F.lit(block)))
    seen = running(
        blocked, keys=[partition], bucket="_block", order=[offset], aggs={"_seen": ("max", event_time)}, inclusive=False
    )
    lag = F.col("_seen") - F.col(event_time)
    late = lag > 0
    return seen.groupBy(partition).agg(
        F.count("*").alias("messages"),
        F.count_if(late).alias("out_of_order"),
        F.coalesce(F.max(F.when(late, lag)), F.lit(0)).alias("max_lateness_ms"),
    )


def stream_quality(classified: DataFrame) -> DataFrame:
    """Consumer-side summary of a classified read in one pass plus a duplicate count.

    Totals, unparseable and invalid rows, defects nobody injected, and repeated ids.
    """
    unparseable = F.col("dq_reason").isin("unparseable_json", "empty_payload")
    by_id = (
        classified.groupBy(F.when(F.col("is_valid"), F.col("e.event_id")).alias("_id"))
        .agg(
            F.count("*").alias("_n"),
            F.count_if("is_valid").alias("_valid"),
            F.count_if(unparseable).alias("_unparseable"),
            F.count_if(~F.col("is_valid") & ~unparseable).alias("_invalid"),
            F.count_if(~F.col("is_valid") & ~unparseable & F.col("e._fault").isNull()).alias("_unmarked"),
        )
    )
    return by_id.agg(
        F.sum("_n").alias("total"),
        F.sum("_valid").alias("valid"),
        F.sum("_invalid").alias("invalid"),
        F.sum("_unparseable").alias("unparseable"),
        F.sum("_unmarked").alias("detected_but_unmarked"),
        F.sum(F.when(F.col("_id").isNotNull(), F.col("_n") - 1)).alias("duplicates"),
    )
