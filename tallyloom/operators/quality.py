"""Data-quality assertions: each returns the failing rows of one rule.

``report`` turns a set of assertions into one row per check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A named assertion: its failing rows, its severity, and the counts at which it speaks up."""

    name: str
    failing: DataFrame
    severity: str = "error"
    warn_above: int = 0
    error_above: int = 0


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, rows)`` for columns with nulls, all counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "rows").filter("rows > 0")


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).filter("rows > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the accepted list with their counts; null is not judged."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("rows"))


def relationships(df: DataFrame, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Foreign keys without a dimension row, with counts; keys are collapsed before the join."""
    used = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count("*").alias("rows"))
    return used.join(dim.select(key), key, "left_anti").withColumnRenamed(key, column) if column != key else used.join(dim.select(key), key, "left_anti")


def freshness(df: DataFrame, column: str, as_of: str, warn_hours: int = 24, error_hours: int = 168) -> DataFrame:
    """Age of the newest row at ``as_of`` if it is stale, with the level it reaches."""
    newest = df.agg(F.max(column).cast("timestamp").alias("newest"))
    age = (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("newest")) / 3600
    level = F.when(F.col("age_hours") > error_hours, "error").when(F.col("age_hours") > warn_hours, "warn")
    return newest.withColumn("age_hours", age).withColumn("level", level).filter("level is not null or newest is null").select("age_hours", "level")


def line_count(modeled: DataFrame, source: DataFrame) -> DataFrame:
    """Both row counts when they differ: two one-row aggregates compared as scalars."""
    expected = source.agg(F.count("*").alias("n")).scalar()
    return modeled.agg(F.count("*").alias("modeled_rows")).withColumn("source_rows", expected).filter("modeled_rows <> source_rows")


def payment_reconcile(
    lines: DataFrame, payments: DataFrame, tolerance: float = 0.02, excluded: tuple[str, ...] = ("canceled", "unavailable")
) -> DataFrame:
    """Orders whose payments differ from their lines by more than ``tolerance`` of the lines.

    Both sides are totalled per order before they meet.
    """
    line_totals = lines.filter(~F.col("order_status").isin(*excluded)).groupBy("order_id").agg(F.sum("item_revenue").alias("line_total"))
    paid = payments.groupBy("order_id").agg(F.sum("payment_value").alias("payment_total"))
    gap = F.col("payment_total") - F.col("line_total")
    return line_totals.join(paid, "order_id").withColumn("difference", gap).filter(F.abs("difference") > F.col("line_total") * F.lit(tolerance))


def orphan_bound(dim: DataFrame, most: int) -> DataFrame:
    """The number of distinct categories outside the tree if it exceeds the bound."""
    orphan = F.when(F.col("category_id").isNotNull() & F.col("root_category_id").isNull(), F.col("category_id"))
    return dim.agg(F.countDistinct(orphan).alias("orphan_categories")).filter(F.col("orphan_categories") > most)


def share_within(df: DataFrame, flag: Column, low: float, high: float) -> DataFrame:
    """The share of rows with the flag when it lies outside the two-sided bound."""
    share = F.try_divide(F.count_if(flag), F.count("*"))
    return df.agg(share.alias("share"), F.count("*").alias("rows")).filter(~F.col("share").between(low, high))


def reconcile_counts(classified: DataFrame) -> DataFrame:
    """Messages read, quarantined and kept as clean events, and the duplicates removed between them.

    One aggregation by id gives all four: each valid id is one clean event.
    """
    by_id = classified.groupBy(F.when(F.col("is_valid"), F.col("e.event_id")).alias("_id")).agg(
        F.count("*").alias("_n"), F.count_if(~F.col("is_valid")).alias("_bad")
    )
    counts = by_id.agg(F.sum("_n").alias("read"), F.sum("_bad").alias("quarantined"), F.count("_id").alias("clean"))
    removed = F.col("read") - F.col("quarantined") - F.col("clean")
    return counts.withColumn("duplicates_removed", removed).withColumn(
        "quarantined_pct", F.round(F.try_divide(F.col("quarantined") * F.lit(100.0), F.col("read")), 4)
    )


def overlap(a: DataFrame, b: DataFrame, a_date: str, b_date: str) -> DataFrame:
    """The two date ranges when one source is empty or they do not overlap."""
    other = b.agg(F.struct(F.min(b_date).alias("lo"), F.max(b_date).alias("hi")).alias("s")).scalar()
    ranges = a.agg(F.min(a_date).alias("a_first"), F.max(a_date).alias("a_last")).withColumn("_o", other)
    ranges = ranges.select("a_first", "a_last", F.col("_o.lo").alias("b_first"), F.col("_o.hi").alias("b_last"))
    fine = (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    return ranges.filter(~F.coalesce(fine, F.lit(False)))


def report(checks: list[Check]) -> DataFrame:
    """``(check, severity, failing, outcome)`` for every assertion."""
    rows = []
    for c in checks:
        n = F.col("failing")
        outcome = F.when(n <= c.warn_above, "pass").when((F.lit(c.severity) == "warn") | (n <= c.error_above), "warn").otherwise("error")
        counted = c.failing.agg(F.count("*").alias("failing"))
        rows.append(counted.select(F.lit(c.name).alias("check"), F.lit(c.severity).alias("severity"), "failing", outcome.alias("outcome")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out


@dataclass(frozen=True)
class RowRule:
    """A rule on single rows: ``fails`` is true for a row that breaks it; null is not judged."""

    name: str
    fails: Column
    severity: str = "error"
    warn_above: int = 0
    error_above: int = 0


def null_rules(columns: list[str], severity: str = "error") -> list[RowRule]:
    return [RowRule(f"{c} is present", F.col(c).isNull(), severity) for c in columns]


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], rules: list[RowRule]) -> DataFrame:
    """Writes ``df`` by ``write`` and returns ``(check, severity, rows, failing, outcome)`` per rule.

    The counts ride on the write itself, so any number of row-level rules costs no pass of its own.
    ``write`` runs one action over the frame it is given. What spans rows (uniqueness, references)
    stays with the assertions above. An empty frame has 0 rows and passes.
    """
    seen = Observation()
    counts = [F.count_if(F.coalesce(r.fails, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules)]
    write(df.observe(seen, F.count("*").alias("rows"), *counts))
    found = seen.get
    rows = []
    for i, r in enumerate(rules):
        n = found[f"r{i}"]
        outcome = "pass" if n <= r.warn_above else "warn" if r.severity == "warn" or n <= r.error_above else "error"
        rows.append((r.name, r.severity, found["rows"], n, outcome))
    return df.sparkSession.createDataFrame(rows, "check string, severity string, rows long, failing long, outcome string")
