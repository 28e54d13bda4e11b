"""Business measures over facts and dimensions.

Shares divide by a scalar subquery over the small aggregate, not by an unpartitioned
window, so no step gathers rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import exact_quantile


def exclude_status(df: DataFrame, statuses: tuple[str, ...], column: str = "order_status") -> DataFrame:
    """Rows whose status is known and not excluded (``<>`` drops null statuses)."""
    return df.filter(~F.col(column).isin(*statuses)) if statuses else df


def date_window(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """The half-open window ``[start, end)``; a plain range that reaches the scan."""
    kind = dict(df.dtypes)[ts]
    return df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def header_lines(df: DataFrame) -> DataFrame:
    """One row per order, for averages at order grain."""
    return df.filter("is_order_header_line")


def with_share(df: DataFrame, value: str, out: str = "share_pct", digits: int = 4) -> DataFrame:
    """Percent of the column's total."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, F.round(F.try_divide(F.col(value) * F.lit(100.0), total), digits))


def revenue_kpis(lines: DataFrame) -> DataFrame:
    """Revenue, orders, average order value, and the review score averaged over orders."""
    per_order = lines.groupBy("order_id").agg(
        F.sum("item_revenue").alias("_rev"), F.max("review_score").alias("_score")
    )
    return per_order.agg(
        F.sum("_rev").alias("total_revenue"), F.count("*").alias("total_orders"), F.avg("_score").alias("avg_review_score")
    ).select(
        "total_revenue",
        "total_orders",
        F.try_divide(F.col("total_revenue").cast("double"), F.col("total_orders")).alias("avg_order_value"),
        "avg_review_score",
    )


def revenue_by(lines: DataFrame, *by: Column | str, revenue: str = "item_revenue") -> DataFrame:
    """Revenue, lines and distinct orders by the given keys."""
    return lines.groupBy(*by).agg(
        F.sum(revenue).alias("revenue"), F.count("*").alias("lines"), F.countDistinct("order_id").alias("orders")
    )


def growth_drivers(lines: DataFrame, *by: Column | str) -> DataFrame:
    """Orders, customers, sellers and average order value by period.

    Lines are first reduced to orders and to sellers per period; several distinct counts at once
    would multiply every line.
    """
    names = lines.select(*by).columns
    rows = lines.select(*by, "order_id", "customer_id", "seller_id", "item_revenue")
    per_order = rows.groupBy(*names, "order_id", "customer_id").agg(F.sum("item_revenue").alias("_revenue"))
    orders = per_order.groupBy(*names).agg(
        F.count("order_id").alias("orders"), F.countDistinct("customer_id").alias("unique_customers"), F.sum("_revenue").alias("_revenue")
    )
    sellers = rows.select(*names, "seller_id").distinct().groupBy(*[F.col(n).alias(f"_{n}") for n in names]).agg(F.count("seller_id").alias("active_sellers"))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    average = F.round(F.try_divide(F.col("_revenue").cast("double"), F.col("orders")), 2)
    return orders.join(sellers, same).select(*names, "orders", "unique_customers", "active_sellers", average.alias("avg_order_value"))


def day_peaks(lines: DataFrame, day: Column, n: int = 5) -> DataFrame:
    """The ``n`` best days and each as a multiple of the mean day."""
    daily = lines.groupBy(day.alias("day")).agg(
        F.sum("item_revenue").alias("revenue"), F.countDistinct("order_id").alias("orders")
    )
    mean = daily.agg(F.avg(F.col("revenue").cast("double"))).scalar()
    best = daily.orderBy(F.desc("revenue"), "day").limit(n)
    return best.withColumn("x_mean", F.round(F.col("revenue").cast("double") / mean, 4))


def thin_periods(periods: DataFrame, orders: str = "orders", minimum: int = 100) -> DataFrame:
    """Flags periods with too few orders to mean anything."""
    return periods.withColumn("is_thin", F.col(orders) < minimum)


def top_n_share(totals: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """The ``n`` largest with their percent share of everything."""
    return with_share(totals, value).orderBy(F.desc(value), label).limit(n)


def top_n_other(totals: DataFrame, label: str, value: str, n: int = 10, unknown: str | None = None) -> DataFrame:
    """The ``n`` largest labels and one ``Other (m)`` row for the rest.

    The unknown label takes no rank and stays a row of its own. The top labels come
    from a top-k, which keeps ``n`` rows per task; the rest is re-aggregated.
    """
    ranked = totals if unknown is None else totals.filter(F.col(label) != unknown)
    top = ranked.orderBy(F.desc(value), label).limit(n).select(F.col(label).alias("_top"))
    marked = ranked.join(top, F.col(label) == F.col("_top"), "left")
    rest = marked.filter("_top is null").agg(F.sum(value).alias(value), F.count("*").alias("_n")).filter("_n > 0")
    other = rest.select(F.concat(F.lit("Other ("), F.col("_n"), F.lit(")")).alias(label), value)
    out = marked.filter("_top is not null").select(label, value).unionByName(other)
    return out if unknown is None else out.unionByName(totals.filter(F.col(label) == unknown).select(label, value))


def status_mix(lines: DataFrame) -> DataFrame:
    """Orders, revenue and revenue share by status."""
    return with_share(
        lines.groupBy("order_status").agg(
            F.countDistinct("order_id").alias("orders"), F.sum("item_revenue").alias("revenue")
        ),
        "revenue",
    )


def review_by_band(lines: DataFrame) -> DataFrame:
    """Orders, reviewed orders and mean score per timeliness band, at order grain."""
    delivered = header_lines(lines).filter(F.col("delivery_timeliness_band").isNotNull())
    return delivered.groupBy("delivery_timeliness_sort", "delivery_timeliness_band").agg(
        F.count("*").alias("orders"), F.count("review_score").alias("reviewed"), F.avg("review_score").alias("avg_score")
    )


def state_delivery(lines: DataFrame, state: str, min_orders: int = 200) -> DataFrame:
    """Mean delivery days and late share per state with enough delivered orders."""
    delivered = header_lines(lines).filter(F.col("days_to_deliver").isNotNull())
    return (
        delivered.groupBy(state)
        .agg(
            F.count("*").alias("delivered"),
            F.avg("days_to_deliver").alias("avg_days"),
            F.round(F.count_if("is_late_delivery") * F.lit(100.0) / F.count("*"), 4).alias("late_pct"),
        )
        .filter(F.col("delivered") >= min_orders)
    )


def review_by_category(lines: DataFrame, category: str, min_reviews: int = 30, unknown: str = "unknown") -> DataFrame:
    """Mean review per category at order grain, categories with enough reviews."""
    return (
        header_lines(lines)
        .filter(F.col("review_score").isNotNull() & (F.col(category) != unknown))
        .groupBy(category)
        .agg(F.round(F.avg("review_score"), 2).alias("avg_review"), F.count("*").alias("n_reviews"))
        .filter(F.col("n_reviews") >= min_reviews)
    )


def best_and_worst(df: DataFrame, label: str, value: str, n: int = 10) -> DataFrame:
    """The ``n`` best and the ``n`` worst rows; a row may be in both."""
    keep = [F.col(label), F.col(value)]
    best = df.orderBy(F.desc(value), label).limit(n).select(F.lit("Top").alias("grp"), *keep)
    worst = df.orderBy(value, label).limit(n).select(F.lit("Bottom").alias("grp"), *keep)
    return best.unionByName(worst)


def payment_mix(payments: DataFrame) -> DataFrame:
    """Rows, value, value share and mean instalments by payment type."""
    return with_share(
        payments.groupBy("payment_type").agg(
            F.count("*").alias("payments"),
            F.sum("payment_value").alias("value"),
            F.avg("payment_installments").alias("avg_installments"),
        ),
        "value",
    )


def installment_ladder(payments: DataFrame, payment_type: str) -> DataFrame:
    """Payments and mean value per number of instalments for one type."""
    return (
        payments.filter(F.col("payment_type") == payment_type)
        .groupBy("payment_installments")
        .agg(F.count("*").alias("payments"), F.avg(F.col("payment_value").cast("double")).alias("avg_value"))
    )


def repeat_rate(people: DataFrame) -> DataFrame:
    """People, people with several orders, and the rate."""
    return people.agg(
        F.count("*").alias("people"), F.count_if(F.col("orders_by_person") > 1).alias("repeat_people")
    ).withColumn("repeat_pct", F.round(F.try_divide(F.col("repeat_people") * F.lit(100.0), F.col("people")), 4))


def order_count_histogram(people: DataFrame) -> DataFrame:
    return people.groupBy("orders_by_person").agg(F.count("*").alias("people"))


def labelled_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """``(label, n)`` rows, one count per frame."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in parts.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out


def groups_with_many(df: DataFrame, *by: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).filter("_n > 1")


def freshness(facts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """First and last date of each fact."""
    rows = [
        df.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date")).select(
            F.lit(label).alias("fact"), "first_date", "last_date"
        )
        for label, (df, day) in facts.items()
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionAll(more)
    return out


def revenue_gap(lines: DataFrame, payments: DataFrame) -> DataFrame:
    """Line revenue against payments, gap and gap percent: two one-row aggregates."""
    paid = payments.agg(F.sum("payment_value")).scalar()
    return (
        lines.agg(F.sum("item_revenue").alias("line_revenue"))
        .withColumn("payment_total", paid)
        .withColumn("gap", F.col("payment_total") - F.col("line_revenue"))
        .withColumn("gap_pct", F.round(F.try_divide(F.col("gap").cast("double") * 100.0, F.col("line_revenue").cast("double")), 4))
    )


def state_centroids(points: DataFrame, volumes: DataFrame, state: str = "state", digits: int = 4) -> DataFrame:
    """Per-state median latitude and longitude of the points in bounds, with order volume."""
    inside = points.filter("is_within_bounds")
    lat = exact_quantile(inside, keys=[state], value="latitude", p=0.5, out="lat")
    lng = exact_quantile(inside, keys=[state], value="longitude", p=0.5, out="lng")
    return (
        lat.join(lng, state)
        .join(volumes, state, "left")
        .select(state, F.round("lat", digits).alias("lat"), F.round("lng", digits).alias("lng"), F.coalesce("orders", F.lit(0)).alias("orders"))
    )


def matched_cells(df: DataFrame, cells: list[Column], flag: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Effect of a flag inside matched cells.

    Mean with the flag minus mean without, per cell that has both; the summed
    difference over the summed baseline, overall or per ``by`` (which must be among
    the cells).
    """
    named = [c.alias(f"_cell{i}") for i, c in enumerate(cells)]
    by = by or []
    per_cell = (
        df.filter(F.col(flag).isNotNull())
        .groupBy(*named, *by)
        .agg(
            F.avg(F.when(F.col(flag), F.col(value))).alias("_on"),
            F.avg(F.when(~F.col(flag), F.col(value))).alias("_off"),
        )
        .filter("_on is not null and _off is not null")
    )
    return (
        per_cell.groupBy(*by)
        .agg(F.count("*").alias("cells"), F.sum(F.col("_on") - F.col("_off")).alias("delta"), F.sum("_off").alias("baseline"))
        .withColumn("effect_pct", F.try_divide(F.col("delta") * 100, F.col("baseline")))
    )


def pivot_mean(long: DataFrame, index: str, names: list[str], name_col: str = "datatype", value_col: str = "value") -> DataFrame:
    """Long to wide means with a fixed list of columns, so no extra pass finds them."""
    return long.groupBy(index).pivot(name_col, names).agg(F.avg(value_col))


def yoy_by(filings: DataFrame, state: str, year: str, org: str, amount: str) -> DataFrame:
    """Organisations, total, mean and change on the previous year by state.

    The window runs over the aggregate: one row per state and year.
    """
    totals = filings.groupBy(state, year).agg(
        F.countDistinct(org).alias("num_orgs"),
        F.sum(amount).alias("total"),
        F.try_divide(F.sum(amount).cast("double"), F.count(amount)).alias("average"),
    )
    previous = F.lag("total").over(Window.partitionBy(state).orderBy(year))
    return totals.withColumn("yoy_change", F.col("total") - previous)


def retention(filings: DataFrame, org: str, year: str, amount: str, literal: bool = False) -> DataFrame:
    """Organisations giving in consecutive years.

    Collapses to one row per organisation and year first. ``literal=True`` keeps one
    row per filing, where two filings in a year break the chain.
    """
    pairs = filings.filter(F.col(amount) > 0).groupBy(org, year).agg(F.count("*").alias("_m"))
    # The year before is an equality, so a join on (org, year) replaces a window over the org. Of
    # several filings in a year only the first can follow the year before, so the literal count
    # differs in the total alone.
    shifted = pairs.select(org, (F.col(year) + 1).alias(year), F.lit(True).alias("_kept"))
    total = F.sum("_m") if literal else F.count("*")
    return (
        pairs.join(shifted, [org, year], "left")
        .groupBy(year)
        .agg(total.alias("total_orgs"), F.count_if("_kept").alias("retained"))
        .withColumn("retention_pct", F.round(F.try_divide(F.col("retained") * F.lit(100.0), F.col("total_orgs")), 1))
    )


def previous_active_year(filings: DataFrame, org: str, year: str) -> DataFrame:
    """Each organisation's active years with the one before; at most one row per calendar year."""
    return filings.select(org, year).distinct().withColumn(
        "prev_year", F.lag(year).over(Window.partitionBy(org).orderBy(year))
    )


def revenue_mix(filings: DataFrame, code: str, year: str, parts: list[str], part: str, whole: str) -> DataFrame:
    """Sums by the first letter of a code and year, with one part in percent of the whole."""
    return filings.groupBy(F.left(F.col(code), F.lit(1)).alias("category"), year).agg(
        *[F.sum(p).alias(p) for p in parts],
        F.round(F.try_divide(F.sum(part).cast("double") * 100.0, F.sum(whole).cast("double")), 1).alias("part_pct"),
    )


def compensation_ratio(filings: DataFrame, part: str, whole: str, size: str, min_size: float, digits: int = 1) -> DataFrame:
    """Guarded ratio for rows above a size, largest first."""
    ratio = F.when(F.col(whole) > 0, F.round(F.col(part) * 100.0 / F.col(whole), digits))
    return filings.filter(F.col(size) > min_size).withColumn("compensation_pct", ratio)
