"""Calendar features, date dimensions and the federal holiday calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN_KEY = -1


def _days(spark: SparkSession, start: str, end: str) -> DataFrame:
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("date_day"))


def iso_weekday(day: Column | str) -> Column:
    """1 = Monday to 7 = Sunday."""
    return F.weekday(day) + 1


def calendar_features(ts: str) -> dict[str, Column]:
    """Hour, weekday (Monday 0), month and weekend flag of a timestamp column."""
    return {
        "hour_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
    }


def date_dim(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day of the span, both ends included."""
    day = F.col("date_day")
    return _days(spark, start, end).select(
        day,
        F.year(day).alias("calendar_year"),
        F.quarter(day).alias("calendar_quarter"),
        F.month(day).alias("calendar_month"),
        F.date_format(day, "MMM").alias("month_name"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.dayofmonth(day).alias("day_of_month"),
        iso_weekday(day).alias("day_of_week"),
        F.date_format(day, "EEE").alias("day_name"),
        F.weekofyear(day).alias("week_of_year"),
        F.dayofyear(day).alias("day_of_year"),
        (iso_weekday(day) >= 6).alias("is_weekend"),
        (day == F.last_day(day)).alias("is_month_end"),
        F.to_date(F.date_trunc("week", day)).alias("week_start_date"),
        F.to_date(F.date_trunc("month", day)).alias("month_start_date"),
    )


def date_dim_ext(spans: DataFrame, with_unknown: bool = True) -> DataFrame:
    """Keyed date dimension over the span of ``spans(first_day, last_day)``.

    The span is the overall minimum and maximum, widened to whole years. The unknown
    member has key -1, so a missing date still resolves.
    """
    span = spans.agg(F.trunc(F.min("first_day"), "year").alias("a"), F.max("last_day").alias("b"))
    year_end = F.last_day(F.make_date(F.year("b"), F.lit(12), F.lit(1)))
    days = span.filter(F.col("a").isNotNull()).select(F.explode(F.sequence("a", year_end)).alias("date_day"))
    day = F.col("date_day")
    month_end = day == F.last_day(day)
    rows = days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        F.extract(F.lit("YEAROFWEEK"), day).cast("int").alias("iso_year"),
        iso_weekday(day).alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "EEE").alias("day_abbr"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "MMM").alias("month_abbr"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.concat(F.year(day), F.lit("-Q"), F.quarter(day)).alias("year_quarter"),
        F.trunc(day, "month").alias("first_day_of_month"),
        F.last_day(day).alias("last_day_of_month"),
        (iso_weekday(day) >= 6).alias("is_weekend"),
        (F.dayofmonth(day) == 1).alias("is_month_start"),
        month_end.alias("is_month_end"),
        (month_end & (F.month(day) % 3 == 0)).alias("is_quarter_end"),
        (month_end & (F.month(day) == 12)).alias("is_year_end"),
    )
    if not with_unknown:
        return rows
    blank = {"date_day", "first_day_of_month", "last_day_of_month"}
    member = []
    for field in rows.schema.fields:
        if field.name in blank:
            value = F.lit(None)
        elif field.name.startswith("is_"):
            value = F.lit(False)
        else:
            value = F.lit("Unknown" if field.dataType.typeName() == "string" else UNKNOWN_KEY)
        member.append(value.cast(field.dataType).alias(field.name))
    return rows.unionByName(spans.sparkSession.range(1).select(*member))


# Holiday rules as (name, month, fixed day) and (name, month, weekday, nth from start or end, first year).
FIXED_HOLIDAYS = (
    ("New Year's Day", 1, 1, 1),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1),
    ("Veterans Day", 11, 11, 1),
    ("Christmas Day", 12, 25, 1),
)
FLOATING_HOLIDAYS = (
    ("Birthday of Martin Luther King, Jr.", 1, 0, 3, 1986),
    ("Washington's Birthday", 2, 0, 3, 1),
    ("Memorial Day", 5, 0, -1, 1),
    ("Labor Day", 9, 0, 1, 1),
    ("Columbus Day", 10, 0, 2, 1),
    ("Thanksgiving Day", 11, 3, 4, 1),
)


def federal_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``(holiday, name)`` with the observed date: Saturday moves to Friday, Sunday to Monday.

    Eleven rows a year, so the result is bounded by the span of years.
    """
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))

    def fixed(month: int, day: int) -> Column:
        d = F.make_date("y", F.lit(month), F.lit(day))
        return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)

    def floating(month: int, weekday: int, nth: int) -> Column:
        first = F.make_date("y", F.lit(month), F.lit(1))
        if nth > 0:
            return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))
        last = F.last_day(first)
        return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))

    entries = [
        F.struct(fixed(m, d).alias("holiday"), F.lit(name).alias("name"), F.lit(since).alias("since"))
        for name, m, d, since in FIXED_HOLIDAYS
    ] + [
        F.struct(floating(m, wd, nth).alias("holiday"), F.lit(name).alias("name"), F.lit(since).alias("since"))
        for name, m, wd, nth, since in FLOATING_HOLIDAYS
    ]
    return years.select("y", F.inline(F.array(*entries))).filter("y >= since").select("holiday", "name")


def with_holiday_flag(df: DataFrame, day: str, first_year: int, last_year: int) -> DataFrame:
    """Adds ``is_holiday``. The calendar side is broadcast: at most eleven rows a year."""
    calendar = federal_holidays(df.sparkSession, first_year, last_year).select(
        F.col("holiday").alias("_holiday"), F.lit(1).alias("_hit")
    ).dropDuplicates(["_holiday"])
    joined = df.join(F.broadcast(calendar), F.to_date(day) == F.col("_holiday"), "left")
    return joined.withColumn("is_holiday", F.coalesce("_hit", F.lit(0))).drop("_holiday", "_hit")
