"""Daily volume against weather and calendar, and incident rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import bands, calendar, text
from tallyloom.operators import metrics as m
from tallyloom.operators import regression, series
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables


def ridership(t: Tables) -> DataFrame:
    """Daily order value standing in for ridership."""
    return t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("ridership")
    )


def weather_long(t: Tables) -> DataFrame:
    """Long weather table ``(date, datatype, value)`` over the order days; some readings are missing."""
    doy = F.dayofyear("date")
    readings = F.array(
        F.struct(F.lit("TMAX").alias("datatype"), F.when(doy % 50 != 0, (doy * 7) % 40 - 2).cast("double").alias("value")),
        F.struct(F.lit("TMIN").alias("datatype"), ((doy * 7) % 40 - 12).cast("double").alias("value")),
        F.struct(F.lit("PRCP").alias("datatype"), F.when(doy % 60 != 0, F.greatest((doy * 11) % 30 - 18, F.lit(0))).cast("double").alias("value")),
    )
    days = t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()
    return days.select("date", F.inline(readings)).filter("value is not null")


def days(t: Tables) -> DataFrame:
    wide = m.pivot_mean(weather_long(t), "date", ["TMAX", "TMIN", "PRCP"])
    joined = ridership(t).join(wide, "date").withColumn("TMAX_F", bands.celsius_to_fahrenheit("TMAX"))
    return joined.withColumns(
        {"rain_day": bands.rain_day("PRCP"), "temp_band": bands.temp_band("TMAX_F"), "weekday": F.weekday("date"), "month": F.month("date")}
    )


WX_SQL = """ride AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS ridership FROM orders GROUP BY 1),
wx AS (SELECT date, CASE WHEN doy % 50 <> 0 THEN CAST((doy * 7) % 40 - 2 AS DOUBLE) END AS tmax, CAST((doy * 7) % 40 - 12 AS DOUBLE) AS tmin,
  CASE WHEN doy % 60 <> 0 THEN CAST(greatest((doy * 11) % 30 - 18, 0) AS DOUBLE) END AS prcp
  FROM (SELECT date, dayofyear(date) AS doy FROM ride) d),
days AS (SELECT ride.date, ridership, tmax, tmin, prcp, tmax * 9 / 5 + 32 AS tmax_f, prcp > 0 AS rain_day, isodow(ride.date) - 1 AS weekday,
  month(ride.date) AS month, CASE WHEN tmax * 9 / 5 + 32 < 55 THEN 'Cold (<55F)' WHEN tmax * 9 / 5 + 32 <= 75 THEN 'Mild (55-75F)'
    WHEN tmax IS NOT NULL THEN 'Warm (>75F)' END AS temp_band FROM ride JOIN wx USING (date))"""


@query("agg_weather_pivot", f"WITH {WX_SQL} SELECT date, tmax AS TMAX, tmin AS TMIN, prcp AS PRCP FROM wx")
def agg_weather_pivot(t: Tables) -> DataFrame:
    return m.pivot_mean(weather_long(t), "date", ["TMAX", "TMIN", "PRCP"])


@query("join_date_inner", f"WITH {WX_SQL} SELECT date, ridership, tmax_f AS TMAX_F, prcp AS PRCP FROM days")
def join_date_inner(t: Tables) -> DataFrame:
    return days(t).select("date", "ridership", "TMAX_F", "PRCP")


@query("temp_band", f"WITH {WX_SQL} SELECT temp_band, rain_day, count(*) AS days, min(tmax_f) AS coldest FROM days GROUP BY 1, 2")
def temp_band(t: Tables) -> DataFrame:
    return days(t).groupBy("temp_band", "rain_day").agg(F.count("*").alias("days"), F.min("TMAX_F").alias("coldest"))


def flag_effect(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Mean with and without a flag and the percent difference; unknown flags stay out."""
    on, off = F.avg(F.when(F.col(flag), F.col(value))), F.avg(F.when(~F.col(flag), F.col(value)))
    return df.agg(
        F.count_if(F.col(flag)).alias("days_on"), F.count_if(~F.col(flag)).alias("days_off"), on.alias("mean_on"), off.alias("mean_off")
    ).withColumn("diff_pct", text.pct_change("mean_off", "mean_on"))


EFFECT = """count(CASE WHEN rain_day THEN 1 END) AS days_on, count(CASE WHEN NOT rain_day THEN 1 END) AS days_off,
  round(avg(CASE WHEN rain_day THEN ridership END), 2) AS mean_on, round(avg(CASE WHEN NOT rain_day THEN ridership END), 2) AS mean_off,
  round((avg(CASE WHEN rain_day THEN ridership END) - avg(CASE WHEN NOT rain_day THEN ridership END)) * 100
    / avg(CASE WHEN NOT rain_day THEN ridership END), 6) AS diff_pct FROM days"""


@query("agg_rain_effect", f"WITH {WX_SQL} SELECT 'all' AS scope, {EFFECT} UNION ALL SELECT 'weekdays', {EFFECT} WHERE weekday < 5")
def agg_rain_effect(t: Tables) -> DataFrame:
    base = days(t)
    parts = {"all": base, "weekdays": base.filter("weekday < 5")}
    out = [flag_effect(df, "rain_day", "ridership").select(F.lit(name).alias("scope"), "*") for name, df in parts.items()]
    both = out[0].unionByName(out[1])
    return both.select("scope", "days_on", "days_off", F.round("mean_on", 2).alias("mean_on"), F.round("mean_off", 2).alias("mean_off"), F.round("diff_pct", 6).alias("diff_pct"))


@query("agg_temp_effect", f"""WITH {WX_SQL}
SELECT temp_band, count(*) AS days, round(avg(ridership), 2) AS mean_all, round(avg(CASE WHEN weekday < 5 THEN ridership END), 2) AS mean_weekdays
FROM days WHERE temp_band IS NOT NULL GROUP BY 1""")
def agg_temp_effect(t: Tables) -> DataFrame:
    return (
        days(t)
        .filter("temp_band is not null")
        .groupBy("temp_band")
        .agg(
            F.count("*").alias("days"),
            F.round(F.avg("ridership"), 2).alias("mean_all"),
            F.round(F.avg(F.when(F.col("weekday") < 5, F.col("ridership"))), 2).alias("mean_weekdays"),
        )
    )


@query("flt_weekday_only", f"WITH {WX_SQL} SELECT weekday, count(*) AS days FROM days WHERE weekday < 5 GROUP BY 1")
def flt_weekday_only(t: Tables) -> DataFrame:
    return ridership(t).filter(F.weekday("date") < 5).groupBy(F.weekday("date").cast("bigint").alias("weekday")).agg(F.count("*").alias("days"))


@query("agg_dow", f"WITH {WX_SQL} SELECT weekday, count(*) AS days, round(avg(ridership), 2) AS mean FROM days GROUP BY 1")
def agg_dow(t: Tables) -> DataFrame:
    return days(t).groupBy(F.col("weekday").cast("bigint").alias("weekday")).agg(F.count("*").alias("days"), F.round(F.avg("ridership"), 2).alias("mean"))


@query("agg_month_swing", f"""WITH {WX_SQL}, mm AS (SELECT month, avg(ridership) AS mean FROM days GROUP BY 1)
SELECT arg_max(month, mean) AS peak_month, round(max(mean), 2) AS peak, arg_min(month, mean) AS trough_month, round(min(mean), 2) AS trough,
  round((max(mean) - min(mean)) * 100 / min(mean), 6) AS swing_pct FROM mm""")
def agg_month_swing(t: Tables) -> DataFrame:
    months = ridership(t).groupBy(F.month("date").cast("bigint").alias("month")).agg(F.avg("ridership").alias("mean"))
    swing = months.agg(
        F.max_by("month", "mean").alias("peak_month"), F.max("mean").alias("peak"), F.min_by("month", "mean").alias("trough_month"), F.min("mean").alias("trough")
    )
    return swing.select("peak_month", F.round("peak", 2).alias("peak"), "trough_month", F.round("trough", 2).alias("trough"), text.pct_change("trough", "peak", 6).alias("swing_pct"))


@query("agg_corr", f"WITH {WX_SQL} SELECT round(corr(ridership, prcp), 8) AS corr_rain, round(corr(ridership, tmax_f), 8) AS corr_temp FROM days")
def agg_corr(t: Tables) -> DataFrame:
    return days(t).agg(F.round(F.corr("ridership", "PRCP"), 8).alias("corr_rain"), F.round(F.corr("ridership", "TMAX_F"), 8).alias("corr_temp"))


Z_SQL = f"""{WX_SQL}, gs AS (SELECT weekday, avg(ridership) AS mu, stddev_samp(ridership) AS sd FROM days GROUP BY 1),
gz AS (SELECT date, days.weekday, (ridership - mu) * 100 / mu AS pct_dev, (ridership - mu) / sd AS z FROM days JOIN gs USING (weekday))"""


@query("win_group_z", f"WITH {Z_SQL} SELECT date, weekday, round(pct_dev, 6) AS pct_dev, round(z, 6) AS z FROM gz")
def win_group_z(t: Tables) -> DataFrame:
    out = series.group_z(ridership(t), by=F.weekday("date"), value="ridership")
    return out.select("date", F.weekday("date").cast("bigint").alias("weekday"), F.round("pct_dev", 6).alias("pct_dev"), F.round("z", 6).alias("z"))


@query("topk_spikes", f"WITH {Z_SQL} SELECT date, round(pct_dev, 6) AS pct_dev FROM gz ORDER BY gz.pct_dev DESC, date LIMIT 10")
def topk_spikes(t: Tables) -> DataFrame:
    out = series.group_z(ridership(t), by=F.weekday("date"), value="ridership")
    return out.orderBy(F.desc("pct_dev"), "date").limit(10).select("date", F.round("pct_dev", 6).alias("pct_dev"))


def incidents(t: Tables) -> DataFrame:
    """Monthly counts ``(month, line, category, incidents)``: lines are customer nations, categories priorities."""
    orders = t.orders.select("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderpriority").alias("category"))
    lines = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("line"))
    return orders.join(lines, "o_custkey").groupBy("month", "line", "category").agg(F.count("*").alias("incidents"))


INC_SQL = """inc AS (SELECT c_nationkey AS line, o_orderpriority AS category, count(*) AS incidents FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
tops AS (SELECT line, sum(incidents) AS total FROM inc GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""


def top_lines(inc: DataFrame, n: int) -> DataFrame:
    return inc.groupBy("line").agg(F.sum("incidents").alias("total")).orderBy(F.desc("total"), "line").limit(n)


@query("topk_lines", """SELECT c_nationkey AS line, count(*) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def topk_lines(t: Tables) -> DataFrame:
    return top_lines(incidents(t), 10)


@query("join_semi_top", f"WITH {INC_SQL} SELECT line, category, CAST(incidents AS BIGINT) AS incidents FROM inc WHERE line IN (SELECT line FROM tops)")
def join_semi_top(t: Tables) -> DataFrame:
    inc = incidents(t)
    kept = inc.join(top_lines(inc, 5).select("line"), "line", "left_semi")
    return kept.groupBy("line", "category").agg(F.sum("incidents").alias("incidents"))


CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-UNUSED"]
CAT_COLS = ", ".join(f"CAST(coalesce(sum(CASE WHEN category = '{c}' THEN incidents END), 0) AS BIGINT) AS \"{c}\"" for c in CATEGORIES)


@query("agg_incidents_rank", f"WITH {INC_SQL} SELECT line, {CAT_COLS} FROM inc WHERE line IN (SELECT line FROM tops) GROUP BY 1")
def agg_incidents_rank(t: Tables) -> DataFrame:
    inc = incidents(t)
    kept = inc.join(top_lines(inc, 5).select("line"), "line", "left_semi")
    return kept.groupBy("line").pivot("category", CATEGORIES).agg(F.sum("incidents")).na.fill(0)


@query("pct_change_guarded", f"""WITH {WX_SQL}, y AS (SELECT year(date) AS yr, sum(CASE WHEN weekday >= 5 THEN 1 ELSE 0 END) AS a,
  sum(CASE WHEN weekday >= 5 AND prcp > 100 THEN 1 ELSE 0 END) AS b, count(*) AS n FROM days GROUP BY 1)
SELECT yr, round((n - a) * 100.0 / a, 4) AS change_pct, CASE WHEN b <> 0 THEN 1.0 END AS zero_base FROM y""")
def pct_change_guarded(t: Tables) -> DataFrame:
    y = days(t).groupBy(F.year("date").cast("bigint").alias("yr")).agg(
        F.count_if(F.col("weekday") >= 5).alias("a"), F.count_if((F.col("weekday") >= 5) & (F.col("PRCP") > 100)).alias("b"), F.count("*").alias("n")
    )
    return y.select("yr", text.pct_change("a", "n", 4).alias("change_pct"), text.pct_change("b", "n").cast("double").alias("zero_base"))


def driver_table(t: Tables) -> DataFrame:
    ready = calendar.with_holiday_flag(days(t), "date", 1995, 2001).withColumn("rain", F.col("rain_day").cast("double"))
    fit = regression.drivers(ready, y="ridership", categories=["weekday", "month"], flags=["rain", "TMAX_F", "is_holiday"])
    return fit


@query("ols_drivers")
def ols_drivers(t: Tables) -> DataFrame:
    """Daily drivers with category dummies; checked against numpy in the tests."""
    return driver_table(t)


@query("sort_drivers_abs")
def sort_drivers_abs(t: Tables) -> DataFrame:
    """The five strongest drivers by absolute effect."""
    return driver_table(t).select("driver", F.abs("effect").alias("abs_effect")).orderBy(F.desc("abs_effect"), "driver").limit(5)


@query("sig_stars", """SELECT c_mktsegment, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END AS sig, count(*) AS n
FROM (SELECT c_mktsegment, abs(c_acctbal) / 50000 AS p FROM customer) x GROUP BY 1, 2""")
def sig_stars(t: Tables) -> DataFrame:
    p = F.abs("c_acctbal") / 50_000
    return t.customer.groupBy("c_mktsegment", bands.significance_stars(p).alias("sig")).agg(F.count("*").alias("n"))


@query("temp_c_to_f", f"WITH {WX_SQL} SELECT date, round(tmax * 9 / 5 + 32, 6) AS tmax_f FROM wx WHERE tmax IS NOT NULL")
def temp_c_to_f(t: Tables) -> DataFrame:
    wide = m.pivot_mean(weather_long(t), "date", ["TMAX"]).filter("TMAX is not null")
    return wide.select("date", F.round(bands.celsius_to_fahrenheit("TMAX"), 6).alias("tmax_f"))


@query("rain_day", f"WITH {WX_SQL} SELECT prcp > 0 AS rain_day, count(*) AS days FROM wx GROUP BY 1")
def rain_day(t: Tables) -> DataFrame:
    wide = m.pivot_mean(weather_long(t), "date", ["TMAX", "TMIN", "PRCP"])
    return wide.groupBy(bands.rain_day("PRCP").alias("rain_day")).agg(F.count("*").alias("days"))
