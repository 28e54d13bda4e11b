"""Hourly and daily series: features, gaps, spectra, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import calendar
from tallyloom.operators import series as s
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables

KEY, TS = ["event_type"], "ts"


def hourly(t: Tables) -> DataFrame:
    """Hourly totals per event type; hours without events have no row."""
    total = F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
    return s.to_series(t.events, KEY, "ts", "hour", {"value": total})


def regular(t: Tables) -> DataFrame:
    """The hourly series with every hour present and gaps null."""
    return s.fill_ticks(hourly(t), KEY, TS, "hour")


def filled(t: Tables) -> DataFrame:
    return regular(t).na.fill(0.0, ["value"])


def daily_orders(t: Tables) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double")
    return s.to_series(t.orders, ["o_orderstatus"], "o_orderdate", "day", {"value": total})


HOURLY_SQL = """hourly AS (SELECT event_type, date_trunc('hour', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS value
  FROM events GROUP BY 1, 2),
ticks AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY 1),
regular AS (SELECT ticks.event_type, ticks.ts, value FROM ticks LEFT JOIN hourly USING (event_type, ts)),
filled AS (SELECT event_type, ts, coalesce(value, 0) AS value FROM regular)"""
DAILY_SQL = """daily AS (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)"""


@query("series_hourly", f"WITH {HOURLY_SQL} SELECT * FROM regular")
def series_hourly(t: Tables) -> DataFrame:
    return regular(t)


@query("calendar_features", """SELECT CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
  CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, count(*) AS n FROM events GROUP BY 1, 2, 3, 4""")
def calendar_features(t: Tables) -> DataFrame:
    names = calendar.calendar_features("ts")
    return t.events.withColumns(names).groupBy(*names).agg(F.count("*").alias("n"))


HOLIDAY_SQL = """years AS (SELECT unnest(range(1995, 2002)) AS y),
fixed AS (SELECT make_date(y, m, d) AS raw FROM years, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) v(m, d)),
days AS (SELECT CAST(d AS DATE) AS d FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2002-01-01', INTERVAL 1 DAY) r(d)),
nth AS (SELECT d, month(d) AS m, isodow(d) AS w, row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d) AS k,
  row_number() OVER (PARTITION BY year(d), month(d), isodow(d) ORDER BY d DESC) AS back FROM days),
hol AS (SELECT CASE isodow(raw) WHEN 6 THEN raw - 1 WHEN 7 THEN raw + 1 ELSE raw END AS d FROM fixed
  UNION SELECT d FROM nth WHERE (m = 1 AND w = 1 AND k = 3) OR (m = 2 AND w = 1 AND k = 3) OR (m = 5 AND w = 1 AND back = 1)
    OR (m = 9 AND w = 1 AND k = 1) OR (m = 10 AND w = 1 AND k = 2) OR (m = 11 AND w = 4 AND k = 4))"""


@query("federal_holidays", f"""WITH {HOLIDAY_SQL}
SELECT CAST(o_orderdate AS DATE) AS day, CAST(hol.d IS NOT NULL AS INTEGER) AS is_holiday, count(*) AS orders
FROM orders LEFT JOIN hol ON hol.d = CAST(o_orderdate AS DATE) GROUP BY 1, 2""")
def federal_holidays(t: Tables) -> DataFrame:
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"))
    return calendar.with_holiday_flag(daily, "day", 1995, 2001)


@query("win_lags", f"""WITH {HOURLY_SQL}
SELECT event_type, ts, value, lag(value, 1) OVER w AS lag_1, lag(value, 24) OVER w AS lag_24, lag(value, 168) OVER w AS lag_168
FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY ts)""")
def win_lags(t: Tables) -> DataFrame:
    return s.lags(filled(t), keys=KEY, order=TS, value="value", steps=[1, 24, 168])


@query("win_rolling_stats", f"""WITH {HOURLY_SQL}
SELECT event_type, ts, CASE WHEN count(value) OVER w = 24 THEN round(avg(value) OVER w, 6) END AS rolling_24_mean,
  CASE WHEN count(value) OVER w = 24 THEN round(stddev_samp(value) OVER w, 5) END AS rolling_24_std
FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def win_rolling_stats(t: Tables) -> DataFrame:
    out = s.rolling_before(filled(t), keys=KEY, order=TS, value="value", n=24)
    return out.select(
        "event_type", "ts", F.round("rolling_24_mean", 6).alias("rolling_24_mean"), F.round("rolling_24_std", 5).alias("rolling_24_std")
    )


@query("win_rolling_mean", f"""WITH {HOURLY_SQL}
SELECT event_type, ts, CASE WHEN count(value) OVER w = 24 THEN round(avg(value) OVER w, 6) END AS rolling_mean
FROM filled WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def win_rolling_mean(t: Tables) -> DataFrame:
    out = s.rolling_mean(filled(t), keys=KEY, order=TS, value="value", n=24)
    return out.select("event_type", "ts", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("win_ffill_bfill", f"""WITH {HOURLY_SQL}
SELECT event_type, ts, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM regular""")
def win_ffill_bfill(t: Tables) -> DataFrame:
    return s.fill_forward_back(regular(t), keys=KEY, order=TS, values=["value"])


@query("win_interpolate_time", f"""WITH {HOURLY_SQL},
m AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER b AS t0,
  first_value(value IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t1 FROM regular
  WINDOW b AS (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING),
    a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, ts, round(CASE WHEN value IS NOT NULL OR v1 IS NULL THEN coalesce(value, v0)
  ELSE v0 + (v1 - v0) * (epoch(ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 6) AS value FROM m""")
def win_interpolate_time(t: Tables) -> DataFrame:
    out = s.interpolate_time(regular(t), keys=KEY, order=TS, value="value")
    return out.select("event_type", "ts", F.round("value", 6).alias("value"))


@query("downsample_every_n", f"""WITH {HOURLY_SQL}
SELECT event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM filled) x WHERE rn % 6 = 1""")
def downsample_every_n(t: Tables) -> DataFrame:
    return s.every_nth(filled(t), keys=KEY, order=TS, n=6)


@query("dedupe_first_by_key", """SELECT event_type, ts, event_id, value FROM (
  SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events) x WHERE rn = 1""")
def dedupe_first_by_key(t: Tables) -> DataFrame:
    readings = t.events.select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return s.dedupe_series(readings, KEY, TS, ["event_id"])


HEAT = ", ".join(f"round(avg(CASE WHEN hour(ts) = {h} THEN value END), 6) AS h{h}" for h in range(24))


@query("agg_heatmap_dow_hour", f"WITH {HOURLY_SQL} SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, {HEAT} FROM filled GROUP BY 1")
def agg_heatmap_dow_hour(t: Tables) -> DataFrame:
    hours = filled(t).withColumn("h", F.hour("ts"))
    grid = hours.groupBy(F.weekday("ts").alias("day_of_week")).pivot("h", list(range(24))).agg(F.avg("value"))
    return grid.select("day_of_week", *[F.round(F.col(str(h)), 6).alias(f"h{h}") for h in range(24)])


@query("ts_split", f"""WITH {DAILY_SQL}, c AS (SELECT max(day) - INTERVAL 3 MONTH AS cut FROM daily)
SELECT CASE WHEN day < cut THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM daily, c GROUP BY 1""")
def ts_split(t: Tables) -> DataFrame:
    parts = s.temporal_split(daily_orders(t), "ts", 3)
    counted = [
        p.agg(F.count("*").alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")).select(
            F.lit(name).alias("part"), "n", "first_day", "last_day"
        )
        for name, p in zip(("train", "test"), parts)
    ]
    return counted[0].unionByName(counted[1])


NAIVE_SQL = f"""{HOURLY_SQL}, lagged AS (SELECT event_type, ts, value, lag(value, 168) OVER (PARTITION BY event_type ORDER BY ts) AS lag_168 FROM filled)"""


@query("ts_naive168", f"WITH {NAIVE_SQL} SELECT event_type, ts, value, lag_168 AS predicted FROM lagged WHERE lag_168 IS NOT NULL")
def ts_naive168(t: Tables) -> DataFrame:
    lagged = s.lags(filled(t), keys=KEY, order=TS, value="value", steps=[168])
    return lagged.filter("lag_168 is not null").withColumnRenamed("lag_168", "predicted")


@query("ml_reg_metrics", f"""WITH {NAIVE_SQL}
SELECT event_type, count(*) AS n, round(sqrt(avg((value - lag_168) * (value - lag_168))), 6) AS rmse, round(avg(abs(value - lag_168)), 6) AS mae,
  round(100 * avg(CASE WHEN value <> 0 THEN abs((value - lag_168) / value) END), 6) AS mape FROM lagged WHERE lag_168 IS NOT NULL GROUP BY 1""")
def ml_reg_metrics(t: Tables) -> DataFrame:
    lagged = s.lags(filled(t), keys=KEY, order=TS, value="value", steps=[168])
    out = s.forecast_errors(lagged, "value", "lag_168", "event_type")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "mape")])


@query("ts_residuals", f"""WITH {NAIVE_SQL}, r AS (SELECT value - lag_168 AS residual FROM lagged WHERE lag_168 IS NOT NULL),
b AS (SELECT min(residual) AS a, max(residual) AS z FROM r)
SELECT CAST(least(59, floor((residual - a) / ((z - a) / 60))) AS INTEGER) AS bin, count(*) AS n FROM r, b GROUP BY 1""")
def ts_residuals(t: Tables) -> DataFrame:
    lagged = s.lags(filled(t), keys=KEY, order=TS, value="value", steps=[168])
    return s.histogram(lagged.withColumn("residual", F.col("value") - F.col("lag_168")), "residual", 60).select("bin", "n")


PERIODS = [12.0, 24.0, 48.0, 168.0]
PERIOD_SQL = f"""{HOURLY_SQL}, st AS (SELECT event_type, min(ts) AS t0, avg(value) AS mu, count(*) AS n FROM filled GROUP BY 1),
pg AS (SELECT f.event_type, p AS period_h, n, sum((value - mu) * cos(2 * pi() * (epoch(ts) - epoch(t0)) / 3600 / p)) AS c,
  sum((value - mu) * sin(2 * pi() * (epoch(ts) - epoch(t0)) / 3600 / p)) AS s
  FROM filled f JOIN st USING (event_type), (VALUES (12.0::DOUBLE), (24.0), (48.0), (168.0)) v(p) GROUP BY 1, 2, 3)"""


@query("ts_periodogram", f"""WITH {PERIOD_SQL}
SELECT event_type, period_h, round(2 * sqrt(c * c + s * s) / n, 6) AS amplitude,
  CASE period_h WHEN 12 THEN 'semidaily' WHEN 24 THEN 'daily' WHEN 168 THEN 'weekly' ELSE 'period_48h' END AS label FROM pg""")
def ts_periodogram(t: Tables) -> DataFrame:
    out = s.periodogram(filled(t), keys=KEY, order=TS, value="value", periods=PERIODS)
    return out.select("event_type", "period_h", F.round("amplitude", 6).alias("amplitude"), "label")


def components(t: Tables) -> DataFrame:
    return s.full_periodogram(filled(t), keys=KEY, order=TS, value="value")


DFT_SQL = f"""{HOURLY_SQL}, st AS (SELECT event_type, min(ts) AS t0, avg(value) AS mu, count(*) AS n FROM filled GROUP BY 1),
dft AS (SELECT f.event_type, k, max(n) AS n, sum((value - mu) * cos(2 * pi() * k * (epoch(ts) - epoch(t0)) / 3600 / n)) AS c,
  sum((value - mu) * sin(2 * pi() * k * (epoch(ts) - epoch(t0)) / 3600 / n)) AS s
  FROM filled f JOIN st USING (event_type), range(1, 100000) r(k) WHERE k <= n / 6.0 AND n / k <= 10000 GROUP BY 1, 2),
bins AS (SELECT *, 2 * sqrt(c * c + s * s) / n AS amplitude, row_number() OVER (PARTITION BY event_type ORDER BY c * c + s * s DESC) AS rank FROM dft)"""


@query("ts_periodogram_full", f"""WITH {DFT_SQL}
SELECT event_type, CAST(rank AS INTEGER) AS rank, round(n / k, 6) AS period_h, round(amplitude * amplitude, 5) AS power FROM bins WHERE rank <= 10""")
def ts_periodogram_full(t: Tables) -> DataFrame:
    """Top ten bins of the Fourier transform per series."""
    return components(t).select("event_type", "rank", F.round("period_h", 6).alias("period_h"), F.round("power", 5).alias("power"))


SPECTRAL_COLS = ", ".join(
    f"round(max(CASE WHEN rank = {r} THEN amplitude * {fn}(2 * pi() * k * (epoch(ts) - epoch(t0)) / 3600 / b.n + atan2(-s, c)) END), 4) AS spectral_{r}_{fn}"
    for r in (1, 2, 3)
    for fn in ("sin", "cos")
)


@query("ts_spectral_features", f"""WITH {DFT_SQL}
SELECT event_type, ts, max(value) AS value, {SPECTRAL_COLS} FROM filled JOIN st USING (event_type) JOIN bins b USING (event_type)
WHERE rank <= 3 GROUP BY 1, 2""")
def ts_spectral_features(t: Tables) -> DataFrame:
    """Sine and cosine features of the top three components."""
    base = filled(t)
    parts = s.full_periodogram(base, keys=KEY, order=TS, value="value", top=3)
    out = s.spectral_features(base, parts, keys=KEY, order=TS, top=3)
    names = [c for c in out.columns if c.startswith("spectral_")]
    return out.select("event_type", "ts", "value", *[F.round(c, 4).alias(c) for c in names])


@query("join_spectral_left", f"""WITH {HOURLY_SQL}
SELECT r.event_type, r.ts, coalesce(last_value(h.value IGNORE NULLS) OVER (PARTITION BY r.event_type ORDER BY r.ts ROWS UNBOUNDED PRECEDING),
  first_value(h.value IGNORE NULLS) OVER (PARTITION BY r.event_type ORDER BY r.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS feature
FROM filled r LEFT JOIN (SELECT * FROM hourly WHERE value > 100) h USING (event_type, ts)""")
def join_spectral_left(t: Tables) -> DataFrame:
    features = hourly(t).filter("value > 100").withColumnRenamed("value", "feature")
    joined = filled(t).drop("value").join(features, ["event_type", "ts"], "left")
    return s.fill_forward_back(joined, keys=KEY, order=TS, values=["feature"])


AR_SQL = f"""{HOURLY_SQL}, pairs AS (SELECT event_type, ts, value, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS prev FROM filled),
ar AS (SELECT event_type, regr_slope(value, prev) AS b, regr_intercept(value, prev) AS a, arg_max(value, ts) AS x0 FROM pairs GROUP BY 1)"""


@query("ts_ar1", f"WITH {AR_SQL} SELECT event_type, round(b, 8) AS slope, round(a, 6) AS intercept, x0 AS last_value FROM ar")
def ts_ar1(t: Tables) -> DataFrame:
    model = s.ar1(filled(t), keys=KEY, order=TS, value="value")
    return model.select("event_type", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), "last_value")


@query("ts_ar1_forecast", f"""WITH RECURSIVE {AR_SQL},
fc AS (SELECT event_type, 1 AS step, a + b * x0 AS x, a, b FROM ar UNION ALL SELECT event_type, step + 1, a + b * x, a, b FROM fc WHERE step < 5)
SELECT event_type, step, round(x, 6) AS forecast FROM fc""")
def ts_ar1_forecast(t: Tables) -> DataFrame:
    model = s.ar1(filled(t), keys=KEY, order=TS, value="value")
    return s.ar1_forecast(model, KEY, 5).select("event_type", "step", F.round("forecast", 6).alias("forecast"))


@query("ts_sequences", f"""WITH {HOURLY_SQL}, q AS (SELECT event_type, ts, value, list(value) OVER (PARTITION BY event_type ORDER BY ts
  ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS sequence FROM filled)
SELECT event_type, ts, value, sequence FROM q WHERE len(sequence) = 10""")
def ts_sequences(t: Tables) -> DataFrame:
    return s.sequences(filled(t), keys=KEY, order=TS, value="value", n=10)
