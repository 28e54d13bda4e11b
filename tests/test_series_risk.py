from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import bands, calendar, text
from tallyloom.operators import regression, risk, series

T0 = datetime(2024, 1, 1)


def hourly(spark, values, key="a"):
    rows = [(key, T0 + timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def col(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_rolling_needs_a_full_window_and_excludes_today(spark):
    out = series.rolling_before(hourly(spark, [float(i) for i in range(30)]), keys=["k"], order="ts", value="v", n=24)
    means = col(out, "rolling_24_mean")
    assert means[:24] == [None] * 24 and means[24] == pytest.approx(11.5)


def test_interpolation_edges(spark):
    out = series.interpolate_time(hourly(spark, [None, 1.0, None, None, 4.0, None]), keys=["k"], order="ts", value="v")
    assert col(out, "v") == [None, 1.0, pytest.approx(2.0), pytest.approx(3.0), 4.0, 4.0]
    both = series.fill_forward_back(hourly(spark, [None, 1.0, None, 4.0]), keys=["k"], order="ts", values=["v"])
    assert col(both, "v") == [1.0, 1.0, 1.0, 4.0]


def test_ewm_is_recursive(spark):
    xs = [3.0, 1.0, 4.0, 1.0, 5.0]
    out = series.ewm(hourly(spark, xs), keys=["k"], order="ts", value="v", span=5, out="s")
    want, acc = [], None
    for x in xs:
        acc = x if acc is None else acc * 2 / 3 + x / 3
        want.append(acc)
    assert col(out, "s") == pytest.approx(want)


def test_ewm_carries_over_nulls_like_pandas(spark):
    xs = [None, 3.0, None, 4.0, None, None, 5.0]
    out = series.ewm(hourly(spark, xs), keys=["k"], order="ts", value="v", span=5, out="s")
    want = pd.Series(xs, dtype=float).ewm(span=5, adjust=False).mean()
    got = col(out, "s")
    assert got[0] is None and got[1:] == pytest.approx(want.tolist()[1:])


def test_correlations_over_shared_dates_in_blocks(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(7, 20))
    rows = [(f"s{i}", d, None if (i, d) == (2, 3) else float(values[i, d])) for i in range(7) for d in range(20)]
    df = spark.createDataFrame(rows, "ticker string, date int, ret double")
    want = np.corrcoef(np.delete(values, 3, axis=1))
    for block, span in ((2, 1024), (256, 1024), (2, 3)):
        got = {(r.a, r.b): r["corr"] for r in risk.correlations(df, block=block, span=span).collect()}
        assert len(got) == 21
        assert all(got[f"s{i}", f"s{j}"] == pytest.approx(want[i, j]) for i in range(7) for j in range(i + 1, 7))


def test_periodogram_finds_planted_cycles(spark):
    n = 24 * 7 * 4
    xs = [10 + 5 * np.sin(2 * np.pi * i / 24 + 0.3) + 2 * np.cos(2 * np.pi * i / 168) for i in range(n)]
    df = hourly(spark, [float(x) for x in xs])
    top = series.full_periodogram(df, keys=["k"], order="ts", value="v").filter("rank <= 2").orderBy("rank").collect()
    assert [r.label for r in top] == ["daily", "weekly"]
    assert top[0].power == pytest.approx(25.0, rel=1e-6) and top[1].power == pytest.approx(4.0, rel=1e-6)
    listed = {r.period_h: r.amplitude for r in series.periodogram(df, keys=["k"], order="ts", value="v", periods=[24.0, 168.0, 36.0]).collect()}
    assert listed[24.0] == pytest.approx(5.0, rel=1e-6) and listed[168.0] == pytest.approx(2.0, rel=1e-6) and listed[36.0] < 0.5
    parts = series.full_periodogram(df, keys=["k"], order="ts", value="v", top=2)
    feats = series.spectral_features(df, parts, keys=["k"], order="ts", top=2).orderBy("ts").collect()
    rebuilt = [10 + r.spectral_1_cos + r.spectral_2_cos for r in feats]
    assert rebuilt == pytest.approx(xs, abs=1e-6)


def test_mape_skips_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, p double")
    row = series.forecast_errors(df, "a", "p").first()
    assert row.mape == pytest.approx(50.0) and row.mae == pytest.approx(1.0)


def test_ar1_forecast_matches_recursion(spark):
    df = hourly(spark, [1.0, 2.0, 2.5, 3.5, 3.0, 4.0])
    model = series.ar1(df, keys=["k"], order="ts", value="v")
    m = model.first()
    x, want = m.last_value, []
    for _ in range(4):
        x = m.intercept + m.slope * x
        want.append(x)
    assert [r.forecast for r in series.ar1_forecast(model, ["k"], 4).orderBy("step").collect()] == pytest.approx(want)


def rets(spark, values, name="p"):
    return spark.createDataFrame([(name, date(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)], "portfolio string, date date, ret double")


def test_known_drawdown_and_first_day_loss(spark):
    assert risk.max_drawdown(rets(spark, [0.20, -0.50, 0.50])).first().max_drawdown == pytest.approx(-0.50)
    assert risk.max_drawdown(rets(spark, [-0.30, 0.10])).first().max_drawdown == pytest.approx(0.0)


def test_flat_returns_have_zero_ratios(spark):
    flat = rets(spark, [0.0, 0.0, 0.0])
    row = risk.sharpe_sortino(rets(spark, [0.01] * 5)).first()
    assert row.sortino == 0.0
    assert risk.sharpe_sortino(flat).first().sharpe == 0.0
    same = risk.tracking(flat, flat.select("date", F.col("ret").alias("bench"))).first()
    assert same.tracking_error == 0.0 and same.information_ratio == 0.0


def test_var_cvar_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    row = risk.var_cvar(rets(spark, [float(v) for v in x])).first()
    v = np.percentile(x, 5)
    assert row.var_95 == pytest.approx(v) and row.cvar_95 == pytest.approx(x[x <= v].mean()) and row.cvar_95 <= row.var_95


def test_portfolio_needs_every_member(spark):
    r = spark.createDataFrame([("A", date(2024, 1, 1), 0.1), ("B", date(2024, 1, 1), 0.3), ("A", date(2024, 1, 2), 0.1)], "ticker string, date date, ret double")
    w = spark.createDataFrame([("p", "A", 0.5), ("p", "B", 0.5)], "portfolio string, ticker string, weight double")
    out = risk.portfolio_returns(r, w).collect()
    assert len(out) == 1 and out[0].ret == pytest.approx(0.2)


def test_daily_scores_do_not_depend_on_how_the_events_are_dealt(spark, scratch_dir, monkeypatch):
    from tallyloom.plans import risk as plans
    from tallyloom.sources.tables import Tables

    rng = np.random.default_rng(5)
    kinds = {"view": 3.0, "click": 2.0, "signup": 1.0, "purchase": 0.5, "error": 1.0}
    rows = [(i, T0 + timedelta(minutes=i), i % 7, list(kinds)[rng.integers(5)], round(float(rng.exponential(50)), 2), '{"k": %d}' % rng.integers(100)) for i in range(420)]
    want = {}
    for _, _, user, kind, value, props in rows:
        x, w, n = want.get(f"U{user}", (0.0, 0.0, 0))
        want[f"U{user}"] = x + (value / 1000 - int(props[6:-1]) / 1000) * kinds[kind], w + kinds[kind], n + 1
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(f"{scratch_dir}/sf/events.parquet")
    got = {r.ticker: (r.weighted_sentiment, r.n_texts) for r in plans.daily_scores(Tables(spark, f"{scratch_dir}/sf")).collect()}
    assert got == {k: (x / w, n) for k, (x, w, n) in want.items()}
    monkeypatch.setattr(risk, "SCORE_BLOCK", 50)
    cut = {r.ticker: (r.weighted_sentiment, r.n_texts) for r in plans.daily_scores(Tables(spark, f"{scratch_dir}/sf")).collect()}
    assert cut == {k: (pytest.approx(x / w), n) for k, (x, w, n) in want.items()}


def zero_price_events(spark, folder):
    """Twelve users on four working days; some earn nothing on a day, one on two days in a row."""
    free = {(3, 0), (3, 1), (8, 1), (9, 2), (0, 1)}
    rows = []
    for day in range(4):
        for user in range(12):
            value = 0.0 if (user, day) in free else round(10.0 + 7 * user + 13 * day + user * day % 5, 2)
            rows.append((len(rows), T0 + timedelta(days=day, minutes=user), user, "view", value, '{"k": %d}' % (user * 37 % 100)))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/events.parquet")


def equals_its_sql(spark, folder, name):
    import duckdb

    from tallyloom.plans import risk as plans  # noqa: F401
    from tallyloom.plans.registry import oracle_sql, queries

    zero_price_events(spark, folder)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(oracle_sql()[name]).fetchall()}
    got = {r[0]: tuple(r)[1:] for r in queries()[name](spark, folder).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}
    return want


def test_sentiment_factor_counts_the_names_after_a_price_of_zero(spark, scratch_dir):
    want = equals_its_sql(spark, f"{scratch_dir}/sf", "sentiment_factor")
    assert [n for n, _ in want.values()] == [12, 12] and not np.isfinite([f for _, f in want.values()]).all()


def test_returns_after_a_price_of_zero(spark):
    rows = [("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 5.0), ("a", 5, None), ("a", 6, 1.0)]
    out = series.pct_return(spark.createDataFrame(rows, "k string, i int, p double"), keys=["k"], order="i", price="p")
    assert [repr(r.ret) for r in out.orderBy("i").collect()] == ["None", "-1.0", "nan", "inf", "None", "None"]


def test_win_quintile_ls_counts_the_names_after_a_price_of_zero(spark, scratch_dir):
    want = equals_its_sql(spark, f"{scratch_dir}/sf", "win_quintile_ls")
    assert [n for n, _ in want.values()] == [12, 12, 12] and not np.isfinite([f for _, f in want.values()]).all()


def test_weighted_scores_and_cross_section(spark):
    s = spark.createDataFrame([(date(2024, 1, 1), "AAPL", "edgar", 0.8), (date(2024, 1, 1), "AAPL", "news", 0.6), (date(2024, 1, 1), "AAPL", "blog", 0.72)], "date date, ticker string, source string, composite double")
    row = risk.weighted_scores(s).first()
    assert row.weighted_sentiment == pytest.approx((0.8 * 3 + 0.6 * 2 + 0.72) / 6) and row.n_texts == 3
    five = spark.createDataFrame([(1, float(i)) for i in range(5)] + [(2, 1.0), (2, 1.0)], "date int, v double")
    z = [r.z for r in series.cross_z(five, date="date", value="v").filter("date = 1").collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    assert {r.z for r in series.cross_z(five, date="date", value="v").filter("date = 2").collect()} == {0.0}


def hac_reference(y, x, lags):
    design = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(design.T @ design)
    beta = inv @ design.T @ y
    u = design * (y - design @ beta)[:, None]
    s = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        s += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inv @ s @ inv)), beta


def factor_frame(spark, n=150):
    rng = np.random.default_rng(11)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.1 + 1.2 * x1 - 0.5 * x2 + rng.normal(scale=0.3, size=n)
    rows = [("p", date(2024, 1, 1) + timedelta(days=i), float(y[i]), float(x1[i]), float(x2[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k string, d date, y double, x1 double, x2 double"), y, np.column_stack([x1, x2])


def test_hac_regression_against_numpy(spark):
    df, y, x = factor_frame(spark)
    fit = {r.term: r for r in regression.ols(df, keys=["k"], y="y", xs=["x1", "x2"], order="d", hac_lags=5).collect()}
    beta, se, _ = hac_reference(y, x, 5)
    for i, name in enumerate(("const", "x1", "x2")):
        assert fit[name].coef == pytest.approx(beta[i], abs=1e-9) and fit[name].se == pytest.approx(se[i], rel=1e-8)
    assert abs(fit["x1"].coef - 1.2) < 0.3


def test_incremental_f_equals_ssr_form(spark):
    df, y, x = factor_frame(spark)

    def ssr(cols):
        design = np.column_stack([np.ones(len(y)), *cols])
        return ((y - design @ np.linalg.lstsq(design, y, rcond=None)[0]) ** 2).sum()

    a, b = ssr([x[:, 0]]), ssr([x[:, 0], x[:, 1]])
    row = regression.incremental_f(df, keys=["k"], y="y", base=["x1"], added="x2").first()
    assert row.f_stat == pytest.approx((a - b) / (b / (len(y) - 3)), rel=1e-8) and row.delta_r2 >= 0
    assert 0 <= row.f_p < 1e-6


def test_student_tail_values():
    # Textbook quantiles: t(10) at 2.228 and t(1) at 1 (a quarter on each side).
    assert regression.student_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert regression.student_p(1.0, 1) == pytest.approx(0.5, abs=1e-10)
    assert regression.normal_p(1.959963985) == pytest.approx(0.05, abs=1e-8)


def test_rolling_ols_excludes_the_labelled_row(spark):
    df, y, x = factor_frame(spark, 60)
    out = regression.rolling_ols(df, keys=["k"], order="d", y="y", xs=["x1", "x2"], window=40).orderBy("d").collect()
    assert len(out) == 20
    design = np.column_stack([np.ones(40), x[:40]])
    want = np.linalg.lstsq(design, y[:40], rcond=None)[0]
    assert out[0].x1_beta == pytest.approx(want[1], abs=1e-9) and out[0].alpha == pytest.approx(want[0] * 252, abs=1e-7)


def test_drivers_against_numpy(spark):
    rng = np.random.default_rng(2)
    day, flag = rng.integers(0, 3, 300), rng.integers(0, 2, 300)
    y = 5 + np.array([0, 2, -1])[day] + 3 * flag + rng.normal(scale=0.1, size=300)
    df = spark.createDataFrame([(float(a), int(b), int(c)) for a, b, c in zip(y, day, flag)], "y double, day int, flag int")
    got = {r.driver: r for r in regression.drivers(df, y="y", categories=["day"], flags=["flag"]).collect()}
    design = np.column_stack([np.ones(300), day == 1, day == 2, flag]).astype(float)
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got[k].effect for k in ("day[1]", "day[2]", "flag")] == pytest.approx(list(want[1:]), abs=1e-6)
    assert got["flag"].sig == "***"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_bands_are_right_closed_and_null_safe(spark):
    lit = F.lit
    assert [one(spark, bands.dti_band(lit(v))) for v in (10.0, 10.1, 20.0, 30.0, 31.0)] == ["low", "medium", "medium", "high", "very_high"]
    assert one(spark, bands.income_band(lit(0.0))) is None and one(spark, bands.income_band(lit(40000.0))) == "<40k"
    assert one(spark, bands.temp_band(lit(None).cast("double"))) is None
    assert [one(spark, bands.temp_band(lit(v))) for v in (54.9, 55.0, 75.0, 75.1)] == ["Cold (<55F)", "Mild (55-75F)", "Mild (55-75F)", "Warm (>75F)"]
    labels = [one(spark, bands.timeliness(lit(d))[0]) for d in (11, 10, 3, 0, -3, -10, -11)]
    assert labels == [">10d early", "4-10d early", "0-3d early", "0-3d early", "1-3d late", "4-10d late", ">10d late"]
    assert one(spark, bands.weather_condition(lit(44))) == "other"
    assert one(spark, bands.grade_number(lit(None).cast("string"))) == 4


def test_text_helpers(spark):
    lit = F.lit
    assert one(spark, text.zero_pad(lit("123456"), 5)) == "123456" and one(spark, text.zero_pad(lit(12), 5)) == "00012"
    assert one(spark, text.employment_years(lit("< 1 year"))) == 0.0 and one(spark, text.employment_years(lit("10+ years"))) == 10.0
    assert one(spark, text.percent_text(lit("13.56%"))) == 13.56 and one(spark, text.leading_number(lit(" 36 months"))) == 36.0
    assert one(spark, text.numeric_or_null(lit("abc"))) is None
    assert one(spark, text.joined_key(lit("a"), lit(None).cast("string"))) is None
    assert one(spark, text.guarded_ratio(lit(1.0), lit(0.0))) is None


def test_holidays_are_observed(spark):
    days = {str(r.holiday): r.name for r in calendar.federal_holidays(spark, 2020, 2022).collect()}
    assert days["2020-07-03"] == "Independence Day" and days["2021-12-24"] == "Christmas Day"
    assert days["2022-06-20"].startswith("Juneteenth") and "2020-06-19" not in days
    assert days["2021-11-25"] == "Thanksgiving Day" and days["2022-05-30"] == "Memorial Day"
