"""Return, risk, factor and sentiment queries.

Nations play tickers: their monthly order value is the price. Regions are portfolios
of their nations. Events are scored texts: the user is the ticker, the type the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import regression, risk, series
from tallyloom.plans.registry import query
from tallyloom.sources.tables import Tables


def prices(t: Tables) -> DataFrame:
    """``(ticker, date, price)``: order value by customer nation and month."""
    # Join first: grouping by customer removes next to nothing and would shuffle the orders once more.
    orders = t.orders.select("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_totalprice").cast("decimal(12,2)").alias("p"))
    owners = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    by_nation = orders.join(owners, "o_custkey").groupBy("c_nationkey", "date").agg(F.sum("p").cast("double").alias("price"))
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("ticker"))
    return by_nation.join(names, "c_nationkey").select("ticker", "date", "price")


def returns(t: Tables) -> DataFrame:
    return t.once("returns", _returns)


def _returns(t: Tables) -> DataFrame:
    full = series.pct_return(prices(t), keys=["ticker"], order="date", price="price")
    return series.complete_dates(full, key="ticker", date="date", value="ret").select("ticker", "date", "price", "ret")


def weights(t: Tables) -> DataFrame:
    """Equal weights of the nations in each region."""
    sizes = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("m"))
    joined = t.nation.join(sizes, "n_regionkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("portfolio"), F.col("n_name").alias("ticker"), (F.lit(1.0) / F.col("m")).alias("weight"))


def portfolios(t: Tables) -> DataFrame:
    return risk.portfolio_returns(returns(t), weights(t))


def benchmark(t: Tables) -> DataFrame:
    return returns(t).groupBy("date").agg(F.avg("ret").alias("bench"))


def factors(t: Tables) -> DataFrame:
    """``(date, mkt_rf, smb, hml, rf)`` from the market mean and two nation spreads."""

    def of(name: str):
        return F.max(F.when(F.col("ticker") == name, F.col("ret")))

    rf = F.lit(0.001)
    return returns(t).groupBy("date").agg(
        (F.avg("ret") - rf).alias("mkt_rf"),
        (of("NATION_1") - of("NATION_2")).alias("smb"),
        (of("NATION_3") - of("NATION_4")).alias("hml"),
        F.lit(0.001).alias("rf"),
    )


def with_factors(t: Tables) -> DataFrame:
    joined = portfolios(t).join(factors(t), "date").na.drop()
    return joined.withColumn("excess", F.col("ret") - F.col("rf"))


RET_SQL = """px AS (SELECT n_name AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
    CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS price
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
rt0 AS (SELECT *, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM px),
rt AS (SELECT * FROM rt0 WHERE ret IS NOT NULL AND date IN (SELECT date FROM rt0 WHERE ret IS NOT NULL GROUP BY 1
  HAVING count(*) = (SELECT count(DISTINCT ticker) FROM px))),
wt AS (SELECT r_name AS portfolio, n_name AS ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY r_name) AS weight FROM nation JOIN region ON r_regionkey = n_regionkey),
pf AS (SELECT portfolio, date, sum(ret * weight) AS ret FROM rt JOIN wt USING (ticker) GROUP BY 1, 2),
bm AS (SELECT date, avg(ret) AS bench FROM rt GROUP BY 1),
fc AS (SELECT date, avg(ret) - 0.001 AS mkt_rf, max(CASE WHEN ticker = 'NATION_1' THEN ret END) - max(CASE WHEN ticker = 'NATION_2' THEN ret END) AS smb,
  max(CASE WHEN ticker = 'NATION_3' THEN ret END) - max(CASE WHEN ticker = 'NATION_4' THEN ret END) AS hml, 0.001::DOUBLE AS rf FROM rt GROUP BY 1),
cum AS (SELECT portfolio, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio ORDER BY date)) AS c FROM pf),
dd AS (SELECT *, c / max(c) OVER (PARTITION BY portfolio ORDER BY date) - 1 AS drawdown FROM cum),
vr AS (SELECT portfolio, quantile_cont(ret, 0.05) AS v FROM pf GROUP BY 1)"""
RF = "(0.05 / 252)"
SHARPE_SQL = f"""sh AS (SELECT portfolio, (avg(ret) - {RF}) * 252 / (stddev_samp(ret) * sqrt(252)) AS sharpe,
  (avg(ret) - {RF}) * 252 / (sqrt(avg(CASE WHEN ret < {RF} THEN pow(ret - {RF}, 2) END)) * sqrt(252)) AS sortino FROM pf GROUP BY 1),
te AS (SELECT portfolio, stddev_samp(ret - bench) * sqrt(252) AS te, avg(ret - bench) * 252 / (stddev_samp(ret - bench) * sqrt(252)) AS ir
  FROM pf JOIN bm USING (date) GROUP BY 1),
ab AS (SELECT portfolio, regr_intercept(ret - {RF}, bench - {RF}) * 252 AS alpha, regr_slope(ret - {RF}, bench - {RF}) AS beta FROM pf JOIN bm USING (date) GROUP BY 1),
cv AS (SELECT portfolio, max(v) AS v, avg(CASE WHEN ret <= v THEN ret END) AS cv FROM pf JOIN vr USING (portfolio) GROUP BY 1),
mx AS (SELECT portfolio, min(drawdown) AS mdd FROM dd GROUP BY 1)"""


def rounded(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


@query("win_pct_change", f"WITH {RET_SQL} SELECT ticker, date, round(ret, 9) AS ret FROM rt")
def win_pct_change(t: Tables) -> DataFrame:
    return rounded(returns(t).select("ticker", "date", "ret"), 9, "ticker", "date")


@query("pf_returns", f"WITH {RET_SQL} SELECT portfolio, date, round(ret, 9) AS ret FROM pf")
def pf_returns(t: Tables) -> DataFrame:
    return rounded(portfolios(t), 9, "portfolio", "date")


@query("kpi_return_vol", f"WITH {RET_SQL} SELECT portfolio, round(avg(ret) * 252, 6) AS ann_return, round(stddev_samp(ret) * sqrt(252), 6) AS ann_vol FROM pf GROUP BY 1")
def kpi_return_vol(t: Tables) -> DataFrame:
    return rounded(risk.return_vol(portfolios(t)), 6, "portfolio")


@query("kpi_sharpe", f"WITH {RET_SQL}, {SHARPE_SQL} SELECT portfolio, round(sharpe, 6) AS sharpe FROM sh")
def kpi_sharpe(t: Tables) -> DataFrame:
    return rounded(risk.sharpe_sortino(portfolios(t)).select("portfolio", "sharpe"), 6, "portfolio")


@query("kpi_sortino", f"WITH {RET_SQL}, {SHARPE_SQL} SELECT portfolio, round(sortino, 6) AS sortino FROM sh")
def kpi_sortino(t: Tables) -> DataFrame:
    return rounded(risk.sharpe_sortino(portfolios(t)).select("portfolio", "sortino"), 6, "portfolio")


@query("win_cumreturn", f"WITH {RET_SQL} SELECT portfolio, date, round(c * 100, 2) AS cumulative FROM cum")
def win_cumreturn(t: Tables) -> DataFrame:
    grown = series.cumulative_return(portfolios(t), keys=["portfolio"], order="date", ret="ret")
    return grown.select("portfolio", "date", F.round(F.col("cumulative") * 100, 2).alias("cumulative"))


@query("win_drawdown", f"WITH {RET_SQL} SELECT portfolio, date, round(drawdown, 8) + 0.0 AS drawdown FROM dd")
def win_drawdown(t: Tables) -> DataFrame:
    fall = series.drawdown(portfolios(t), keys=["portfolio"], order="date", ret="ret")
    return fall.select("portfolio", "date", F.round("drawdown", 8).alias("drawdown"))


@query("kpi_max_drawdown", f"WITH {RET_SQL} SELECT portfolio, round(min(drawdown), 8) AS max_drawdown FROM dd GROUP BY 1")
def kpi_max_drawdown(t: Tables) -> DataFrame:
    return rounded(risk.max_drawdown(portfolios(t)), 8, "portfolio")


@query("kpi_var_cvar", f"WITH {RET_SQL}, {SHARPE_SQL} SELECT portfolio, round(v, 8) AS var_95, round(cv, 8) AS cvar_95 FROM cv")
def kpi_var_cvar(t: Tables) -> DataFrame:
    return rounded(risk.var_cvar(portfolios(t)), 8, "portfolio")


@query("kpi_te_ir", f"WITH {RET_SQL}, {SHARPE_SQL} SELECT portfolio, round(te, 6) AS tracking_error, round(ir, 6) AS information_ratio FROM te")
def kpi_te_ir(t: Tables) -> DataFrame:
    return rounded(risk.tracking(portfolios(t), benchmark(t)), 6, "portfolio")


@query("kpi_regime", f"""WITH {RET_SQL}, al AS (SELECT portfolio, ret, smb FROM pf JOIN fc USING (date)),
md AS (SELECT portfolio, median(smb) AS mid FROM al GROUP BY 1),
sp AS (SELECT portfolio, CASE WHEN smb >= mid THEN 'high' ELSE 'low' END AS regime, ret FROM al JOIN md USING (portfolio)),
v AS (SELECT portfolio, regime, count(*) AS days, quantile_cont(ret, 0.05) AS var_95 FROM sp GROUP BY 1, 2)
SELECT portfolio, regime, max(days) AS days, CASE WHEN max(days) > 20 THEN round(max(var_95), 8) END AS var_95,
  CASE WHEN max(days) > 20 THEN round(avg(CASE WHEN ret <= var_95 THEN ret END), 8) END AS cvar_95 FROM sp JOIN v USING (portfolio, regime) GROUP BY 1, 2""")
def kpi_regime(t: Tables) -> DataFrame:
    factor = factors(t).select("date", F.col("smb").alias("factor"))
    out = risk.regime_risk(portfolios(t), factor)
    return out.select("portfolio", "regime", "days", F.round("var_95", 8).alias("var_95"), F.round("cvar_95", 8).alias("cvar_95"))


@query("kpi_stress", f"""WITH {RET_SQL}, b AS (SELECT portfolio, regr_slope(ret, smb) AS beta, stddev_samp(smb) * sqrt(252) AS vol FROM pf JOIN fc USING (date) GROUP BY 1)
SELECT portfolio, shock, round(beta * shock * vol / sqrt(252), 8) AS impact FROM b, (VALUES (-2.0::DOUBLE), (-1.0), (1.0), (2.0)) s(shock)""")
def kpi_stress(t: Tables) -> DataFrame:
    betas = portfolios(t).join(factors(t), "date").groupBy("portfolio").agg(
        F.regr_slope("ret", "smb").alias("beta"), (F.stddev_samp("smb") * F.sqrt(F.lit(252))).alias("factor_vol")
    )
    return risk.stress_impact(betas, [-2, -1, 1, 2]).select("portfolio", "shock", F.round("impact", 8).alias("impact"))


KPI_COLS = "portfolio, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(mdd, 6) AS max_drawdown, round(v, 6) AS var_95, round(cv, 6) AS cvar_95, round(ir, 6) AS information_ratio"
KPI_SQL = f"{RET_SQL}, {SHARPE_SQL}, kp AS (SELECT {KPI_COLS} FROM ab JOIN sh USING (portfolio) JOIN mx USING (portfolio) JOIN cv USING (portfolio) JOIN te USING (portfolio))"


@query("kpi_all", f"WITH {KPI_SQL} SELECT * FROM kp")
def kpi_all(t: Tables) -> DataFrame:
    return rounded(risk.all_kpis(portfolios(t), benchmark(t)), 6, "portfolio")


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
COMPARE_COLS = ", ".join(f"max(CASE WHEN portfolio = '{r}' THEN value END) AS \"{r}\"" for r in REGIONS)


@query("kpi_compare", f"""WITH {KPI_SQL}, lg AS (UNPIVOT kp ON COLUMNS(* EXCLUDE portfolio) INTO NAME metric VALUE value)
SELECT metric, {COMPARE_COLS} FROM lg GROUP BY 1""")
def kpi_compare(t: Tables) -> DataFrame:
    kpis = rounded(risk.all_kpis(portfolios(t), benchmark(t)), 6, "portfolio")
    return risk.compare(kpis, REGIONS)


@query("win_rolling_beta", f"""WITH {RET_SQL}
SELECT portfolio, date, round(CASE WHEN count(*) OVER w = 12 THEN covar_samp(ret, bench) OVER w / var_samp(bench) OVER w END, 6) AS beta
FROM pf JOIN bm USING (date) WINDOW w AS (PARTITION BY portfolio ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def win_rolling_beta(t: Tables) -> DataFrame:
    joined = portfolios(t).join(benchmark(t), "date")
    out = series.rolling_beta(joined, keys=["portfolio"], order="date", y="ret", x="bench", window=12)
    return out.select("portfolio", "date", F.round("beta", 6).alias("beta"))


@query("win_last_n", f"WITH {RET_SQL} SELECT portfolio, date, round(ret, 9) AS ret FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) AS rn FROM pf) x WHERE rn <= 10")
def win_last_n(t: Tables) -> DataFrame:
    return rounded(series.last_n(portfolios(t), keys=["portfolio"], order="date", n=10), 9, "portfolio", "date")


@query("agg_corr_matrix", f"""WITH {RET_SQL} SELECT a.ticker AS a, b.ticker AS b, round(corr(a.ret, b.ret), 8) AS corr
FROM rt a JOIN rt b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2""")
def agg_corr_matrix(t: Tables) -> DataFrame:
    return risk.correlations(returns(t)).select("a", "b", F.round("corr", 8).alias("corr"))


@query("pf_hist", f"""WITH {RET_SQL}, b AS (SELECT portfolio, min(ret) AS lo, max(ret) AS hi, count(*) AS total FROM pf GROUP BY 1)
SELECT portfolio, CAST(least(59, floor((ret - lo) / ((hi - lo) / 60))) AS INTEGER) AS bin, count(*) AS n, round(count(*) / (max(total) * ((max(hi) - max(lo)) / 60)), 6) AS density
FROM pf JOIN b USING (portfolio) GROUP BY 1, 2""")
def pf_hist(t: Tables) -> DataFrame:
    return series.histogram(portfolios(t), "ret", 60, "portfolio").select("portfolio", "bin", "n", F.round("density", 6).alias("density"))


@query("join_align_dates", f"WITH {RET_SQL} SELECT a.date, round(a.ret, 9) AS ret_a, round(b.ret, 9) AS ret_b FROM rt0 a JOIN rt0 b ON a.date = b.date WHERE a.ticker = 'NATION_5' AND b.ticker = 'NATION_6' AND a.ret IS NOT NULL AND b.ret IS NOT NULL")
def join_align_dates(t: Tables) -> DataFrame:
    full = series.pct_return(prices(t), keys=["ticker"], order="date", price="price").filter("ret is not null")

    def one(name: str, out: str) -> DataFrame:
        return full.filter(F.col("ticker") == name).select("date", F.round("ret", 9).alias(out))

    return one("NATION_5", "ret_a").join(one("NATION_6", "ret_b"), "date")


@query("join_factors", f"WITH {RET_SQL} SELECT portfolio, date, round(ret - rf, 9) AS excess, round(mkt_rf, 9) AS mkt_rf, round(smb, 9) AS smb, round(hml, 9) AS hml FROM pf JOIN fc USING (date) WHERE smb IS NOT NULL AND hml IS NOT NULL")
def join_factors(t: Tables) -> DataFrame:
    return rounded(with_factors(t).select("portfolio", "date", "excess", "mkt_rf", "smb", "hml"), 9, "portfolio", "date")


def scores(t: Tables) -> DataFrame:
    """Scored texts ``(event_id, date, ticker, source, pos, neg, composite)``."""
    kinds = {"view": "edgar", "click": "news", "signup": "reddit", "purchase": "twitter"}
    source = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit("blog"))
    pos, neg = F.col("value") / 1000, F.get_json_object("props", "$.k").cast("int") / 1000
    return t.events.select(
        "event_id", F.to_date("ts").alias("date"), F.concat(F.lit("U"), "user_id").alias("ticker"), source.alias("source"), pos.alias("pos"), neg.alias("neg"), (pos - neg).alias("composite")
    )


def daily_scores(t: Tables) -> DataFrame:
    return t.once("scores", lambda t: risk.weighted_scores(scores(t), order="event_id"))


def user_returns(t: Tables) -> DataFrame:
    """Daily returns ``(date, ticker, ret)`` of each user's event value over the user's active days."""
    total = F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
    daily = t.events.groupBy(F.concat(F.lit("U"), "user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(total.alias("price"))
    out = series.pct_return(daily, keys=["ticker"], order="date", price="price")
    return out.filter("ret is not null").select("date", "ticker", "ret")


SCORE_SQL = """sc AS (SELECT CAST(ts AS DATE) AS date, 'U' || user_id AS ticker,
    CASE event_type WHEN 'view' THEN 'edgar' WHEN 'click' THEN 'news' WHEN 'signup' THEN 'reddit' WHEN 'purchase' THEN 'twitter' ELSE 'blog' END AS source,
    value / 1000 AS pos, CAST(json_extract_string(props, '$.k') AS INTEGER) / 1000 AS neg FROM events),
sw AS (SELECT *, pos - neg AS composite, CASE source WHEN 'edgar' THEN 3.0 WHEN 'news' THEN 2.0 WHEN 'reddit' THEN 1.0 WHEN 'twitter' THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM sc),
ds AS (SELECT date, ticker, sum(composite * w) / sum(w) AS weighted_sentiment, count(composite) AS n_texts FROM sw GROUP BY 1, 2),
dz AS (SELECT date, ticker, CASE WHEN stddev_pop(weighted_sentiment) OVER (PARTITION BY date) > 0
  THEN (weighted_sentiment - avg(weighted_sentiment) OVER (PARTITION BY date)) / stddev_pop(weighted_sentiment) OVER (PARTITION BY date) ELSE 0 END AS z FROM ds),
ur AS (SELECT * FROM (SELECT ticker, date, price / lag(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM (
  SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS price FROM events GROUP BY 1, 2) p) q WHERE ret IS NOT NULL)"""


@query("sentiment_composite", f"WITH {SCORE_SQL} SELECT source, count(*) AS n, round(min(composite), 6) AS lowest, round(max(composite), 6) AS highest FROM sw GROUP BY 1")
def sentiment_composite(t: Tables) -> DataFrame:
    return scores(t).groupBy("source").agg(F.count("*").alias("n"), F.round(F.min("composite"), 6).alias("lowest"), F.round(F.max("composite"), 6).alias("highest"))


@query("date_from_iso", "SELECT CAST(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 10) AS DATE) AS date, count(*) AS n FROM events GROUP BY 1")
def date_from_iso(t: Tables) -> DataFrame:
    iso = t.events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"))
    return iso.groupBy(F.to_date(F.substring("published_at", 1, 10)).alias("date")).agg(F.count("*").alias("n"))


@query("agg_weighted_sentiment", f"WITH {SCORE_SQL} SELECT date, ticker, round(weighted_sentiment, 8) AS weighted_sentiment, n_texts FROM ds")
def agg_weighted_sentiment(t: Tables) -> DataFrame:
    return daily_scores(t).select("date", "ticker", F.round("weighted_sentiment", 8).alias("weighted_sentiment"), "n_texts")


@query("agg_sent_daily_stats", f"""WITH {SCORE_SQL} SELECT date, round(avg(weighted_sentiment), 8) AS avg_sentiment, round(stddev_samp(weighted_sentiment), 8) AS dispersion,
  CAST(sum(n_texts) AS BIGINT) AS n_texts FROM ds GROUP BY 1""")
def agg_sent_daily_stats(t: Tables) -> DataFrame:
    return rounded(risk.daily_sentiment_stats(daily_scores(t)), 8, "date", "n_texts")


@query("win_cross_z", f"WITH {SCORE_SQL} SELECT date, ticker, round(z, 7) AS z FROM dz")
def win_cross_z(t: Tables) -> DataFrame:
    return series.cross_z(daily_scores(t), date="date", value="weighted_sentiment").select("date", "ticker", F.round("z", 7).alias("z"))


@query("win_ewm", f"""WITH RECURSIVE {SCORE_SQL}, nn AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM ds),
ew AS (SELECT ticker, date, i, weighted_sentiment AS s FROM nn WHERE i = 1
  UNION ALL SELECT nn.ticker, nn.date, nn.i, ew.s * (2.0 / 3) + nn.weighted_sentiment * (1.0 / 3) FROM ew JOIN nn ON nn.ticker = ew.ticker AND nn.i = ew.i + 1)
SELECT ticker, date, round(s, 8) AS smoothed FROM ew""")
def win_ewm(t: Tables) -> DataFrame:
    out = series.ewm(daily_scores(t), keys=["ticker"], order="date", value="weighted_sentiment", span=5, out="smoothed")
    return out.select("ticker", "date", F.round("smoothed", 8).alias("smoothed"))


@query("win_quintile_ls", f"""WITH {SCORE_SQL}, c AS (SELECT date, ticker, z, ret, row_number() OVER (PARTITION BY date ORDER BY z, ticker) AS r,
  count(*) OVER (PARTITION BY date) AS n FROM dz JOIN ur USING (date, ticker))
SELECT date, max(n) AS names, CASE WHEN max(n) < 10 THEN 0 ELSE round(avg(CASE WHEN r > n - n // 5 THEN ret END) - avg(CASE WHEN r <= n // 5 THEN ret END), 7) END AS factor
FROM c GROUP BY 1""")
def win_quintile_ls(t: Tables) -> DataFrame:
    z = series.cross_z(daily_scores(t), date="date", value="weighted_sentiment").select("date", "ticker", "z")
    out = risk.bucket_spread(z.join(user_returns(t), ["date", "ticker"]))
    return out.select("date", "names", F.round("factor", 7).alias("factor"))


# No scores at weekends here, so that the day before may have none.
ASOF_SQL = f"""{SCORE_SQL.replace(" AS neg FROM events),", " AS neg FROM events WHERE isodow(ts) < 6),")}, td AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev_date FROM (SELECT DISTINCT date FROM ur) x),
pl AS (SELECT date, prev_date, (SELECT max(s.date) FROM (SELECT DISTINCT date FROM dz) s WHERE s.date <= td.prev_date) AS score_date FROM td WHERE prev_date IS NOT NULL)"""


@query("join_asof_prior", f"WITH {ASOF_SQL} SELECT prev_date, score_date FROM pl WHERE score_date IS NOT NULL")
def join_asof_prior(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    days = user_returns(t).select("date").distinct()
    previous = days.select(F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("prev_date")).filter("prev_date is not null")
    known = scores(t).filter(F.weekday("date") < 5).select(F.col("date").alias("score_date")).distinct()
    return series.asof_dates(previous, known, "prev_date", "score_date").filter("score_date is not null")


@query("join_asof_keyed", """SELECT p.event_id, p.user_id, p.ts, c.ts AS click_ts, c.event_id AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (
  SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def join_asof_keyed(t: Tables) -> DataFrame:
    """Every purchase with the user's latest click before it."""
    purchases = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = t.events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("id"))
    return series.asof_join(purchases, clicks, keys=["user_id"], left_on="ts", right_on="ts", prefix="click_")


@query("sentiment_factor", f"""WITH {ASOF_SQL}, c AS (SELECT pl.date, ur.ticker, z, ret, row_number() OVER (PARTITION BY pl.date ORDER BY z, ur.ticker) AS r,
  count(*) OVER (PARTITION BY pl.date) AS n FROM pl JOIN dz ON dz.date = pl.score_date JOIN ur ON ur.date = pl.date AND ur.ticker = dz.ticker),
fx AS (SELECT date, max(n) AS names, CASE WHEN max(n) < 10 THEN 0 ELSE round(avg(CASE WHEN r > n - n // 5 THEN ret END) - avg(CASE WHEN r <= n // 5 THEN ret END), 7) END AS factor
  FROM c GROUP BY 1)
SELECT pl.date, coalesce(names, 0) AS names, coalesce(factor, 0) AS factor FROM pl LEFT JOIN fx USING (date) WHERE score_date IS NOT NULL""")
def sentiment_factor(t: Tables) -> DataFrame:
    daily = daily_scores(t).filter(F.weekday("date") < 5)
    z = series.cross_z(daily, date="date", value="weighted_sentiment").select("date", "ticker", "z")
    out = risk.long_short_factor(z, t.once("user-returns", user_returns))
    return out.select("date", "names", F.round("factor", 7).alias("factor"))


@query("join_sent_left_zero", f"""WITH {RET_SQL}, se AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, round(avg(l_discount), 8) AS sent FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT date, round(mkt_rf, 9) AS mkt_rf, coalesce(sent, 0) AS sent FROM fc LEFT JOIN se USING (date)""")
def join_sent_left_zero(t: Tables) -> DataFrame:
    sent = t.lineitem.filter(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).groupBy(F.date_trunc("month", "l_shipdate").cast("date").alias("date"))
    sent = sent.agg(F.round(F.avg("l_discount"), 8).alias("sent"))
    return factors(t).join(sent, "date", "left").select("date", F.round("mkt_rf", 9).alias("mkt_rf"), F.coalesce("sent", F.lit(0.0)).alias("sent"))


@query("join_outer_prices", f"""WITH {RET_SQL}, cached AS (SELECT ticker, date, price FROM px WHERE date < DATE '2000-01-01'),
fresh AS (SELECT ticker, date, price * 2 AS price FROM px WHERE date >= DATE '1999-07-01')
SELECT ticker, date, coalesce(fresh.price, cached.price) AS price FROM cached FULL JOIN fresh USING (ticker, date)""")
def join_outer_prices(t: Tables) -> DataFrame:
    px = prices(t)
    cached = px.filter("date < date'2000-01-01'").select("ticker", "date", F.col("price").alias("old"))
    fresh = px.filter("date >= date'1999-07-01'").select("ticker", "date", (F.col("price") * 2).alias("new"))
    return cached.join(fresh, ["ticker", "date"], "full_outer").select("ticker", "date", F.coalesce("new", "old").alias("price"))


@query("ols_single", f"WITH {RET_SQL} SELECT portfolio, round(regr_slope(ret - rf, mkt_rf), 6) AS beta, round(regr_intercept(ret - rf, mkt_rf), 8) AS alpha, round(regr_r2(ret - rf, mkt_rf), 6) AS r2, count(*) AS n FROM pf JOIN fc USING (date) GROUP BY 1")
def ols_single(t: Tables) -> DataFrame:
    fit = regression.ols(with_factors(t), keys=["portfolio"], y="excess", xs=["mkt_rf"])

    def at(term: str, digits: int):
        return F.round(F.max(F.when(F.col("term") == term, F.col("coef"))), digits)

    return fit.groupBy("portfolio").agg(at("mkt_rf", 6).alias("beta"), at("const", 8).alias("alpha"), F.round(F.max("r2"), 6).alias("r2"), F.max("n").alias("n"))


@query("ols_capm", f"""WITH {RET_SQL}, d AS (SELECT portfolio, date, ret - rf AS y, mkt_rf AS x FROM pf JOIN fc USING (date)),
m AS (SELECT portfolio, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM d GROUP BY 1),
u AS (SELECT portfolio, date, y - a - b * x AS e, x * (y - a - b * x) AS ex FROM d JOIN m USING (portfolio)),
nb AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS i FROM u),
g AS (SELECT p.portfolio, sum(w * p.e * q.e) AS s00, sum(w * (p.e * q.ex + p.ex * q.e) / 2) AS s01, sum(w * p.ex * q.ex) AS s11
  FROM (SELECT *, unnest(range(-5, 6)) AS l FROM nb) p JOIN nb q ON q.portfolio = p.portfolio AND q.i = p.i + p.l,
    LATERAL (SELECT 1 - abs(p.l) / 6.0 AS w) ww GROUP BY 1),
v AS (SELECT portfolio, a, b, (sxx * sxx * s00 - 2 * sx * sxx * s01 + sx * sx * s11) / pow(n * sxx - sx * sx, 2) AS va,
  (sx * sx * s00 - 2 * sx * n * s01 + n * n * s11) / pow(n * sxx - sx * sx, 2) AS vb FROM m JOIN g USING (portfolio))
SELECT portfolio, round(a * 252, 6) AS alpha, round(b, 6) AS beta, round(a / sqrt(va), 5) AS alpha_t, round(b / sqrt(vb), 5) AS beta_t FROM v""")
def ols_capm(t: Tables) -> DataFrame:
    out = regression.capm(with_factors(t), keys=["portfolio"], order="date")
    return out.select(
        "portfolio", F.round("alpha", 6).alias("alpha"), F.round("mkt_rf_beta", 6).alias("beta"),
        F.round("alpha_t", 5).alias("alpha_t"), F.round("mkt_rf_t", 5).alias("beta_t"),
    )


def ols_sql(data: str, key: str, k: int, lags: int = 5) -> str:
    """Least squares on ``c1 .. ck`` and a constant in plain SQL, as tables up to ``fit``, from ``data`` with ``key, date, y, c1 ..``.

    Every column is made orthogonal to all the others, one after the other. A coefficient is then one quotient, and its
    autocorrelation-robust variance a weighted sum of lagged products; no matrix is inverted.
    """
    parts = [f"d AS (SELECT *, 1.0::DOUBLE AS c0 FROM ({data}) z)"]

    def less(column: str, upto: int) -> str:
        return column + "".join(f" - q{m} * (sum({column} * q{m}) OVER p / sum(q{m} * q{m}) OVER p)" for m in range(upto))

    for j in range(k + 1):
        before, others = "d", [i for i in range(k + 1) if i != j]
        for m, o in enumerate(others):
            parts.append(f"g{j}_{m} AS (SELECT *, {less(f'c{o}', m)} AS q{m} FROM {before} WINDOW p AS (PARTITION BY {key}))")
            before = f"g{j}_{m}"
        parts.append(f"x{j} AS (SELECT {key}, date, y, {less(f'c{j}', k)} AS x FROM {before} WINDOW p AS (PARTITION BY {key}))")
        parts.append(f"b{j} AS (SELECT {key}, sum(y * x) / sum(x * x) AS b{j}, sum(x * x) AS xx{j} FROM x{j} GROUP BY 1)")
    joined = " ".join(f"JOIN b{j} USING ({key})" for j in range(k + 1))
    parts.append(f"e AS (SELECT {key}, date, y, y - ({' + '.join(f'b{j} * c{j}' for j in range(k + 1))}) AS e FROM d {joined})")
    for j in range(k + 1):
        lagged = ", ".join(f"lag(u, {l}) OVER w AS l{l}" for l in range(1, lags + 1))
        pairs = " + ".join(f"2 * (1 - {l} / {lags + 1}.0) * u * coalesce(l{l}, 0)" for l in range(1, lags + 1))
        parts.append(f"u{j} AS (SELECT {key}, date, x * e AS u FROM x{j} JOIN e USING ({key}, date))")
        parts.append(f"l{j} AS (SELECT *, {lagged} FROM u{j} WINDOW w AS (PARTITION BY {key} ORDER BY date))")
        parts.append(f"s{j} AS (SELECT {key}, sum(u * u + {pairs}) AS s{j} FROM l{j} GROUP BY 1)")
    sums = " ".join(f"JOIN s{j} USING ({key})" for j in range(k + 1))
    robust = ", ".join(f"b{j} * xx{j} / sqrt(s{j}) AS t{j}" for j in range(k + 1))
    parts.append(f"r AS (SELECT {key}, count(*) AS n, sum(e * e) AS ssr, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1)")
    parts.append(f"fit AS (SELECT *, {robust} FROM r {joined} {sums})")
    return ", ".join(parts)


def tail_sql(t: str, density: str) -> str:
    """Two-sided tail of a density, given as a function of ``v``, by Simpson's rule between 0 and ``t``."""
    weight = "CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = density.replace("v", f"(i * abs({t}) / 1000)")
    return f"(1 - 2 * abs({t}) / 3000 * list_sum(list_transform(range(0, 1001), lambda i: ({weight}) * {at})))"


NORMAL = "exp(-0.5 * pow(v, 2)) / sqrt(2 * pi())"
FACTORS_SQL = f"""{RET_SQL}, {ols_sql("SELECT portfolio, date, ret - rf AS y, mkt_rf AS c1, smb AS c2, hml AS c3 FROM pf JOIN fc USING (date) WHERE smb IS NOT NULL AND hml IS NOT NULL", "portfolio", 3)}"""


def estimates(df: DataFrame) -> DataFrame:
    """Coefficients and R2 to 6 digits, t to 5 and p to 6."""
    return df.select(*[F.round(c, 5 if c.endswith("_t") else 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def terms_sql(names: list[str]) -> str:
    cells = ["round(b0 * 252, 6) AS alpha", "round(t0, 5) AS alpha_t", f"round({tail_sql('t0', NORMAL)}, 6) AS alpha_p"]
    for j, name in enumerate(names, 1):
        cells += [f"round(b{j}, 6) AS {name}_beta", f"round(t{j}, 5) AS {name}_t", f"round({tail_sql(f't{j}', NORMAL)}, 6) AS {name}_p"]
    return ", ".join(cells)


@query("ols_ff", f"WITH {FACTORS_SQL} SELECT portfolio, {terms_sql(['mkt_rf', 'smb', 'hml'])}, round(r2, 6) AS r2, n FROM fit")
def ols_ff(t: Tables) -> DataFrame:
    """Three-factor model with robust errors."""
    return estimates(regression.factor_model(with_factors(t), keys=["portfolio"], order="date", excess="excess", factors=["mkt_rf", "smb", "hml"]))


@query("ols_rolling", f"""WITH {RET_SQL}, d AS (SELECT portfolio, date, ret - rf AS y, mkt_rf AS x FROM pf JOIN fc USING (date) WHERE smb IS NOT NULL AND hml IS NOT NULL)
SELECT portfolio, date, round(alpha, 5) AS alpha, round(beta, 6) AS mkt_rf_beta FROM (
  SELECT portfolio, date, count(*) OVER w AS n, regr_slope(y, x) OVER w AS beta, regr_intercept(y, x) OVER w * 252 AS alpha FROM d
  WINDOW w AS (PARTITION BY portfolio ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) z WHERE n = 24""")
def ols_rolling(t: Tables) -> DataFrame:
    out = regression.rolling_ols(with_factors(t), keys=["portfolio"], order="date", y="excess", xs=["mkt_rf"], window=24)
    return out.select("portfolio", "date", F.round("alpha", 5).alias("alpha"), F.round("mkt_rf_beta", 6).alias("mkt_rf_beta"))


BASE_SQL = ols_sql("SELECT portfolio, date, ret - rf AS y, mkt_rf AS c1, smb AS c2 FROM pf JOIN fc USING (date) WHERE smb IS NOT NULL AND hml IS NOT NULL", "portfolio", 2)
STUDENT = "exp(lgamma((n - 3) / 2.0) - lgamma((n - 4) / 2.0)) / sqrt((n - 4) * pi()) * pow(1 + pow(v, 2) / (n - 4), -(n - 3) / 2.0)"


@query("ols_incremental_f", f"""WITH {FACTORS_SQL}, small AS (WITH {BASE_SQL} SELECT portfolio, r2 AS r2_base FROM fit),
duo AS (SELECT portfolio, r2_base, r2, n, b3 * b3 * xx3 / (ssr / (n - 4)) AS f FROM fit JOIN small USING (portfolio))
SELECT portfolio, round(r2_base, 6) AS r2_base, round(r2, 6) AS r2_with, round(f, 5) AS f_stat, round({tail_sql("sqrt(f)", STUDENT)}, 6) AS f_p, round(r2 - r2_base, 6) AS delta_r2 FROM duo""")
def ols_incremental_f(t: Tables) -> DataFrame:
    """R2 gain and F-test of the third factor."""
    out = estimates(regression.incremental_f(with_factors(t), keys=["portfolio"], y="excess", base=["mkt_rf", "smb"], added="hml").withColumnRenamed("f_stat", "f_stat_t"))
    return out.withColumnRenamed("f_stat_t", "f_stat")


@query("ols_orthogonality", f"""WITH {RET_SQL}, {ols_sql("SELECT 'all' AS g, date, hml AS y, mkt_rf AS c1, smb AS c2 FROM fc WHERE smb IS NOT NULL AND hml IS NOT NULL", "g", 2)}
SELECT g, {terms_sql(['mkt_rf', 'smb'])}, round(r2, 6) AS r2, n FROM fit""")
def ols_orthogonality(t: Tables) -> DataFrame:
    """One factor regressed on the others with robust errors."""
    frame = factors(t).na.drop().withColumn("g", F.lit("all"))
    return estimates(regression.factor_model(frame, keys=["g"], order="date", excess="hml", factors=["mkt_rf", "smb"]))


@query("ols_significance", f"WITH {FACTORS_SQL} SELECT portfolio, round(b3, 6) AS hml_beta, round(t3, 5) AS hml_t, round({tail_sql('t3', NORMAL)}, 6) AS hml_p, round(r2, 6) AS r2 FROM fit")
def ols_significance(t: Tables) -> DataFrame:
    """The tested factor's beta, t and p for every portfolio, one grouped fit."""
    out = regression.factor_model(with_factors(t), keys=["portfolio"], order="date", excess="excess", factors=["mkt_rf", "smb", "hml"])
    return estimates(out.select("portfolio", "hml_beta", "hml_t", "hml_p", "r2"))
