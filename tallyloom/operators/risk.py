"""Portfolio returns, risk measures and the long-short sentiment factor.

Returns are long: one row per (portfolio or ticker, date). A portfolio's history is
bounded by the trading calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import value_at_rank
from tallyloom.operators.series import asof_dates, drawdown
from tallyloom.session import frozen

# Fixed values.
TRADING_DAYS = 252
RISK_FREE_ANNUAL = 0.05
SOURCE_WEIGHTS = {"edgar": 3.0, "news": 2.0, "reddit": 1.0, "twitter": 0.5}


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted return per portfolio and date, for dates on which every member has a return.

    ``returns(ticker, date, ret)``, ``weights(portfolio, ticker, weight)``.
    """
    members = weights.groupBy("portfolio").agg(F.count("*").alias("_m"))
    return (
        returns.filter("ret is not null")
        .join(weights, "ticker")
        .groupBy("portfolio", "date")
        .agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"), F.count("*").alias("_n"))
        .join(members, "portfolio")
        .filter("_n = _m")
        .select("portfolio", "date", "ret")
    )


def _rf() -> Column:
    return F.lit(RISK_FREE_ANNUAL / TRADING_DAYS)


def return_vol(returns: DataFrame, by: str = "portfolio") -> DataFrame:
    """Annualised mean and volatility."""
    return returns.groupBy(by).agg(
        (F.avg("ret") * TRADING_DAYS).alias("ann_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(TRADING_DAYS))).alias("ann_vol")
    )


def sharpe_sortino(returns: DataFrame, by: str = "portfolio") -> DataFrame:
    """Sharpe and Sortino ratios, 0 where the deviation is 0.

    The downside deviation is the root mean square of the negative excess returns only.
    """
    excess = F.col("ret") - _rf()
    below = F.when(excess < 0, excess * excess)
    year = F.sqrt(F.lit(TRADING_DAYS))
    stats = returns.groupBy(by).agg(
        (F.avg(excess) * TRADING_DAYS).alias("_ex"),
        (F.stddev_samp("ret") * year).alias("_vol"),
        (F.sqrt(F.avg(below)) * year).alias("_down"),
    )

    def ratio(deviation: str) -> Column:
        return F.when(F.col(deviation) > 0, F.col("_ex") / F.col(deviation)).otherwise(F.lit(0.0))

    return stats.select(by, ratio("_vol").alias("sharpe"), ratio("_down").alias("sortino"))


def max_drawdown(returns: DataFrame, by: str = "portfolio") -> DataFrame:
    return drawdown(returns, keys=[by], order="date", ret="ret").groupBy(by).agg(F.min("drawdown").alias("max_drawdown"))


def var_cvar(returns: DataFrame, by: list[str] | None = None, p: float = 0.05) -> DataFrame:
    """The ``p`` quantile of returns and the mean of the returns not above it."""
    by = by or ["portfolio"]
    known = returns.filter("ret is not null")
    limit = known.groupBy(*by).agg(F.percentile("ret", F.lit(p)).alias("var_95"))
    tail = F.when(F.col("ret") <= F.col("var_95"), F.col("ret"))
    return known.join(limit, by).groupBy(*by).agg(F.max("var_95").alias("var_95"), F.avg(tail).alias("cvar_95"))


def tracking(returns: DataFrame, benchmark: DataFrame, by: str = "portfolio") -> DataFrame:
    """Tracking error and information ratio against ``benchmark(date, bench)``."""
    active = returns.join(benchmark, "date").withColumn("_a", F.col("ret") - F.col("bench"))
    stats = active.groupBy(by).agg(
        (F.avg("_a") * TRADING_DAYS).alias("_ex"),
        (F.stddev_samp("_a") * F.sqrt(F.lit(TRADING_DAYS))).alias("tracking_error"),
    )
    ratio = F.when(F.col("tracking_error") > 0, F.col("_ex") / F.col("tracking_error")).otherwise(F.lit(0.0))
    return stats.select(by, "tracking_error", ratio.alias("information_ratio"))


def all_kpis(returns: DataFrame, benchmark: DataFrame, by: str = "portfolio") -> DataFrame:
    """Eight measures per portfolio, alpha and beta against the benchmark's excess return.

    One aggregation gives all of them but the tail mean, which needs the quantile first.
    """
    fallen = drawdown(returns.join(benchmark, "date", "left"), keys=[by], order="date", ret="ret")
    y, x, active = F.col("ret") - _rf(), F.col("bench") - _rf(), F.col("ret") - F.col("bench")
    year = F.sqrt(F.lit(TRADING_DAYS))

    def ratio(mean: Column, deviation: Column) -> Column:
        return F.when(deviation > 0, mean * TRADING_DAYS / (deviation * year)).otherwise(F.lit(0.0))

    stats = fallen.groupBy(by).agg(
        (F.regr_intercept(y, x) * TRADING_DAYS).alias("alpha"),
        F.regr_slope(y, x).alias("beta"),
        ratio(F.avg(y), F.stddev_samp("ret")).alias("sharpe"),
        ratio(F.avg(y), F.sqrt(F.avg(F.when(y < 0, y * y)))).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"),
        ratio(F.avg(active), F.stddev_samp(active)).alias("information_ratio"),
    )
    tail = returns.join(stats.select(by, "var_95"), by).filter("ret <= var_95").groupBy(by).agg(F.avg("ret").alias("cvar_95"))
    return stats.join(tail, by)


def compare(kpis: DataFrame, portfolios: list[str], by: str = "portfolio") -> DataFrame:
    """Metric by portfolio: the wide table turned on its side for a named list of portfolios."""
    metrics = [c for c in kpis.columns if c != by]
    long = kpis.unpivot([by], metrics, "metric", "value")
    return long.groupBy("metric").pivot(by, portfolios).agg(F.first("value"))


def regime_risk(returns: DataFrame, factor: DataFrame, by: str = "portfolio", min_days: int = 20) -> DataFrame:
    """VaR and CVaR on days of high and low factor, split at the factor's median over the shared days.

    A regime with no more than ``min_days`` days has no measures.
    """
    aligned = returns.join(factor, "date")
    middle = aligned.groupBy(by).agg(F.median("factor").alias("_mid"))
    regime = F.when(F.col("factor") >= F.col("_mid"), "high").otherwise("low")
    split = aligned.join(middle, by).withColumn("regime", regime)
    days = split.groupBy(by, "regime").agg(F.count("*").alias("days"))
    risk = var_cvar(split.select(by, "regime", "ret"), [by, "regime"])
    enough = F.col("days") > min_days
    return days.join(risk, [by, "regime"]).select(
        by, "regime", "days", F.when(enough, F.col("var_95")).alias("var_95"), F.when(enough, F.col("cvar_95")).alias("cvar_95")
    )


def stress_impact(betas: DataFrame, shocks: list[float], beta: str = "beta", annual_vol: str = "factor_vol") -> DataFrame:
    """One-day impact of each shock, in factor deviations."""
    shock = F.explode(F.array(*[F.lit(float(s)) for s in shocks])).alias("shock")
    out = betas.select("*", shock)
    return out.withColumn("impact", F.col(beta) * F.col("shock") * F.col(annual_vol) / F.sqrt(F.lit(TRADING_DAYS)))


def correlations(returns: DataFrame, key: str = "ticker", block: int = 256, span: int = 1024) -> DataFrame:
    """Pearson correlation of every pair of series over the dates all of them share.

    Series are standardised, so a correlation is a plain sum of products over dates, and sums over
    parts of the dates add up. Series are dealt into blocks and dates into parts of about ``span``; a
    task multiplies two blocks over one part. No row or task grows with the dates or the number of series.
    """
    known = returns.filter(F.col("ret").isNotNull())
    n = known.agg(F.countDistinct(key)).scalar()
    shared = known.groupBy("date").agg(F.countDistinct(key).alias("_n")).filter(F.col("_n") == n).select("date")
    # Three passes read these rows; they are computed once.
    rows = frozen(known.join(shared, "date").select(F.col(key).alias("name"), "date", "ret"), "aligned")
    parts = F.greatest(F.ceil(rows.agg(F.countDistinct("date")).scalar() / F.lit(span)), F.lit(1)).cast("int")
    stats = rows.groupBy("name").agg(F.avg("ret").alias("_mean"), F.sqrt(F.var_pop("ret") * F.count("ret")).alias("_size"))
    z = F.when(F.col("_size") > 0, (F.col("ret") - F.col("_mean")) / F.col("_size")).otherwise(F.lit(float("nan")))
    standard = rows.join(stats, "name").select("name", "date", z.alias("z"), F.pmod(F.xxhash64("date"), parts).alias("_part"))
    entry = F.array_sort(F.collect_list(F.struct("date", "z")))
    packed = standard.groupBy("name", "_part").agg(F.transform(entry, lambda e: e.z).alias("z"))
    blocks = F.ceil(n / F.lit(block)).cast("int")
    dealt = packed.withColumn("_b", F.pmod(F.hash("name"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o")

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name")
        names, side = group["name"].to_numpy(), group["_b"].to_numpy()
        x = np.stack(group["z"].to_numpy()).astype(float)
        product = x @ x.T
        i, j = np.triu_indices(len(names), 1)
        if group["_i"].iloc[0] != group["_j"].iloc[0]:
            apart = side[i] != side[j]
            i, j = i[apart], j[apart]
        return pd.DataFrame({"a": names[i], "b": names[j], "part": product[i, j]})

    sums = dealt.groupBy("_i", "_j", "_part").applyInPandas(multiply, "a string, b string, part double")
    return sums.groupBy("a", "b").agg(F.sum("part").alias("corr"))


#: Consecutive ``order`` values whose texts are added up one after the other.
SCORE_BLOCK = 1 << 22


def weighted_scores(scores: DataFrame, weights: dict[str, float] | None = None, default: float = 1.0, order: str | None = None) -> DataFrame:
    """Source-weighted mean score and text count per (date, ticker).

    ``order``, a whole number that numbers the texts, fixes the order of the floating-point sums, so that scores
    which tie do so however the rows are dealt. A group holds ``SCORE_BLOCK`` numbers at most; the blocks of one
    cell are added in order too.
    """
    weights = SOURCE_WEIGHTS if weights is None else weights
    w = F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in weights.items()], F.lit(default))
    rows = scores.withColumn("_w", w).withColumn("_x", F.col("composite") * F.col("_w"))
    if order is None:
        mean = F.sum("_x") / F.sum("_w")
        return rows.groupBy("date", "ticker").agg(mean.alias("weighted_sentiment"), F.count("composite").alias("n_texts"))

    def folded(items: Column, name: str) -> Column:
        return F.aggregate(items, F.lit(None).cast("double"), lambda s, i: F.coalesce(s + i[name], s, i[name]))

    listed = F.sort_array(F.collect_list(F.struct("_at", "_x", "_w")))
    blocks = rows.withColumn("_at", F.col(order).cast("long")).groupBy("date", "ticker", F.floor(F.col("_at") / SCORE_BLOCK).alias("_block"))
    sums = blocks.agg(listed.alias("_i"), F.count("composite").alias("_n"))
    parts = sums.select("date", "ticker", F.struct("_block", folded(F.col("_i"), "_x").alias("_x"), folded(F.col("_i"), "_w").alias("_w")).alias("_p"), "_n")
    cells = parts.groupBy("date", "ticker").agg(F.sort_array(F.collect_list("_p")).alias("_i"), F.sum("_n").alias("n_texts"))
    return cells.select("date", "ticker", (folded(F.col("_i"), "_x") / folded(F.col("_i"), "_w")).alias("weighted_sentiment"), "n_texts")


def daily_sentiment_stats(daily: DataFrame) -> DataFrame:
    """Mean, dispersion and text count per date."""
    return daily.groupBy("date").agg(
        F.avg("weighted_sentiment").alias("avg_sentiment"),
        F.stddev_samp("weighted_sentiment").alias("dispersion"),
        F.sum("n_texts").alias("n_texts"),
    )


def bucket_spread(
    cross: DataFrame,
    *,
    date: str = "date",
    z: str = "z",
    ret: str = "ret",
    name: str = "ticker",
    n_buckets: int = 5,
    min_names: int = 10,
) -> DataFrame:
    """Mean return of the top bucket minus the bottom one, per date.

    A bucket holds ``floor(n / n_buckets)`` names; equal scores go by name; dates with
    fewer than ``min_names`` names get 0. The bucket borders are exact order statistics
    of the score, so a date's names are never sorted in one task; only names that tie
    with a border are ranked. The scores are checkpointed first: both passes must see
    the same floating-point values.
    """
    known = frozen(
        cross.filter(F.col(z).isNotNull() & F.col(ret).isNotNull()).select(
            date, F.col(name).alias("_name"), F.col(z).alias("_z"), F.col(ret).alias("_r")
        )
    )
    size = F.floor(F.col("n") / n_buckets)
    part = 1 / n_buckets
    low = value_at_rank(known, keys=[date], value="_z", rank=F.greatest(size - 1, F.lit(0)), near=part, out="_lo")
    high = value_at_rank(known, keys=[date], value="_z", rank=F.col("n") - F.greatest(size, F.lit(1)), near=1 - part, out="_hi")
    borders = low.join(high.drop("_hi_n"), date).withColumn("_k", F.floor(F.col("_lo_n") / n_buckets))
    marked = known.join(borders, date)
    under, over = F.col("_z") < F.col("_lo"), F.col("_z") > F.col("_hi")
    inside = marked.groupBy(date).agg(
        F.max("_lo_n").alias("names"),
        F.max("_k").alias("_size"),
        F.coalesce(F.sum(F.when(under, F.col("_r"))), F.lit(0.0)).alias("_bottom"),
        F.coalesce(F.sum(F.when(over, F.col("_r"))), F.lit(0.0)).alias("_top"),
        F.count_if(under).alias("_under"),
        F.count_if(over).alias("_over"),
    )
    at_low, at_high = F.col("_z") == F.col("_lo"), F.col("_z") == F.col("_hi")
    tied = marked.filter(at_low | at_high).join(inside.select(date, "_under", "_over"), date)
    same = Window.partitionBy(date, "_z")
    tied = tied.withColumns(
        {
            "_up": F.row_number().over(same.orderBy("_name")),
            "_down": F.row_number().over(same.orderBy(F.col("_name").desc())),
        }
    )
    low_fits = at_low & (F.col("_up") <= F.col("_k") - F.col("_under"))
    high_fits = at_high & (F.col("_down") <= F.col("_k") - F.col("_over"))
    edges = tied.groupBy(date).agg(
        F.coalesce(F.sum(F.when(low_fits, F.col("_r"))), F.lit(0.0)).alias("_low_edge"),
        F.coalesce(F.sum(F.when(high_fits, F.col("_r"))), F.lit(0.0)).alias("_high_edge"),
    )
    spread = (F.col("_top") + F.col("_high_edge") - F.col("_bottom") - F.col("_low_edge")) / F.col("_size")
    factor = F.when(F.col("names") >= F.lit(max(min_names, n_buckets)), spread).otherwise(F.lit(0.0))
    return inside.join(edges, date).select(date, factor.alias("factor"), "names")


def long_short_factor(z_scores: DataFrame, returns: DataFrame, n_buckets: int = 5, min_names: int = 10) -> DataFrame:
    """Daily factor: names ranked on the scores of the previous trading day.

    If that day has no scores, the latest earlier score date stands in; a day without
    any earlier scores has no factor. ``z_scores(date, ticker, z)``,
    ``returns(date, ticker, ret)``.
    """
    days = returns.select("date").distinct()
    previous = days.withColumn("prev_date", F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    previous = previous.filter("prev_date is not null")
    source = asof_dates(previous, z_scores.select(F.col("date").alias("score_date")), "prev_date", "score_date")
    plan = previous.join(source, "prev_date").filter("score_date is not null").select("date", "score_date")
    scored = plan.join(z_scores.withColumnRenamed("date", "score_date"), "score_date").select("date", "ticker", "z")
    cross = scored.join(returns, ["date", "ticker"])
    spread = bucket_spread(cross, n_buckets=n_buckets, min_names=min_names)
    filled = {"factor": F.coalesce("factor", F.lit(0.0)), "names": F.coalesce("names", F.lit(0))}
    return plan.select("date").join(spread, "date", "left").withColumns(filled)
