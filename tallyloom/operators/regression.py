"""Least squares over grouped tables.

Rows are reduced to the moments X'X and X'y by ordinary partial aggregation; only
those K x K sums per group reach Python, in Arrow batches, to be solved. The rows of a
group are never gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def _terms(xs: list[str]) -> list[Column]:
    return [F.lit(1.0)] + [F.col(x).cast("double") for x in xs]


def _moments(y: str, xs: list[str], over=None) -> dict[str, Column]:
    """``xx`` (upper triangle), ``xy``, ``yy`` and ``n`` as sums, optionally over a window."""
    cols, target = _terms(xs), F.col(y).cast("double")
    k = len(cols)

    def total(expr: Column) -> Column:
        return F.sum(expr) if over is None else F.sum(expr).over(over)

    out = {f"_xx_{i}_{j}": total(cols[i] * cols[j]) for i in range(k) for j in range(i, k)}
    out |= {f"_xy_{i}": total(cols[i] * target) for i in range(k)}
    out["_yy"] = total(target * target)
    return out


def _matrices(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            xx[:, i, j] = xx[:, j, i] = pdf[f"_xx_{i}_{j}"].to_numpy(float)
    xy = np.stack([pdf[f"_xy_{i}"].to_numpy(float) for i in range(k)], axis=1)
    return xx, xy


def _solve(xx: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse of X'X per row; NaN where the matrix is singular."""
    n, k = xy.shape
    beta, inverse = np.full((n, k), np.nan), np.full((n, k, k), np.nan)
    for r in range(n):
        if np.isfinite(xx[r]).all():
            scale = np.sqrt(np.diag(xx[r]))
            if (scale > 0).all():
                unit = xx[r] / np.outer(scale, scale)
                if np.linalg.cond(unit) < 1e12:
                    inverse[r] = np.linalg.inv(unit) / np.outer(scale, scale)
                    beta[r] = inverse[r] @ xy[r]
    return beta, inverse


def normal_p(t: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(t) / math.sqrt(2.0)) if math.isfinite(t) else math.nan


def student_p(t: float, dof: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or dof <= 0:
        return math.nan
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def _known(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    return df.na.drop(subset=[y, *xs])


def _fit_frame(moments: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per group: coefficients, inverse of X'X (row by row) and residual sums, from moments."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xx, xy = _matrices(pdf, k)
            beta, inverse = _solve(xx, xy)
            yy, n = pdf["_yy"].to_numpy(float), pdf["_n"].to_numpy(float)
            ssr = np.maximum(yy - np.einsum("ri,ri->r", beta, xy), 0.0)
            sst = yy - xy[:, 0] ** 2 / n
            out = pdf[keys].copy()
            out["_n"] = pdf["_n"]
            out["_beta"] = list(beta)
            out["_inverse"] = list(inverse.reshape(len(pdf), k * k))
            out["_ssr"] = ssr
            out["_sst"] = sst
            yield out

    types = dict(moments.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys])
    schema += ", _n bigint, _beta array<double>, _inverse array<double>, _ssr double, _sst double"
    return moments.mapInPandas(solve, schema)


def ols(df: DataFrame, *, keys: list[str], y: str, xs: list[str], order: str | None = None, hac_lags: int | None = None) -> DataFrame:
    """One row per group and term: coefficient, standard error, t, p; with R2, n and residual sums.

    Without ``hac_lags`` errors are classical and p-values Student's. With it they are
    robust to autocorrelation over that many lags in ``order`` (Bartlett weights, no
    small-sample correction) and p-values normal. The term ``const`` is the intercept.
    """
    names, k = ["const", *xs], len(xs) + 1
    known = _known(df, y, xs)
    moments = known.groupBy(*keys).agg(F.count("*").alias("_n"), *[c.alias(n) for n, c in _moments(y, xs).items()])
    fit = _fit_frame(moments, keys, k)
    if hac_lags is None:
        spread = fit.withColumn("_meat", F.array().cast("array<double>"))
    else:
        if order is None:
            raise ValueError("autocorrelation-robust errors need an order column")
        spread = fit.join(_hac_meat(known, fit, keys, y, xs, order, hac_lags), keys)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                rec = dict(zip(pdf.columns, row))
                beta = np.asarray(rec["_beta"], float)
                inverse = np.asarray(rec["_inverse"], float).reshape(k, k)
                n, ssr, sst = rec["_n"], rec["_ssr"], rec["_sst"]
                if hac_lags is None:
                    cov = inverse * (ssr / (n - k) if n > k else np.nan)
                else:
                    cov = inverse @ np.asarray(rec["_meat"], float).reshape(k, k) @ inverse
                se = np.sqrt(np.maximum(np.diag(cov), 0.0))
                for i, name in enumerate(names):
                    t = beta[i] / se[i] if se[i] > 0 else math.nan
                    p = normal_p(t) if hac_lags is not None else student_p(t, n - k)
                    rows.append(
                        [rec[c] for c in keys] + [name, beta[i], se[i], t, p, 1 - ssr / sst if sst > 0 else math.nan, n, ssr]
                    )
            yield pd.DataFrame(rows, columns=[*keys, "term", "coef", "se", "t", "p", "r2", "n", "ssr"])

    types = dict(spread.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["term string", "coef double", "se double", "t double"])
    return spread.mapInPandas(finish, f"{schema}, p double, r2 double, n bigint, ssr double")


def _hac_meat(known: DataFrame, fit: DataFrame, keys: list[str], y: str, xs: list[str], order: str, lags: int) -> DataFrame:
    """Weighted sums of u(t) u(t-l)' per group, with u = x * residual, as a flat array."""
    k = len(xs) + 1
    terms = _terms(xs)
    joined = known.join(fit.select(*keys, "_beta"), keys)
    residual = F.col(y).cast("double") - sum((terms[i] * F.col("_beta")[i] for i in range(1, k)), F.col("_beta")[0])
    scored = joined.withColumn("_e", residual).select(*keys, order, *[(terms[i] * F.col("_e")).alias(f"_u{i}") for i in range(k)])
    spec = Window.partitionBy(*keys).orderBy(order)
    lagged = scored.withColumns({f"_u{i}_{l}": F.lag(f"_u{i}", l).over(spec) for i in range(k) for l in range(1, lags + 1)})
    cells = []
    for i in range(k):
        for j in range(k):
            value = F.sum(F.col(f"_u{i}") * F.col(f"_u{j}"))
            for l in range(1, lags + 1):
                weight = 1 - l / (lags + 1)
                pair = F.col(f"_u{i}") * F.col(f"_u{j}_{l}") + F.col(f"_u{i}_{l}") * F.col(f"_u{j}")
                value = value + F.lit(weight) * F.coalesce(F.sum(pair), F.lit(0.0))
            cells.append(value)
    return lagged.groupBy(*keys).agg(F.array(*cells).alias("_meat"))


def capm(df: DataFrame, *, keys: list[str], order: str, excess: str = "excess", market: str = "mkt_rf", hac_lags: int = 5) -> DataFrame:
    """Annualised alpha and beta on the market, with robust t and p, one row per group."""
    return factor_model(df, keys=keys, order=order, excess=excess, factors=[market], hac_lags=hac_lags)


def factor_model(df: DataFrame, *, keys: list[str], order: str, excess: str, factors: list[str], hac_lags: int = 5) -> DataFrame:
    """Factor regression turned to one row per group; the intercept is annualised."""
    fit = ols(df, keys=keys, y=excess, xs=factors, order=order, hac_lags=hac_lags)

    def at(term: str, column: str) -> Column:
        return F.max(F.when(F.col("term") == term, F.col(column)))

    cols = [(at("const", "coef") * TRADING_DAYS).alias("alpha"), at("const", "t").alias("alpha_t"), at("const", "p").alias("alpha_p")]
    for f in factors:
        cols += [at(f, "coef").alias(f"{f}_beta"), at(f, "t").alias(f"{f}_t"), at(f, "p").alias(f"{f}_p")]
    return fit.groupBy(*keys).agg(*cols, F.max("r2").alias("r2"), F.max("n").alias("n"))


def rolling_ols(df: DataFrame, *, keys: list[str], order: str, y: str, xs: list[str], window: int = 120) -> DataFrame:
    """Coefficients from the ``window`` rows before each row; rows with a short or singular window are left out.

    The moments are windowed sums; the solve runs on Arrow batches of moments.
    """
    k = len(xs) + 1
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-window, -1)
    known = _known(df, y, xs)
    summed = known.select(*keys, order, F.count("*").over(frame).alias("_n"), *[c.alias(n) for n, c in _moments(y, xs, frame).items()])
    full = summed.filter(F.col("_n") == window)
    names = ["alpha", *[f"{x}_beta" for x in xs]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            beta, _ = _solve(*_matrices(pdf, k))
            out = pdf[[*keys, order]].copy()
            for i, name in enumerate(names):
                out[name] = beta[:, i] * (TRADING_DAYS if i == 0 else 1)
            yield out[np.isfinite(beta).all(axis=1)]

    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in [*keys, order]] + [f"`{n}` double" for n in names])
    return full.mapInPandas(solve, schema)


def incremental_f(df: DataFrame, *, keys: list[str], y: str, base: list[str], added: str) -> DataFrame:
    """Gain in R2 and F-test of adding one regressor; with one restriction F is t squared."""
    known = _known(df, y, [*base, added])
    small = ols(known, keys=keys, y=y, xs=base).filter("term = 'const'").select(*keys, F.col("r2").alias("r2_base"))
    large = ols(known, keys=keys, y=y, xs=[*base, added]).filter(F.col("term") == added)
    large = large.select(*keys, F.col("r2").alias("r2_with"), (F.col("t") * F.col("t")).alias("f_stat"), F.col("p").alias("f_p"))
    joined = small.join(large, keys) if keys else small.withColumn("_g", F.lit(0)).join(large.withColumn("_g", F.lit(0)), "_g").drop("_g")
    return joined.withColumn("delta_r2", F.col("r2_with") - F.col("r2_base"))


def drivers(df: DataFrame, *, y: str, categories: list[str], flags: list[str]) -> DataFrame:
    """Regression on category dummies and numeric flags, ranked by absolute effect.

    The first level of each category in order is the baseline. Uses the library's
    one-pass weighted normal-equation solver, which sums partial matrices per partition.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from tallyloom.functions.bands import significance_stars

    known = df.na.drop(subset=[y, *categories, *flags])
    typed = known.select(
        F.col(y).cast("double").alias(y),
        *[F.col(c).cast("string").alias(c) for c in categories],
        *[F.col(f).cast("double").alias(f) for f in flags],
    )
    stages = [
        StringIndexer(inputCols=categories, outputCols=[f"{c}_i" for c in categories], stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], dropLast=True),
        VectorAssembler(inputCols=[*[f"{c}_v" for c in categories], *flags], outputCol="_x"),
    ]
    prepared = Pipeline(stages=stages).fit(typed)
    names: list[str] = []
    for c, labels in zip(categories, prepared.stages[0].labelsArray):
        names += [f"{c}[{label}]" for label in labels[:-1]]
    names += flags
    model = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(prepared.transform(typed))
    effects = [float(v) for v in model.coefficients]
    rows = list(zip(names, effects, [float(p) for p in model.summary.pValues[: len(effects)]]))
    ranked = df.sparkSession.createDataFrame(
        [(*row, float(model.summary.r2)) for row in rows], "driver string, effect double, p_value double, r2 double"
    )
    return ranked.withColumn("sig", significance_stars("p_value")).orderBy(F.abs("effect").desc(), "driver")
