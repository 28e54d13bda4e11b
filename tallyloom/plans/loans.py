"""Loan queries: orders play loans, their customers the borrowers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import bands
from tallyloom.operators import boosting, learning, loans
from tallyloom.plans.registry import query
from tallyloom.plans.series import HOURLY_SQL
from tallyloom.session import frozen
from tallyloom.sources.tables import Tables

AS_OF = "2002-01-01"


def raw_loans(t: Tables) -> DataFrame:
    letters = {"1-URGENT": "A", "2-HIGH": "B", "3-MEDIUM": "C", "4-NOT SPECIFIED": "D"}
    years = F.col("o_custkey") % 12
    emp = (
        F.when(years == 0, "< 1 year").when(years == 10, "10+ years").when(years < 10, F.concat(years.cast("string"), F.lit(" years")))
    )
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_totalprice").alias("loan_amnt"),
        F.when(F.col("o_orderstatus") == "F", " 36 months").otherwise(" 60 months").alias("term"),
        F.concat((F.col("o_custkey") % 25).cast("string"), F.lit(".5%")).alias("int_rate"),
        F.coalesce(*[F.when(F.col("o_orderpriority") == k, F.lit(v)) for k, v in letters.items()]).alias("grade"),
        emp.alias("emp_length"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("home_ownership"),
        (F.col("c_acctbal") * 20).alias("annual_inc"),
        F.when(F.col("o_orderstatus") == "F", "Verified").when(F.col("o_orderstatus") == "P", "Source Verified").otherwise("Other").alias("verification_status"),
        F.col("c_nationkey").cast("string").alias("purpose"),
        F.when(F.col("c_acctbal") > 100, (F.col("o_custkey") % 400) / 10).alias("dti"),
        F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%")).alias("revol_util"),
        F.date_add(F.lit("1980-01-01").cast("date"), (F.col("o_custkey") % 5000).cast("int")).alias("earliest_cr_line"),
        F.to_date("o_orderdate").alias("issue_d"),
        F.when(F.col("o_orderstatus") == "O", "Current")
        .when((F.col("o_orderstatus") == "P") & (F.col("c_acctbal") < 5000), "Charged Off")
        .otherwise("Fully Paid")
        .alias("loan_status"),
    )


def prepared(t: Tables) -> DataFrame:
    """Typed loans with a definitive outcome and all derived columns."""
    typed = loans.target(loans.parse(loans.final_outcomes(raw_loans(t))))
    return loans.encode(loans.ratios(typed, AS_OF))


LOAN_SQL = """lo AS (SELECT o_orderkey AS loan_id, o_totalprice AS loan_amnt, CASE WHEN o_orderstatus = 'F' THEN 36.0 ELSE 60.0 END::DOUBLE AS term,
  CAST(o_custkey % 25 + 0.5 AS DOUBLE) AS int_rate, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' WHEN '3-MEDIUM' THEN 'C' WHEN '4-NOT SPECIFIED' THEN 'D' END AS grade,
  CAST(CASE WHEN o_custkey % 12 <= 10 THEN o_custkey % 12 END AS DOUBLE) AS emp_length, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS home_ownership,
  c_acctbal * 20 AS annual_inc, o_orderstatus, CAST(c_nationkey AS VARCHAR) AS purpose, CASE WHEN c_acctbal > 100 THEN (o_custkey % 400) / 10 END AS dti,
  CAST(o_orderkey % 100 AS DOUBLE) AS revol_util, CAST(o_custkey % 5000 AS INTEGER) AS cr_days, CAST(o_orderdate AS DATE) AS issue_d,
  CASE WHEN o_orderstatus = 'O' THEN 'Current' WHEN o_orderstatus = 'P' AND c_acctbal < 5000 THEN 'Charged Off' ELSE 'Fully Paid' END AS loan_status
  FROM orders JOIN customer ON c_custkey = o_custkey),
ln AS (SELECT *, CAST(loan_status = 'Charged Off' AS INTEGER) AS "default",
  CASE WHEN dti <= 10 THEN 'low' WHEN dti <= 20 THEN 'medium' WHEN dti <= 30 THEN 'high' WHEN dti > 30 THEN 'very_high' END AS dti_bucket,
  CASE WHEN revol_util <= 30 THEN 'low' WHEN revol_util <= 60 THEN 'moderate' WHEN revol_util <= 80 THEN 'high' ELSE 'maxed' END AS revol_util_bucket,
  CASE WHEN annual_inc <= 0 THEN NULL WHEN annual_inc <= 40000 THEN '<40k' WHEN annual_inc <= 75000 THEN '40-75k' WHEN annual_inc <= 120000 THEN '75-120k' ELSE '120k+' END AS income_bracket
  FROM lo WHERE loan_status <> 'Current')"""


@query("loan_parse", f"WITH {LOAN_SQL} SELECT loan_id, term, int_rate, emp_length, revol_util FROM lo")
def loan_parse(t: Tables) -> DataFrame:
    return loans.parse(raw_loans(t)).select("loan_id", "term", "int_rate", "emp_length", "revol_util")


@query("loan_filter_outcome", f"WITH {LOAN_SQL} SELECT loan_status, count(*) AS n FROM ln GROUP BY 1")
def loan_filter_outcome(t: Tables) -> DataFrame:
    return loans.final_outcomes(raw_loans(t)).groupBy("loan_status").agg(F.count("*").alias("n"))


@query("loan_target", f'WITH {LOAN_SQL} SELECT "default", count(*) AS n FROM ln GROUP BY 1')
def loan_target(t: Tables) -> DataFrame:
    return loans.target(loans.final_outcomes(raw_loans(t))).groupBy("default").agg(F.count("*").alias("n"))


@query("dti_band", f"WITH {LOAN_SQL} SELECT dti_bucket, count(*) AS n, min(dti) AS lowest, max(dti) AS highest FROM ln GROUP BY 1")
def dti_band(t: Tables) -> DataFrame:
    return prepared(t).groupBy("dti_bucket").agg(F.count("*").alias("n"), F.min("dti").alias("lowest"), F.max("dti").alias("highest"))


@query("revol_band", f"WITH {LOAN_SQL} SELECT revol_util_bucket, count(*) AS n, min(revol_util) AS lowest, max(revol_util) AS highest FROM ln GROUP BY 1")
def revol_band(t: Tables) -> DataFrame:
    return prepared(t).groupBy("revol_util_bucket").agg(F.count("*").alias("n"), F.min("revol_util").alias("lowest"), F.max("revol_util").alias("highest"))


@query("income_band", f"WITH {LOAN_SQL} SELECT income_bracket, count(*) AS n, min(annual_inc) AS lowest, max(annual_inc) AS highest FROM ln GROUP BY 1")
def income_band(t: Tables) -> DataFrame:
    return prepared(t).groupBy("income_bracket").agg(F.count("*").alias("n"), F.min("annual_inc").alias("lowest"), F.max("annual_inc").alias("highest"))


@query("loan_ratios", f"""WITH {LOAN_SQL} SELECT loan_id, round((DATE '{AS_OF}' - (DATE '1980-01-01' + cr_days)) / 365.25, 6) AS credit_hist_years,
  round(annual_inc / greatest(loan_amnt, 1), 8) AS income_to_loan FROM ln""")
def loan_ratios(t: Tables) -> DataFrame:
    return prepared(t).select("loan_id", F.round("credit_hist_years", 6).alias("credit_hist_years"), F.round("income_to_loan", 8).alias("income_to_loan"))


@query("ordinal_maps", f"""WITH {LOAN_SQL} SELECT CASE grade WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 ELSE 4 END AS grade_num,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS verification_num, count(*) AS n FROM lo GROUP BY 1, 2""")
def ordinal_maps(t: Tables) -> DataFrame:
    raw = raw_loans(t)
    return raw.groupBy(bands.grade_number("grade").alias("grade_num"), bands.verification_number("verification_status").alias("verification_num")).agg(F.count("*").alias("n"))


@query("agg_default_by_grade", f'WITH {LOAN_SQL} SELECT grade, round(avg("default"), 8) AS default_rate, count(*) AS loan_count FROM ln WHERE grade IS NOT NULL GROUP BY 1')
def agg_default_by_grade(t: Tables) -> DataFrame:
    out = loans.default_rates(prepared(t), "grade")
    return out.select("grade", F.round("default_rate", 8).alias("default_rate"), "loan_count")


@query("agg_default_by_dti_income", f"""WITH {LOAN_SQL} SELECT dti_bucket, income_bracket, round(avg("default"), 8) AS default_rate, count(*) AS loan_count
FROM ln WHERE dti_bucket IS NOT NULL AND income_bracket IS NOT NULL GROUP BY 1, 2""")
def agg_default_by_dti_income(t: Tables) -> DataFrame:
    out = loans.default_rates(prepared(t), "dti_bucket", "income_bracket")
    return out.select("dti_bucket", "income_bracket", F.round("default_rate", 8).alias("default_rate"), "loan_count")


@query("agg_default_by_month", f"""WITH {LOAN_SQL} SELECT CAST(date_trunc('month', issue_d) AS DATE) AS month, round(avg("default"), 8) AS default_rate, count(*) AS loan_count FROM ln GROUP BY 1""")
def agg_default_by_month(t: Tables) -> DataFrame:
    out = loans.default_rates(prepared(t), F.trunc("issue_d", "month").alias("month"))
    return out.select("month", F.round("default_rate", 8).alias("default_rate"), "loan_count")


@query("agg_mode_median_impute", f"""WITH {LOAN_SQL}, fm AS (SELECT (SELECT median(dti) FROM ln) AS dti_m, (SELECT median(emp_length) FROM ln) AS emp_m,
  (SELECT grade FROM ln WHERE grade IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, grade LIMIT 1) AS g_m,
  (SELECT home_ownership FROM ln WHERE home_ownership IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, home_ownership LIMIT 1) AS h_m)
SELECT loan_id, coalesce(dti, dti_m) AS dti, coalesce(emp_length, emp_m) AS emp_length, coalesce(grade, g_m) AS grade, coalesce(home_ownership, h_m) AS home_ownership FROM ln, fm""")
def agg_mode_median_impute(t: Tables) -> DataFrame:
    out = loans.impute(prepared(t), ["dti", "emp_length"], ["grade", "home_ownership"])
    return out.select("loan_id", "dti", "emp_length", "grade", "home_ownership")


@query("agg_topn_lump", f"""WITH {LOAN_SQL}, tp AS (SELECT purpose FROM ln GROUP BY 1 ORDER BY count(*) DESC, purpose LIMIT 8)
SELECT CASE WHEN purpose IN (SELECT purpose FROM tp) THEN purpose ELSE 'OTHER' END AS purpose, count(*) AS n FROM ln GROUP BY 1""")
def agg_topn_lump(t: Tables) -> DataFrame:
    return loans.lump(prepared(t), "purpose", 8).groupBy("purpose").agg(F.count("*").alias("n"))


@query("ml_onehot_drop_first", """SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O", CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""")
def ml_onehot_drop_first(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return learning.dummies(orders, "o_orderstatus", learning.levels(orders, "o_orderstatus")).drop("o_orderstatus")


SPLIT_SQL = f"""{LOAN_SQL}, hs AS (SELECT loan_id, "default", CAST('0x' || substr(md5(loan_id || ':42'), 1, 15) AS BIGINT) AS h FROM ln),
rk AS (SELECT *, row_number() OVER (PARTITION BY "default" ORDER BY h) AS r, count(*) OVER (PARTITION BY "default") AS n FROM hs)"""


@query("ml_stratified_split", f'WITH {SPLIT_SQL} SELECT loan_id, "default", r <= floor(n * 0.2) AS is_test FROM rk')
def ml_stratified_split(t: Tables) -> DataFrame:
    return learning.stratified_split(prepared(t), "default", "loan_id").select("loan_id", "default", "is_test")


# Term and verification follow from the order status, which also decides the outcome here, so they stay out.
NUMERIC = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_util", "grade_num", "emp_length", "credit_hist_years", "income_to_loan"]
CATEGORICAL = ["home_ownership", "purpose"]


def training(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Imputed and lumped loans, split by outcome class: the training rows, and all rows."""
    # Every fill value and split point passes over the rows; the written copies are read instead of the joins.
    typed = frozen(prepared(t).select("loan_id", "default", *[F.col(c).cast("double").alias(c) for c in NUMERIC], *CATEGORICAL))
    table = loans.lump(loans.lump(loans.impute(typed, NUMERIC, CATEGORICAL), "home_ownership", 4), "purpose", 8)
    split = frozen(learning.stratified_split(table, "default", "loan_id"))
    return split.filter("not is_test"), split


_FITTED: dict[tuple, object] = {}


def fitted(t: Tables, kind: str):
    """``(model, all rows)`` of one scale folder; a session fits each model once."""
    key = (t.spark.sparkContext.applicationId, t.root, kind)
    if key not in _FITTED:
        train, table = training(t)
        fit = {"logistic": learning.fit_logistic, "boosted": fit_boosted}[kind]
        _FITTED[key] = (fit(train, "default", NUMERIC, CATEGORICAL), table)
    return _FITTED[key]


def with_dummies(df: DataFrame, features: list[str]) -> DataFrame:
    """The 0/1 columns among ``features``, named ``label_v_level``."""
    parted = [(f, *f.split("_v_", 1)) for f in features if "_v_" in f]
    return df.withColumns({f: (F.col(c) == level).cast("double") for f, c, level in parted})


def fit_boosted(train: DataFrame, label: str, numeric: list[str], categorical: list[str], trees: int = 200, depth: int = 5) -> boosting.Boosted:
    """``learning.fit_boosted`` over binned blocks: the same trees up to where cuts lie, without a row of features per loan."""
    flags = [f"{c}_v_{level}" for c in categorical for level in learning.levels(train, c)[1:]]
    cuts = [*boosting.quantile_cuts(train, numeric, 32), *[np.array([0.5])] * len(flags)]
    rows = with_dummies(learning.class_weights(train, label), flags)
    return boosting.fit_boosted_trees(
        rows, label, [*numeric, *flags], key="loan_id", loss="residual", trees=trees, depth=depth, penalty=0.0, least=1e-9, weight="weight", cuts=cuts
    )


def measures(scored: DataFrame) -> DataFrame:
    return learning.auc(scored, "default", "p").withColumn("accuracy", learning.accuracy(scored, "default", "predicted").select("accuracy").scalar())


def held_out_measures(t: Tables, kind: str) -> DataFrame:
    model, table = fitted(t, kind)
    return measures(learning.score_all(model, table).filter("is_test"))


def boosted_measures(model: boosting.Boosted, table: DataFrame) -> DataFrame:
    held_out = with_dummies(table.filter("is_test"), model.features)
    scored = boosting.boosted_scores(model, held_out).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))
    return measures(frozen(scored.select("default", "p", "predicted"), "boosted"))


def feature_importance(t: Tables, top: int | None = None) -> DataFrame:
    model, _ = fitted(t, "boosted")
    rows = sorted(model.gain_importance().items(), key=lambda r: (-r[1], r[0]))
    return t.spark.createDataFrame(rows[:top] if top else rows, "feature string, importance double")


def model_columns(df: DataFrame) -> DataFrame:
    return df.select("loan_id", "default", "is_test", F.round("p", 6).alias("p"), "predicted")


@query("ml_logistic")
def ml_logistic(t: Tables) -> DataFrame:
    """Logistic model: exact AUC and accuracy on the held-out loans."""
    return held_out_measures(t, "logistic")


@query("ml_calibration", f"""WITH {SPLIT_SQL} SELECT r <= floor(n * 0.2) AS is_test, count(*) AS loans, CAST(sum("default") AS BIGINT) AS defaults,
  CASE WHEN r <= floor(n * 0.2) THEN NULL ELSE CAST(sum("default") AS DOUBLE) END AS expected FROM rk GROUP BY r <= floor(n * 0.2)""")
def ml_calibration(t: Tables) -> DataFrame:
    """Split and label totals; on the training rows an unpenalised logistic fit expects as many defaults as there are."""
    model, table = fitted(t, "logistic")
    sums = learning.score_all(model, table).groupBy("is_test").agg(
        F.count("*").alias("loans"), F.sum("default").alias("defaults"), F.round(F.sum("p"), 2).alias("total")
    )
    return sums.select("is_test", "loans", "defaults", F.when(~F.col("is_test"), F.col("total")).alias("expected"))


@query("ml_boosted_cls")
def ml_boosted_cls(t: Tables) -> DataFrame:
    """Boosted trees: exact AUC and accuracy on the held-out loans."""
    return boosted_measures(*fitted(t, "boosted"))


@query("ml_boosted_newton")
def ml_boosted_newton(t: Tables) -> DataFrame:
    """Second-order boosted trees, positives weighted up: exact AUC and accuracy on the held-out loans. Numeric features only."""
    train, table = training(t)
    weighted = learning.class_weights(train, "default")
    model = boosting.fit_boosted_trees(weighted, "default", NUMERIC, key="loan_id", trees=60, subsample=0.8, weight="weight")
    return boosted_measures(model, table)


SPLIT_CUTS = {"loan_amnt": [50_000.0, 100_000.0, 150_000.0, 200_000.0, 250_000.0], "dti": [5.0, 10.0, 20.0, 30.0], "revol_util": [25.0, 50.0, 75.0]}
_REACHED = ", ".join(
    f"""{{'feature': {f}, 'bin': CASE WHEN {c} IS NULL THEN 0 ELSE 1 + {" + ".join(f"CAST({c} >= {v} AS INTEGER)" for v in cuts)} END}}"""
    for f, (c, cuts) in enumerate(SPLIT_CUTS.items())
)


@query("ml_split_sums", f"""WITH {LOAN_SQL}, s AS (SELECT "default", unnest([{_REACHED}]) AS x FROM ln)
SELECT CAST(x.feature AS BIGINT) AS feature, CAST(x.bin AS BIGINT) AS bin, sum(0.5::DOUBLE - "default") AS g, sum(0.25::DOUBLE) AS h, count(*) AS n FROM s GROUP BY 1, 2""")
def ml_split_sums(t: Tables) -> DataFrame:
    """What the root of the first boosted tree is split by: gradient and hessian sums per feature and bin over all loans."""
    features = list(SPLIT_CUTS)
    model = boosting.Boosted(features, [np.array(c) for c in SPLIT_CUTS.values()], "logistic", 0.0)
    rows = boosting.prepared_rows(prepared(t), "default", features, "loan_id", None, 0.0)
    return boosting.split_sums(rows, model, [], boosting.Tree.empty(1), [0], (0, 1.0)).drop("node")


@query("ml_score_all")
def ml_score_all(t: Tables) -> DataFrame:
    """Every loan with its probability and thresholded label."""
    model, table = fitted(t, "logistic")
    return model_columns(learning.score_all(model, table))


@query("ml_score_rows", f'WITH {SPLIT_SQL} SELECT loan_id, "default", r <= floor(n * 0.2) AS is_test, true AS scored FROM rk')
def ml_score_rows(t: Tables) -> DataFrame:
    """Keys, labels and split of the scored table: every loan once, with a probability."""
    model, table = fitted(t, "logistic")
    return learning.score_all(model, table).select("loan_id", "default", "is_test", F.col("p").between(0, 1).alias("scored"))


@query("ml_importance")
def ml_importance(t: Tables) -> DataFrame:
    """Features by importance in the boosted model."""
    return feature_importance(t)


@query("topk_features")
def topk_features(t: Tables) -> DataFrame:
    """The five most important features."""
    return feature_importance(t, top=5)


def label_scores(t: Tables) -> DataFrame:
    """Document quality labels with text length as the score: many ties, many rows."""
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("predicted", (F.col("n_chars") >= 1000).cast("int"))


LABEL_SQL = """ls AS (SELECT quality, CAST(n_chars AS DOUBLE) AS score, CAST(n_chars >= 1000 AS INTEGER) AS predicted FROM labels JOIN documents USING (doc_id)),
tot AS (SELECT count(CASE WHEN quality = 1 THEN 1 END) AS p, count(CASE WHEN quality = 0 THEN 1 END) AS n FROM ls)"""


@query("ml_auc", f"""WITH {LABEL_SQL}, rk AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM ls)
SELECT round((sum(CASE WHEN quality = 1 THEN r END) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(n)), 8) AS auc, max(p) AS positives, max(n) AS negatives FROM rk, tot""")
def ml_auc(t: Tables) -> DataFrame:
    out = learning.auc(label_scores(t), "quality", "n_chars")
    return out.select(F.round("auc", 8).alias("auc"), "positives", "negatives")


@query("ml_roc", f"""WITH {LABEL_SQL}, c AS (SELECT score, count(CASE WHEN quality = 1 THEN 1 END) AS pos, count(CASE WHEN quality = 0 THEN 1 END) AS neg FROM ls GROUP BY 1)
SELECT score AS threshold, round(sum(neg) OVER (ORDER BY score DESC) / (SELECT n FROM tot), 8) AS fpr, round(sum(pos) OVER (ORDER BY score DESC) / (SELECT p FROM tot), 8) AS tpr FROM c""")
def ml_roc(t: Tables) -> DataFrame:
    out = learning.roc(label_scores(t), "quality", "n_chars")
    return out.select("threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


@query("ml_confusion", f"WITH {LABEL_SQL} SELECT quality AS actual, predicted, count(*) AS n FROM ls GROUP BY 1, 2")
def ml_confusion(t: Tables) -> DataFrame:
    return learning.confusion(label_scores(t), "quality", "predicted")


@query("ml_accuracy", f"WITH {LABEL_SQL} SELECT round(avg(CAST(quality = predicted AS DOUBLE)), 8) AS accuracy, count(*) AS n FROM ls")
def ml_accuracy(t: Tables) -> DataFrame:
    return learning.accuracy(label_scores(t), "quality", "predicted").select(F.round("accuracy", 8).alias("accuracy"), "n")


@query("ml_class_report", f"""WITH {LABEL_SQL}, c AS (SELECT unnest([0, 1]) AS cls)
SELECT cls, round(count(CASE WHEN quality = cls AND predicted = cls THEN 1 END) / nullif(count(CASE WHEN predicted = cls THEN 1 END), 0), 8) AS precision,
  round(count(CASE WHEN quality = cls AND predicted = cls THEN 1 END) / nullif(count(CASE WHEN quality = cls THEN 1 END), 0), 8) AS recall,
  round(2 * count(CASE WHEN quality = cls AND predicted = cls THEN 1 END) / (count(CASE WHEN quality = cls THEN 1 END) + count(CASE WHEN predicted = cls THEN 1 END)), 8) AS f1,
  count(CASE WHEN quality = cls THEN 1 END) AS support FROM ls, c GROUP BY 1""")
def ml_class_report(t: Tables) -> DataFrame:
    out = learning.class_report(label_scores(t), "quality", "predicted")
    return out.select("cls", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


def demand_features(t: Tables) -> DataFrame:
    from tallyloom.functions.calendar import calendar_features
    from tallyloom.operators import series as ops
    from tallyloom.plans import series

    base = series.filled(t)
    lagged = ops.lags(base, keys=series.KEY, order=series.TS, value="value", steps=[1, 24, 168])
    rolled = ops.rolling_before(lagged, keys=series.KEY, order=series.TS, value="value", n=24)
    return rolled.withColumns(calendar_features("ts")).na.drop()


DEMAND = ["hour_of_day", "day_of_week", "is_weekend", "lag_1", "lag_24", "lag_168", "rolling_24_mean", "rolling_24_std"]


def demand_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Training rows, and the last week: three months, the default, do not fit thirty days of events."""
    table = frozen(demand_features(t))
    cut = table.agg((F.max("ts") - F.expr("interval 7 days")).alias("c")).scalar()
    return table.filter(F.col("ts") < cut), table.filter(F.col("ts") >= cut)


def demand_model(t: Tables, train: DataFrame, label: str, features: list[str]):
    """The boosted regression on some features; a session fits each choice once."""
    key = (t.spark.sparkContext.applicationId, t.root, *features)
    if key not in _FITTED:
        _FITTED[key] = learning.fit_boosted_regression(train, label, features)
    return _FITTED[key]


@query("ml_gbt_reg")
def ml_gbt_reg(t: Tables) -> DataFrame:
    """Boosted regression on the hourly series: errors of the held-out week."""
    from tallyloom.operators.series import forecast_errors

    train, test = demand_split(t)
    predicted = demand_model(t, train, "value", DEMAND).transform(test)
    return forecast_errors(predicted, "value", "prediction")


@query("ml_ablation_lags")
def ml_ablation_lags(t: Tables) -> DataFrame:
    """Errors with and without the lag features."""
    train, test = demand_split(t)
    return learning.ablation(train, test, "value", DEMAND, ["lag_1", "lag_24", "lag_168"], lambda *args: demand_model(t, *args))


SPECTRAL = [f"spectral_{r}_{f}" for r in (1, 2, 3) for f in ("sin", "cos")]


def spectral_split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The demand rows with the spectral features of their series, the components read from the training rows alone.

    Every series keeps its rows: one without components has features of 0.
    """
    from tallyloom.operators import series as ops
    from tallyloom.plans import series

    train, test = demand_split(t)
    cut = test.agg(F.min("ts")).scalar()
    base = series.filled(t)
    parts = ops.full_periodogram(base.filter(F.col("ts") < cut), keys=series.KEY, order=series.TS, value="value", top=3)
    waves = ops.spectral_features(base.select(*series.KEY, series.TS), parts, keys=series.KEY, order=series.TS, top=3)
    both = frozen(train.unionByName(test).join(waves, [*series.KEY, series.TS], "left").na.fill(0.0, subset=SPECTRAL), "spectral")
    return both.filter(F.col("ts") < cut), both.filter(F.col("ts") >= cut)


@query("ml_ablation")
def ml_ablation(t: Tables) -> DataFrame:
    """Errors with all features and without the spectral group."""
    train, test = spectral_split(t)
    out = learning.ablation(train, test, "value", [*DEMAND, *SPECTRAL], SPECTRAL, lambda *args: demand_model(t, *args))
    return out.withColumn("variant", F.concat("variant", F.lit(" spectral features")))


@query("ml_spectral_rows", f"""WITH {HOURLY_SQL}, lg AS (SELECT event_type, ts, value, lag(value, 168) OVER (PARTITION BY event_type ORDER BY ts) AS l FROM filled), k AS (SELECT * FROM lg WHERE l IS NOT NULL)
SELECT event_type, ts >= (SELECT max(ts) FROM k) - INTERVAL 7 DAYS AS is_test, count(*) AS hours, count(DISTINCT ts) AS ticks, count(*) AS with_waves FROM k GROUP BY 1, 2""")
def ml_spectral_rows(t: Tables) -> DataFrame:
    """The rows that the spectral ablation learns from and is measured on: nothing lost, nothing doubled by the join."""
    parts = [df.withColumn("is_test", F.lit(held)) for df, held in zip(spectral_split(t), (False, True))]
    waves = F.expr(" + ".join(f"abs({c})" for c in SPECTRAL))
    return parts[0].unionByName(parts[1]).groupBy("event_type", "is_test").agg(
        F.count("*").alias("hours"), F.countDistinct("ts").alias("ticks"), F.count_if(waves > 0).alias("with_waves")
    )
