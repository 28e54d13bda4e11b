"""Feature assembly, splits, models and exact evaluation measures."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ordered import range_bucket, running, value_at_rank
from tallyloom.operators.series import forecast_errors
from tallyloom.session import frozen

#: Rows of one range that a task sorts, about.
BUCKET_ROWS = 1_000_000


def one_hot(categorical: list[str]) -> list:
    """Stages that turn labels into dummies, the alphabetically first label dropped."""
    return [
        # Without a slot for unknown labels, the one dropped is the alphabetically first; rare and unseen labels are lumped before.
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], stringOrderType="alphabetDesc"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical]),
    ]


def levels(df: DataFrame, column: str) -> list[str]:
    """The labels a column holds, alphabetically; nulls are none."""
    return list(StringIndexer(inputCol=column, outputCol="_i", stringOrderType="alphabetAsc").fit(df.select(column).na.drop()).labels)


def dummies(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """0/1 columns for every level but the first of ``levels``."""
    return df.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in levels[1:]})


def _hash60(key: str, seed: int) -> Column:
    """Reproducible 60-bit hash of a key, the same on every run and cluster."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the same share of each class, chosen by hash order.

    The cut of each class is an exact order statistic of the hash, so no class is
    sorted in one task and a rerun gives the same split.
    """
    hashed = df.withColumn("_h", _hash60(key, seed))
    take = F.floor(F.col("n") * F.lit(test_share))
    cut = value_at_rank(hashed.select(label, "_h"), keys=[label], value="_h", rank=take, near=test_share, out="_cut", few_keys=True)
    # One row per class; a shuffle by class would bring a whole class to one task.
    joined = hashed.join(F.broadcast(cut.select(label, "_cut")), label, "left")
    return joined.withColumn("is_test", F.coalesce(F.col("_h") < F.col("_cut"), F.lit(False))).drop("_h", "_cut")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of positives ``n_neg / n_pos``, of negatives 1."""
    ratio = df.agg(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))).scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, F.coalesce(ratio, F.lit(1.0))).otherwise(F.lit(1.0)))


def _assembled(numeric: list[str], categorical: list[str]) -> list:
    stages = one_hot(categorical) if categorical else []
    return [*stages, VectorAssembler(inputCols=[*numeric, *[f"{c}_v" for c in categorical]], outputCol="features", handleInvalid="keep")]


def fit_logistic(train: DataFrame, label: str, numeric: list[str], categorical: list[str] | None = None) -> PipelineModel:
    model = LogisticRegression(labelCol=label, maxIter=100)
    return Pipeline(stages=[*_assembled(numeric, categorical or []), model]).fit(train)


def fit_boosted(
    train: DataFrame, label: str, numeric: list[str], categorical: list[str] | None = None, trees: int = 200, depth: int = 5
) -> PipelineModel:
    """Boosted trees with positives weighted up to balance the classes."""
    model = GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, weightCol="weight", seed=42, cacheNodeIds=True)
    return Pipeline(stages=[*_assembled(numeric, categorical or []), model]).fit(class_weights(train, label))


def fit_boosted_regression(train: DataFrame, label: str, numeric: list[str], trees: int = 300, depth: int = 5) -> PipelineModel:
    model = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[*_assembled(numeric, []), model]).fit(train)


def score_all(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability of the positive class and the thresholded label for every row."""
    ready = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
    p = vector_to_array("probability")[1]
    out = model.transform(ready).withColumn("p", p).withColumn("predicted", (p >= threshold).cast("int"))
    return out.drop("rawPrediction", "probability", "prediction", "features", "weight")


def importance(model: PipelineModel, df: DataFrame, top: int | None = None) -> DataFrame:
    """Features by importance."""
    values = model.stages[-1].featureImportances.toArray()
    names = _feature_names(model, df)
    rows = sorted(zip(names, (float(v) for v in values)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows[:top] if top else rows, "feature string, importance double")


def _feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    ready = df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0))
    meta = model.transform(ready.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
    found = [a for group in meta.values() for a in group]
    return [a["name"] for a in sorted(found, key=lambda a: a["idx"])]


def _by_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, the highest score first in ``_o``."""
    known = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _ranked(scored: DataFrame, label: str, score: str, n_buckets: int) -> DataFrame:
    """Running positives and negatives from the highest score down.

    Equal scores are collapsed first. The running sums go by score ranges of similar
    size, so the global order needs no single-task sort.
    """
    # Checkpointed: a model score recomputed in another pass may differ in its last bits.
    cells = frozen(_by_score(scored, label, score).withColumn("_o", -F.col("score")))
    buckets = max(n_buckets, math.ceil(cells.count() / BUCKET_ROWS))
    bucketed = cells.withColumn("_b", range_bucket(cells, "_o", buckets, min(0.005, 0.25 / buckets)))
    keyed = bucketed.withColumn("_g", F.lit(0))
    return running(keyed, keys=["_g"], bucket="_b", order=["_o"], aggs={"tp": ("sum", "pos"), "fp": ("sum", "neg")}).drop("_g", "_b")


def auc(scored: DataFrame, label: str, score: str, n_buckets: int = 64) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half. Exact, one row."""
    cells = _ranked(scored, label, score, n_buckets)
    above = F.col("tp") - F.col("pos")
    area = cells.agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("_a"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    return area.select(F.try_divide("_a", F.col("positives") * F.col("negatives")).alias("auc"), "positives", "negatives")


def roc(scored: DataFrame, label: str, score: str, n_buckets: int = 64) -> DataFrame:
    """One point per distinct score: threshold, false and true positive rate."""
    cells = _ranked(scored, label, score, n_buckets)
    p, n = cells.agg(F.max("tp")).scalar(), cells.agg(F.max("fp")).scalar()
    return cells.select(
        F.col("score").alias("threshold"), F.try_divide(F.col("fp"), n).alias("fpr"), F.try_divide(F.col("tp"), p).alias("tpr")
    )


def confusion(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted)."""
    return scored.groupBy(F.col(label).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    pair = F.explode(
        F.array(
            F.struct(F.col(label).alias("cls"), F.lit(1).alias("is_actual"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")),
            F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("is_actual"), F.lit(0).alias("hit")),
        )
    )
    sums = scored.select(pair.alias("r")).groupBy("r.cls").agg(
        F.sum("r.hit").alias("tp"), F.sum("r.is_actual").alias("support"), F.sum(1 - F.col("r.is_actual")).alias("predicted")
    )
    precision, recall = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    f1 = F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return sums.select("cls", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy(scored: DataFrame, label: str, predicted: str) -> DataFrame:
    return scored.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def ablation(train: DataFrame, test: DataFrame, label: str, features: list[str], drop_group: list[str], fit=None) -> DataFrame:
    """Errors with and without a group of features, and the change in RMSE.

    ``fit(train, label, features)`` returns a model with a ``prediction`` column.
    """
    fit = fit or fit_boosted_regression
    kept = [f for f in features if f not in drop_group]
    parts = []
    for name, used in (("with", features), ("without", kept)):
        predicted = fit(train, label, used).transform(test)
        parts.append(forecast_errors(predicted, label, "prediction").select(F.lit(name).alias("variant"), "n", "rmse", "mae", "mape"))
    both = parts[0].unionByName(parts[1])
    base = F.max(F.when(F.col("variant") == "without", F.col("rmse"))).over(Window.partitionBy(F.lit(0)))
    return both.withColumn("rmse_change_pct", F.try_divide((F.col("rmse") - base) * 100, base))
