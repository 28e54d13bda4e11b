import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import learning, ordered, risk, series


def test_running_equals_plain_window_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice([None, rng.randint(-50, 50)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("b", F.floor(F.col("i") / 37))
    for inclusive, end in ((True, 0), (False, -1)):
        out = ordered.running(df, keys=["k"], bucket="b", order=["i"], aggs={"s": ("sum", "v"), "m": ("max", "v"), "n": ("min", "v"), "l": ("last", "v")}, inclusive=inclusive)
        w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, end)
        want = df.select("k", "i", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min("v").over(w).alias("n"), F.last("v", True).over(w).alias("l"))
        assert out.select("k", "i", "s", "m", "n", "l").exceptAll(want).count() == 0


@pytest.mark.parametrize("p", [0.05, 0.2, 0.5, 0.95])
def test_exact_quantile_small_and_large(spark, p):
    rng = np.random.default_rng(1)
    big = rng.normal(size=60_000).round(3)
    big[:20_000] = 0.25  # a third of the group is one value
    small = rng.normal(size=11)
    rows = [("big", float(x)) for x in big] + [("small", float(x)) for x in small] + [("one", 4.0), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in ordered.exact_quantile(df, keys=["k"], value="v", p=p, out="q").collect()}
    assert got["big"] == pytest.approx(np.quantile(big, p), abs=1e-12)
    assert got["small"] == pytest.approx(np.quantile(small, p), abs=1e-12)
    assert got["one"] == 4.0
    alone = ordered.exact_quantile(df.filter("k = 'big'"), keys=[], value="v", p=p, out="q").first().q
    assert alone == pytest.approx(np.quantile(big, p), abs=1e-12)


def test_auc_and_roc_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.5, rng.random()])) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert learning.auc(df, "y", "s", n_buckets=7).first().auc == pytest.approx(want, abs=1e-12)
    points = learning.roc(df, "y", "s", n_buckets=7).orderBy(F.desc("threshold")).collect()
    assert points[-1].fpr == 1.0 and points[-1].tpr == 1.0
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(points, points[1:]))


def test_bucket_spread_matches_sorting_with_ties(spark):
    rng = random.Random(7)
    rows = [(f"d{d}", f"n{n:03d}", float(rng.choice([-1, 0, 0, 0, 1, 2])), rng.random()) for d in range(4) for n in range(53)]
    rows += [("few", f"n{n}", float(n), 1.0) for n in range(9)]
    df = spark.createDataFrame(rows, "date string, ticker string, z double, ret double")
    got = {r.date: r.factor for r in risk.bucket_spread(df).collect()}
    for day in {r[0] for r in rows}:
        ranked = sorted((z, n, r) for d, n, z, r in rows if d == day)
        k = len(ranked) // 5
        want = 0.0 if len(ranked) < 10 else np.mean([x[2] for x in ranked[-k:]]) - np.mean([x[2] for x in ranked[:k]])
        assert got[day] == pytest.approx(want, abs=1e-12)


def test_stratified_split_keeps_shares_and_repeats(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = learning.stratified_split(df, "y", "id")
    shares = {r.y: (r.t, r.n) for r in a.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert shares == {0: (900, 4500), 1: (100, 500)}
    assert a.exceptAll(learning.stratified_split(df.repartition(7), "y", "id")).count() == 0


def test_series_operators_need_keys(spark):
    df = spark.range(3).withColumn("v", F.lit(1.0))
    with pytest.raises(ValueError):
        series.lags(df, keys=[], order="id", value="v", steps=[1])


def test_top_and_first_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    plan = ordered.first_by(df, ["k"], [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_affine_scan_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.choice([1.0, 0.5, 0.0, -0.3, 1e-200, 2.0]), rng.choice([0.0, 1.5, -2.0])) for k, n in (("hot", 900), ("b", 64), ("c", 1), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, a double, b double").withColumn("extra", F.lit("x"))
    df = df.filter("k is not null")
    for fold in (4, 64):
        got = {(r.k, r.i): r.y for r in ordered.affine_scan(df, keys=["k"], position="i", a="a", b="b", out="y", fold=fold).collect()}
        for k in ("hot", "b", "c"):
            y = 0.0
            for _, i, a, b in (r for r in rows if r[0] == k):
                y = a * y + b
                assert got[k, i] == pytest.approx(y, rel=1e-12, abs=1e-300)
    assert ordered.affine_scan(df.limit(0), keys=["k"], position="i", a="a", b="b", out="y").count() == 0


def hours(spark, rows):
    return spark.createDataFrame(rows, "k string, h int, v double").select("k", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "v", "h")


def test_series_operators_agree_with_pandas_over_many_buckets(spark):
    rng = random.Random(8)
    rows = [(k, h * step, None if rng.random() < 0.4 else rng.uniform(-9, 9)) for k, n, step in (("hot", 400, 1), ("gaps", 60, 7), ("none", 3, 1)) for h in range(n)]
    rows = [(k, h, None if k == "none" else v) for k, h, v in rows]
    df = hours(spark, rows)
    want = pd.DataFrame(rows, columns=["k", "h", "v"]).astype({"v": float})
    by = want.groupby("k").v
    want["fill"] = by.transform(lambda v: v.ffill().bfill())
    want["smooth"] = by.transform(lambda v: v.ewm(span=5, adjust=False).mean())
    want["line"] = [x for _, g in want.groupby("k", sort=False) for x in pd.Series(g.v.to_numpy(), index=g.h.to_numpy()).interpolate("index").to_numpy()]
    for ticks in (16, 4096):
        how = {"keys": ["k"], "order": "ts", "ticks": ticks}
        got = series.fill_forward_back(df, values=["v"], **how).select("k", "h", F.col("v").alias("fill"))
        got = got.join(series.interpolate_time(df, value="v", **how).select("k", "h", F.col("v").alias("line")), ["k", "h"])
        smooth = series.ewm(df, value="v", span=5, out="smooth", **how).select("k", (F.unix_seconds("ts") / 3600).cast("int").alias("h"), "smooth")
        both = got.join(smooth, ["k", "h"]).toPandas().merge(want, on=["k", "h"], suffixes=("", "_w"))
        assert len(both) == len(rows)
        for c in ("fill", "line", "smooth"):
            np.testing.assert_allclose(both[c].astype(float), both[f"{c}_w"], rtol=1e-9, equal_nan=True)
    plan = series.ewm(df, keys=["k"], order="ts", value="v", span=5, out="s")._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan


def test_asof_join_with_a_hot_key(spark):
    rng = random.Random(4)
    quotes = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randrange(200), i) for i in range(150)] + [("a", None, 999)]
    trades = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(-5, 210), f"t{i}") for i in range(120)] + [("a", None, "t-null")]
    left = spark.createDataFrame(trades, "k string, at int, name string")
    right = spark.createDataFrame(quotes, "k string, at int, price int")
    for ticks in (8, 4096):
        got = series.asof_join(left, right, keys=["k"], left_on="at", right_on="at", prefix="q_", ticks=ticks)
        assert got.columns == ["k", "at", "name", "q_at", "q_price"]
        for r in got.collect():
            before = [(t, p) for k, t, p in quotes if k == r.k and t is not None and r.at is not None and t <= r.at]
            assert (r.q_at, r.q_price) == (max(before) if before else (None, None))
        assert got.count() == len(trades)
    assert series.asof_join(left, right.limit(0), keys=["k"], left_on="at", right_on="at").filter("asof_at is not null").count() == 0


@pytest.mark.parametrize("n", [720, 1001, 997, 6])
def test_dealt_fourier_transform_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, h, float(10 + 3 * np.sin(2 * np.pi * h / 24) + v)) for k in ("a", "b") for h, v in enumerate(rng.normal(size=n))]
    df = hours(spark, rows)
    got = series.full_periodogram(df, keys=["k"], order="ts", value="v", shortest=2.0, longest=10_000.0, top=n, ticks=50, group_values=64)
    by_key = {k: sorted((r.period_h, r.amplitude, r.phase) for r in got.filter(F.col("k") == k).collect()) for k in ("a", "b")}
    for k in ("a", "b"):
        x = np.array([v for key, _, v in rows if key == k])
        spectrum = np.fft.rfft(x - x.mean()) / n
        bins = np.arange(1, n // 2 + 1)
        amplitude = np.abs(spectrum[1:]) * np.where(2 * bins == n, 1, 2)
        want = sorted(zip(n / bins, amplitude, np.angle(spectrum[1:])))
        assert len(by_key[k]) == len(want)
        for (p, a, f), (q, b, g) in zip(by_key[k], want):
            assert p == pytest.approx(q) and a == pytest.approx(b, abs=1e-9)
            assert b < 1e-9 or abs(np.exp(1j * f) - np.exp(1j * g)) < 1e-6
    if n == 1001:
        parts = series.full_periodogram(df, keys=["k"], order="ts", value="v", group_values=64)
        assert parts.filter("rank = 1").select("label").distinct().collect()[0].label == "daily"
        gap = df.withColumn("v", F.when(F.col("h") != 5, F.col("v")))
        assert series.full_periodogram(gap, keys=["k"], order="ts", value="v").count() == 0


def test_a_stratified_split_brings_no_class_to_one_task(spark):
    from tallyloom.operators import learning

    def split(n):
        return learning.stratified_split(spark.range(n).select("id", (F.col("id") % 9 == 0).cast("int").alias("y")), "y", "id")

    plan = split(10**9)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert {(r.y, r.is_test): r["count"] for r in split(900).groupBy("y", "is_test").count().collect()} == {(0, False): 640, (0, True): 160, (1, False): 80, (1, True): 20}
