"""Second-order boosting against a plain numpy version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import boosting as bo


def plain(x, y, cuts, loss, trees, depth, rate=0.1, penalty=1.0, least=1.0):
    """Margins after boosting: every cut of every feature tried, missing values on either side."""
    margin = np.full(len(y), y.mean() if loss == "squared" else 0.0)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = (margin - y, np.ones(len(y))) if loss == "squared" else (p - y, p * (1 - p))
        step = np.zeros(len(y))

        def grow(at, level):
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
            best = None
            for f in range(x.shape[1]) if level < depth else []:
                for missing_left in (False, True):
                    for c in cuts[f]:
                        side = np.where(np.isnan(x[:, f]), missing_left, x[:, f] < c)
                        a, b = at & side, at & ~side
                        gain = score(a) + score(b) - score(at)
                        if min(h[a].sum(), h[b].sum()) >= least and gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, a, b)
            if best:
                grow(best[1], level + 1)
                grow(best[2], level + 1)
            elif level:
                step[at] = -rate * g[at].sum() / (h[at].sum() + penalty)

        grow(np.ones(len(y), bool), 0)
        margin = margin + step
    return margin


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_boosting_equals_a_plain_version(spark, loss):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[rng.random(300) < 0.1, 1] = np.nan
    raw = x[:, 0] + 2 * (np.nan_to_num(x[:, 1], nan=1.5) > 0.4) * x[:, 2]
    y = (raw > 0.3).astype(float) if loss == "logistic" else raw
    rows = [(i, *[None if np.isnan(v) and i % 2 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)
    cuts = [np.linspace(-1.5, 1.5, 7)] * 3
    model = bo.fit_boosted_trees(df, "y", ["a", "b", "c"], key="id", loss=loss, trees=4, depth=3, cuts=cuts)
    got = np.array([r.p for r in bo.boosted_scores(model, df).orderBy("id").collect()])
    want = plain(x, y, cuts, loss, 4, 3)
    assert np.allclose(got, want if loss == "squared" else 1 / (1 + np.exp(-want)), atol=1e-9)
    assert len(model.trees) == 4 and sum(model.importance().values()) > 8


def test_boosting_draws_rows_by_key_and_outlives_the_written_margins(spark, monkeypatch):
    monkeypatch.setattr(bo, "PENDING", 2)
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("y"))
    fits = [bo.fit_boosted_trees(df.repartition(n), "y", ["a"], key="id", trees=5, depth=2, subsample=0.7) for n in (1, 4)]
    scores = [[r.p for r in bo.boosted_scores(m, df).orderBy("id").collect()] for m in fits]
    assert np.allclose(scores[0], scores[1])
    assert all((p > 0.5) == (i % 20 >= 10) for i, p in enumerate(scores[0]))
    assert 0.65 < bo._drawn(np.arange(20_000) * 7919, 3, 0.7).mean() < 0.75


def test_boosting_without_rows_labels_or_differences(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None)], "id long, a double, y int")
    model = bo.fit_boosted_trees(df, "y", ["a"], key="id", trees=3)
    assert model.trees == [] and [r.p for r in bo.boosted_scores(model, df).collect()] == [0.5, 0.5]
    same = df.withColumn("y", F.lit(1))
    assert bo.fit_boosted_trees(same, "y", ["a"], key="id", trees=3, least=10.0).trees == []


def test_residual_boosting_equals_mllib_where_all_values_are_cuts(spark):
    from tallyloom.operators import learning
    from tallyloom.plans import loans

    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 12, 600), rng.integers(0, 9, 600)
    kind = np.array(["u", "v", "w"])[rng.integers(0, 3, 600)]
    chance = 1 / (1 + np.exp(-(0.5 * a - 0.7 * b + 2 * (kind == "w") - 2)))
    rows = [(i, float(x), float(z), k, int(y)) for i, (x, z, k, y) in enumerate(zip(a, b, kind.tolist(), rng.random(600) < chance))]
    df = spark.createDataFrame(rows, "loan_id long, a double, b double, kind string, y int").repartition(3)
    model = loans.fit_boosted(df, "y", ["a", "b"], ["kind"], trees=4, depth=2)
    got = {r.loan_id: r.p for r in bo.boosted_scores(model, loans.with_dummies(df, model.features)).collect()}
    plainer = learning.fit_boosted(df, "y", ["a", "b"], ["kind"], trees=4, depth=2)
    want = {r.loan_id: r.p for r in learning.score_all(plainer, df).collect()}
    assert got == {k: pytest.approx(p, abs=1e-9) for k, p in want.items()}
    shares = {r.feature: r.importance for r in learning.importance(plainer, df).collect()}
    assert model.gain_importance() == {k: pytest.approx(v, abs=1e-9) for k, v in shares.items()}


def test_a_level_is_one_job_without_a_shuffle_and_blocks_leave_the_storage(spark, monkeypatch):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 50)
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 >= 10).cast("int").alias("y")).repartition(3)
    status, calls = spark.sparkContext.statusTracker(), []
    before = bo._level_sums

    def counted(state, *args):
        spark.sparkContext.setJobGroup("level", "level")
        done = len(status.getJobIdsForGroup("level"))
        out = before(state, *args)
        calls.append([len(status.getJobInfo(j).stageIds) for j in sorted(status.getJobIdsForGroup("level"))[done:]])
        spark.sparkContext.setJobGroup("other", "other")
        return out

    monkeypatch.setattr(bo, "_level_sums", counted)
    bo.fit_boosted_trees(df, "y", ["a"], key="id", trees=3, depth=2)
    assert calls and all(len(stages) == 1 for stages in calls)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def mixed(spark, n=500):
    """Rows with two weights, missing values in one feature, and flags that share a histogram."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] - 3 * x[:, 2] + 2 * x[:, 1] * x[:, 3] + rng.normal(size=n) > 3).astype(int)
    rows = [(i, *[None if f == 1 and i % 7 == 0 else float(v) for f, v in enumerate(r)], int(t), 2.5 if t else 1.0) for i, (r, t) in enumerate(zip(x, y))]
    cuts = [np.arange(1, 9.0), np.linspace(-1, 1, 5), np.array([0.5]), np.array([0.5])]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, w double").repartition(3), cuts


@pytest.mark.parametrize("loss, depth", [("residual", 3), ("squared", 4), ("residual", 8)])
def test_counted_kinds_give_the_trees_of_rows_added_up_one_by_one(spark, monkeypatch, loss, depth):
    monkeypatch.setattr(bo, "BLOCK_ROWS", 100)
    df, cuts = mixed(spark)
    sums, nodes = bo._level_sums, []

    def counted(state, name, layout, tree, wanted, draw):
        nodes.append((len(wanted), layout.kinds is not None, len(layout.groups)))
        return sums(state, name, layout, tree, wanted, draw)

    def fit():
        nodes.clear()
        return bo.fit_boosted_trees(df, "y", ["a", "b", "c", "d"], key="id", loss=loss, trees=3, depth=depth, penalty=0.0, least=1e-9, weight="w", cuts=cuts)

    monkeypatch.setattr(bo, "_level_sums", counted)
    few, seen = fit(), list(nodes)
    monkeypatch.setattr(bo, "KINDS", 0)
    all_rows, plainly = fit(), list(nodes)
    assert [n for n, _, _ in plainly[1:depth]] == [2 * n for n, _, _ in seen[1:depth]]
    assert all(k and g == 1 for _, k, g in seen) and not any(k for _, k, _ in plainly)
    for a, b in zip(few.trees, all_rows.trees, strict=True):
        assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
        assert a.missing_left.tolist() == b.missing_left.tolist() and np.allclose(a.value, b.value, atol=1e-9)
    scores = {r.id: r.p for r in bo.boosted_scores(few, df).collect()}
    margin = {}
    for r in df.collect():
        bins = few.bins(np.array([[np.nan if r[c] is None else r[c] for c in "abcd"]]))
        margin[r.id] = few.base + sum(t.value[t.node(bins)][0] for t in few.trees)
    assert scores == {i: pytest.approx(m if loss == "squared" else 1 / (1 + np.exp(-2 * m)), abs=1e-12) for i, m in margin.items()}


def test_a_side_without_rows_is_no_split():
    h = np.array([[0.0, 0.1, 0.2, 0.7, 0.0, 0.0]]) * 3.3e7
    found = bo.best_split(np.array([[0.0, 1.0, 2.0, 7.0, 0.0, 0.0]]) / 3, h, 0.0, 1e-9)
    assert found is None or found[2] < 3
    assert bo.best_split(np.zeros((0, 5)), np.zeros((0, 5)), 0.0, 1e-9) is None


def test_shared_histograms_add_up_to_those_of_each_feature():
    rng = np.random.default_rng(6)
    cuts = [np.arange(31.0)] * 9 + [np.array([0.5])] * 12
    kinds = np.array([[0.0, 1.0], [1.0, 2.5]])
    bins = np.column_stack([rng.integers(0 if f == 4 else 1, len(c) + 2, 3000) for f, c in enumerate(cuts)])
    layout = bo.Layout.of(cuts, [f == 4 for f in range(21)], kinds, False)
    kind, g = rng.integers(0, 2, 3000), rng.normal(size=3000)
    assert len(layout.groups) <= 7 and sorted(f for group in layout.groups for f in group) == list(range(21))
    totals = [np.bincount(c, g, layout.size(group)).reshape(2, -1).sum(axis=0) for c, group in zip(layout.cells(bins, kind), layout.groups)]
    want = [np.bincount(bins[:, f], g, layout.width) for f in range(21)]
    assert np.allclose(layout.by_feature(totals), want)


def test_top_features_are_the_first_of_all_and_share_one_fit(spark, monkeypatch):
    from tallyloom.plans import loans
    from tallyloom.sources.tables import Tables

    df, cuts = mixed(spark)
    model, fits = bo.fit_boosted_trees(df, "y", ["a", "b", "c", "d"], key="id", loss="residual", trees=3, depth=3, penalty=0.0, least=1e-9, weight="w", cuts=cuts), []
    monkeypatch.setattr(loans, "_FITTED", {})
    monkeypatch.setattr(loans, "training", lambda t: (df, df))
    monkeypatch.setattr(loans, "fit_boosted", lambda *args: fits.append(args) or model)
    t = Tables(spark, "/nowhere")
    ranked = [(r.feature, r.importance) for r in loans.ml_importance(t).collect()]
    assert [(r.feature, r.importance) for r in loans.feature_importance(t, top=2).collect()] == ranked[:2] and len(fits) == 1
    assert [v for _, v in ranked] == sorted((v for _, v in ranked), reverse=True) and sum(v for _, v in ranked) == pytest.approx(1.0)
