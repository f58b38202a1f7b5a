"""Boosting over shared bins: against a plain per-row version, stopping, missing predictors, partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brineframe.operators import boosting as B

FEATURES = ["a", "b", "c"]
LABELS = ["CHLA_0_10", "CHLA_10_20"]


def table(spark, n=400, seed=3):
    """Two responses of three predictors, one with gaps that matter, one constant."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.normal()), float(rng.normal())
        y = 10 ** (0.5 * (a > 0.2) + 0.1 * rng.normal())
        gap = i % 4 == 0
        z = 10 ** (0.8 * gap + 0.3 * (b > 0) + 0.1 * rng.normal())
        rows.append((i, a, None if gap else b, 1.0, float(y), float(z) if i % 5 else None))
    # few partitions: a pass is one small job
    return spark.createDataFrame(rows, f"id long, {', '.join(c + ' double' for c in FEATURES + LABELS)}").coalesce(2)


def walk(tree, row, edges):
    """One row down one tree, in plain Python."""
    node = 0
    while tree.feature[node] >= 0:
        f = int(tree.feature[node])
        v = row[f]
        if v is None:
            left = bool(tree.missing_left[node])
        else:
            cut = int(tree.cut[node])
            left = cut > len(edges[f]) or v <= edges[f][cut - 1]
        node = 2 * node + (1 if left else 2)
    return float(tree.value[node])


def same(one, two):
    assert one.base == two.base and one.edges == two.edges and one.rounds == two.rounds
    for x, y in zip(one.trees, two.trees):
        assert len(x) == len(y)
        for s, t in zip(x, y):
            assert all(np.array_equal(getattr(s, k), getattr(t, k)) for k in vars(s))


def brute_tree(x, y, depth, edges):
    """Greedy squared-error tree over all cuts and both sides for missing values: leaf mean per row."""
    out = np.full(len(y), y.mean())
    if depth == 0:
        return out
    best = (1e-9, None)
    for f, e in enumerate(edges):
        v = x[:, f]
        for side in (True, False):
            for cut in [*e, math.inf]:
                left = np.where(np.isnan(v), side, v <= cut)
                if 0 < left.sum() < len(y):
                    gain = left.sum() * y[left].mean() ** 2 + (~left).sum() * y[~left].mean() ** 2 - len(y) * y.mean() ** 2
                    if gain > best[0] + 1e-7:
                        best = (gain, left)
    if best[1] is not None:
        left = best[1]
        out[left], out[~left] = brute_tree(x[left], y[left], depth - 1, edges), brute_tree(x[~left], y[~left], depth - 1, edges)
    return out


def test_first_tree_equals_brute_force(spark):
    df = table(spark)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", validation=0.0, max_iter=1, max_depth=3, learning_rate=1.0, bins=16)
    got = {r["id"]: r["p"] for r in B.score_forest(df, forest, out="p", kind="double").select("id", "p").collect()}
    rows = df.orderBy("id").collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in FEATURES] for r in rows])
    for i, label in enumerate(LABELS):
        own = [k for k, r in enumerate(rows) if r[label]]
        y = np.log10([rows[k][label] for k in own])
        want = brute_tree(x[own], y, 3, forest.edges)
        assert np.allclose([got[rows[k]["id"]][i] for k in own], want, atol=1e-6)


def test_scores_equal_a_walk_through_every_tree(spark):
    df = table(spark)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", max_iter=6, max_depth=3, learning_rate=0.3, bins=16)
    got = B.score_forest(df, forest, linear=True, kind="double").collect()
    for r in got:
        x = [r[c] for c in FEATURES]
        for i in range(2):
            want = 10 ** (forest.base[i] + sum(walk(t, x, forest.edges) for t in forest.trees[i]))
            assert r["chla"][i] == pytest.approx(want, rel=1e-9)


def test_partitioning_and_refresh_never_change_the_forest(spark, monkeypatch):
    df = table(spark)
    settings = {"max_iter": 4, "max_depth": 2, "bins": 16}
    one = B.fit_forest(df.coalesce(1), LABELS, FEATURES, "id", **settings)
    same(one, B.fit_forest(df.repartition(7, "id"), LABELS, FEATURES, "id", **settings))
    monkeypatch.setattr(B, "REFRESH", 2)
    monkeypatch.setattr(B, "SLICE", 1)
    same(one, B.fit_forest(df, LABELS, FEATURES, "id", **settings))


def test_fitting_stops_patience_rounds_after_the_best(spark):
    df = table(spark)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", validation=0.3, max_iter=60, max_depth=2, learning_rate=0.9, bins=16, patience=2)
    for trees, rounds, errors in zip(forest.trees, forest.rounds, forest.errors):
        assert len(errors) == rounds < 60 and rounds == len(trees) + 2
        assert min(errors) == pytest.approx(errors[len(trees) - 1], abs=1e-7)


def test_errors_are_those_of_the_validation_rows(spark):
    df = table(spark)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", validation=0.3, max_iter=4, max_depth=2, bins=16)
    held = B.score_forest(df, forest, out="p", kind="double").where(B.uniform01("id", f"{B.SEED}v") < 0.3).collect()
    for i, label in enumerate(LABELS):
        squares = [(math.log10(r[label]) - r["p"][i]) ** 2 for r in held if r[label]]
        assert forest.errors[i][len(forest.trees[i]) - 1] == pytest.approx(sum(squares) / len(squares), rel=1e-5)


def test_missing_predictors_choose_their_side(spark):
    rows = [(i, None if i % 2 else float(i % 10), 10.0 if i % 2 or i % 10 >= 6 else 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, CHLA_0_10 double")
    forest = B.fit_forest(df, LABELS[:1], ["a"], "id", validation=0.0, max_iter=1, max_depth=1, learning_rate=1.0)
    assert not forest.trees[0][0].missing_left[0]
    got = B.score_forest(df, forest, linear=True, kind="double").collect()
    assert all(r["chla"][0] == pytest.approx(r["CHLA_0_10"], rel=1e-5) for r in got)


def test_nan_is_missing_and_rules_for_incomplete_rows(spark):
    df = table(spark, 60)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", max_iter=2, max_depth=2, bins=8)
    nan = df.withColumn("b", F.coalesce("b", F.lit(float("nan"))))
    same(forest, B.fit_forest(nan, LABELS, FEATURES, "id", max_iter=2, max_depth=2, bins=8))
    assert B.score_forest(nan, forest).where("chla is null").count() == 0
    assert B.score_forest(nan, forest, incomplete="blank").where("chla is null").count() == 15
    assert B.score_forest(nan, forest, incomplete="drop").count() == 45
    with pytest.raises(ValueError):
        B.score_forest(df, forest, incomplete="guess")


def test_empty_responses_tables_and_constant_predictors(spark):
    df = table(spark, 60).withColumn(LABELS[1], F.lit(-1.0))
    forest = B.fit_forest(df, LABELS, FEATURES, "id", max_iter=2, max_depth=2, bins=8)
    assert forest.rounds == [2, 0]
    profile = B.score_forest(df, forest).first()["chla"]
    assert profile[0] is not None and profile[1] is None
    empty = B.fit_forest(df.limit(0), LABELS, FEATURES, "id", max_iter=2)
    assert empty.rounds == [0, 0] and B.score_forest(df, empty).first()["chla"] == [None, None]
    assert B.score_forest(df.limit(0), forest).count() == 0
    flat = B.fit_forest(df, LABELS[:1], ["c"], "id", validation=0.0, max_iter=2, max_depth=2)
    assert all(t.feature[0] < 0 for t in flat.trees[0])
    with pytest.raises(ValueError):
        B.fit_forest(df, LABELS, FEATURES, "id", bins=300)


def test_forest_survives_storage(spark, tmp_path):
    forest = B.fit_forest(table(spark, 80), LABELS, FEATURES, "id", max_iter=2, max_depth=2, bins=8)
    B.save_forest(spark, forest, str(tmp_path / "forest"))
    loaded = B.load_forest(spark, str(tmp_path / "forest"))
    same(forest, loaded)
    assert loaded.errors == forest.errors and loaded.features == FEATURES


def test_scoring_is_one_pass_without_a_shuffle(spark):
    df = table(spark, 60)
    forest = B.fit_forest(df, LABELS, FEATURES, "id", max_iter=2, max_depth=2, bins=8)
    plan = B.score_forest(df, forest)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and "Exchange" not in plan


def test_edges_are_exact_quantiles_of_many_rows(spark):
    """Every edge is the value of its rank; missing values count for nothing, infinite ones rank last."""
    n, bins = 60_000, 64
    value = F.when(F.col("id") % 5 != 0, (F.col("id") * 7919 % n).cast("double") / 7 - 2000)
    rows = spark.range(n).select(F.array(value, F.lit(None).cast("double"), F.when(F.col("id") < 8, F.lit(math.inf)).when(F.col("id") < 10, F.lit(1.5))).alias("x"))
    got = B.bin_edges(rows, "x", 3, bins)
    there = sorted(r[0] for r in rows.select(F.get("x", F.lit(0))).collect() if r[0] is not None)
    assert got[0] == [there[-(-len(there) * k // bins) - 1] for k in range(1, bins)]
    assert got[1:] == [[], [1.5, math.inf]]
