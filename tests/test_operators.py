"""Calibration, forest draws, skylines, completeness and scratch tables, against plain loops."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorhealth.operators import candidates as cand
from sensorhealth.operators import contract, rolling
from sensorhealth.operators.calibration import empirical_risk
from sensorhealth.operators.forest import sample_trees
from sensorhealth.session import checkpoint_root, delete_tables, materialize, temporary_tables

SCORES = "key string, us bigint, score double"


@pytest.mark.parametrize("bin_rows", [200_000, 7])
def test_risk_with_most_scores_equal(spark, bin_rows):
    """90 % of the scores are one value; small parts deal its bin out to many tasks."""
    rng = np.random.default_rng(bin_rows)

    def made(n):
        tied = np.where(rng.random(n) < 0.9, 0.25, np.round(rng.normal(size=n), 1))
        return [None if x < 0.02 else float("nan") if x < 0.03 else float("inf") if x < 0.04 else float(v)
                for x, v in zip(rng.random(n), tied)]

    reference = [("a", i, s) for i, s in enumerate(made(300))] + [("b", 0, None), ("c", 0, -0.0), ("c", 1, 1e-300)]
    asked = [(k, i, s) for k in "abcd" for i, s in enumerate([*made(200), 0.0, -0.0, 1e-300, -5.0, 5.0])]
    got = empirical_risk(
        spark.createDataFrame(reference, SCORES), spark.createDataFrame(asked, SCORES).withColumn("x", F.lit(1)),
        ["key"], "score", "risk", bin_rows,
    )
    assert got.columns == ["key", "us", "score", "x", "risk"]
    finite = lambda s: s is not None and np.isfinite(s)
    told = {(r["key"], r["us"]): r["risk"] for r in got.collect()}
    assert len(told) == len(asked)
    for key, us, score in asked:
        known = [s for k, _, s in reference if k == key and finite(s)]
        want = sum(s <= score for s in known) / len(known) if known and finite(score) else None
        assert told[key, us] == (None if want is None else pytest.approx(want)), (key, us, score)


def test_risk_sends_each_query_once(spark):
    rows = spark.range(1000).select(F.lit("a").alias("key"), F.col("id").alias("us"), F.sin("id").alias("score"))
    told = empirical_risk(rows, rows, ["key"], "score", "risk")._jdf.queryExecution().executedPlan().toString()
    # after the window that gives queries their rank there is neither a join nor another exchange
    assert told.index("Window") < told.index("Exchange") and "Join" not in told[: told.index("Window")]


def trees_of(rows, trees, keep, seed):
    return sample_trees(rows, ["key"], "us", trees, keep, seed)


def test_forest_leaps_draw_like_independent_tests(spark):
    """Leaps (many rows) give every row and tree the chance that testing each cell would give it."""
    n, trees, keep = 60_000, 40, 50
    rows = spark.range(n).select(F.lit("a").alias("key"), F.col("id").alias("us"), F.array(F.lit(0.0)).alias("features"))
    drawn = trees_of(rows, trees, keep, 3).select("us", "tree", "_rank", "_size").toPandas()
    assert (drawn["_size"] == n).all() and not drawn.duplicated(["us", "tree"]).any()
    share = 3 * keep / n
    per_tree = drawn.groupby("tree").size()
    assert len(per_tree) == trees and abs(per_tree.mean() - 3 * keep) < 4 * np.sqrt(3 * keep / trees)
    per_row = np.bincount(drawn.groupby("us").size())
    lam = trees * share
    want = n * np.array([np.exp(-lam) * lam**k / np.prod(range(1, k + 1)) for k in (1, 2)])
    assert np.abs(per_row[1:3] - want).max() < 5 * np.sqrt(want.max())
    halves = drawn["us"] < n / 2
    assert abs(halves.mean() - 0.5) < 0.05
    again = trees_of(rows.repartition(7), trees, keep, 3).select("us", "tree").toPandas()
    assert set(map(tuple, again.to_numpy().tolist())) == set(map(tuple, drawn[["us", "tree"]].to_numpy().tolist()))


def test_forest_draws_of_models_of_different_sizes(spark):
    rows = spark.range(40_000).select(F.lit("a").alias("key"), F.col("id").alias("us"), F.array(F.lit(0.0)).alias("features"))
    listed = rows.withColumn("models", F.when(F.col("us") < 10_000, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    drawn = sample_trees(listed, ["key", "model"], "us", 30, 20, 5, "model")
    told = drawn.groupBy("model", "tree").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("top")).toPandas()
    for model, size in ((1, 10_000), (2, 40_000)):
        own = told[told["model"] == model]
        assert len(own) == 30 and abs(own["n"].mean() - 60) < 8 and own["top"].max() > 0.95 * size
    assert told[told["model"] == 1]["top"].max() < 10_000


def fronts(points):
    x = points[list(cand.OBJECTIVES)].to_numpy()
    return [not ((x <= p).all(axis=1) & (x < p).any(axis=1)).any() for p in x]


@pytest.mark.parametrize("seed", range(3))
def test_sweep_of_three_objectives(seed):
    rng = np.random.default_rng(seed)
    for values in (3, 10, 10**6):
        points = pd.DataFrame(rng.integers(0, values, (200, 3)).astype(float), columns=list(cand.OBJECTIVES))
        assert cand._undominated(points.to_numpy()).tolist() == fronts(points)


def test_skyline_of_many_undominated_points(spark):
    """200,000 points of one study on a plane, none of which dominates another, and some that are dominated."""
    n = 200_000
    a, b = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**6)) for k in "ab")
    plane = spark.range(n).select("id", F.lit("s").alias("study"), a.alias("x"), b.alias("y"))
    plane = plane.select("id", "study", *[c.cast("double").alias(o) for c, o in zip((F.col("x"), F.col("y"), 2 * 10**6 - F.col("x") - F.col("y")), cand.OBJECTIVES)])
    worse = plane.filter("id % 100 = 0").select((F.col("id") + n).alias("id"), "study", *[(F.col(o) + 1).alias(o) for o in cand.OBJECTIVES])
    alone = spark.createDataFrame([(-1, "t", 9e9, 9e9, 9e9)], "id bigint, study string, obj_error double, obj_pdm double, obj_alarm_burden double")
    front = cand.pareto_front(plane.unionByName(worse).unionByName(alone), ["study"])
    assert front.agg(F.count("id"), F.min("id"), F.max("id")).first()[:] == (n + 1, -1, n - 1)


def test_missing_families_are_found_in_results(spark):
    metrics = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 2.0)], "workflow_id string, far double, nab double")
    told = contract.family_problems(metrics, ["a", "b", "c"], ["far", "nab", "ttd"])
    missing = {tuple(r) for r in told.collect()}
    assert missing == {("b", "far"), ("c", "far"), ("c", "nab"), ("a", "ttd"), ("b", "ttd"), ("c", "ttd")}
    assert rolling.unresolved(metrics, ["far", "nab", "gone"]).first()[:] == (2, 3, 2)


def test_scratch_tables_are_deleted(spark):
    folder = f"{checkpoint_root(spark).removeprefix('file:')}/sensorhealth"
    listed = lambda: {f for f in os.listdir(folder) if f.startswith("cleanup")} if os.path.isdir(folder) else set()
    others = listed()  # the folder may be one that earlier sessions used
    with temporary_tables(spark):
        outer = materialize(spark.range(3), "cleanup")
        assert len(listed() - others) == 1
        with temporary_tables(spark), pytest.raises(ValueError):
            materialize(spark.range(5), "cleanup")
            assert len(listed() - others) == 2
            raise ValueError
        assert outer.count() == 3 and len(listed() - others) == 1
    assert listed() == others
    assert delete_tables(spark, 10**9) == 0
