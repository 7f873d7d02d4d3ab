"""Whole studies on the synthetic compressor series and on the driver tables."""

import json

import numpy as np
import pandas as pd
import pytest
from helpers import ADJACENT_EVENTS, SMALL, compressor_study, fleet_rows, minute_rows
from pyspark.sql import functions as F

from sensorhealth import StudyParams
from sensorhealth.functions import grids
from sensorhealth.operators import candidates as cand
from sensorhealth.operators import contract, events, lineage, rolling
from sensorhealth.operators.forest import fit_forest, sample_trees, score_forest
from sensorhealth.operators.reconstruction import windows_holding
from sensorhealth.operators.risk import (
    alarm_flags,
    fleet_sweep,
    operating_point,
    threshold_sweep,
)
from sensorhealth.params import MINUTE_US
from sensorhealth.plans.detectors import STRATEGIES, Detectors, workflow_scores
from sensorhealth.plans.evaluation import Evaluation
from sensorhealth.plans.prepared import load_study, save_study
from sensorhealth.sources import ledger as ledgers
from sensorhealth.sources import maintenance, sinks, telemetry


@pytest.fixture(scope="module")
def study(spark):
    return compressor_study(spark)


@pytest.fixture(scope="module")
def detectors(study):
    return Detectors(study)


def evaluate(detectors, workflows):
    calibration, evaluation = zip(*(workflow_scores(detectors, w) for w in workflows), strict=True)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Evaluation(
        detectors.study, union(calibration), union(evaluation), {w: STRATEGIES[w] for w in workflows}
    )


def test_default_threshold_grid(spark):
    p = StudyParams()
    values = grids.theta_list(p.theta_grid, p.extra_thresholds)
    assert len(values) == 23
    assert values[:3] == [0.1, 0.15, 0.2]
    assert values[-3:] == [0.985, 0.99, 0.995]
    table = grids.theta_grid(spark, p.theta_grid, p.extra_thresholds).orderBy("theta").collect()
    assert [r["theta"] for r in table] == values


def test_scaler_passes_binary_features_through(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, 0.0, 0.0), (0, 2.0, 1.0, 0.5), (0, 3.0, 0.0, 0.0)],
        "asset_id int, TP2__mean double, COMP__mean double, COMP__std double",
    )
    names = ["TP2__mean", "COMP__mean", "COMP__std"]
    scaler = rolling.fit_scaler(rows, ["asset_id"], names, ["COMP"])
    got = rolling.apply_scaler(rows, scaler, ["asset_id"], names, names).toPandas()
    assert got["COMP__mean"].tolist() == [0, 1, 0]
    assert got["COMP__std"].tolist() == [0, 0.5, 0]
    assert abs(got["TP2__mean"].mean()) < 1e-12
    with pytest.raises(ValueError):
        rolling.apply_scaler(rows, scaler, ["asset_id"], names[::-1], names)


def split_literals(spark, sizes):
    segments = spark.createDataFrame(
        [(0, 1, i * 100, i * 100, n, max(0, n - 5)) for i, n in enumerate(sizes)],
        "asset_id int, cycle_id int, run_us bigint, start_us bigint, row_count bigint, windows bigint",
    )
    return lineage.split_segments(segments, SMALL).orderBy("start_us").collect()


def test_local_split_over_segments(spark):
    first, second = split_literals(spark, [30, 20])
    assert first["total_windows"] == 40
    assert first["train_windows"] + second["train_windows"] == 27
    assert (first["validation_windows"], second["validation_windows"]) == (0, 8)
    assert second["embargo_windows"] == 5
    assert (second["train_rows"], second["validation_from_row"]) == (7, 7)


def test_local_split_at_a_real_gap(spark):
    first, second = split_literals(spark, [17, 8])
    assert first["total_windows"] == 15
    assert (first["train_windows"], second["validation_windows"]) == (12, 3)
    assert first["embargo_windows"] == second["embargo_windows"] == 0


def test_split_falls_back_to_training_on_everything(spark):
    (only,) = split_literals(spark, [6])
    assert only["fallback"] and only["train_windows"] == 1 and only["validation_windows"] == 0


def test_even_picks_match_the_formula(spark):
    for total, count in [(10, 3), (17, 16), (100, 7), (5, 5), (4, 9), (12, 0)]:
        rows = spark.range(total).filter(
            lineage.is_even_pick(F.col("id"), F.lit(total), F.lit(count))
        )
        got = sorted(r["id"] for r in rows.collect())
        if count >= total:
            expected = list(range(total))
        else:
            expected = [int((i + 0.5) * total / count) for i in range(count)]
        assert got == expected


def test_windows_holding_a_row(spark):
    for n in range(1, 15):
        rows = spark.range(1, n + 1).select(
            windows_holding(F.col("id"), F.lit(n), 4).alias("w")
        )
        got = [r["w"] for r in rows.collect()]
        expected = [
            sum(1 for s in range(1, n - 2) if s <= p <= s + 3) for p in range(1, n + 1)
        ]
        assert got == expected


def test_pareto_front_and_winner(spark):
    rows = spark.createDataFrame(
        [(1, 0.2, 0.6, 0.2), (2, 0.4, 0.2, 0.1), (3, 0.8, 0.8, 0.8)],
        "id int, obj_error double, obj_pdm double, obj_alarm_burden double",
    ).select("*", F.lit("s").alias("study"), F.lit("t").alias("created_at"), F.lit(True).alias("_valid"))
    front = cand.pareto_front(rows, ["study"])
    assert sorted(r["id"] for r in front.collect()) == [1, 2]
    best = cand.winner(rows, front, ["study"], StudyParams()).collect()
    assert best[0]["id"] in (1, 2)
    assert best[0]["pareto_candidate_count"] == 2


def test_pareto_front_matches_pairwise_dominance(spark):
    rng = np.random.default_rng(0)
    points = pd.DataFrame(rng.integers(0, 12, (500, 3)) / 4, columns=list(cand.OBJECTIVES))
    points["id"] = range(500)
    points["study"] = ["abc"[i % 3] for i in range(500)]
    front = cand.pareto_front(spark.createDataFrame(points), ["study"])
    x, study = points[list(cand.OBJECTIVES)].to_numpy(), points["study"].to_numpy()
    keep = [
        i
        for i in range(500)
        if not ((x <= x[i]).all(axis=1) & (x < x[i]).any(axis=1) & (study == study[i])).any()
    ]
    assert {r["id"] for r in front.collect()} == set(keep)
    named = front.select("*", F.lit("t").alias("created_at"))
    rows = spark.createDataFrame(points).withColumn("_valid", F.lit(True))
    best = cand.winner(rows, named, ["study"], StudyParams()).collect()
    assert sorted(r["study"] for r in best) == ["a", "b", "c"]


def test_auroc_with_ties_and_missing_class(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"key": "a", "s": rng.integers(0, 9, 300) / 8, "y": rng.random(300) < 0.3})
    frame = pd.concat([frame, frame.assign(key="b", y=False)])
    got = cand.auroc(spark.createDataFrame(frame), ["key"], "s", "y").toPandas().set_index("key")
    a = frame[frame["key"] == "a"]
    pos, neg = a.loc[a["y"], "s"].to_numpy(), a.loc[~a["y"], "s"].to_numpy()
    wins = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert got.loc["a", "smoothed_auroc"] == pytest.approx(wins)
    assert pd.isna(got.loc["b", "smoothed_auroc"])


def test_json_sink_writes_null_for_nan(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, float("nan"))], "epoch int, train double, validation double")
    sinks.write_json(rows, str(tmp_path / "h"))
    lines = [x for f in (tmp_path / "h").glob("part-*.json") for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"epoch": 1, "train": 0.5, "validation": None}]


def test_source_checks(spark):
    with pytest.raises(ValueError):
        telemetry.resolve_timestamp(spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(ValueError):
        telemetry.require_channels(spark.createDataFrame([(1,)], "a int"), ["b"])
    with pytest.raises(ValueError):
        maintenance.build_events(spark, [("2020-01-02", "2020-01-01", "#1", "high")])
    with pytest.raises(ValueError):
        maintenance.build_events(
            spark,
            [("2020-01-02", "2020-01-03", "#1", "high"), ("2020-01-01", "2020-01-02", "#2", "high")],
        )


def sweep_fixture(spark):
    """240 minute rows, risk 0.9 on rows 90..120, one event at rows 120..125."""
    minutes = np.arange(240)
    risk = np.where((minutes >= 90) & (minutes <= 120), 0.9, 0.0)
    rows = minute_rows(spark, minutes, {"maintenance_risk": risk}).select(
        F.lit("w").alias("workflow_id"),
        "asset_id",
        "us",
        "maintenance_risk",
        (F.col("us") > 0).alias("linked"),
        F.lit(0).alias("chain"),
    )
    event = spark.createDataFrame(
        [(0, 1, 120 * MINUTE_US, 125 * MINUTE_US)],
        "asset_id bigint, ordinal int, start_us bigint, end_us bigint",
    )
    return rows, event


def test_sweep_and_operating_point(spark):
    params = StudyParams(
        theta_grid="0.10:0.90:0.40", extra_thresholds=(), lead_minutes=30, target_coverage=0.5
    )
    rows, event = sweep_fixture(spark)
    grid = spark.createDataFrame([("w", 0)], "workflow_id string, asset_id bigint")
    thetas = grids.theta_list(params.theta_grid, ())
    assert thetas == [0.1, 0.5, 0.9]
    sweep = fleet_sweep(
        threshold_sweep(rows, grid, event, thetas, params, 7 * MINUTE_US), params
    )
    selected = operating_point(sweep, params)
    best = selected.collect()[0]
    assert best["recall"] == 1.0 and 0 < best["coverage"] < 0.5
    assert best["selection_mode"] == "feasible"
    alarms = alarm_flags(rows, selected)
    intervals = events.alarm_intervals(alarms, 7 * MINUTE_US).collect()
    assert [(r["start_us"] // MINUTE_US, r["end_us"] // MINUTE_US) for r in intervals] == [(90, 120)]
    assert intervals[0]["row_count"] == 31


def naive_match(intervals, starts, lead):
    used, tp = set(), 0
    for s in sorted(starts):
        for i, (a, b) in enumerate(intervals):
            if i not in used and a <= s and b >= s - lead:
                used.add(i)
                tp += 1
                break
    return tp


@pytest.mark.parametrize("seed", range(3))
def test_sweep_counts_match_a_naive_loop(spark, seed):
    rng = np.random.default_rng(seed)
    risk = np.round(rng.random(300), 2)
    linked = rng.random(300) < 0.8
    linked[0] = False
    starts = np.sort(rng.choice(np.arange(20, 300), 6, replace=False))
    params = StudyParams(lead_minutes=25)
    rows = minute_rows(spark, range(300), {"maintenance_risk": risk, "linked": linked}).withColumn(
        "workflow_id", F.lit("w")
    )
    event = spark.createDataFrame(
        [(0, i, int(s) * MINUTE_US, int(s) * MINUTE_US) for i, s in enumerate(starts, 1)],
        "asset_id bigint, ordinal int, start_us bigint, end_us bigint",
    )
    grid = spark.createDataFrame([("w", 0)], "workflow_id string, asset_id bigint")
    thetas = grids.theta_list(params.theta_grid, params.extra_thresholds)
    got = threshold_sweep(rows, grid, event, thetas, params, 11 * MINUTE_US).collect()
    assert len(got) == len(thetas)
    for r in got:
        intervals, previous = [], False
        for t in range(300):
            on = risk[t] >= r["theta"]
            if on and previous and linked[t]:
                intervals[-1][1] = t
            elif on:
                intervals.append([t, t])
            previous = on
        tp = naive_match(intervals, starts, 25)
        assert (r["tp"], r["fp"], r["fn"]) == (tp, len(intervals) - tp, 6 - tp)
        assert r["alarm_points"] == (risk >= r["theta"]).sum()


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_against_a_naive_loop(spark, seed):
    rng = np.random.default_rng(seed)
    edges = np.sort(rng.choice(np.arange(400), 40, replace=False)).reshape(-1, 2)
    starts = np.sort(rng.choice(np.arange(400), 7, replace=False))
    intervals = spark.createDataFrame(
        [("w", 0, int(a) * MINUTE_US, int(b) * MINUTE_US) for a, b in edges],
        "workflow_id string, asset_id bigint, start_us bigint, end_us bigint",
    )
    event = spark.createDataFrame(
        [(0, i, "e", int(s) * MINUTE_US, int(s) * MINUTE_US) for i, s in enumerate(starts, 1)],
        "asset_id bigint, ordinal int, event_id string, start_us bigint, end_us bigint",
    )
    grid = spark.createDataFrame([("w", 0)], "workflow_id string, asset_id bigint")
    listed = events.event_grid(grid, event)
    eligible = events.warned(intervals, event, 60)
    matches = events.greedy_match(eligible, listed, events.KEYS)
    counts = events.interval_counts(intervals, grid)
    got = events.match_counts(matches, counts, []).collect()[0]
    tp = naive_match(edges.tolist(), starts, 60)
    assert (got["tp"], got["fp"], got["fn"]) == (tp, 20 - tp, 7 - tp)


def test_prepared_populations(study):
    assert len(study.features_list) == 90
    rows = study.timeline
    counts = rows.agg(
        F.count_if("baseline_train").alias("train"),
        F.count_if(F.col("evaluation") & F.col("post_train")).alias("overlap"),
        F.collect_set("phase").alias("phases"),
    ).collect()[0]
    fitted = study.scaler.groupBy("asset_id").agg(F.max("fitted_rows").alias("n"))
    assert fitted.agg(F.sum("n")).first()[0] == counts["train"] > 0
    assert counts["overlap"] == 0
    assert sorted(counts["phases"]) == [0, 1, 2]


def test_populations_do_not_depend_on_slices(spark, study):
    from dataclasses import replace

    wide = compressor_study(spark, params=replace(SMALL, slice_us=100_000 * MINUTE_US))
    drop = ["slice"]
    a = study.timeline.drop(*drop)
    b = wide.timeline.drop(*drop)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_features_match_pandas(study):
    raw, features = study.base.toPandas(), study.feature_table.toPandas()
    for asset in (0, 1):
        frame = raw[raw["asset_id"] == asset].sort_values("us")
        index = pd.to_datetime(frame["us"], unit="us")
        rolled = frame[study.channels].set_index(index).rolling("5min", min_periods=1)
        expected = rolled.agg(["mean", "median", "std", "skew", "min", "max"])
        expected.columns = [f"{c}__{a}" for c, a in expected.columns]
        expected = expected.ffill().bfill()
        got = features[features["asset_id"] == asset].sort_values("us")
        for name in study.features_list:
            # Skewness of nearly constant windows is ill-conditioned in any floating-point form.
            tolerance = 1e-4 if name.endswith("skew") else 1e-9
            np.testing.assert_allclose(got[name], expected[name], atol=tolerance)


def test_two_workflows_end_to_end(spark, study, detectors):
    e = evaluate(detectors, ["iforest_static", "linear_per_maintenance"])
    anchors = study.timeline.filter("evaluation").count()
    rows = e.predictions.toPandas()
    assert rows.groupby("workflow_id").size().tolist() == [anchors, anchors]
    assert rows["risk_score"].between(0, 1).all()
    assert rows["maintenance_risk"].between(0, 1).all()
    summary = e.comparison.orderBy("position").collect()
    assert [r["workflow_id"] for r in summary] == ["iforest_static", "linear_per_maintenance"]
    cycles = contract.cycle_counts(study.timeline, study.cycles)
    assert contract.cycle_problems(cycles, e.results, list(e.workflows)).count() == 0
    tampered = e.predictions.withColumn("us", F.col("us") + 1)
    keys = ["workflow_id", "asset_id", "cycle_id", "us"]
    assert contract.population_differences(e.predictions, tampered, keys).count() > 0


def test_cycle_without_anchors_stays_in_lineage(spark):
    study = compressor_study(spark, ADJACENT_EVENTS)
    e = evaluate(Detectors(study), ["iforest_static", "iforest_per_maintenance"])
    found = e.results.filter("cycle_id IN (1, 2) AND asset_id = 0").collect()
    rows = {(r["workflow_id"], r["cycle_id"]): r for r in found}
    static, adaptive = rows["iforest_static", 1], rows["iforest_per_maintenance", 1]
    assert static["prediction_count"] == adaptive["prediction_count"] == 0
    assert static["evaluation_status"] == "no_evaluation_anchors"
    assert static["model_status"] == "reused_static"
    assert adaptive["model_status"] == "alias_no_trainable_local_window"
    assert rows["iforest_per_maintenance", 2]["model_status"] == "refitted"


def test_forest_finds_an_outlier_and_repeats(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2000, 3))
    x[-1] = 9.0
    frame = pd.DataFrame({"key": 0, "us": np.arange(2000), "features": x.tolist()})
    rows = spark.createDataFrame(frame)
    scores = []
    for parts in (1, 5):
        forest = fit_forest(
            rows.repartition(parts), ["key"], "us", "features", trees=50, tree_rows=256, seed=42
        )
        assert forest.count() == 50
        got = score_forest(rows, forest, ["key"], "us", "features", 700).toPandas()
        scores.append(got.sort_values("us")["anomaly_score"].to_numpy())
    np.testing.assert_array_equal(scores[0], scores[1])
    assert scores[0].argmax() == 1999
    assert -0.5 < scores[0].min() and scores[0].max() < 0.5


def test_forest_draws_from_all_rows_of_large_training_sets(spark):
    """More rows than all trees need together: none is out of reach, and trees differ."""
    rows = spark.range(120_000).select(
        F.lit("a").alias("key"), F.col("id").alias("us"), F.array(F.col("id").cast("double")).alias("features")
    )
    sampled = sample_trees(rows, ["key"], "us", 100, 256, 7)
    drawn = sampled.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    found = drawn.collect()
    assert len(found) == 100 and all(r["n"] >= 256 for r in found)
    assert sampled.select("us").distinct().count() > 50_000
    assert min(r["lo"] for r in found) < 200 and max(r["hi"] for r in found) > 119_800


def test_forests_of_different_keys_use_different_random_numbers(spark):
    rows = spark.range(600).select(
        F.pmod("id", F.lit(2)).alias("key"), F.floor(F.col("id") / 2).alias("us")
    ).withColumn("features", F.array(F.sin("us"), F.cos("us")))
    forest = fit_forest(rows, ["key"], "us", "features", trees=10, tree_rows=512, seed=1)
    cuts = {r["key"]: r["cut"] for r in forest.filter("tree = 0").collect()}
    assert cuts[0] != cuts[1]


def test_rows_of_many_models_equal_copied_rows(spark):
    """Rows that list their models are drawn as if they had been copied to each of them."""
    rows = spark.range(900).select(
        F.lit(0).alias("asset"), F.col("id").alias("us"), F.array(F.col("id").cast("double")).alias("features")
    )
    listed = rows.withColumn("models", F.when(F.col("us") < 800, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))))
    got = sample_trees(listed, ["asset", "model"], "us", 5, 50, 3, "model")
    sizes = got.groupBy("model").agg(F.max("_size").alias("n")).collect()
    assert {r["model"]: r["n"] for r in sizes} == {1: 800, 2: 900}
    assert got.filter("model = 1 AND us >= 800").count() == 0
    for model in (1, 2):
        trees = got.filter(F.col("model") == model).groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(trees) == 5 and all(r["n"] >= 50 for r in trees)


def test_sweep_of_assets_with_different_numbers_of_events(spark):
    """An asset with many more events than its neighbour loses none of them."""
    minutes = np.arange(300)
    risk = np.where(minutes % 10 < 3, 0.9, 0.0)
    rows = minute_rows(spark, minutes, {"maintenance_risk": risk}, 0).unionByName(
        minute_rows(spark, minutes, {"maintenance_risk": risk}, 1)
    )
    rows = rows.select(F.lit("w").alias("workflow_id"), "*", (F.col("us") > 0).alias("linked"))
    starts = [(0, 5)] + [(1, 10 * i + 5) for i in range(1, 25)]
    listed = [(a, i, m * MINUTE_US, m * MINUTE_US) for i, (a, m) in enumerate(starts)]
    event = spark.createDataFrame(listed, "asset_id bigint, ordinal int, start_us bigint, end_us bigint")
    grid = spark.createDataFrame([("w", 0), ("w", 1)], "workflow_id string, asset_id bigint")
    params = StudyParams(lead_minutes=8)
    got = threshold_sweep(rows, grid, event, [0.5], params, 47 * MINUTE_US).collect()
    assert {r["asset_id"]: (r["tp"], r["fp"], r["fn"]) for r in got} == {0: (1, 29, 0), 1: (24, 6, 0)}


def test_adaptation_rows_are_bounded(spark):
    """A refit holds each training row once, however long the window is."""
    from dataclasses import replace

    study = compressor_study(spark, params=replace(SMALL, sequence_length=20))
    d = Detectors(study)
    rows = d.component_training(STRATEGIES["linear_per_maintenance"])
    assert rows.count() <= d.rows.count() * (1 + study.cycles.count())
    sums = {(r["asset_id"], r["model_cycle"]): r["w"] for r in
            rows.groupBy("asset_id", "model_cycle").agg(F.sum("weight").alias("w")).collect()}
    windows = d.mix.groupBy("asset_id", F.col("cycle_id").alias("model_cycle")).agg(F.count(F.lit(1)).alias("n"))
    for r in windows.collect():
        assert sums[r["asset_id"], r["model_cycle"]] == 20 * r["n"]


def test_lineage_of_results_is_the_one_that_scores(spark, detectors):
    e = evaluate(detectors, ["linear_per_maintenance"])
    scored = e.scores.select("asset_id", "cycle_id", "model_cycle").distinct()
    told = e.lineage.select("asset_id", "cycle_id", F.col("effective_model_cycle").alias("model_cycle"))
    assert scored.join(told, scored.columns, "left_anti").count() == 0


def test_package_reaches_workers_from_elsewhere(tmp_path):
    """A session started in another folder, without PYTHONPATH, runs Python stages."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', 2).getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('rows', e.queries()['h7_pareto_front'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 7" in out.stdout, out.stderr[-2000:]


def test_schedule_table_with_its_problems(spark):
    table = spark.createDataFrame(
        [
            (0, "2020-01-01 04:00:00", "2020-01-01 04:10:00", "a", "high"),
            (0, "2020-01-01 07:20:00", "2020-01-01 07:10:00", "b", "high"),
            (0, "2020-01-01 07:10:00", "not a time", "c", "high"),
            (0, "2020-01-01 07:12:00", "2020-01-01 07:20:00", "d", "high"),
            (7, "2020-01-01 04:00:00", "2020-01-01 04:10:00", "a", "high"),
        ],
        "asset_id bigint, start string, end string, event_id string, severity string",
    )
    study = compressor_study(spark, windows=table)
    listed = {(r["asset_id"], r["event_id"], r["ordinal"]) for r in study.events.collect()}
    assert listed == {(0, "a", 1), (0, "d", 2)}
    problems = {(r["asset_id"], r["problem"]): r["findings"] for r in study.problems.collect()}
    assert problems[0, "invalid_event"] == 2 and problems[1, "no_event"] == 1
    cycles = {(r["asset_id"], r["cycle_id"]) for r in study.cycles.collect()}
    assert cycles == {(0, 0), (0, 1), (0, 2)}
    with pytest.raises(ValueError):
        maintenance.table_events(table.drop("severity"))


def test_stored_study_is_taken_only_for_its_input(spark, study, tmp_path):
    path = f"file://{tmp_path}/study"
    assert not load_study(compressor_study(spark), path)
    save_study(study, path)
    again = compressor_study(spark)
    assert load_study(again, path)
    assert again.scaler.exceptAll(study.scaler).count() == 0
    assert again.timeline.count() == study.timeline.count()
    from dataclasses import replace

    assert not load_study(compressor_study(spark, params=replace(SMALL, risk_window_minutes=11)), path)
    other = compressor_study(spark)
    other.base = other.base.filter("us % 60000000 = 0 AND asset_id = 0")
    assert not load_study(other, path)


def test_compressor_study_from_files(spark, tmp_path):
    rows = fleet_rows(spark).select(
        F.col("us").cast("string").alias("Unnamed: 0"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("asset_id").cast("string").alias("asset"),
        *telemetry.COMPRESSOR_CHANNELS,
    )
    sinks.write_csv(rows, f"{tmp_path}/csv")
    study = type(compressor_study(spark)).compressor(
        spark, f"{tmp_path}/csv", rows.columns, asset_column="asset", params=SMALL
    )
    assert study.base.count() == fleet_rows(spark).count()
    assert study.events.filter("asset_id = 0").count() == 21


def test_ledger_append_adds_only_new_keys(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame(
        [(i, "s", "c", f"h{i % 4}", "t") for i in range(8)],
        "id int, study_id string, search_contract_fingerprint string, architecture_hash string, created_at string",
    )
    assert ledgers.append_new(spark, path, rows.filter("id < 2")) == 2
    assert ledgers.append_new(spark, path, rows) == 2
    assert ledgers.append_new(spark, path, rows) == 0
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
