"""Rows of one asset that share an instant: their pairs are counted and never made."""

from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sensorhealth import StudyParams
from sensorhealth.operators import contract, events, report
from sensorhealth.operators.risk import alarm_flags, threshold_sweep
from sensorhealth.params import MINUTE_US
from sensorhealth.plans.evaluation import Evaluation

COPIES = 6
LENGTH = 4


@pytest.fixture(scope="module")
def evaluation(spark):
    """Forty minutes of one run with ``COPIES`` rows a minute; a first minute with a single row."""
    rows = [(0, 0, 1)] + [(0, m, 2 + (m - 1) * COPIES + i) for m in range(1, 40) for i in range(COPIES)]
    rows += [(0, 60, 1 + i) for i in range(LENGTH)]
    timeline = spark.createDataFrame(
        [(a, m * MINUTE_US, p, 0 if m < 60 else 60 * MINUTE_US, p >= LENGTH, 1) for a, m, p in rows],
        "asset_id bigint, us bigint, eval_pos bigint, eval_run bigint, evaluation boolean, cycle_id int",
    )
    risk = lambda m: None if m == 20 else 0.9 if m % 9 < 3 else 0.2
    predictions = spark.createDataFrame(
        [("w", a, m * MINUTE_US, risk(m), 1) for a, m, p in rows if p >= LENGTH and m != 30],
        "workflow_id string, asset_id bigint, us bigint, maintenance_risk double, cycle_id int",
    )
    study = SimpleNamespace(timeline=timeline, params=StudyParams(sequence_length=LENGTH))
    found = Evaluation(study, None, None, {"w": "static"})
    found.__dict__["predictions"] = predictions
    return found


def test_equal_pairs_are_merged(spark, evaluation):
    columns = ["workflow_id", "asset_id", "us", "linked", "chain", "maintenance_risk"]
    every = Counter(tuple(r) for r in evaluation.aligned.select(*columns).collect())
    merged = evaluation.merged.select(*columns, "weight").collect()
    counted = Counter()
    for r in merged:
        counted[tuple(r)[:-1]] += r["weight"]
    assert counted == every
    linked = [r for r in merged if r["linked"]]
    assert len(linked) == 39 and max(r["weight"] for r in linked) == COPIES**2
    assert all(r["weight"] == 1 for r in merged if not r["linked"])


def test_metrics_of_merged_rows(spark, evaluation):
    grid = spark.createDataFrame([("w", 0)], "workflow_id string, asset_id bigint")
    event = spark.createDataFrame(
        [(0, 1, 22 * MINUTE_US, 23 * MINUTE_US)], "asset_id bigint, ordinal int, start_us bigint, end_us bigint"
    )
    selected = spark.createDataFrame([("w", 0.5)], "workflow_id string, maintenance_risk_theta double")
    width, params = 7 * MINUTE_US, StudyParams(lead_minutes=10)

    def measured(rows):
        alarms = alarm_flags(rows, selected)
        sweep = threshold_sweep(rows, grid, event, [0.1, 0.5, 0.95], params, width)
        tables = sweep, events.alarm_intervals(alarms, width), events.alarm_coverage(alarms)
        chart = report.bucketed_timeline(alarms).withColumn("mean_risk", F.round("mean_risk", 9))
        return [sorted(map(tuple, t.collect())) for t in (*tables, chart)]

    # Rows that begin a run have no order among others of their instant, so only linked rows are compared.
    assert measured(evaluation.merged.filter("linked")) == measured(evaluation.aligned.filter("linked"))


def test_row_cycles_of_shared_instants(spark, evaluation):
    timeline, predictions = evaluation.study.timeline, evaluation.predictions
    moved = predictions.withColumn("cycle_id", F.lit(0))
    problems = contract.row_cycle_problems(moved, timeline)
    assert problems.count() == predictions.count()
    pairs = predictions.join(timeline.filter("evaluation"), ["asset_id", "us"]).count()
    assert pairs > 4 * predictions.count()
    found = contract.check_summary(
        {"moved": problems, "right": contract.row_cycle_problems(predictions, timeline)}
    )
    assert {r["check_name"]: r["violations"] for r in found.collect()} == {"moved": pairs, "right": 0}
