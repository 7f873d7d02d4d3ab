"""Interval joins by time bucket and lead-time matching, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from sensorhealth.operators import calendar, events
from sensorhealth.params import DAY_US, HOUR_US, MINUTE_US, StudyParams

ROWS, LABELLED = "asset_id bigint, us bigint", "asset_id bigint, from_us bigint, to_us bigint, label int"


def disjoint(rng, n, span):
    marks = sorted(rng.sample(range(-span, span), 2 * n))
    return list(zip(marks[::2], marks[1::2]))


@pytest.mark.parametrize("width", [7, 1000, 10**9])
def test_interval_join_at_any_bucket_width(spark, width):
    rng = random.Random(width)
    given = {a: disjoint(rng, 30, 4000) for a in (0, 1)}
    given[1] += [(5000, 5000), (6000, 5990)]
    rows = [(a, rng.randrange(-4100, 6100)) for a in (0, 1, 2) for _ in range(400)] + [(1, 5000), (1, 5995)]
    listed = [(a, s, t, k) for a, own in given.items() for k, (s, t) in enumerate(own)] + [(0, None, 9000, 99)]
    left = spark.createDataFrame(rows, ROWS)
    joined = calendar.interval_join(left, spark.createDataFrame(listed, LABELLED), ["label"], width=width)
    want = [(a, us, next((k for k, (s, t) in enumerate(given.get(a, ())) if s <= us <= t), None)) for a, us in rows]
    assert joined.columns == ["asset_id", "us", "label"]
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(want, key=str)


def test_many_events_of_one_asset(spark):
    """5,000 events: rows meet those of their bucket, and no join is on the asset alone."""
    listed = spark.range(5000).select(
        F.least("id", F.lit(0)).alias("asset_id"), (F.col("id") * HOUR_US).alias("from_us"),
        (F.col("id") * HOUR_US + 20 * MINUTE_US).alias("to_us"), F.col("id").cast("int").alias("label"),
    )
    rows = spark.range(0, 5000 * 60, 7).select(F.least("id", F.lit(0)).alias("asset_id"), (F.col("id") * MINUTE_US).alias("us"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = calendar.interval_join(rows, listed, ["label"], width=DAY_US)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [asset_id" in plan and ", _bucket#" in plan.split("SortMergeJoin [asset_id")[1][:60]
        minute = (F.col("us") / MINUTE_US).cast("bigint")
        wrong = joined.filter(~F.col("label").eqNullSafe(F.when(minute % 60 <= 20, F.floor(minute / 60).cast("int"))))
        assert joined.count() == rows.count() and wrong.isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def islands(rng, n):
    return [(s * MINUTE_US, t * MINUTE_US) for s, t in disjoint(rng, n, 3000)]


EVENTS = "workflow_id string, asset_id bigint, ordinal int, start_us bigint, end_us bigint"
ISLANDS = "workflow_id string, asset_id bigint, start_us bigint, end_us bigint"


@pytest.mark.parametrize("width", [11 * MINUTE_US, DAY_US * 30])
def test_lead_matches_and_warnings_against_loops(spark, width):
    rng = random.Random(width)
    params = StudyParams(lead_minutes=90)
    own = {("w", a): islands(rng, 60) for a in (0, 1)} | {("v", 0): []}
    listed = {k: sorted((s * MINUTE_US, t * MINUTE_US) for s, t in disjoint(rng, 25, 3000)) for k in own}
    made = [(*k, n, s, t) for k, l in listed.items() for n, (s, t) in enumerate(l, 1)]
    intervals = spark.createDataFrame([(*k, s, t) for k, l in own.items() for s, t in l], ISLANDS)
    grid = spark.createDataFrame(made, EVENTS)
    got = events.lead_time_matches(intervals, grid, params, [10, 60], width).collect()
    want = set()
    for (w, a), found in own.items():
        for lead in (10, 60):
            last = -1
            for n, (s, t) in enumerate(listed[w, a], 1):
                fits = [
                    i for i, (x, y) in enumerate(found)
                    if i > last and x <= t and y >= s - 90 * MINUTE_US and x <= s - lead * MINUTE_US
                ]
                last = fits[0] if fits else last
                want.add((w, a, lead, n, fits[0] + 1 if fits else None))
    assert {tuple(r[c] for c in ("workflow_id", "asset_id", "lead_minutes", "ordinal", "matched_no")) for r in got} == want
    fleet = grid.filter("workflow_id = 'w'").select("asset_id", "ordinal", "start_us", "end_us")
    pairs = events.warned(intervals.filter("workflow_id = 'w'"), fleet, 90, width).select("asset_id", "start_us", "ordinal")
    plain = [
        (a, x, n) for (w, a), found in own.items() if w == "w" for x, y in found
        for n, (s, _) in enumerate(listed[w, a], 1) if x <= s and y >= s - 90 * MINUTE_US
    ]
    assert sorted(map(tuple, pairs.collect())) == sorted(plain)
