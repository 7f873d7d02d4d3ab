"""Sliced operators against plain single-series computations."""

import numpy as np
import pandas as pd
import pytest
from helpers import minute_rows, random_series
from pyspark.sql import functions as F

from sensorhealth import StudyParams
from sensorhealth.operators import rolling, runs
from sensorhealth.operators.calibration import empirical_risk
from sensorhealth.operators.risk import segmented_risk
from sensorhealth.operators.slices import floor_div, grouped_median, running_totals, with_neighbour
from sensorhealth.params import AGGREGATIONS, MINUTE_US

WIDTHS = [5 * MINUTE_US, 60 * MINUTE_US, 10_000 * MINUTE_US]


def sliced(spark, frame, width):
    return spark.createDataFrame(frame).withColumn("slice", floor_div(F.col("us"), width))


def plain_runs(us, selected, gap):
    """Run start and position per row, row by row."""
    out, start, position, previous = [], None, 0, None
    for t, chosen in zip(us, selected, strict=True):
        broken = previous is None or t - previous > 1.5 * gap
        if not chosen:
            out.append((None, None))
            start = None
        else:
            if start is None or broken:
                start, position = t, 0
            position += 1
            out.append((start, position))
        previous = t
    return out


@pytest.mark.parametrize("width", WIDTHS)
def test_runs_do_not_depend_on_slices(spark, width):
    frame = random_series(1)
    rows = sliced(spark, frame, width)
    gaps = runs.median_gap(rows, ["asset_id"], "us", "slice")
    labelled = runs.label_runs(
        rows.join(gaps, "asset_id").withColumn("sel", F.when(F.col("flag"), F.lit(0))),
        ["asset_id"],
        "us",
        "slice",
        {"r": "sel"},
    ).toPandas()
    for asset, part in frame.groupby("asset_id"):
        steps = np.diff(part["us"])
        expected = plain_runs(part["us"], part["flag"], np.median(steps[steps > 0]))
        got = labelled[labelled["asset_id"] == asset].sort_values("us")
        found = [
            (None, None) if pd.isna(r) else (int(r), int(p))
            for r, p in zip(got["r_run"], got["r_pos"], strict=True)
        ]
        assert found == expected
        assert got["r_ord"].dropna().astype(int).tolist() == list(range(1, part["flag"].sum() + 1))


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours_cross_slices(spark, width):
    frame = random_series(2)
    rows = sliced(spark, frame, width)
    both = with_neighbour(rows, ["asset_id"], "us", "slice", {"x": "before"})
    both = with_neighbour(both, ["asset_id"], "us", "slice", {"x": "after"}, following=True)
    got = both.toPandas().sort_values(["asset_id", "us"])
    by_asset = frame.groupby("asset_id")["x"]
    np.testing.assert_array_equal(got["before"], by_asset.shift(1))
    np.testing.assert_array_equal(got["after"], by_asset.shift(-1))


def test_grouped_median_is_exact(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "key": rng.integers(0, 5, 2000),
            "v": np.r_[rng.normal(0, 1, 1000), np.zeros(500), rng.lognormal(0, 9, 500)],
        }
    )
    got = grouped_median(spark.createDataFrame(frame), ["key"], "v", "m").toPandas()
    expected = frame.groupby("key")["v"].median()
    np.testing.assert_allclose(got.set_index("key")["m"].sort_index(), expected, rtol=0, atol=0)


def test_running_totals_over_ties(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"key": rng.integers(0, 3, 900), "v": rng.integers(-20, 20, 900) / 8})
    got = running_totals(
        spark.createDataFrame(frame), ["key"], "v", {"rows": F.lit(1)}
    ).toPandas()
    for r in got.itertuples():
        values = frame.loc[frame["key"] == r.key, "v"]
        assert (r.n_rows, r.upto_rows, r.all_rows) == (
            (values == r.v).sum(),
            (values <= r.v).sum(),
            len(values),
        )


def test_empirical_risk_matches_sorted_search(spark):
    rng = np.random.default_rng(5)
    reference = pd.DataFrame({"key": 0, "s": np.round(rng.exponential(1, 500), 2)})
    asked = pd.DataFrame(
        {"key": 0, "id": range(300), "s": np.r_[np.round(rng.exponential(1, 299), 2), np.nan]}
    )
    got = empirical_risk(
        spark.createDataFrame(reference), spark.createDataFrame(asked), ["key"], "s", "risk"
    ).toPandas()
    got = got.sort_values("id")
    ranks = np.searchsorted(np.sort(reference["s"]), asked["s"][:299], side="right") / 500
    np.testing.assert_allclose(got["risk"][:299], ranks)
    assert np.isnan(got["risk"].iloc[299])


@pytest.mark.parametrize("width", WIDTHS)
def test_rolling_features_match_pandas(spark, width):
    frame = random_series(6)
    window = 7 * MINUTE_US
    rows = sliced(spark, frame, width)
    got = (
        rolling.rolling_features(rows, ["asset_id"], "us", "slice", width, ["x"], window)
        .toPandas()
        .sort_values(["asset_id", "us"])
    )
    parts = []
    for _, part in frame.groupby("asset_id"):
        series = pd.Series(part["x"].to_numpy(), index=pd.to_datetime(part["us"], unit="us"))
        parts.append(series.rolling("7min", min_periods=1).agg(list(AGGREGATIONS)))
    expected = pd.concat(parts)
    for a in AGGREGATIONS:
        np.testing.assert_allclose(got[f"x__{a}"], expected[a], atol=1e-8)


def test_only_raw_rows_travel_for_features(spark):
    rows = sliced(spark, random_series(6), 40 * MINUTE_US)
    rolled = rolling.rolling_features(
        rows, ["asset_id"], "us", "_filled", 40 * MINUTE_US, ["x"], 7 * MINUTE_US, others=["flag"]
    )
    names = rolling.feature_names(["x"])
    filled = rolling.fill_inside(rolled, ["asset_id"], "us", "_filled", names)
    plan = filled._jdf.queryExecution().executedPlan().toString()
    steps = [next((s for s in ("Exchange", "FlatMapGroups") if s in line), None) for line in plan.splitlines()]
    assert [s for s in steps if s] == ["Exchange", "FlatMapGroups", "Exchange"]
    python = next(line for line in plan.splitlines() if "FlatMapGroups" in line)
    assert "x__median" in python and not any(n in python for n in names if n != "x__median")


@pytest.mark.parametrize("width", WIDTHS)
def test_fills_cross_slices(spark, width):
    frame = random_series(7).drop(columns="flag")
    frame["y"] = frame["x"].where(frame["x"] > 6.5)
    rows = sliced(spark, frame, width).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = rolling.fill_series(rows, ["asset_id"], "us", "slice", ["y"]).toPandas()
    got = got.sort_values(["asset_id", "us"])
    expected = frame.groupby("asset_id")["y"].transform(lambda s: s.ffill().bfill())
    np.testing.assert_allclose(got["y"], expected)


@pytest.mark.parametrize("width", WIDTHS)
def test_segmented_risk_matches_rolling_mean(spark, width):
    frame = random_series(8).drop(columns=["flag"])
    frame["risk"] = (frame["x"] / 7.5).clip(0, 1)
    frame.loc[::17, "risk"] = np.nan
    params = StudyParams(risk_window_minutes=9, exceedance_quantile=0.8)
    rows = spark.createDataFrame(frame).withColumn("risk", F.nanvl("risk", F.lit(None)))
    got = segmented_risk(rows, ["asset_id"], "us", "risk", params, width, "m").toPandas()
    got = got.sort_values(["asset_id", "us"])
    expected = []
    for _, part in frame.groupby("asset_id"):
        steps = np.diff(part["us"])
        labels = plain_runs(part["us"], part["risk"].notna(), np.median(steps[steps > 0]))
        run = pd.Series([r for r, _ in labels], index=part.index, dtype=float)
        for _, piece in part.groupby(run):
            series = pd.Series(
                (piece["risk"] >= 0.8).astype(float).to_numpy(),
                index=pd.to_datetime(piece["us"], unit="us"),
            )
            expected.append(
                pd.Series(series.rolling("9min", min_periods=1).mean().to_numpy(), index=piece.index)
            )
    expected = pd.concat(expected).reindex(frame.index)
    np.testing.assert_allclose(got["m"], expected, atol=1e-12)


def test_anchor_literals(spark):
    mask = [c == "T" for c in "TTTFTTTTFT"]
    rows = minute_rows(spark, range(10), {"chosen": mask}).withColumn(
        "sel", F.when(F.col("chosen"), F.lit(0))
    )
    labelled = runs.label_runs(
        rows.withColumn("gap_us", F.lit(float(MINUTE_US))), ["asset_id"], "us", "slice", {"r": "sel"}
    )
    anchors = labelled.filter(runs.is_anchor(F.col("r_pos"), 3, 1)).orderBy("us").collect()
    assert [r["us"] // MINUTE_US for r in anchors] == [2, 6, 7]


def test_risk_restarts_after_a_gap(spark):
    rows = minute_rows(spark, [0, 1, 2, 4, 5], {"risk": [1.0, 1, 1, 0, 0]}).drop("slice")
    params = StudyParams(risk_window_minutes=120)
    got = segmented_risk(rows, ["asset_id"], "us", "risk", params, 2 * MINUTE_US, "m")
    values = [r["m"] for r in got.orderBy("us").collect()]
    assert values == [1.0, 1.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("length", [1, 4, 7])
def test_sequence_windows_cross_chunks(spark, monkeypatch, length):
    monkeypatch.setattr(runs, "CHUNK_ROWS", 10)
    rows = sliced(spark, random_series(9, assets=2), 5 * MINUTE_US)
    gaps = runs.median_gap(rows, ["asset_id"], "us", "slice")
    chosen = rows.join(gaps, "asset_id").withColumn("sel", F.when(F.col("flag"), F.lit(0)))
    chosen = chosen.withColumn("x", F.when(F.pmod(F.col("us"), F.lit(7)) != 0, F.col("x")))
    labelled = runs.label_runs(chosen, ["asset_id"], "us", "slice", {"r": "sel"})
    sums = runs.over_sequence(
        labelled, ["asset_id"], "r_run", "r_pos", length, {"total": F.sum("x"), "n": F.count(F.lit(1))}
    )
    means = runs.mean_over_sequence(labelled, ["asset_id"], "r_run", "r_pos", length, "x", "mean")
    part = labelled.filter("r_run IS NOT NULL").toPandas().sort_values(["asset_id", "us"])
    rolled = part.groupby(["asset_id", "r_run"])["x"].rolling(length, min_periods=1)
    both = sums.join(means.select("asset_id", "us", "mean"), ["asset_id", "us"]).toPandas()
    both = both.sort_values(["asset_id", "us"])
    assert len(both) == len(part)
    np.testing.assert_allclose(both["total"], rolled.sum().to_numpy())
    np.testing.assert_allclose(both["mean"], rolled.mean().to_numpy())
    np.testing.assert_array_equal(both["n"], np.minimum(both["r_pos"], length))


def test_rolling_spread_survives_a_moved_level(spark):
    """A level that jumps between windows does not cancel the small spread on either side."""
    minutes = np.arange(240)
    x = np.where(minutes < 120, 0.0, 1e5) + 1e-3 * np.sin(minutes)
    rows = minute_rows(spark, minutes, {"x": x})
    got = rolling.rolling_features(
        rows, ["asset_id"], "us", "slice", 40 * MINUTE_US, ["x"], 10 * MINUTE_US, ("std", "skew")
    ).orderBy("us").toPandas()
    for t in (*range(20, 120), *range(140, 240)):
        window = x[t - 9 : t + 1] - x[t]
        assert got["x__std"][t] == pytest.approx(window.std(ddof=1), rel=1e-5)
        assert np.isfinite(got["x__skew"][t])
