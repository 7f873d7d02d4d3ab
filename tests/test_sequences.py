"""Order-aware window models and chained adaptation, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorhealth.operators import runs
from sensorhealth.operators.reconstruction import chained, decomposed
from sensorhealth.operators.sequences import score_windows, window_moments

L, SIZE = 4, 3
SCHEMA = "asset_id bigint, us bigint, run bigint, pos bigint, features array<double>, model_cycles array<int>"


def series(rng, lengths):
    """Rows of several runs of two assets; each row lists some models."""
    out, us = [], 0
    for asset in (0, 1):
        for n in lengths:
            run = us
            for pos in range(1, n + 1):
                models = None if rng.random() < 0.2 else [m for m in range(3) if rng.random() < 0.5]
                out.append((asset, us, run, pos, rng.normal(size=SIZE).tolist(), models))
                us += 1
    return out


def windows(rows):
    """(asset, us, models, window) of every complete window."""
    at = {(r[0], r[2], r[3]): r for r in rows}
    for a, us, run, pos, _, models in rows:
        if pos >= L:
            yield a, us, models or [], np.concatenate([at[a, run, pos - L + 1 + i][4] for i in range(L)])


@pytest.fixture(params=[None, 6])
def small(request, spark, monkeypatch):
    """Also with tiny chunks and batches, so that windows cross both."""
    if request.param:
        monkeypatch.setattr(runs, "CHUNK_ROWS", request.param)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def moments_of(df):
    return window_moments(df, ["asset_id"], "run", "pos", "features", "model_cycles", "model_cycle", L)


def test_moments_and_scores_against_numpy(spark, small):
    rows = series(np.random.default_rng(2), [1, 3, 4, 5, 23, 40])
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sums = {}
    for a, _, models, w in windows(rows):
        for m in models:
            part = np.concatenate([[1.0], w, np.outer(w, w).ravel()])
            sums[a, m] = sums.get((a, m), 0.0) + part
    got = {}
    for r in moments_of(table).collect():
        got.setdefault((r["asset_id"], r["model_cycle"]), {})[r["cell"]] = r["amount"]
    assert got.keys() == sums.keys()
    for key, want in sums.items():
        assert np.allclose([got[key][c] for c in range(len(want))], want)
    fitted = decomposed(moments_of(table), ["asset_id", "model_cycle"], L * SIZE, 2)
    models = {(r["asset_id"], r["model_cycle"]): (np.array(r["mean"]), np.array(r["components"])) for r in fitted.collect()}
    scored = score_windows(
        table, fitted, ["asset_id"], "us", "run", "pos", "features", "model_cycles", "model_cycle", L, 30
    ).collect()
    want = {}
    for a, us, listed, w in windows(rows):
        for m in listed:
            mean, parts = models[a, m]
            rebuilt = mean + parts.T @ (parts @ (w - mean))
            want[a, us, m] = ((w - rebuilt) ** 2).mean()
    found = {(r["asset_id"], r["us"], r["model_cycle"]): r["anomaly_score"] for r in scored}
    assert len(found) == len(scored) and found.keys() == want.keys()
    assert all(abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_the_order_of_a_window_matters(spark):
    noise = np.random.default_rng(3).normal(size=(400, SIZE))
    steady = np.sin(np.arange(400)[:, None] / 2 + np.arange(SIZE)) + 0.02 * noise
    rows = [(0, i, 0, i + 1, x.tolist(), [0]) for i, x in enumerate(steady)]
    fitted = decomposed(moments_of(spark.createDataFrame(rows, SCHEMA)), ["asset_id", "model_cycle"], L * SIZE, 3)
    window = steady[100:104]
    asked = [
        (0, 10 * k + i, 10 * k, i + 1, x.tolist(), [0])
        for k, order in enumerate([(0, 1, 2, 3), (3, 0, 2, 1)])
        for i, x in enumerate(window[list(order)])
    ]
    args = ("us", "run", "pos", "features", "model_cycles", "model_cycle", L, 10**6)
    scored = score_windows(spark.createDataFrame(asked, SCHEMA), fitted, ["asset_id"], *args).orderBy("us").collect()
    ordered, permuted = (r["anomaly_score"] for r in scored)
    assert permuted > 100 * ordered > 0


def test_rows_without_features_or_models_have_no_score(spark):
    rows = [(0, i, 0, i + 1, [1.0 * i] * SIZE, [0, 7]) for i in range(6)] + [(1, 50 + i, 50, i + 1, None, [0]) for i in range(5)]
    table = spark.createDataFrame(rows, SCHEMA)
    fitted = decomposed(
        moments_of(table.filter("asset_id = 0").withColumn("model_cycles", F.array(F.lit(0)))), ["asset_id", "model_cycle"], L * SIZE, 1
    )
    args = ("us", "run", "pos", "features", "model_cycles", "model_cycle", L, 1000)
    scored = score_windows(table, fitted, ["asset_id"], *args)
    told = sorted((r["asset_id"], r["us"], r["model_cycle"], r["anomaly_score"] is None) for r in scored.collect())
    assert told == [(0, u, m, m == 7) for u in (3, 4, 5) for m in (0, 7)] + [(1, u, 0, True) for u in (53, 54)]


def test_chained_models_start_from_the_one_before(spark):
    rng = np.random.default_rng(4)
    own = {(a, s): rng.random(9000) for a in (0, 1) for s in (0, 2, 5, 6)[: 4 - a]}
    rows = [(a, s, c, float(x)) for (a, s), v in own.items() for c, x in enumerate(v)]
    table = spark.createDataFrame(rows, "asset_id bigint, model_cycle int, cell int, amount double")
    got = {}
    for r in chained(table, ["asset_id", "model_cycle"], "model_cycle", 0.25).collect():
        got.setdefault((r["asset_id"], r["model_cycle"]), np.zeros(9000))[r["cell"]] = r["amount"]
    for a in (0, 1):
        state = np.zeros(9000)
        for s in sorted(s for b, s in own if b == a):
            state = own[a, s] + 0.25 * state
            assert np.allclose(got[a, s], state)
    assert len(got) == len(own)
