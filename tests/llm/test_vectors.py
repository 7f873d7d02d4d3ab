import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorhealth.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, list string"


def brute(ids, rows, queries, k):
    out = {}
    for q in queries:
        scores = (rows * rows[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df, settings=vectors.Settings()):
    rows = vectors.nearest(df, F.col("vec_id") % 20 == 0, settings).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, ids, rows):
    return spark.createDataFrame([(int(i), r if r is None else [None if x is None else float(x) for x in r], 0, "own") for i, r in zip(ids, rows)], SCHEMA)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_against_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 24))
    rows = (centres[rng.integers(0, 12, 6000)] + spread * rng.standard_normal((6000, 24))).astype(np.float32)
    rows *= rng.uniform(0.5, 2, (6000, 1)).astype(np.float32)
    ids = rng.permutation(6000)
    exact = brute(ids, rows.astype(np.float64), np.flatnonzero(ids % 20 == 0), 20)
    small = vectors.Settings(list_rows=100, block_rows=64, chunk_rows=32, sample_rows=1500, bound_rows=300)
    got = found(table(spark, ids, rows.tolist()), small)
    assert got.keys() == exact.keys() and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in exact[q]}) / 20 for q in exact]
    assert np.mean(hits) >= 0.9
    score = {(q, i): s for q, own in exact.items() for i, s in own}
    assert all(abs(s - score.get((q, i), s)) < 1e-9 for q, own in got.items() for i, s in own)


def test_copies_ties_and_odd_vectors(spark):
    same = [1.0, 0.0, 0.0]
    rows = [same] * 300 + [None, [0.0, 0.0, 0.0], [None, 1.0, 0.0], [float("nan"), 1, 1], [float("inf"), 1, 1], [1.0, 2.0], []]
    got = found(table(spark, range(len(rows)), rows), vectors.Settings(block_rows=32, chunk_rows=16))
    assert set(got) == set(range(0, 300, 20))
    for q, own in got.items():
        assert own == [(i, 1.0) for i in range(300) if i != q][:20]


def test_few_and_no_candidates(spark):
    assert found(table(spark, [], [])) == {}
    assert found(table(spark, [0], [[1.0]])) == {}
    got = found(table(spark, [0, 1, 20, 20], [[1.0, 0], [0.5, 1], [3.0, 1], [3.0, 1]]))
    assert got == {0: [(20, 3.0), (1, 0.5)], 20: [(0, 3.0), (1, 2.5)]}
