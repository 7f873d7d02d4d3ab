"""Candidate objectives, ledger selection and diagnostics.

The ledger of the driver tables has one candidate per supplier of ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as cand
from ..operators.reconstruction import SMAPE_EPSILON
from ..plans.search import evaluate_candidates
from ..sources import ledger as ledgers
from . import query, tidy
from .oracle import FEATURES, L, P, sql

STUDY = ["study_id", "search_contract_fingerprint"]


def candidate_ledger(p):
    """Candidates with objectives averaged over a supplier's lines."""
    lines = p.table("lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.round(F.avg("l_tax"), 6).alias("obj_error"),
        F.round(F.avg("l_discount"), 6).alias("obj_pdm"),
        F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("obj_alarm_burden"),
        F.count(F.lit(1)).alias("line_count"),
    )
    numbers = F.struct(F.col("line_count"), (F.col("id") * 10).alias("parameter_count"))
    return lines.select(
        "id",
        F.concat(F.lit("study_"), (F.col("id") % 3).cast("string")).alias("study_id"),
        F.lit("contract").alias("search_contract_fingerprint"),
        F.md5(F.col("id").cast("string")).alias("architecture_hash"),
        *cand.OBJECTIVES,
        F.lit("valid").alias("status"),
        F.to_json(numbers).alias("diagnostics_json"),
        F.format_string("2024-01-01T00:%02d:00", F.col("id") % 60).alias("created_at"),
    )


FAILED = "obj_alarm_burden > 0.34"


def failing(p):
    """The ledger as evaluation returns it: some candidates come back without an error score."""
    return candidate_ledger(p).drop("status").withColumn(
        "obj_error", F.when(~F.expr(FAILED), F.col("obj_error"))
    )


@query("h1_candidate_objectives")
def h1(p):
    return tidy(evaluate_candidates(p.detectors, [1, 2, 3]))


AUROC = """SELECT workflow_id, cycle_id, count(*) FILTER (phase = 1) AS positive_windows,
                  count(*) FILTER (phase <> 1) AS negative_windows,
                  CASE WHEN count(*) FILTER (phase = 1) > 0 AND count(*) FILTER (phase <> 1) > 0 THEN
                    (sum(CASE WHEN phase = 1 THEN rk END) - count(*) FILTER (phase = 1)
                     * (count(*) FILTER (phase = 1) + 1) / 2)
                    / (count(*) FILTER (phase = 1) * count(*) FILTER (phase <> 1)) END AS smoothed_auroc,
                  avg(CASE WHEN phase <> 1 THEN CASE WHEN maintenance_risk >= {limit} THEN 1.0 ELSE 0.0
                      END END) AS normal_high_risk_rate
           FROM (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY workflow_id, cycle_id,
                        maintenance_risk) - 1) / 2 AS rk
                 FROM predictions WHERE maintenance_risk IS NOT NULL WINDOW w AS (PARTITION BY workflow_id, cycle_id
                                               ORDER BY maintenance_risk))
           GROUP BY workflow_id, cycle_id""".format(limit=P.alarm_burden_threshold)


SMAPE = " + ".join(
    f"2.0 * abs(s.{f} - m.m_{f}) / (abs(s.{f}) + abs(m.m_{f}) + {SMAPE_EPSILON})" for f in FEATURES
)


@query(
    "h1_mean_candidate",
    sql(
        f"""SELECT 'linear_0' AS workflow_id, positive_windows + negative_windows AS search_windows,
                   positive_windows, negative_windows, round(smoothed_auroc, 6) AS smoothed_auroc,
                   round(2 * smoothed_auroc - 1, 6) AS smoothed_rank_gap,
                   round(CASE WHEN smoothed_auroc IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0,
                         1 - smoothed_auroc)) END, 6) AS obj_pdm,
                   round(CASE WHEN smoothed_auroc IS NULL THEN 1.0 ELSE normal_high_risk_rate END, 6)
                   AS obj_alarm_burden,
                   CASE WHEN smoothed_auroc IS NULL THEN '{cand.MISSING_CLASS}' END AS pdm_invalid_reason,
                   (SELECT round(sum(window_sum) / (count(*) * {L * len(FEATURES)}), 6) FROM (
                      SELECT src_pos, sum(row_smape) OVER (PARTITION BY asset_id, src_run ORDER BY us
                             ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS window_sum
                      FROM (SELECT t.asset_id, t.us, t.src_run, t.src_pos, {SMAPE} AS row_smape
                            FROM timeline t JOIN scaled s USING (asset_id, us)
                            JOIN mix_mean m ON m.asset_id = t.asset_id AND m.model_cycle = 0
                            WHERE t.cycle_id = 0)) WHERE src_pos >= {L}) AS obj_error,
                   'valid' AS status
            FROM ({AUROC}) WHERE workflow_id = 'mean_per_maintenance' AND cycle_id = 0"""
    ),
)
def h1_mean(p):
    """The candidate without components, whose objectives have a closed form."""
    return tidy(evaluate_candidates(p.detectors, [0]))


def labelled(p):
    return p.distance.predictions.withColumn("_positive", F.col("phase") == 1)


@query(
    "h2_auroc",
    sql(
        f"""SELECT workflow_id, cycle_id::BIGINT AS cycle_id, positive_windows, negative_windows,
                   round(smoothed_auroc, 6) AS smoothed_auroc FROM ({AUROC})"""
    ),
)
def h2(p):
    return tidy(
        cand.auroc(labelled(p), ["workflow_id", "cycle_id"], "maintenance_risk", "_positive")
    )


@query(
    "h3_normal_high_risk_rate",
    sql(
        f"""SELECT workflow_id, cycle_id::BIGINT AS cycle_id,
                   round(normal_high_risk_rate, 6) AS normal_high_risk_rate FROM ({AUROC})"""
    ),
)
def h3(p):
    keys = ["workflow_id", "cycle_id"]
    return tidy(
        cand.high_risk_rate(
            labelled(p), keys, "maintenance_risk", "_positive", P.alarm_burden_threshold
        )
    )


PENALISED = f"""SELECT id, CASE WHEN {FAILED} THEN {P.invalid_penalty} ELSE obj_error END AS obj_error,
       CASE WHEN {FAILED} THEN {P.invalid_penalty} ELSE obj_pdm END AS obj_pdm,
       CASE WHEN {FAILED} THEN {P.invalid_penalty} ELSE obj_alarm_burden END AS obj_alarm_burden,
       CASE WHEN {FAILED} THEN 'invalid' ELSE 'valid' END AS status FROM candidates"""


@query("h4_failed_candidates", sql(PENALISED))
def h4(p):
    return cand.with_status(failing(p).select("id", *cand.OBJECTIVES), P.invalid_penalty)


@query(
    "h5_memoised_lookup",
    sql("SELECT id, architecture_hash FROM ledger WHERE NOT obj_error < 0.04"),
)
def h5(p):
    everything = candidate_ledger(p)
    known = everything.filter("obj_error < 0.04")
    return ledgers.new_candidates(known, everything).select("id", "architecture_hash")


@query("h6_valid_candidates", sql(f"SELECT id, obj_error FROM ({PENALISED}) WHERE status = 'valid'"))
def h6(p):
    rows = cand.with_status(failing(p), P.invalid_penalty)
    return cand.valid_candidates(rows, P.invalid_penalty).select("id", "obj_error")


@query("h7_pareto_front", sql("SELECT study_id, id, obj_error, obj_pdm, obj_alarm_burden FROM front"))
def h7(p):
    valid = cand.valid_candidates(candidate_ledger(p), P.invalid_penalty)
    return cand.pareto_front(valid, STUDY).select("study_id", "id", *cand.OBJECTIVES)


def weighted() -> str:
    weights = [w / sum(P.winner_weights) for w in P.winner_weights]
    return " + ".join(
        f"{w} * pow(CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0 END, 2)"
        for c, w in zip(cand.OBJECTIVES, weights, strict=True)
    )


@query(
    "h8_winner",
    sql(
        f"""SELECT study_id, search_contract_fingerprint, id, obj_error, obj_pdm, obj_alarm_burden,
                   round(distance, 6) AS distance,
                   (SELECT count(*) FROM ledger l WHERE l.study_id = b.study_id) AS candidate_count,
                   (SELECT count(*) FROM valid_candidates v WHERE v.study_id = b.study_id)
                   AS valid_candidate_count,
                   (SELECT count(*) FROM front f WHERE f.study_id = b.study_id)
                   AS pareto_candidate_count
            FROM (SELECT *, min(distance) OVER (PARTITION BY study_id) AS best FROM (
                    SELECT *, sqrt({weighted()}) AS distance FROM (
                      SELECT *, """
        + ", ".join(
            f"min({c}) OVER (PARTITION BY study_id) AS lo_{c}, max({c}) OVER (PARTITION BY study_id) AS hi_{c}"
            for c in cand.OBJECTIVES
        )
        + """ FROM front))) b
            WHERE distance - best <= 1e-12
            QUALIFY row_number() OVER (PARTITION BY study_id
                ORDER BY obj_alarm_burden, obj_pdm, obj_error, created_at, id) = 1"""
    ),
)
def h8(p):
    everything = candidate_ledger(p)
    valid = cand.valid_candidates(everything, P.invalid_penalty)
    counted = everything.withColumn("_valid", cand.is_valid(P.invalid_penalty))
    return tidy(cand.winner(counted, cand.pareto_front(valid, STUDY), STUDY, P))


@query(
    "h9_candidate_diagnostics",
    sql(
        f"""SELECT workflow_id, cycle_id::BIGINT AS cycle_id,
                   positive_windows + negative_windows AS search_windows, positive_windows,
                   negative_windows, round(smoothed_auroc, 6) AS smoothed_auroc,
                   round(2 * smoothed_auroc - 1, 6) AS smoothed_rank_gap,
                   round(CASE WHEN smoothed_auroc IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0,
                         1 - smoothed_auroc)) END, 6) AS obj_pdm,
                   round(CASE WHEN smoothed_auroc IS NULL THEN 1.0 ELSE normal_high_risk_rate END, 6)
                   AS obj_alarm_burden,
                   CASE WHEN smoothed_auroc IS NULL THEN '{cand.MISSING_CLASS}' END AS pdm_invalid_reason
            FROM ({AUROC})"""
    ),
)
def h9(p):
    return tidy(
        cand.diagnostics(
            labelled(p), ["workflow_id", "cycle_id"], "maintenance_risk", "_positive", P
        )
    )
