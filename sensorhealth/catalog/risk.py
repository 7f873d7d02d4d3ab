"""Calibration, risk and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.calibration import empirical_risk, reference_problems
from ..operators.contract import check_summary, population_differences
from ..operators.risk import (
    alarm_flags,
    exceeds,
    fleet_sweep,
    operating_point,
    segmented_risk,
    threshold_sweep,
)
from ..plans.evaluation import CALIBRATOR, CYCLE
from . import query, tidy
from .oracle import P, sql


@query(
    "c1_cdf_fit",
    sql("SELECT workflow_id, asset_id, model_cycle::BIGINT AS model_cycle, us, anomaly_score FROM cal_ref"),
)
def c1(p):
    return tidy(p.distance.reference.select(*CALIBRATOR, "us", "anomaly_score"))


@query(
    "c1_reference_checks",
    sql(
        """SELECT 'short_reference' AS check_name, count(*) AS violations FROM (
             SELECT workflow_id, asset_id, model_cycle FROM cal_ref GROUP BY ALL HAVING count(*) < 2)
           UNION ALL
           SELECT 'unscored_anchor', (SELECT count(*) FROM cal WHERE anomaly_score IS NULL)"""
    ),
)
def c1_checks(p):
    """Calibrators with fewer than two scores, and reference anchors without a finite score."""
    reference = p.distance.reference
    models = p.distance.lineage.select(
        "workflow_id", "asset_id", F.col("effective_model_cycle").alias("model_cycle")
    ).distinct()
    anchors = p.study.timeline.filter("calibration").select("asset_id", "us").join(models, "asset_id")
    keys = [*CALIBRATOR, "us"]
    return check_summary(
        {
            "short_reference": reference_problems(reference, CALIBRATOR),
            "unscored_anchor": population_differences(anchors, reference, keys),
        }
    )


@query(
    "c2_cdf_apply",
    sql("SELECT workflow_id, asset_id, us, round(risk_score, 6) AS risk_score FROM risked"),
)
def c2(p):
    e = p.distance
    risk = empirical_risk(e.reference, e.scores, CALIBRATOR, "anomaly_score", "risk_score")
    return tidy(risk.select("workflow_id", "asset_id", "us", "risk_score"))


@query(
    "c3_calibration_summary",
    sql(
        """SELECT workflow_id, asset_id, model_cycle::BIGINT AS model_cycle, count(*) AS reference_count,
                  round(min(anomaly_score), 6) AS minimum_score,
                  round(max(anomaly_score), 6) AS maximum_score
           FROM cal_ref GROUP BY workflow_id, asset_id, model_cycle"""
    ),
)
def c3(p):
    return tidy(p.distance.calibration_summary)


@query(
    "c4_exceedance",
    sql(
        f"""SELECT workflow_id, asset_id, us, CASE WHEN risk_score >= {P.exceedance_quantile} THEN 1.0
                   WHEN risk_score IS NOT NULL THEN 0.0 END AS exceedance FROM risked"""
    ),
)
def c4(p):
    return p.distance.risk.select(
        "workflow_id", "asset_id", "us", exceeds(F.col("risk_score"), P.exceedance_quantile).alias("exceedance")
    )


@query(
    "c5_segmented_risk",
    sql(
        """SELECT workflow_id, asset_id, cycle_id::BIGINT AS cycle_id, us,
                  round(maintenance_risk, 6) AS maintenance_risk FROM predictions"""
    ),
)
def c5(p):
    rolled = segmented_risk(p.distance.risk, CYCLE, "us", "risk_score", P, p.study.slice_us)
    return tidy(rolled.select(*CYCLE, "us", "maintenance_risk"))


SWEEP = (
    "workflow_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1, 6) AS f1, round(maintenance_risk_theta, 6) AS maintenance_risk_theta, "
    "round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, "
    "round(coverage_percent, 6) AS coverage_percent, alarm_points, total_points, "
    "round(target_gap, 6) AS target_gap"
)


@query("c6_threshold_sweep", sql(f"SELECT {SWEEP} FROM sweep"))
def c6(p):
    e = p.distance
    per_asset = threshold_sweep(
        e.aligned, e.grid, p.study.events, e.thresholds, P, p.study.slice_us, p.study.stats
    )
    return tidy(fleet_sweep(per_asset, P))


@query(
    "c7_operating_point",
    sql(
        f"SELECT {SWEEP}, selection_mode, target_recall, target_coverage, selection_scope FROM selected"
    ),
)
def c7(p):
    return tidy(operating_point(p.distance.sweep, P))


@query("c8_alarm_flag", sql("SELECT workflow_id, asset_id, us, alarm FROM alarmed WHERE evaluation"))
def c8(p):
    e = p.distance
    return alarm_flags(e.aligned, e.selected).select("workflow_id", "asset_id", "us", "alarm")
