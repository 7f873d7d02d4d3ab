"""Assembly, comparison, contract checks and report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import contract as con
from ..operators import report
from ..operators.risk import operating_point
from ..plans.detectors import STRATEGIES, workflow_scores
from ..plans.evaluation import CYCLE, Evaluation
from ..session import materialize
from . import query, tidy
from .oracle import WORKFLOWS, sql

PREDICTION = """workflow_id, asset_id, cycle_id::BIGINT AS cycle_id, us, phase::BIGINT AS phase,
    round(anomaly_score, 6) AS anomaly_score, round(risk_score, 6) AS risk_score,
    round(maintenance_risk, 6) AS maintenance_risk"""


@query("g1_cycle_predictions", sql(f"SELECT {PREDICTION} FROM predictions"))
def g1(p):
    return tidy(p.distance.predictions)


@query(
    "g2_union_of_cycles",
    sql(
        """SELECT workflow_id, count(*) AS row_count, 0::BIGINT AS overlapping, min(us) AS first_us,
                  max(us) AS last_us FROM predictions GROUP BY workflow_id"""
    ),
)
def g2(p):
    rows = p.distance.predictions
    overlaps = con.duplicated(rows, ["workflow_id", "asset_id", "us"])
    found = overlaps.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("overlapping"))
    return (
        rows.groupBy("workflow_id")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
        )
        .join(found, "workflow_id", "left")
        .withColumn("overlapping", F.coalesce("overlapping", F.lit(0).cast("bigint")))
    )


@query(
    "g3_align_to_timeline",
    sql(
        """SELECT workflow_id, asset_id, us, evaluation, round(maintenance_risk, 6) AS maintenance_risk
           FROM aligned"""
    ),
)
def g3(p):
    names = F.explode(F.array(*[F.lit(w) for w in WORKFLOWS])).alias("workflow_id")
    rows = p.study.timeline.select(names, "asset_id", "us", "evaluation")
    risk = p.distance.predictions.select("workflow_id", "asset_id", "us", "maintenance_risk")
    return tidy(rows.join(risk, ["workflow_id", "asset_id", "us"], "left"))


SUMMARY = """workflow_id, selection_scope, selection_mode,
    round(maintenance_risk_theta, 6) AS maintenance_risk_theta, tp, fp, fn,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
    round(ttd_minutes, 6) AS ttd_minutes, round(faa, 6) AS faa, round(far_per_day, 6) AS far_per_day,
    round(coverage, 6) AS coverage, round(coverage_percent, 6) AS coverage_percent,
    round(mtia_minutes, 6) AS mtia_minutes, round(nab_standard, 6) AS nab_standard,
    round(nab_low_fp, 6) AS nab_low_fp, round(nab_low_fn, 6) AS nab_low_fn, alarm_islands,
    false_alarm_islands"""


@query("g4_workflow_summary", sql(f"SELECT {SUMMARY} FROM summary"))
def g4(p):
    return tidy(p.distance.summary)


def detector_evaluation(p) -> Evaluation:
    """Evaluation of the study's own workflows, scored once for a prepared study."""
    if not hasattr(p, "detector_evaluation"):
        scores = [workflow_scores(p.detectors, w) for w in STRATEGIES]
        calibration, evaluation = (
            materialize(reduce(DataFrame.unionByName, parts), "detector-scores")
            for parts in zip(*scores, strict=True)
        )
        p.detector_evaluation = Evaluation(p.study, calibration, evaluation, STRATEGIES)
    return p.detector_evaluation


@query("g4_detector_summary")
def g4_detectors(p):
    """The summary of the study's own workflows."""
    return tidy(detector_evaluation(p).comparison)


@query(
    "g4_detector_checks",
    sql(
        f"""SELECT w.workflow_id, (SELECT count(*) FROM timeline WHERE evaluation) AS predictions,
                   (SELECT count(*) FROM timeline WHERE evaluation AND asset_id IN (SELECT asset_id FROM complete)
                    AND asset_id IN (SELECT asset_id FROM timeline WHERE calibration)) AS defined_risks,
                   (SELECT count(*) FROM aev) AS events, true AS theta_in_grid, 0::BIGINT AS out_of_bounds,
                   0::BIGINT AS rank_inversions
            FROM (SELECT unnest({list(STRATEGIES)}) AS workflow_id) w"""
    ),
)
def g4_checks(p):
    """What must hold after scoring whatever the scores are: populations, bounds, and ranks.

    A rank inversion is a row whose risk is below that of a lower score of the same calibrator.
    """
    e = detector_evaluation(p)
    unit = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1", "coverage")]
    bounded = reduce(lambda a, b: a & b, unit) & (F.col("false_alarm_islands") <= F.col("alarm_islands"))
    summary = e.summary.select(
        "workflow_id",
        (F.col("tp") + F.col("fn")).alias("events"),
        F.round("maintenance_risk_theta", 6).isin([round(t, 6) for t in e.thresholds]).alias("theta_in_grid"),
        (~bounded).cast("bigint").alias("_summary"),
    )
    risk = e.risk.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count("risk_score").alias("defined_risks"),
        F.count_if(~F.col("risk_score").between(0, 1)).alias("_risk"),
    )
    order = Window.partitionBy("workflow_id", "asset_id", "model_cycle").orderBy("anomaly_score")
    before = F.max("risk_score").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = e.risk.filter("risk_score IS NOT NULL").select("workflow_id", (F.col("risk_score") < before).alias("_below"))
    inverted = ranked.groupBy("workflow_id").agg(F.count_if("_below").alias("rank_inversions"))
    return tidy(
        summary.join(risk, "workflow_id").join(inverted, "workflow_id", "left").select(
            "workflow_id", "predictions", "defined_risks", "events", "theta_in_grid",
            (F.col("_summary") + F.col("_risk")).alias("out_of_bounds"),
            F.coalesce("rank_inversions", F.lit(0)).alias("rank_inversions"),
        )
    )


POSITION = f"list_position({list(WORKFLOWS)}, workflow_id)::BIGINT AS position"


@query("g5_workflow_comparison", sql(f"SELECT {SUMMARY}, {POSITION} FROM summary"))
def g5(p):
    return tidy(p.distance.comparison)


def contract_anchors(p):
    names = F.explode(F.array(*[F.lit(w) for w in WORKFLOWS])).alias("workflow_id")
    return p.study.timeline.filter("evaluation").select(names, "asset_id", "cycle_id", "us")


@query(
    "g6_population_equality",
    sql(
        """SELECT 'predictions' AS check_name, 0::BIGINT AS violations
           UNION ALL
           SELECT 'shifted_population', 2 * (SELECT count(*) FROM predictions)"""
    ),
)
def g6(p):
    keys = [*CYCLE, "us"]
    expected, observed = contract_anchors(p), p.distance.predictions
    moved = observed.withColumn("us", F.col("us") + 1)
    return con.check_summary(
        {
            "predictions": con.population_differences(expected, observed, keys),
            "shifted_population": con.population_differences(expected, moved, keys),
        }
    )


@query(
    "g7_cycle_checks",
    sql(
        """SELECT 'complete' AS study, 'none' AS problem, count(*) AS cycles
           FROM cycles CROSS JOIN wfs
           UNION ALL
           SELECT 'tampered', CASE WHEN cycle_id = 1 THEN 'population_size'
                                   WHEN cycle_id = 4 THEN 'missing_cycle' ELSE 'none' END, count(*)
           FROM cycles CROSS JOIN wfs GROUP BY 2"""
    ),
)
def g7(p):
    """Checks on the results as they are, and with a changed count and a dropped cycle."""
    contract = con.cycle_counts(p.study.timeline, p.study.cycles)
    names = F.explode(F.array(*[F.lit(w) for w in WORKFLOWS])).alias("workflow_id")
    every = contract.select(names, "asset_id", "cycle_id")
    results = materialize(p.distance.results, "results")
    tampered = results.filter("cycle_id <> 4").withColumn(
        "prediction_count",
        F.col("prediction_count") + F.when(F.col("cycle_id") == 1, 1).otherwise(0),
    )
    parts = []
    for study, table in (("complete", results), ("tampered", tampered)):
        problems = con.cycle_problems(contract, table, WORKFLOWS)
        parts.append(
            every.join(problems, CYCLE, "left")
            .groupBy(F.lit(study).alias("study"), F.coalesce("problem", F.lit("none")).alias("problem"))
            .agg(F.count(F.lit(1)).alias("cycles"))
        )
    return parts[0].unionByName(parts[1])


@query(
    "g7_contract_checks",
    sql(
        """SELECT * FROM (VALUES ('lineage', 0::BIGINT), ('row_cycle', 0::BIGINT), ('row_total', 0::BIGINT),
             ('calibration', 0::BIGINT)) AS t(check_name, violations)
           UNION ALL SELECT 'dropped_lineage', (SELECT count(*) FROM cycles WHERE cycle_id = 2)
           UNION ALL SELECT 'moved_cycle', (SELECT count(*) FROM predictions WHERE cycle_id = 1)
           UNION ALL SELECT 'doubled_rows', count(*) FROM (
               SELECT DISTINCT workflow_id, asset_id FROM predictions)
           UNION ALL SELECT 'short_calibration', (SELECT count(*) FROM cal
               WHERE workflow_id = 'mean_per_maintenance' AND model_cycle > 0)"""
    ),
)
def g7_checks(p):
    """Lineage, row cycles, totals and calibration populations, as they are and tampered with."""
    e, timeline, cycles = p.distance, p.study.timeline, p.study.cycles
    adaptive = "mean_per_maintenance"
    kept = e.lineage.filter(~((F.col("workflow_id") == adaptive) & (F.col("cycle_id") == 2)))
    moved = e.predictions.withColumn(
        "cycle_id", F.when(F.col("cycle_id") == 1, 0).otherwise(F.col("cycle_id"))
    )
    short = e.calibration.filter((F.col("workflow_id") != adaptive) | (F.col("model_cycle") == 0))
    dropped = con.lineage_problems(kept, cycles, WORKFLOWS).filter("problem = 'lineage_rows'")
    return con.check_summary(
        {
            "lineage": con.lineage_problems(e.lineage, cycles, WORKFLOWS),
            "row_cycle": con.row_cycle_problems(e.predictions, timeline),
            "row_total": con.row_total_problems(e.predictions, timeline, WORKFLOWS),
            "calibration": con.calibration_problems(e.calibration, e.lineage, timeline),
            "dropped_lineage": dropped,
            "moved_cycle": con.row_cycle_problems(moved, timeline),
            "doubled_rows": con.row_total_problems(
                e.predictions.unionAll(e.predictions), timeline, WORKFLOWS
            ),
            "short_calibration": con.calibration_problems(short, e.lineage, timeline),
        }
    )


@query(
    "g8_duplicate_predictions",
    sql(
        """SELECT 'predictions' AS check_name, 0::BIGINT AS violations
           UNION ALL SELECT 'predictions_twice', (SELECT count(*) FROM predictions)"""
    ),
)
def g8(p):
    keys = ["workflow_id", "asset_id", "us"]
    rows = p.distance.predictions.select(*keys)
    return con.check_summary(
        {
            "predictions": con.duplicated(rows, keys),
            "predictions_twice": con.duplicated(rows.unionAll(rows), keys),
        }
    )


@query(
    "g9_study_completeness",
    sql(
        """SELECT * FROM (VALUES ('missing_workflow', 0::BIGINT), ('foreign_workflow', 0::BIGINT),
             ('missing_metric_family', 0::BIGINT), ('selection_scope', 0::BIGINT))
             AS t(check_name, violations)
           UNION ALL SELECT 'tampered_workflow', count(*) FILTER (workflow_id = 'distance_row') FROM summary
           UNION ALL SELECT 'tampered_families', """
    + f"{len(con.METRIC_FAMILIES)} + 2 * count(*) FILTER (workflow_id <> 'distance_row') FROM summary"
    + """ UNION ALL SELECT 'tampered_scope', count(*) FILTER (workflow_id = 'distance_window') FROM summary
           UNION ALL
           SELECT 'calibration_populations_' || asset_id, count(DISTINCT f)
           FROM (SELECT workflow_id, asset_id, model_cycle, sum(us)::VARCHAR AS f FROM cal GROUP BY ALL) GROUP BY asset_id"""
    ),
)
def g9(p):
    """Expected workflows, metric families and scope, and one calibration population per asset.

    Families are looked for in stored results: as they are, and with a workflow, a family of all
    workflows and a family's values taken away.
    """
    e = p.distance
    summary = materialize(e.summary.select("workflow_id", "selection_scope"), "summary")
    metrics = materialize(e.metrics, "metrics")
    first = WORKFLOWS[0]
    fewer = summary.filter(F.col("workflow_id") != first)
    # without a workflow, without far in any, with null coverage in all others
    less = metrics.filter(F.col("workflow_id") != first).drop("far").withColumn(
        "coverage", F.when(F.lit(False), F.col("coverage"))
    )
    moved = summary.withColumn(
        "selection_scope", F.when(F.col("workflow_id") == WORKFLOWS[1], "other").otherwise(F.col("selection_scope"))
    )
    foreign_scope = F.col("selection_scope") != e.params.selection_scope
    checks = con.check_summary(
        {
            "missing_workflow": con.absent(WORKFLOWS, summary, "workflow_id"),
            "foreign_workflow": summary.filter(~F.col("workflow_id").isin(*WORKFLOWS)),
            "missing_metric_family": con.family_problems(metrics, WORKFLOWS),
            "selection_scope": summary.filter(foreign_scope),
            "tampered_workflow": con.absent(WORKFLOWS, fewer, "workflow_id"),
            "tampered_families": con.family_problems(less, WORKFLOWS),
            "tampered_scope": moved.filter(foreign_scope),
        }
    )
    stamped = e.calibration.withColumn("ts", F.timestamp_micros(F.col("us")))
    prints = con.fingerprint(stamped, ["workflow_id", "asset_id", "model_cycle"])
    populations = prints.groupBy("asset_id").agg(
        F.count_distinct("row_count", "first_ts", "last_ts", "mark_sum").alias("violations")
    )
    return checks.unionByName(
        populations.select(
            F.concat(F.lit("calibration_populations_"), F.col("asset_id").cast("string")).alias(
                "check_name"
            ),
            "violations",
        )
    )


MARK = "('0x' || substr(md5(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), 1, 8))::BIGINT"
PRINT = f"""count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts,
            sum({MARK})::BIGINT AS mark_sum"""


@query(
    "g10_population_fingerprint",
    sql(f"SELECT asset_id, evaluation, {PRINT} FROM timeline GROUP BY asset_id, evaluation"),
)
def g10(p):
    return con.fingerprint(p.study.timeline, ["asset_id", "evaluation"])


@query(
    "g11_contract_report",
    sql(
        " UNION ALL ".join(
            f"SELECT asset_id, '{name}' AS population, -1::BIGINT AS cycle_id, {PRINT} FROM timeline "
            f"WHERE {name} GROUP BY asset_id"
            for name in con.POPULATIONS
        )
        + f""" UNION ALL SELECT asset_id, 'cycle_anchors', cycle_id::BIGINT, {PRINT} FROM timeline
               WHERE evaluation AND cycle_id IS NOT NULL GROUP BY asset_id, cycle_id"""
    ),
)
def g11(p):
    return tidy(con.population_report(p.study.timeline))


@query(
    "g12_zero_row_cycles",
    sql(
        """SELECT w.workflow_id, c.asset_id, c.cycle_id::BIGINT AS cycle_id, count(e.us) AS prediction_count,
                  CASE WHEN count(e.us) > 0 THEN 'scored' ELSE 'no_evaluation_anchors' END
                  AS evaluation_status
           FROM cycles c CROSS JOIN wfs w LEFT JOIN evs e ON e.workflow_id = w.workflow_id
            AND e.asset_id = c.asset_id AND e.cycle_id = c.cycle_id GROUP BY ALL"""
    ),
)
def g12(p):
    return tidy(
        p.distance.results.select(
            "workflow_id", "asset_id", "cycle_id", "prediction_count", "evaluation_status"
        )
    )


@query(
    "g13_timeline_report",
    sql(
        f"""SELECT s.workflow_id, s.asset_id, s.bucket_us, round(b.mean_risk, 6) AS mean_risk,
                   coalesce(b.alarm, false) AS alarm
            FROM (SELECT workflow_id, asset_id, unnest(range(min(us) // {report.BUCKET_US}
                         * {report.BUCKET_US}, max(us) + 1, {report.BUCKET_US})) AS bucket_us
                  FROM alarmed WHERE evaluation GROUP BY workflow_id, asset_id) s
            LEFT JOIN (SELECT workflow_id, asset_id, us // {report.BUCKET_US} * {report.BUCKET_US}
                              AS bucket_us, avg(maintenance_risk) AS mean_risk, bool_or(alarm) AS alarm
                       FROM alarmed WHERE evaluation GROUP BY ALL) b USING (workflow_id, asset_id, bucket_us)"""
    ),
)
def g13(p):
    return tidy(report.bucketed_timeline(p.distance.alarms))


@query(
    "g14_tradeoff_table",
    sql(
        """SELECT s.workflow_id, s.maintenance_risk_theta,
                  round(s.coverage_percent, 6) AS coverage_percent, round(s.recall, 6) AS recall,
                  round(s.f1, 6) AS f1, s.maintenance_risk_theta = c.maintenance_risk_theta AS selected
           FROM sweep s JOIN selected c USING (workflow_id)"""
    ),
)
def g14(p):
    return tidy(report.tradeoff_table(p.distance.sweep, operating_point(p.distance.sweep, p.distance.params)))


@query(
    "g14_comparison_chart",
    sql(
        f"""SELECT {POSITION}, replace(workflow_id, '_', ' ') AS label, round(precision, 6) AS precision,
                   round(recall, 6) AS recall, round(f1, 6) AS f1,
                   round(coverage_percent, 6) AS coverage_percent,
                   coalesce(round(ttd_minutes, 6), 0) AS ttd_minutes,
                   coalesce(round(far_per_day, 6), 0) AS far_per_day FROM summary"""
    ),
)
def g14_chart(p):
    return tidy(report.comparison_chart(p.distance.comparison))
