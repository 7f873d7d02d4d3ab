"""Event-level metrics at the operating point."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev
from . import query, tidy
from .oracle import P, sql

RATIOS = (
    "tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
)


@query(
    "e1_alarm_intervals",
    sql("SELECT workflow_id, asset_id, start_us, end_us, row_count FROM intervals"),
)
def e1(p):
    return ev.alarm_intervals(p.distance.alarms, p.study.slice_us)


@query("e2_event_scores", sql(f"SELECT workflow_id, {RATIOS} FROM event_scores"))
def e2(p):
    e = p.distance
    eligible = ev.warned(e.intervals, p.study.events, P.lead_minutes, p.study.slice_us)
    matches = ev.greedy_match(eligible, e.listed, ev.KEYS)
    return tidy(ev.match_counts(matches, e.counts, []))


@query(
    "e3_sampling_period",
    sql("SELECT asset_id, round(sample_minutes, 6) AS sample_minutes FROM minutes"),
)
def e3(p):
    return tidy(ev.sample_minutes(p.study.stats))


@query(
    "e4_population_minutes",
    sql(
        """SELECT asset_id, evaluation_rows, round(sample_minutes, 6) AS sample_minutes,
                  round(evaluated_minutes, 4) AS evaluated_minutes FROM minutes"""
    ),
)
def e4(p):
    minutes = ev.evaluated_minutes(p.study.timeline, p.study.stats)
    return tidy(minutes.withColumn("evaluated_minutes", F.round("evaluated_minutes", 4)))


@query(
    "e5_interval_duration",
    sql(
        """SELECT workflow_id, asset_id, start_us, round(duration_minutes, 6) AS duration_minutes
           FROM timed"""
    ),
)
def e5(p):
    timed = ev.with_duration(p.distance.intervals, p.study.stats)
    return tidy(timed.select("workflow_id", "asset_id", "start_us", "duration_minutes"))


@query(
    "e6_time_to_detection",
    sql(
        """SELECT workflow_id, detected_events, missed_events, round(mean_ttd, 6) AS mean_ttd,
                  round(std_ttd, 6) AS std_ttd, round(min_ttd, 6) AS min_ttd,
                  round(max_ttd, 6) AS max_ttd, round(median_ttd, 6) AS median_ttd FROM ttd_summary"""
    ),
)
def e6(p):
    e = p.distance
    return tidy(ev.ttd_summary(ev.time_to_detection(e.alarms, e.listed, P, p.study.slice_us)))


@query(
    "e6_time_to_detection_per_event",
    sql(
        """SELECT workflow_id, asset_id, ordinal::BIGINT AS ordinal, event_id, first_alarm_us,
                  round(ttd_minutes, 6) AS ttd_minutes FROM ttd"""
    ),
)
def e6_events(p):
    e = p.distance
    return tidy(ev.time_to_detection(e.alarms, e.listed, P, p.study.slice_us))


@query(
    "e7_lead_histogram",
    sql(
        f"""SELECT h.workflow_id, h.bin::BIGINT AS bin, h.bin * {P.lead_step_minutes}::BIGINT
                   AS bin_start_minutes, count(t.ttd_minutes) AS events
            FROM (SELECT workflow_id, unnest(range({P.lead_minutes // P.lead_step_minutes})) AS bin
                  FROM wfs) h
            LEFT JOIN ttd t ON t.workflow_id = h.workflow_id
              AND least(floor(t.ttd_minutes / {P.lead_step_minutes}),
                        {P.lead_minutes // P.lead_step_minutes - 1}) = h.bin
            GROUP BY h.workflow_id, h.bin"""
    ),
)
def e7(p):
    return tidy(ev.lead_histogram(p.distance.ttd, P))


@query(
    "e8_first_alarm_accuracy",
    sql(
        """SELECT workflow_id, tp_events, first_alarm_in_window,
                  round(first_alarm_accuracy, 6) AS first_alarm_accuracy FROM first_alarm"""
    ),
)
def e8(p):
    return tidy(ev.first_alarm_accuracy(p.distance.eligible, p.distance.grid))


@query(
    "e9_false_alarm_rate",
    sql(
        """SELECT workflow_id, total_alarm_intervals, fp_intervals, round(total_days, 6) AS total_days,
                  round(total_weeks, 6) AS total_weeks, round(far_per_day, 6) AS far_per_day,
                  round(far_per_week, 6) AS far_per_week FROM far"""
    ),
)
def e9(p):
    e = p.distance
    minutes = ev.evaluated_minutes(p.study.timeline, p.study.stats)
    return tidy(ev.false_alarm_rate(e.intervals, p.study.events, e.grid, minutes, P, p.study.slice_us))


@query(
    "e10_alarm_coverage",
    sql(
        """SELECT workflow_id, alarm_points, total_points, round(alarm_coverage, 6) AS alarm_coverage,
                  round(alarm_coverage_percent, 6) AS alarm_coverage_percent FROM coverage"""
    ),
)
def e10(p):
    return tidy(ev.alarm_coverage(p.distance.alarms))


@query(
    "e11_time_in_alarm",
    sql(
        """SELECT workflow_id, num_intervals, round(mtia_minutes, 6) AS mtia_minutes,
                  round(std_minutes, 6) AS std_minutes, round(min_minutes, 6) AS min_minutes,
                  round(max_minutes, 6) AS max_minutes, round(median_minutes, 6) AS median_minutes
           FROM mtia"""
    ),
)
def e11(p):
    return tidy(ev.time_in_alarm(p.distance.timed, p.distance.grid))


@query(
    "e12_nab_score",
    sql(
        """SELECT workflow_id, profile, round(nab_score_raw, 6) AS nab_score_raw,
                  round(nab_score_normalized, 6) AS nab_score_normalized, num_fp FROM nab"""
    ),
)
def e12(p):
    e = p.distance
    return tidy(ev.nab_scores(e.matches, e.listed, e.counts, P))


@query(
    "e13_lead_time_scores",
    sql(
        f"SELECT workflow_id, lead_minutes::BIGINT AS lead_minutes, {RATIOS} FROM lead_scores"
    ),
)
def e13(p):
    e = p.distance
    matched = ev.lead_time_matches(e.intervals, e.listed, P, e.leads, p.study.slice_us)
    return tidy(ev.match_counts(matched, e.counts, ["lead_minutes"], "matched_no"))


@query(
    "e14_metric_bundle",
    sql(
        """SELECT workflow_id, e.tp, e.fp, e.fn, t.detected_events, f.fp_intervals, c.alarm_points,
                  m.num_intervals, l.lead_recalls, h.detections
           FROM event_scores e JOIN ttd_summary t USING (workflow_id) JOIN far f USING (workflow_id)
           JOIN coverage c USING (workflow_id) JOIN mtia m USING (workflow_id)
           JOIN (SELECT workflow_id, round(sum(recall), 6) AS lead_recalls FROM lead_scores
                 GROUP BY workflow_id) l USING (workflow_id)
           JOIN (SELECT workflow_id, count(ttd_minutes) AS detections FROM ttd GROUP BY workflow_id) h
             USING (workflow_id)"""
    ),
)
def e14(p):
    """The bundle itself is nested; the check reads a field of every family."""
    add = lambda s, x: s + x
    return tidy(
        p.distance.metrics.select(
            "workflow_id",
            "event_scores.tp",
            "event_scores.fp",
            "event_scores.fn",
            "ttd.detected_events",
            "far.fp_intervals",
            "coverage.alarm_points",
            "mtia.num_intervals",
            F.aggregate(
                F.transform("pr_leadtime", lambda x: x["recall"]), F.lit(0.0), add
            ).alias("lead_recalls"),
            F.aggregate(
                F.transform("lead_bins", lambda x: x["events"]), F.lit(0).cast("bigint"), add
            ).alias("detections"),
        )
    )


@query(
    "e15_alarm_islands",
    sql(
        """SELECT workflow_id, asset_id, island_id, start_us, end_us,
                  round(duration_minutes, 6) AS duration_minutes, point_count,
                  round(gap_from_previous_minutes, 6) AS gap_from_previous_minutes,
                  is_true_positive, matched_event_ids FROM islands"""
    ),
)
def e15(p):
    e = p.distance
    return tidy(ev.alarm_islands(e.timed, e.eligible, p.study.slice_us))


@query(
    "e16_island_summary",
    sql(
        """SELECT workflow_id, island_count, true_positive_island_count, false_alarm_island_count,
                  round(mean_duration_minutes, 6) AS mean_duration_minutes,
                  round(median_duration_minutes, 6) AS median_duration_minutes,
                  round(max_duration_minutes, 6) AS max_duration_minutes, alarm_points,
                  total_evaluation_points, round(coverage, 6) AS coverage,
                  round(coverage_percent, 6) AS coverage_percent FROM island_summary"""
    ),
)
def e16(p):
    return tidy(ev.island_summary(p.distance.islands, p.distance.coverage))
