"""Phases, populations, cycles, runs, anchors, local segments and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import lineage as lin
from ..operators import populations as pop
from ..operators import runs
from ..operators.contract import check_summary
from . import query, tidy
from .oracle import L, P, sql


@query("t1_phase", sql("SELECT asset_id, us, phase::BIGINT AS phase FROM phased"))
def t1(p):
    rows = p.study.base.select("asset_id", "us")
    return tidy(cal.with_phase(rows, p.study.events, P.pre_maintenance_minutes))


@query("t2_baseline", sql("SELECT asset_id, us FROM masked WHERE baseline"))
def t2(p):
    rows = p.study.base.select("asset_id", "us").join(
        p.study.stats.select("asset_id", "data_start_us"), "asset_id"
    )
    phased = cal.with_phase(rows, p.study.events, P.pre_maintenance_minutes)
    return phased.filter(pop.in_baseline(P)).select("asset_id", "us")


@query(
    "t3_baseline_split",
    sql(
        """SELECT asset_id, us, baseline_train, baseline_validation FROM timeline
           WHERE baseline_train OR baseline_validation"""
    ),
)
def t3(p):
    rows = p.study.timeline
    sizes = rows.groupBy("asset_id").agg(F.count_if("baseline").alias("baseline_rows"))
    if pop.split_problems(sizes, P).take(1):
        raise ValueError("a baseline is too short to be split")
    return rows.filter("baseline_train OR baseline_validation").select(
        "asset_id", "us", "baseline_train", "baseline_validation"
    )


CYCLE_COLUMNS = """asset_id, cycle_id::BIGINT AS cycle_id, source_event_id, update_start_us,
    update_end_us, score_start_us, score_end_us, update_possible,
    alias_to_cycle::BIGINT AS alias_to_cycle, update_rows"""


@query("t4_cycle_plan", sql(f"SELECT {CYCLE_COLUMNS} FROM cycles"))
def t4(p):
    return tidy(cal.cycle_plan(p.study.base, p.study.events, p.study.stats, P))


@query(
    "t5_post_maintenance_training",
    sql("SELECT asset_id, us FROM timeline WHERE post_train"),
)
def t5(p):
    rows = p.study.base.select("asset_id", "us")
    return cal.interval_join(
        rows, cal.update_intervals(p.study.cycles), ["update_cycle"], "inner"
    ).select("asset_id", "us")


@query(
    "t6_runs",
    sql(
        """SELECT asset_id, us, base_run, base_pos, eval_run, eval_pos FROM timeline
           WHERE base_run IS NOT NULL OR eval_run IS NOT NULL"""
    ),
)
def t6(p):
    rows = p.study.timeline.select(
        "asset_id",
        "us",
        "slice",
        "gap_us",
        F.when(F.col("baseline"), F.lit(0)).alias("_b"),
        F.when(F.col("evaluation_row"), F.lit(0)).alias("_e"),
    )
    labelled = runs.label_runs(rows, ["asset_id"], "us", "slice", {"base": "_b", "eval": "_e"})
    return labelled.filter("base_run IS NOT NULL OR eval_run IS NOT NULL").select(
        "asset_id", "us", "base_run", "base_pos", "eval_run", "eval_pos"
    )


@query(
    "t7_segments",
    sql(
        """SELECT asset_id, eval_run, min(us) AS start_us, max(us) AS end_us, count(*) AS row_count
           FROM timeline WHERE eval_run IS NOT NULL GROUP BY asset_id, eval_run"""
    ),
)
def t7(p):
    return runs.run_segments(p.study.timeline, ["asset_id"], "us", "eval_run")


@query(
    "t8_sequence_anchors",
    sql(
        f"""SELECT asset_id, us FROM timeline
            WHERE src_pos >= {L} AND (src_pos - {L}) % 3 = 0"""
    ),
)
def t8(p):
    """Anchors of the scoring segments at every third row."""
    keep = runs.is_anchor(F.col("src_pos"), L, 3)
    return p.study.timeline.filter(keep).select("asset_id", "us")


@query(
    "t9_sequence_windows",
    sql(
        f"""SELECT asset_id, us, first_us, round(total, 6) AS total, steps::BIGINT AS steps FROM (
              SELECT *, first_value(us) OVER w AS first_us, sum(value) OVER w AS total,
                     count(*) OVER w AS steps
              FROM timeline WHERE eval_run IS NOT NULL
              WINDOW w AS (PARTITION BY asset_id, eval_run ORDER BY us
                           ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW))
            WHERE evaluation"""
    ),
)
def t9(p):
    """Materialised windows, reported by their first row, row count and channel sum."""
    windows = runs.over_sequence(
        p.study.timeline,
        ["asset_id"],
        "eval_run",
        "eval_pos",
        L,
        {"window": F.collect_list(F.struct("us", *p.study.channels))},
    ).filter("evaluation")
    return tidy(
        windows.select(
            "asset_id",
            "us",
            F.array_min(F.transform("window", lambda r: r["us"])).alias("first_us"),
            F.aggregate("window", F.lit(0.0), lambda s, r: s + r["value"]).alias("total"),
            F.size("window").alias("steps"),
        )
    )


@query("t10_calibration_anchors", sql("SELECT asset_id, us FROM timeline WHERE calibration"))
def t10(p):
    return p.study.timeline.filter("calibration").select("asset_id", "us")


@query("t11_evaluation_anchors", sql("SELECT asset_id, us, phase::BIGINT AS phase FROM timeline WHERE evaluation"))
def t11(p):
    return tidy(p.study.timeline.filter("evaluation").select("asset_id", "us", "phase"))


@query(
    "t12_cycle_assignment",
    sql(
        """SELECT asset_id, us, cycle_id::BIGINT AS cycle_id, evaluation FROM timeline
           WHERE cycle_id IS NOT NULL"""
    ),
)
def t12(p):
    return tidy(
        p.study.timeline.filter("cycle_id IS NOT NULL").select(
            "asset_id", "us", "cycle_id", "evaluation"
        )
    )


@query(
    "t13_partition_proof",
    sql(
        """SELECT 'uncovered_anchor' AS check_name,
                  count(*) FILTER (evaluation AND cycle_id IS NULL) AS violations FROM timeline
           UNION ALL
           SELECT 'overlapping_anchor', count(*) FROM (
             SELECT asset_id, us FROM timeline WHERE evaluation AND cycle_id IS NOT NULL
             GROUP BY ALL HAVING count(*) > 1)
           UNION ALL
           SELECT 'evaluation_anchors', count(*) FILTER (evaluation) FROM timeline"""
    ),
)
def t13(p):
    """Violations of the partition, next to the number of anchors checked."""
    found = pop.partition_violations(p.study.timeline)
    return check_summary(
        {
            "uncovered_anchor": found.filter("problem = 'uncovered'"),
            "overlapping_anchor": found.filter("problem = 'overlap'"),
            "evaluation_anchors": p.study.timeline.filter("evaluation"),
        }
    )


@query(
    "t14_local_segments",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS cycle_id, run_us, start_us, end_us, row_count, windows
           FROM segments"""
    ),
)
def t14(p):
    return tidy(lin.local_segments(p.study.timeline, L))


@query(
    "t14_cycles_without_windows",
    sql(
        """SELECT c.asset_id, c.cycle_id::BIGINT AS cycle_id, count(s.run_us) AS segments,
                  coalesce(sum(s.windows), 0)::BIGINT AS windows
           FROM cycles c LEFT JOIN segments s USING (asset_id, cycle_id)
           WHERE c.update_possible AND c.cycle_id > 0 GROUP BY ALL
           HAVING coalesce(sum(s.windows), 0) < 1"""
    ),
)
def t14_problems(p):
    return tidy(lin.cycles_without_windows(p.study.cycles, lin.local_segments(p.study.timeline, L)))


@query(
    "t15_local_split",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS cycle_id, run_us, start_us, row_count, windows,
                  total_windows, requested_validation_windows, train_windows, validation_windows,
                  embargo_windows, unused_rows, train_rows, validation_from_row, fallback FROM split"""
    ),
)
def t15(p):
    return tidy(p.detectors.split)


@query(
    "t15_split_policy",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS cycle_id, local_segment_count, local_total_rows,
                  usable_local_segment_count, local_train_segment_count,
                  local_validation_segment_count, local_total_windows, local_train_windows,
                  local_validation_windows, requested_validation_windows, applied_embargo_windows,
                  unused_boundary_rows, short_local_fallback_applied, baseline_total_windows,
                  baseline_replay_windows FROM policy"""
    ),
)
def t15_policy(p):
    return tidy(p.detectors.policy.drop("requested_embargo_windows", "validation_strategy"))


@query(
    "t16_even_replay",
    sql("SELECT asset_id, cycle_id::BIGINT AS cycle_id, us, window_no FROM replay"),
)
def t16(p):
    return tidy(lin.replay_windows(p.detectors.numbered_windows, p.detectors.policy))


@query(
    "t17_replay_mix",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS cycle_id, us, 'baseline' AS origin FROM replay
           UNION ALL
           SELECT s.asset_id, s.cycle_id, t.us, 'local' FROM split s JOIN timeline t
             ON t.asset_id = s.asset_id AND t.update_cycle = s.cycle_id AND t.upd_run = s.run_us
            AND t.upd_pos > s.row_count - s.windows
            AND t.upd_pos <= s.row_count - s.windows + s.train_windows"""
    ),
)
def t17(p):
    return tidy(p.detectors.mix)
