"""DuckDB reference queries, composed from named common table expressions.

They state each operator the plain way (whole-series windows, pairwise interval conditions), so
that they share no shortcut with the Spark plans.
"""

from __future__ import annotations

import re

from ..functions.grids import lead_times, theta_list
from ..operators.rolling import feature_names
from ..params import AGGREGATIONS, MINUTE_US, NAB_PROFILES, StudyParams
from ..plans.prepared import DISTANCE_WORKFLOWS
from ..sources.maintenance import FLEET_WINDOWS
from ..sources.telemetry import SENSOR_BINARY, SENSOR_CHANNELS

P = StudyParams()
L = P.sequence_length
FEATURES = feature_names(SENSOR_CHANNELS)
THETAS = theta_list(P.theta_grid, P.extra_thresholds)
LEADS = lead_times(P.sensitivity_leads, P.lead_step_minutes, P.lead_minutes)
LEAD_US = P.lead_minutes * MINUTE_US
WORKFLOWS = tuple(DISTANCE_WORKFLOWS)

CTES: dict[str, str] = {}
#: Small results that are computed once, so that their text columns are plain strings from there on.
MATERIALIZED = ("sweep", "selected")


def define(name: str, body: str) -> None:
    CTES[name] = body


def sql(final: str) -> str:
    """Final statement with the expressions it needs, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(final)
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({body})"
        for name, body in CTES.items()
        if name in needed
    ]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + final


def labelled_runs(name: str, source: str, selection: str, keys: str, prefix: str) -> None:
    """Runs of rows with a selected value, broken at gaps of 1.5 times ``gap_us``."""
    define(
        f"{name}_linked",
        f"""SELECT *, {selection} AS _sel, lag({selection}) OVER w AS _psel,
                   us - lag(us) OVER w AS _dt
            FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY us)""",
    )
    define(
        f"{name}_started",
        f"""SELECT * EXCLUDE (_psel, _dt), max(CASE WHEN _sel IS NOT NULL AND NOT coalesce(_psel = _sel
                   AND (gap_us IS NULL OR _dt <= 1.5 * gap_us), false) THEN us END)
                   OVER (PARTITION BY {keys} ORDER BY us) AS _start
            FROM {name}_linked""",
    )
    define(
        name,
        f"""SELECT * EXCLUDE (_sel, _start),
                   CASE WHEN _sel IS NOT NULL THEN _start END AS {prefix}_run,
                   CASE WHEN _sel IS NOT NULL THEN row_number() OVER (
                       PARTITION BY {keys}, _start, _sel IS NOT NULL ORDER BY us) END AS {prefix}_pos,
                   CASE WHEN _sel IS NOT NULL THEN row_number() OVER (
                       PARTITION BY {keys}, _sel IS NOT NULL ORDER BY us) END AS {prefix}_ord
            FROM {name}_started""",
    )


# Telemetry, schedule and calendar -------------------------------------------------------------------

define(
    "tl",
    """SELECT user_id % 8 AS asset_id, ts, epoch_us(ts) AS us, value,
              CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
              CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_error
       FROM events""",
)
define(
    "mev",
    "SELECT position, event_id, start_ts, end_ts, epoch_us(start_ts) AS start_us, "
    "epoch_us(end_ts) AS end_us, severity FROM (VALUES "
    + ", ".join(
        f"({i}, '{e}', TIMESTAMP '{s}', TIMESTAMP '{t}', '{v}')"
        for i, (s, t, e, v) in enumerate(FLEET_WINDOWS, start=1)
    )
    + ") AS t(position, event_id, start_ts, end_ts, severity)",
)
define(
    "aev",
    """SELECT asset_id, mev.*, row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us)::INT
              AS ordinal
       FROM (SELECT DISTINCT asset_id FROM tl) CROSS JOIN mev WHERE end_us >= start_us""",
)
define(
    "steps",
    "SELECT asset_id, us, us - lag(us) OVER (PARTITION BY asset_id ORDER BY us) AS dt FROM tl",
)
define("gaps", "SELECT asset_id, median(dt) AS gap_us FROM steps WHERE dt > 0 GROUP BY asset_id")
define(
    "stats",
    """SELECT asset_id, min(us) AS data_start_us, max(us) AS data_end_us, count(*) AS row_count,
              any_value(gap_us) AS gap_us
       FROM tl LEFT JOIN gaps USING (asset_id) GROUP BY asset_id""",
)
define(
    "phased",
    f"""SELECT t.*, s.data_start_us, s.gap_us,
               CASE WHEN EXISTS (SELECT 1 FROM aev e WHERE e.asset_id = t.asset_id
                                 AND t.us >= e.start_us AND t.us <= e.end_us) THEN 2
                    WHEN EXISTS (SELECT 1 FROM aev e WHERE e.asset_id = t.asset_id
                                 AND t.us >= e.start_us - {P.pre_maintenance_minutes * MINUTE_US}
                                 AND t.us < e.start_us) THEN 1
                    ELSE 0 END AS phase
        FROM tl t JOIN stats s USING (asset_id)""",
)
define(
    "uw",
    f"""SELECT *, least(gap_start_us + {P.post_train_minutes * MINUTE_US}, gap_end_us) AS upd_end_us
        FROM (SELECT asset_id, ordinal AS cycle_id, event_id, end_us AS gap_start_us,
                     coalesce(lead(start_us) OVER (PARTITION BY asset_id ORDER BY start_us, end_us),
                              data_end_us) AS gap_end_us
              FROM aev JOIN stats USING (asset_id))""",
)
define(
    "uw_counts",
    """SELECT u.asset_id, u.cycle_id, count(t.us) AS update_rows
       FROM uw u LEFT JOIN tl t ON t.asset_id = u.asset_id AND t.us > u.gap_start_us
                                AND t.us <= u.upd_end_us
       GROUP BY ALL""",
)
define(
    "uw_possible",
    f"""SELECT *, gap_end_us > upd_end_us AND update_rows >= {L} AS update_possible
        FROM uw JOIN uw_counts USING (asset_id, cycle_id)""",
)
define(
    "cycles",
    """SELECT s.asset_id, 0 AS cycle_id, 'before_first' AS source_event_id,
              NULL::BIGINT AS update_start_us, NULL::BIGINT AS update_end_us,
              s.data_start_us AS score_start_us, min(e.start_us) AS score_end_us,
              true AS update_possible, NULL::INT AS alias_to_cycle, 0::BIGINT AS update_rows
       FROM stats s JOIN aev e USING (asset_id) GROUP BY s.asset_id, s.data_start_us
       UNION ALL
       SELECT asset_id, cycle_id, event_id,
              CASE WHEN update_possible THEN gap_start_us END,
              CASE WHEN update_possible THEN upd_end_us END,
              CASE WHEN update_possible THEN upd_end_us ELSE gap_start_us END, gap_end_us,
              update_possible,
              CASE WHEN NOT update_possible THEN coalesce(max(CASE WHEN update_possible THEN cycle_id END)
                   OVER (PARTITION BY asset_id ORDER BY cycle_id), 0) END::INT,
              update_rows
       FROM uw_possible""",
)

# The same calendar over schedules that differ by asset: names end in _own.
define(
    "aev_own",
    """SELECT asset_id, position, event_id, start_ts + to_hours(asset_id) AS start_ts,
              end_ts + to_hours(asset_id) AS end_ts, start_us + asset_id * 3600000000 AS start_us,
              end_us + asset_id * 3600000000 AS end_us, severity,
              row_number() OVER (PARTITION BY asset_id ORDER BY start_us, end_us)::INT AS ordinal
       FROM (SELECT DISTINCT asset_id FROM tl) CROSS JOIN mev
       WHERE end_us >= start_us AND (asset_id + position) % 4 <> 0""",
)
OWN = ("aev", "phased", "uw", "uw_counts", "uw_possible", "cycles", "masked", "populated", "sourced")


def define_own() -> None:
    for name in OWN[1:]:
        body = re.sub(rf"\b({'|'.join(OWN)})\b", r"\1_own", CTES[name])
        define(
            f"{name}_own",
            body.replace("(SELECT max(cycle_id) FROM cycles_own)",
                         "(SELECT max(d.cycle_id) FROM cycles_own d WHERE d.asset_id = p.asset_id)"),
        )


# Populations ------------------------------------------------------------------------------------------

define(
    "masked",
    f"""SELECT p.*, us <= data_start_us + {P.baseline_minutes * MINUTE_US} AND phase IN {P.train_phases}
               AS baseline,
               (SELECT max(c.cycle_id) FROM cycles c WHERE c.asset_id = p.asset_id
                AND p.us > c.update_start_us AND p.us <= c.update_end_us) AS in_update
        FROM phased p""",
)
define(
    "populated",
    f"""SELECT *, in_update IS NOT NULL AS post_train,
               NOT baseline AND in_update IS NULL AND phase <> 2 AND phase IN {P.test_phases}
               AS evaluation_row,
               CASE WHEN phase IN {P.train_phases} THEN in_update END AS update_cycle,
               max(CASE WHEN baseline THEN us END) OVER (PARTITION BY asset_id) AS baseline_end_us,
               count(*) FILTER (baseline) OVER (PARTITION BY asset_id) AS baseline_rows
        FROM masked""",
)
define(
    "sourced",
    """SELECT p.*, CASE WHEN evaluation_row THEN
                 (SELECT max(c.cycle_id) FROM cycles c WHERE c.asset_id = p.asset_id
                  AND p.us > CASE WHEN c.cycle_id = 0 THEN p.baseline_end_us ELSE c.score_start_us END
                  AND (p.us < c.score_end_us OR (p.us = c.score_end_us AND c.cycle_id =
                       (SELECT max(cycle_id) FROM cycles)))) END AS cycle_id
       FROM populated p""",
)
define_own()
labelled_runs("tl_base", "sourced", "CASE WHEN baseline THEN 0 END", "asset_id", "base")
labelled_runs("tl_eval", "tl_base", "CASE WHEN evaluation_row THEN 0 END", "asset_id", "eval")
labelled_runs("tl_src", "tl_eval", "cycle_id", "asset_id", "src")
labelled_runs("tl_upd", "tl_src", "update_cycle", "asset_id", "upd")
define(
    "split_rows",
    f"""SELECT asset_id, baseline_rows,
               baseline_rows - greatest({L}, round_even(baseline_rows * {P.validation_fraction}, 0)::BIGINT)
               AS val_start
        FROM (SELECT DISTINCT asset_id, baseline_rows FROM populated)""",
)


def anchor(position: str) -> str:
    return f"coalesce({position} >= {L} AND ({position} - {L}) % {P.stride} = 0, false)"


define(
    "timeline",
    f"""SELECT u.*, coalesce(base_ord <= val_start - {L - 1}, false) AS baseline_train,
               coalesce(base_ord > val_start, false) AS baseline_validation,
               {anchor('base_pos')} AS calibration, {anchor('eval_pos')} AS evaluation
        FROM tl_upd u JOIN split_rows USING (asset_id)""",
)

# Features ---------------------------------------------------------------------------------------------

FRAME = (
    f"PARTITION BY asset_id ORDER BY us RANGE BETWEEN {P.rolling_us - 1} PRECEDING AND CURRENT ROW"
)


def rolled(channel: str, aggregation: str) -> str:
    over = "OVER roll"
    if aggregation == "skew":
        return (
            f"CASE WHEN count({channel}) {over} >= 3 THEN CASE WHEN min({channel}) {over} = "
            f"max({channel}) {over} THEN 0.0 ELSE skewness({channel}) {over} END END"
        )
    call = {
        "mean": "avg",
        "median": "median",
        "std": "stddev_samp",
        "min": "min",
        "max": "max",
    }[aggregation]
    return f"{call}({channel}) {over}"


define(
    "rolled",
    "SELECT asset_id, us, "
    + ", ".join(f"{rolled(c, a)} AS {c}__{a}" for c in SENSOR_CHANNELS for a in AGGREGATIONS)
    + f" FROM tl WINDOW roll AS ({FRAME})",
)
define(
    "forward",
    "SELECT asset_id, us, "
    + ", ".join(f"last_value({f} IGNORE NULLS) OVER w AS {f}" for f in FEATURES)
    + " FROM rolled WINDOW w AS (PARTITION BY asset_id ORDER BY us "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
define(
    "feats",
    "SELECT asset_id, us, "
    + ", ".join(f"first_value({f} IGNORE NULLS) OVER w AS {f}" for f in FEATURES)
    + " FROM forward WINDOW w AS (PARTITION BY asset_id ORDER BY us "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)
define(
    "fit_rows",
    "SELECT f.* FROM feats f JOIN timeline t USING (asset_id, us) WHERE t.baseline_train",
)
define(
    "scaler",
    " UNION ALL ".join(
        f"SELECT asset_id, {i} AS position, '{f}' AS feature, "
        + (
            "0.0::DOUBLE AS mean, 1.0::DOUBLE AS scale, true AS passthrough"
            if f.split("__")[0] in SENSOR_BINARY
            else f"avg({f}) AS mean, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1.0 END "
            "AS scale, false AS passthrough"
        )
        + ", count(*) AS fitted_rows FROM fit_rows GROUP BY asset_id"
        for i, f in enumerate(FEATURES)
    ),
)
define(
    "scaler_wide",
    "SELECT asset_id, "
    + ", ".join(
        f"max(CASE WHEN feature = '{f}' THEN mean END) AS m_{f}, "
        f"max(CASE WHEN feature = '{f}' THEN scale END) AS s_{f}"
        for f in FEATURES
    )
    + " FROM scaler GROUP BY asset_id",
)
define(
    "scaled",
    "SELECT asset_id, us, "
    + ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATURES)
    + " FROM feats JOIN scaler_wide USING (asset_id)",
)

# Local segments and replay ----------------------------------------------------------------------------------

define(
    "segments",
    f"""SELECT asset_id, update_cycle AS cycle_id, upd_run AS run_us, min(us) AS start_us,
               max(us) AS end_us, count(*) AS row_count, greatest(0, count(*) - {L - 1}) AS windows
        FROM timeline WHERE update_cycle IS NOT NULL GROUP BY asset_id, update_cycle, upd_run""",
)
define(
    "usable",
    """SELECT *, sum(windows) OVER (PARTITION BY asset_id, cycle_id)::BIGINT AS total_windows,
              coalesce(sum(windows) OVER (PARTITION BY asset_id, cycle_id ORDER BY start_us DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS later_windows
       FROM segments WHERE windows > 0""",
)
define(
    "cut",
    f"""SELECT *, CASE WHEN val > 0 AND val < windows THEN least({L - 1}, windows - val) ELSE 0 END
               AS emb
        FROM (SELECT *, greatest(0, least(windows, wanted - later_windows)) AS val
              FROM (SELECT *, greatest(1, floor(total_windows * {P.local_validation_fraction}))::BIGINT
                           AS wanted FROM usable))""",
)
define(
    "split",
    f"""SELECT asset_id, cycle_id, run_us, start_us, row_count, windows, total_windows,
               wanted AS requested_validation_windows,
               CASE WHEN fallback THEN windows ELSE windows - val - emb END AS train_windows,
               CASE WHEN fallback THEN 0 ELSE val END AS validation_windows,
               CASE WHEN fallback THEN 0 ELSE emb END AS embargo_windows,
               CASE WHEN NOT fallback AND val > 0 AND val < windows THEN (windows - val)
                    - CASE WHEN windows - val - emb > 0 THEN windows - val - emb + {L - 1} ELSE 0 END
                    ELSE 0 END AS unused_rows,
               CASE WHEN fallback OR val = 0 THEN row_count
                    WHEN windows - val - emb > 0 THEN windows - val - emb + {L - 1} ELSE 0 END
               AS train_rows,
               CASE WHEN NOT fallback AND val > 0 THEN row_count - val - {L - 1} END
               AS validation_from_row, fallback
        FROM (SELECT *, sum(windows - val - emb) OVER (PARTITION BY asset_id, cycle_id) < 1 AS fallback
              FROM cut)""",
)
define(
    "base_windows",
    f"""SELECT asset_id, us, row_number() OVER (PARTITION BY asset_id ORDER BY us) - 1 AS window_no,
               count(*) OVER (PARTITION BY asset_id) AS total
        FROM timeline WHERE baseline_train AND base_pos >= {L}""",
)
define(
    "policy",
    f"""SELECT * EXCLUDE (b_total), b_total AS baseline_total_windows,
               least(b_total, round_even(local_train_windows * {P.replay_fraction}
                     / (1.0 - {P.replay_fraction}), 0)::BIGINT) AS baseline_replay_windows
        FROM (SELECT asset_id, cycle_id, count(*) AS usable_local_segment_count,
                     count(*) FILTER (train_windows > 0) AS local_train_segment_count,
                     count(*) FILTER (validation_windows > 0) AS local_validation_segment_count,
                     max(total_windows) AS local_total_windows,
                     sum(train_windows)::BIGINT AS local_train_windows,
                     sum(validation_windows)::BIGINT AS local_validation_windows,
                     max(requested_validation_windows) AS requested_validation_windows,
                     sum(embargo_windows)::BIGINT AS applied_embargo_windows,
                     sum(unused_rows)::BIGINT AS unused_boundary_rows,
                     bool_or(fallback) AS short_local_fallback_applied
              FROM split GROUP BY asset_id, cycle_id)
        JOIN (SELECT s.asset_id, s.cycle_id, count(*) AS local_segment_count,
                     sum(row_count)::BIGINT AS local_total_rows FROM segments s GROUP BY ALL)
          USING (asset_id, cycle_id)
        JOIN (SELECT asset_id, coalesce(max(total), 0) AS b_total FROM stats
              LEFT JOIN base_windows USING (asset_id) GROUP BY asset_id) USING (asset_id)""",
)
define(
    "replay",
    """SELECT w.asset_id, p.cycle_id, w.us, w.window_no
       FROM policy p, unnest(range(p.baseline_replay_windows)) AS r(i), base_windows w
       WHERE w.asset_id = p.asset_id AND w.window_no =
             floor((r.i + 0.5) * p.baseline_total_windows / p.baseline_replay_windows)""",
)

# Models of the adaptive workflows ---------------------------------------------------------------------------

define(
    "complete",
    "SELECT asset_id FROM scaled GROUP BY asset_id HAVING bool_and("
    + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
    + ")",
)
define(
    "refit_cycles",
    """SELECT asset_id, cycle_id FROM cycles c WHERE update_possible AND (cycle_id = 0 OR EXISTS (
         SELECT 1 FROM usable s WHERE s.asset_id = c.asset_id AND s.cycle_id = c.cycle_id))""",
)
define(
    "lineage",
    """SELECT c.asset_id, c.cycle_id, coalesce((SELECT max(d.cycle_id) FROM refit_cycles d
              WHERE d.asset_id = c.asset_id AND d.cycle_id <= c.cycle_id), 0)::INT AS model_cycle
       FROM cycles c""",
)
define(
    "mix_ends",
    """SELECT b.asset_id, 0 AS model_cycle, t.base_run AS run, t.base_pos AS pos, true AS replayed
       FROM base_windows b JOIN timeline t USING (asset_id, us)
       UNION ALL
       SELECT r.asset_id, r.cycle_id, t.base_run, t.base_pos, true
       FROM replay r JOIN timeline t USING (asset_id, us)
       UNION ALL
       SELECT s.asset_id, s.cycle_id, s.run_us, t.upd_pos, false
       FROM split s JOIN timeline t ON t.asset_id = s.asset_id AND t.update_cycle = s.cycle_id
        AND t.upd_run = s.run_us AND t.upd_pos > s.row_count - s.windows
        AND t.upd_pos <= s.row_count - s.windows + s.train_windows""",
)
define(
    "mix_rows",
    f"""SELECT e.asset_id, e.model_cycle, t.us, count(*) AS w
        FROM mix_ends e JOIN timeline t ON t.asset_id = e.asset_id AND CASE WHEN e.replayed
             THEN t.baseline_train AND t.base_run = e.run AND t.base_pos BETWEEN e.pos - {L - 1} AND e.pos
             ELSE t.update_cycle = e.model_cycle AND t.upd_run = e.run
                  AND t.upd_pos BETWEEN e.pos - {L - 1} AND e.pos END
        WHERE e.asset_id IN (SELECT asset_id FROM complete) GROUP BY ALL""",
)
define(
    "mix_held",
    f"""SELECT e.*, s.{FEATURES[0]} AS x,
               CASE WHEN e.replayed THEN t.base_pos ELSE t.upd_pos END - e.pos + {L - 1} AS i
        FROM mix_ends e JOIN timeline t ON t.asset_id = e.asset_id AND CASE WHEN e.replayed
             THEN t.baseline_train AND t.base_run = e.run AND t.base_pos BETWEEN e.pos - {L - 1} AND e.pos
             ELSE t.update_cycle = e.model_cycle AND t.upd_run = e.run
                  AND t.upd_pos BETWEEN e.pos - {L - 1} AND e.pos END
        JOIN scaled s ON s.asset_id = t.asset_id AND s.us = t.us
        WHERE e.asset_id IN (SELECT asset_id FROM complete)""",
)
define(
    "mix_own",
    "SELECT asset_id, model_cycle, row_number() OVER (PARTITION BY asset_id ORDER BY model_cycle) AS step, "
    "sum(w)::DOUBLE AS own_rows, "
    + ", ".join(f"sum(w * {f}) AS t_{f}" for f in FEATURES)
    + " FROM mix_rows JOIN scaled USING (asset_id, us) GROUP BY asset_id, model_cycle",
)
# A model is its own mix and every earlier one, halved (by the memory) at each step between.
KEPT = f"pow({P.adaptation_memory}, a.step - b.step)"
define(
    "mix_mean",
    f"SELECT a.asset_id, a.model_cycle, any_value(a.step) AS step, any_value(a.own_rows) AS own_rows, "
    f"sum(b.own_rows * {KEPT}) AS fitted_rows, "
    + ", ".join(f"sum(b.t_{f} * {KEPT}) / sum(b.own_rows * {KEPT}) AS m_{f}" for f in FEATURES)
    + " FROM mix_own a JOIN mix_own b ON b.asset_id = a.asset_id AND b.step <= a.step"
    " GROUP BY a.asset_id, a.model_cycle",
)
MEAN_ERROR = (
    "round((" + " + ".join(f"pow(s.{f} - m.m_{f}, 2)" for f in FEATURES) + f") / {len(FEATURES)}, 4) AS row_score"
)
define(
    "mean_baseline",
    f"""SELECT t.asset_id, u.model_cycle, t.us, t.base_run, t.calibration, {MEAN_ERROR}
        FROM timeline t JOIN scaled s USING (asset_id, us)
        JOIN (SELECT DISTINCT asset_id, model_cycle FROM lineage) u USING (asset_id)
        LEFT JOIN mix_mean m ON m.asset_id = t.asset_id AND m.model_cycle = u.model_cycle
        WHERE t.base_run IS NOT NULL""",
)
define(
    "mean_source",
    f"""SELECT t.asset_id, u.model_cycle, t.cycle_id, t.us, t.phase, t.src_run, t.evaluation, {MEAN_ERROR}
        FROM timeline t JOIN scaled s USING (asset_id, us)
        JOIN lineage u ON u.asset_id = t.asset_id AND u.cycle_id = t.cycle_id
        LEFT JOIN mix_mean m ON m.asset_id = t.asset_id AND m.model_cycle = u.model_cycle
        WHERE t.src_run IS NOT NULL""",
)

# Scores and risk ----------------------------------------------------------------------------------------

define(
    "distance",
    "SELECT t.*, round(("
    + " + ".join(f"s.{f} * s.{f}" for f in FEATURES)
    + f") / {len(FEATURES)}, 4) AS row_score FROM timeline t JOIN scaled s USING (asset_id, us)",
)
WINDOW_MEAN = (
    "avg(row_score) OVER (PARTITION BY asset_id, {run} ORDER BY us "
    f"ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)"
)
define(
    "cal",
    f"""SELECT 'distance_row' AS workflow_id, asset_id, 0 AS model_cycle, us, row_score AS anomaly_score
        FROM distance WHERE calibration
        UNION ALL
        SELECT 'distance_window', asset_id, 0, us, round(m, 6) FROM (
            SELECT *, {WINDOW_MEAN.format(run='base_run')} AS m FROM distance
            WHERE base_run IS NOT NULL) WHERE calibration
        UNION ALL
        SELECT 'mean_per_maintenance', asset_id, model_cycle, us, round(m, 6) FROM (
            SELECT *, {WINDOW_MEAN.format(run='model_cycle, base_run')} AS m FROM mean_baseline)
        WHERE calibration""",
)
define(
    "evs",
    f"""SELECT 'distance_row' AS workflow_id, asset_id, 0 AS model_cycle, cycle_id, us, phase,
               row_score AS anomaly_score
        FROM distance WHERE evaluation
        UNION ALL
        SELECT 'distance_window', asset_id, 0, cycle_id, us, phase, round(m, 6) FROM (
            SELECT *, {WINDOW_MEAN.format(run='src_run')} AS m FROM distance
            WHERE src_run IS NOT NULL) WHERE evaluation
        UNION ALL
        SELECT 'mean_per_maintenance', asset_id, model_cycle, cycle_id, us, phase, round(m, 6) FROM (
            SELECT *, {WINDOW_MEAN.format(run='src_run')} AS m FROM mean_source) WHERE evaluation""",
)
define("cal_ref", "SELECT * FROM cal WHERE anomaly_score IS NOT NULL")
define(
    "risked",
    """SELECT e.workflow_id, e.asset_id, e.cycle_id, e.us, any_value(e.phase) AS phase,
              any_value(e.anomaly_score) AS anomaly_score,
              CASE WHEN any_value(e.anomaly_score) IS NOT NULL AND count(c.us) > 0 THEN
                count(*) FILTER (c.anomaly_score <= e.anomaly_score) / count(c.us)::DOUBLE END
              AS risk_score
       FROM evs e LEFT JOIN cal_ref c USING (workflow_id, asset_id, model_cycle) GROUP BY ALL""",
)
define(
    "risk_gaps",
    """SELECT workflow_id, asset_id, cycle_id, median(d) AS gap_us FROM (
         SELECT *, us - lag(us) OVER (PARTITION BY workflow_id, asset_id, cycle_id ORDER BY us) AS d
         FROM risked) WHERE d > 0 GROUP BY ALL""",
)
define(
    "risk_rows", "SELECT * FROM risked LEFT JOIN risk_gaps USING (workflow_id, asset_id, cycle_id)"
)
labelled_runs(
    "risk_runs", "risk_rows", "CASE WHEN risk_score IS NOT NULL THEN 0 END",
    "workflow_id, asset_id, cycle_id", "risk",
)
define(
    "predictions",
    f"""SELECT workflow_id, asset_id, cycle_id, us, phase, anomaly_score, risk_score,
               CASE WHEN risk_run IS NOT NULL THEN
               avg(CASE WHEN risk_score >= {P.exceedance_quantile} THEN 1.0 ELSE 0.0 END) OVER (
                   PARTITION BY workflow_id, asset_id, cycle_id, risk_run ORDER BY us
                   RANGE BETWEEN {P.risk_window_minutes * MINUTE_US - 1} PRECEDING AND CURRENT ROW)
               END AS maintenance_risk
        FROM risk_runs""",
)

# Threshold sweep --------------------------------------------------------------------------------------

define("wfs", "SELECT unnest(" + str(list(WORKFLOWS)) + ") AS workflow_id")
define("thetas", f"SELECT unnest({THETAS}) AS theta")
define(
    "aligned",
    """SELECT w.workflow_id, t.asset_id, t.us, t.ts, t.gap_us, t.evaluation, p.maintenance_risk
       FROM timeline t CROSS JOIN wfs w
       LEFT JOIN predictions p ON p.workflow_id = w.workflow_id AND p.asset_id = t.asset_id
                              AND p.us = t.us AND t.evaluation""",
)
define("theta_rows", "SELECT * FROM aligned CROSS JOIN thetas")
labelled_runs(
    "theta_runs",
    "theta_rows",
    "CASE WHEN evaluation AND maintenance_risk >= theta THEN 0 END",
    "workflow_id, asset_id, theta",
    "alarm",
)
define(
    "theta_intervals",
    """SELECT workflow_id, asset_id, theta, min(us) AS start_us, max(us) AS end_us
       FROM theta_runs WHERE alarm_run IS NOT NULL GROUP BY workflow_id, asset_id, theta, alarm_run""",
)
define(
    "theta_spans",
    f"""SELECT w.workflow_id, e.asset_id, h.theta, e.ordinal,
               count(*) FILTER (i.end_us < e.start_us - {LEAD_US}) + 1 AS lo,
               count(*) FILTER (i.start_us <= e.start_us) AS hi
        FROM aev e CROSS JOIN wfs w CROSS JOIN thetas h
        LEFT JOIN theta_intervals i ON i.workflow_id = w.workflow_id AND i.asset_id = e.asset_id
                                   AND i.theta = h.theta
        GROUP BY w.workflow_id, e.asset_id, h.theta, e.ordinal""",
)
define(
    "theta_fold",
    """SELECT DISTINCT workflow_id, asset_id, theta, 0 AS ordinal, 0::BIGINT AS last, 0::BIGINT AS tp
       FROM theta_spans
       UNION ALL
       SELECT f.workflow_id, f.asset_id, f.theta, s.ordinal,
              CASE WHEN greatest(s.lo, f.last + 1) <= s.hi THEN greatest(s.lo, f.last + 1)
                   ELSE f.last END,
              f.tp + CASE WHEN greatest(s.lo, f.last + 1) <= s.hi THEN 1 ELSE 0 END
       FROM theta_fold f JOIN theta_spans s
         ON s.workflow_id = f.workflow_id AND s.asset_id = f.asset_id AND s.theta = f.theta
        AND s.ordinal = f.ordinal + 1""",
)
define(
    "theta_points",
    """SELECT workflow_id, theta,
              count(*) FILTER (evaluation AND maintenance_risk >= theta) AS alarm_points,
              count(*) FILTER (evaluation AND maintenance_risk IS NOT NULL) AS total_points
       FROM theta_rows GROUP BY workflow_id, theta""",
)
define(
    "theta_counts",
    """SELECT workflow_id, theta, sum(tp)::BIGINT AS tp, sum(events - tp)::BIGINT AS fn
       FROM (SELECT workflow_id, asset_id, theta, max(tp) AS tp, max(ordinal) AS events
             FROM theta_fold GROUP BY workflow_id, asset_id, theta) GROUP BY workflow_id, theta""",
)


def ratios(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    """Precision and recall columns; 0 when undefined."""
    return (
        f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp})::DOUBLE ELSE 0.0 END AS precision, "
        f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn})::DOUBLE ELSE 0.0 END AS recall"
    )


F1 = (
    "CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) "
    "ELSE 0.0 END AS f1"
)
define(
    "sweep_counts",
    """SELECT c.workflow_id, c.theta, tp, coalesce(n, 0) - tp AS fp, fn, alarm_points, total_points
       FROM theta_counts c JOIN theta_points USING (workflow_id, theta)
       LEFT JOIN (SELECT workflow_id, theta, count(*) AS n FROM theta_intervals GROUP BY ALL)
         USING (workflow_id, theta)""",
)
define(
    "sweep",
    f"""SELECT workflow_id, tp, fp, fn, precision, recall, f1, theta AS maintenance_risk_theta,
               theta AS threshold, coverage, coverage * 100.0 AS coverage_percent, alarm_points,
               total_points,
               greatest(0.0, {P.target_recall} - recall)
               + greatest(0.0, coverage - {P.target_coverage}) AS target_gap
        FROM (SELECT *, {F1}, CASE WHEN total_points > 0 THEN alarm_points / total_points::DOUBLE
                     ELSE 0.0 END AS coverage
              FROM (SELECT *, {ratios()} FROM sweep_counts))""",
)
define(
    "selected",
    f"""SELECT * EXCLUDE (feasible, rk),
               CASE WHEN feasible THEN 'feasible' ELSE 'fallback' END AS selection_mode,
               {P.target_recall}::DOUBLE AS target_recall,
               {P.target_coverage}::DOUBLE AS target_coverage,
               '{P.selection_scope}' AS selection_scope
        FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY feasible DESC,
                     CASE WHEN feasible THEN 0.0 ELSE target_gap END, f1 DESC, precision DESC,
                     recall DESC, threshold) AS rk
              FROM (SELECT *, recall >= {P.target_recall} AND coverage < {P.target_coverage} AS feasible
                    FROM sweep)) WHERE rk = 1""",
)

# Event metrics at the operating point ---------------------------------------------------------------------

define(
    "alarmed",
    """SELECT a.*, coalesce(evaluation AND maintenance_risk >= maintenance_risk_theta, false) AS alarm
       FROM aligned a JOIN (SELECT workflow_id, maintenance_risk_theta FROM selected)
         USING (workflow_id)""",
)
labelled_runs("alarm_runs", "alarmed", "CASE WHEN alarm THEN 0 END", "workflow_id, asset_id", "alarm")
define(
    "intervals",
    """SELECT workflow_id, asset_id, min(us) AS start_us, max(us) AS end_us, count(*) AS row_count,
              row_number() OVER (PARTITION BY workflow_id, asset_id ORDER BY min(us)) AS idx
       FROM alarm_runs WHERE alarm_run IS NOT NULL GROUP BY workflow_id, asset_id, alarm_run""",
)
define("wev", "SELECT w.workflow_id, e.* FROM aev e CROSS JOIN wfs w")
define(
    "eligible",
    f"""SELECT e.workflow_id, e.asset_id, e.ordinal, e.start_us AS event_start_us,
               e.start_us - {LEAD_US} AS warning_us, i.start_us, i.end_us, i.idx
        FROM wev e JOIN intervals i ON i.workflow_id = e.workflow_id AND i.asset_id = e.asset_id
         AND i.start_us <= e.start_us AND i.end_us >= e.start_us - {LEAD_US}""",
)
define(
    "taken",
    """SELECT DISTINCT workflow_id, asset_id, 0 AS ordinal, 0::BIGINT AS last, NULL::BIGINT AS idx
       FROM wev
       UNION ALL
       SELECT f.workflow_id, f.asset_id, f.ordinal + 1, coalesce(
                (SELECT min(g.idx) FROM eligible g WHERE g.workflow_id = f.workflow_id
                 AND g.asset_id = f.asset_id AND g.ordinal = f.ordinal + 1 AND g.idx > f.last), f.last),
              (SELECT min(g.idx) FROM eligible g WHERE g.workflow_id = f.workflow_id
               AND g.asset_id = f.asset_id AND g.ordinal = f.ordinal + 1 AND g.idx > f.last)
       FROM taken f WHERE f.ordinal < (SELECT max(ordinal) FROM aev)""",
)
define(
    "matches",
    """SELECT t.workflow_id, t.asset_id, t.ordinal, t.idx, i.start_us AS matched_us
       FROM taken t LEFT JOIN intervals i USING (workflow_id, asset_id, idx) WHERE t.ordinal > 0""",
)
define(
    "interval_totals",
    """SELECT w.workflow_id, count(i.idx) AS intervals FROM wfs w
       LEFT JOIN intervals i USING (workflow_id) GROUP BY w.workflow_id""",
)
define(
    "event_scores",
    f"""SELECT *, {F1} FROM (SELECT *, {ratios()} FROM (
          SELECT workflow_id, count(idx) AS tp, any_value(intervals) - count(idx) AS fp,
                 count(*) - count(idx) AS fn
          FROM matches JOIN interval_totals USING (workflow_id) GROUP BY workflow_id))""",
)
define("leads", f"SELECT unnest({LEADS})::INT AS lead_minutes")
define(
    "lead_eligible",
    f"""SELECT e.workflow_id, e.asset_id, l.lead_minutes, e.ordinal, i.idx
        FROM wev e CROSS JOIN leads l JOIN intervals i ON i.workflow_id = e.workflow_id
         AND i.asset_id = e.asset_id AND i.start_us <= e.end_us
         AND i.end_us >= e.start_us - {LEAD_US}
         AND i.start_us <= e.start_us - l.lead_minutes::BIGINT * {MINUTE_US}""",
)
define(
    "lead_taken",
    """SELECT DISTINCT workflow_id, asset_id, lead_minutes, 0 AS ordinal, 0::BIGINT AS last,
              NULL::BIGINT AS idx
       FROM wev CROSS JOIN leads
       UNION ALL
       SELECT f.workflow_id, f.asset_id, f.lead_minutes, f.ordinal + 1, coalesce(
                (SELECT min(g.idx) FROM lead_eligible g WHERE g.workflow_id = f.workflow_id
                 AND g.asset_id = f.asset_id AND g.lead_minutes = f.lead_minutes
                 AND g.ordinal = f.ordinal + 1 AND g.idx > f.last), f.last),
              (SELECT min(g.idx) FROM lead_eligible g WHERE g.workflow_id = f.workflow_id
               AND g.asset_id = f.asset_id AND g.lead_minutes = f.lead_minutes
               AND g.ordinal = f.ordinal + 1 AND g.idx > f.last)
       FROM lead_taken f WHERE f.ordinal < (SELECT max(ordinal) FROM aev)""",
)
define(
    "lead_scores",
    f"""SELECT *, {F1} FROM (SELECT *, {ratios()} FROM (
          SELECT workflow_id, lead_minutes, count(idx) AS tp, any_value(intervals) - count(idx) AS fp,
                 count(*) - count(idx) AS fn
          FROM lead_taken JOIN interval_totals USING (workflow_id)
          WHERE ordinal > 0 GROUP BY workflow_id, lead_minutes))""",
)
define(
    "ttd",
    f"""SELECT e.workflow_id, e.asset_id, e.ordinal, e.event_id, min(a.us) AS first_alarm_us,
               (e.start_us - min(a.us)) / 6e7 AS ttd_minutes
        FROM wev e LEFT JOIN alarmed a ON a.workflow_id = e.workflow_id AND a.asset_id = e.asset_id
         AND a.alarm AND a.us >= e.start_us - {LEAD_US} AND a.us <= e.start_us
        GROUP BY e.workflow_id, e.asset_id, e.ordinal, e.event_id, e.start_us""",
)
define(
    "ttd_summary",
    """SELECT workflow_id, count(ttd_minutes) AS detected_events,
              count(*) - count(ttd_minutes) AS missed_events, avg(ttd_minutes) AS mean_ttd,
              stddev_pop(ttd_minutes) AS std_ttd, min(ttd_minutes) AS min_ttd,
              max(ttd_minutes) AS max_ttd, median(ttd_minutes) AS median_ttd
       FROM ttd GROUP BY workflow_id""",
)
define(
    "first_alarm",
    """SELECT workflow_id, coalesce(n, 0) AS tp_events, coalesce(hit, 0) AS first_alarm_in_window,
              CASE WHEN n > 0 THEN hit / n::DOUBLE END AS first_alarm_accuracy
       FROM wfs LEFT JOIN (
         SELECT workflow_id, count(*) AS n, count(*) FILTER (s >= warning_us) AS hit
         FROM (SELECT workflow_id, asset_id, ordinal, warning_us, min(start_us) AS s
               FROM eligible GROUP BY ALL) GROUP BY workflow_id) USING (workflow_id)""",
)
define(
    "minutes",
    """SELECT asset_id, count(*) FILTER (evaluation) AS evaluation_rows,
              coalesce(any_value(gap_us) / 6e7, 1.0) AS sample_minutes,
              count(*) FILTER (evaluation) * coalesce(any_value(gap_us) / 6e7, 1.0)
              AS evaluated_minutes
       FROM timeline GROUP BY asset_id""",
)
define(
    "far",
    """SELECT *, total_days / 7.0 AS total_weeks,
              CASE WHEN total_days <> 0 THEN fp_intervals / total_days END AS far_per_day,
              CASE WHEN total_days <> 0 THEN fp_intervals / (total_days / 7.0) END AS far_per_week
       FROM (SELECT w.workflow_id, count(i.idx) AS total_alarm_intervals,
                    count(*) FILTER (i.idx IS NOT NULL AND NOT EXISTS (
                        SELECT 1 FROM eligible g WHERE g.workflow_id = i.workflow_id
                        AND g.asset_id = i.asset_id AND g.idx = i.idx)) AS fp_intervals,
                    (SELECT sum(evaluated_minutes) / 1440.0 FROM minutes) AS total_days
             FROM wfs w LEFT JOIN intervals i USING (workflow_id) GROUP BY w.workflow_id)""",
)
define(
    "coverage",
    """SELECT *, CASE WHEN total_points > 0 THEN alarm_points / total_points::DOUBLE ELSE 0.0 END
              AS alarm_coverage,
              100.0 * CASE WHEN total_points > 0 THEN alarm_points / total_points::DOUBLE ELSE 0.0 END
              AS alarm_coverage_percent
       FROM (SELECT workflow_id, count(*) FILTER (alarm) AS alarm_points,
                    count(*) FILTER (evaluation) AS total_points FROM alarmed GROUP BY workflow_id)""",
)
define(
    "timed",
    """SELECT i.*, greatest(0.0, (end_us - start_us) / 6e7) + sample_minutes AS duration_minutes
       FROM intervals i JOIN minutes USING (asset_id)""",
)
define(
    "mtia",
    """SELECT w.workflow_id, count(idx) AS num_intervals, avg(duration_minutes) AS mtia_minutes,
              stddev_pop(duration_minutes) AS std_minutes, min(duration_minutes) AS min_minutes,
              max(duration_minutes) AS max_minutes, median(duration_minutes) AS median_minutes
       FROM wfs w LEFT JOIN timed USING (workflow_id) GROUP BY w.workflow_id""",
)
define(
    "profiles",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in NAB_PROFILES)
    + ") AS t(profile, w_tp, w_fp, w_fn)",
)
define(
    "nab",
    f"""SELECT workflow_id, profile, raw AS nab_score_raw,
               CASE WHEN top <> bottom THEN 100.0 * (raw - bottom) / (top - bottom) ELSE 0.0 END
               AS nab_score_normalized, num_fp
        FROM (SELECT workflow_id, profile, num_fp, score - num_fp * w_fp AS raw, n * w_tp AS top,
                     -n * w_fn - intervals * w_fp AS bottom
              FROM (SELECT m.workflow_id, profile, w_tp, w_fp, w_fn, count(*) AS n,
                           any_value(intervals) AS intervals,
                           any_value(intervals) - count(m.idx) AS num_fp,
                           sum(CASE WHEN m.idx IS NULL THEN -w_fn ELSE w_tp / (1.0 + exp(5.0 * (
                               (greatest(m.matched_us, e.start_us - {LEAD_US}) - (e.start_us - {LEAD_US}))
                               / 6e7 / {float(P.lead_minutes)} - 0.5))) END) AS score
                    FROM matches m JOIN wev e USING (workflow_id, asset_id, ordinal)
                    JOIN interval_totals USING (workflow_id) CROSS JOIN profiles
                    GROUP BY m.workflow_id, profile, w_tp, w_fp, w_fn))""",
)
define(
    "islands",
    """SELECT t.workflow_id, t.asset_id, t.idx AS island_id, t.start_us, t.end_us, t.duration_minutes,
              t.row_count AS point_count,
              (t.start_us - lag(t.end_us) OVER (PARTITION BY t.workflow_id, t.asset_id
                                                ORDER BY t.start_us)) / 6e7
              AS gap_from_previous_minutes,
              g.ids IS NOT NULL AS is_true_positive, coalesce(g.ids, '') AS matched_event_ids
       FROM timed t LEFT JOIN (SELECT workflow_id, asset_id, idx,
                                      string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS ids
                               FROM eligible GROUP BY ALL) g USING (workflow_id, asset_id, idx)""",
)
define(
    "island_summary",
    """SELECT c.workflow_id, count(island_id) AS island_count,
              count(*) FILTER (is_true_positive) AS true_positive_island_count,
              count(island_id) - count(*) FILTER (is_true_positive) AS false_alarm_island_count,
              avg(duration_minutes) AS mean_duration_minutes,
              median(duration_minutes) AS median_duration_minutes,
              max(duration_minutes) AS max_duration_minutes,
              any_value(alarm_points) AS alarm_points,
              any_value(total_points) AS total_evaluation_points,
              any_value(alarm_coverage) AS coverage,
              any_value(alarm_coverage_percent) AS coverage_percent
       FROM coverage c LEFT JOIN islands USING (workflow_id) GROUP BY c.workflow_id""",
)
define(
    "summary",
    """SELECT s.workflow_id, s.selection_scope, s.selection_mode, s.maintenance_risk_theta,
              e.tp, e.fp, e.fn, e.precision, e.recall, e.f1, t.mean_ttd AS ttd_minutes,
              a.first_alarm_accuracy AS faa, f.far_per_day, c.alarm_coverage AS coverage,
              c.alarm_coverage_percent AS coverage_percent, m.mtia_minutes,
              n.nab_standard, n.nab_low_fp, n.nab_low_fn, i.island_count AS alarm_islands,
              i.false_alarm_island_count AS false_alarm_islands
       FROM selected s JOIN event_scores e USING (workflow_id) JOIN ttd_summary t USING (workflow_id)
       JOIN first_alarm a USING (workflow_id) JOIN far f USING (workflow_id)
       JOIN coverage c USING (workflow_id) JOIN mtia m USING (workflow_id)
       JOIN island_summary i USING (workflow_id)
       JOIN (SELECT workflow_id,
                    max(CASE WHEN profile = 'standard' THEN nab_score_normalized END) AS nab_standard,
                    max(CASE WHEN profile = 'low_fp' THEN nab_score_normalized END) AS nab_low_fp,
                    max(CASE WHEN profile = 'low_fn' THEN nab_score_normalized END) AS nab_low_fn
             FROM nab GROUP BY workflow_id) n USING (workflow_id)""",
)

# Candidates ------------------------------------------------------------------------------------------------

define(
    "candidates",
    """SELECT l_suppkey AS id, round(avg(l_tax), 6) AS obj_error, round(avg(l_discount), 6) AS obj_pdm,
              round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS obj_alarm_burden,
              count(*) AS line_count
       FROM lineitem GROUP BY l_suppkey""",
)
define(
    "ledger",
    """SELECT id, 'study_' || (id % 3) AS study_id, 'contract' AS search_contract_fingerprint,
              md5(id::VARCHAR) AS architecture_hash, obj_error, obj_pdm, obj_alarm_burden, 'valid' AS status,
              printf('{"line_count":%d,"parameter_count":%d}', line_count, id * 10) AS diagnostics_json,
              printf('2024-01-01T00:%02d:00', id % 60) AS created_at
       FROM candidates""",
)
define(
    "valid_candidates",
    f"""SELECT * FROM ledger WHERE status = 'valid' AND isfinite(obj_error) AND isfinite(obj_pdm)
        AND isfinite(obj_alarm_burden) AND obj_error < {P.invalid_penalty}
        AND obj_pdm < {P.invalid_penalty} AND obj_alarm_burden < {P.invalid_penalty}""",
)
define(
    "front",
    """SELECT * FROM valid_candidates c WHERE NOT EXISTS (
         SELECT 1 FROM valid_candidates q WHERE q.study_id = c.study_id
         AND q.obj_error <= c.obj_error AND q.obj_pdm <= c.obj_pdm
         AND q.obj_alarm_burden <= c.obj_alarm_burden AND (q.obj_error < c.obj_error
              OR q.obj_pdm < c.obj_pdm OR q.obj_alarm_burden < c.obj_alarm_burden))""",
)
