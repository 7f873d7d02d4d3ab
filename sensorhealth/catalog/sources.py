"""Scans, sources, sinks, projections and scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grids, scalars
from ..operators.calendar import with_phase
from ..operators.contract import check_summary, fingerprint
from ..params import DAY_US, HOUR_US, MINUTE_US
from ..plans.prepared import load_study, save_study
from ..plans.study import Study
from ..session import materialize, scratch_path
from ..sources import ledger as ledgers
from ..sources import sinks
from ..sources import telemetry as tel
from ..sources.maintenance import COMPRESSOR_WINDOWS, FLEET_WINDOWS, every_asset, normalize_windows
from . import query, tidy
from .candidates import candidate_ledger
from .oracle import FEATURES, LEADS, P, THETAS, sql

CHANNELS = list(tel.SENSOR_CHANNELS)


def scratch(p, name: str) -> str:
    return scratch_path(p.spark, name)


def raw_text(p):
    """The telemetry as a raw file would hold it: text columns and a stray index column."""
    return p.study.base.select(
        F.col("us").cast("string").alias("Unnamed: 0"),
        F.col("asset_id").cast("string").alias("asset"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
        *[F.col(c).cast("string").alias(c) for c in CHANNELS],
    )


@query("s1_csv_scan", sql("SELECT asset_id, ts, us, value, k, is_error FROM tl"))
def s1(p):
    path = scratch(p, "csv")
    raw = raw_text(p)
    raw.write.option("header", True).csv(path)
    frame = tel.read_csv(p.spark, path, raw.columns)
    return tel.load_telemetry(frame, CHANNELS, asset_column="asset")


#: Days between the driver's telemetry and the part of the compressor schedule it is moved to.
SHIFT_DAYS = 1361
WINDOW_ROWS = ", ".join(
    f"(epoch_us(TIMESTAMP '{s}') + {SHIFT_DAYS * DAY_US}, epoch_us(TIMESTAMP '{t}') + {SHIFT_DAYS * DAY_US})"
    for s, t, *_ in COMPRESSOR_WINDOWS
)


@query(
    "s1_compressor_study",
    sql(
        f"""SELECT t.asset_id, count(*) AS row_count, count(*) FILTER (phase = 2) AS maintenance_rows,
                   count(*) FILTER (phase = 1) AS warning_rows,
                   count(*) FILTER (phase < 2 AND us <= data_start_us + {P.baseline_minutes * MINUTE_US})
                   AS baseline_rows, 90::BIGINT AS features,
                   round(avg(value__mean), 6) AS mean_feature, round(avg(value__max), 6) AS max_feature
            FROM (SELECT f.asset_id, f.us, f.value__mean, f.value__max, s.data_start_us,
                         CASE WHEN bool_or(f.us BETWEEN w.a AND w.b) THEN 2
                              WHEN bool_or(f.us >= w.a - {P.pre_maintenance_minutes * MINUTE_US} AND f.us < w.a)
                              THEN 1 ELSE 0 END AS phase
                  FROM feats f JOIN stats s USING (asset_id) CROSS JOIN (VALUES {WINDOW_ROWS}) AS w(a, b)
                  GROUP BY ALL) t
            GROUP BY t.asset_id"""
    ),
)
def s1_compressor(p):
    """The compressor study from CSV files: telemetry written under its channel names, then prepared."""
    path = scratch(p, "compressor-csv")
    base = p.study.base
    moved = F.date_format(F.col("ts") - F.make_dt_interval(F.lit(SHIFT_DAYS)), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    frame = base.select(
        F.col("asset_id").cast("string").alias("asset"),
        moved.alias("timestamp"),
        *[
            F.col("is_error" if c in tel.COMPRESSOR_BINARY else "value").cast("string").alias(c)
            for c in tel.COMPRESSOR_CHANNELS
        ],
    )
    frame.write.option("header", True).csv(path)
    study = Study.compressor(p.spark, path, frame.columns, "asset", P)
    first = next(c for c in tel.COMPRESSOR_CHANNELS if c not in tel.COMPRESSOR_BINARY)
    labelled = study.timeline.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("phase") == 2).alias("maintenance_rows"),
        F.count_if(F.col("phase") == 1).alias("warning_rows"),
        F.count_if("baseline").alias("baseline_rows"),
    )
    means = study.feature_table.groupBy("asset_id").agg(
        F.lit(len(study.features_list)).alias("features"),
        F.avg(f"{first}__mean").alias("mean_feature"),
        F.avg(f"{first}__max").alias("max_feature"),
    )
    return tidy(labelled.join(means, "asset_id"))


@query(
    "s2_drop_stray_index",
    sql("SELECT asset_id::VARCHAR AS asset, count(*) AS row_count FROM tl GROUP BY 1"),
)
def s2(p):
    kept = tel.drop_stray_index(raw_text(p))
    if any(c.lower().startswith("unnamed") for c in kept.columns):
        raise ValueError("stray index column left")
    return kept.groupBy("asset").agg(F.count(F.lit(1)).alias("row_count"))


@query("s3_timestamp_column", sql("SELECT asset_id, ts AS timestamp FROM tl"))
def s3(p):
    named = tel.resolve_timestamp(p.study.base.withColumnRenamed("ts", "Timestamp"))
    return named.select("asset_id", "timestamp")


@query(
    "s4_coerce_timestamp",
    sql("SELECT asset_id, ts AS timestamp FROM tl WHERE is_error = 0"),
)
def s4(p):
    text = F.when(F.col("is_error") == 1, "not a time").otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    return tel.coerce_timestamp(p.study.base.select("asset_id", text.alias("timestamp")))


@query(
    "s5_unique_timeline",
    sql(
        f"""SELECT 'duplicate_timestamp' AS check_name, count(*) AS violations FROM (
              SELECT asset_id, us FROM tl GROUP BY ALL HAVING count(*) > 1)
            UNION ALL
            SELECT 'crowded_hour', count(*) FROM (
              SELECT asset_id, us // {HOUR_US} AS h FROM tl GROUP BY ALL HAVING count(*) > 1)"""
    ),
)
def s5(p):
    hours = p.study.base.withColumn("hour", F.floor(F.col("us") / HOUR_US))
    return check_summary(
        {
            "duplicate_timestamp": tel.duplicate_timestamps(p.study.base, ["asset_id"], "us"),
            "crowded_hour": tel.duplicate_timestamps(hours, ["asset_id"], "hour"),
        }
    )


@query(
    "s6_required_channels",
    sql("SELECT asset_id, value, k, is_error FROM tl"),
)
def s6(p):
    tel.require_channels(p.study.base, CHANNELS)
    return p.study.base.select("asset_id", *CHANNELS)


@query(
    "s7_numeric_coercion",
    sql(
        """SELECT asset_id, count(CASE WHEN is_error = 0 THEN value END) AS value, count(k) AS k,
                  count(*) AS row_count FROM tl GROUP BY asset_id"""
    ),
)
def s7(p):
    text = p.study.base.select(
        "asset_id",
        F.when(F.col("is_error") == 1, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.col("k").cast("string").alias("k"),
    )
    typed = tel.require_observations(tel.coerce_channels(text, ["value", "k"]), ["value", "k"])
    return typed.groupBy("asset_id").agg(
        F.count("value").alias("value"), F.count("k").alias("k"), F.count(F.lit(1)).alias("row_count")
    )


@query(
    "s8_maintenance_events",
    sql(
        """SELECT asset_id, event_id, start_ts, end_ts, severity, ordinal,
                  (SELECT count(*) FROM tl t WHERE t.asset_id = e.asset_id
                   AND t.us BETWEEN e.start_us AND e.end_us) AS rows_inside
           FROM aev e"""
    ),
)
def s8(p):
    events = p.study.events
    rows = p.study.base.select("asset_id", F.col("us").alias("_us"))
    inside = (
        events.join(rows, "asset_id")
        .filter(F.col("_us").between(F.col("start_us"), F.col("end_us")))
        .groupBy("asset_id", "ordinal")
        .agg(F.count(F.lit(1)).alias("rows_inside"))
    )
    return events.join(inside, ["asset_id", "ordinal"], "left").select(
        "asset_id",
        "event_id",
        "start_ts",
        "end_ts",
        "severity",
        "ordinal",
        F.coalesce("rows_inside", F.lit(0)).alias("rows_inside"),
    )


def asset_schedule(p):
    """A schedule table: the fleet's events shifted by hours for each asset, some of them left out."""
    shared = every_asset(p.study.stats.select("asset_id"), FLEET_WINDOWS)
    shift = F.make_dt_interval(hours=F.col("asset_id").cast("int"))
    kept = F.pmod(F.col("asset_id") + F.col("position"), F.lit(4)) != 0
    return shared.filter(kept).select(
        "asset_id", (F.col("start_ts") + shift).alias("start"), (F.col("end_ts") + shift).alias("end"),
        "event_id", "severity",
    )


def scheduled_study(p):
    return Study(p.spark, p.study.base, asset_schedule(p), CHANNELS, tel.SENSOR_BINARY)


OWN_EVENTS = "aev_own"


@query(
    "s8_schedule_table",
    sql(f"SELECT asset_id, event_id, start_ts, end_ts, severity, ordinal FROM {OWN_EVENTS}"),
)
def s8_table(p):
    return scheduled_study(p).events.select(
        "asset_id", "event_id", "start_ts", "end_ts", "severity", "ordinal"
    )


@query("t1_phase_own_schedule", sql("SELECT asset_id, us, phase::BIGINT AS phase FROM phased_own"))
def t1_own(p):
    study = scheduled_study(p)
    return tidy(with_phase(p.study.base.select("asset_id", "us"), study.events, P.pre_maintenance_minutes))


@query("t2_baseline_own_schedule", sql("SELECT asset_id, us FROM masked_own WHERE baseline"))
def t2_own(p):
    return scheduled_study(p).timeline.filter("baseline").select("asset_id", "us")


@query(
    "t4_cycles_own_schedule",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS cycle_id, source_event_id, score_start_us, score_end_us,
                  update_possible, alias_to_cycle::BIGINT AS alias_to_cycle, update_rows FROM cycles_own"""
    ),
)
def t4_own(p):
    return tidy(
        scheduled_study(p).cycles.select(
            "asset_id", "cycle_id", "source_event_id", "score_start_us", "score_end_us",
            "update_possible", "alias_to_cycle", "update_rows",
        )
    )


@query(
    "t5_populations_own_schedule",
    sql(
        """SELECT asset_id, us, post_train, evaluation_row, update_cycle::BIGINT AS update_cycle,
                  cycle_id::BIGINT AS cycle_id FROM sourced_own"""
    ),
)
def t5_own(p):
    rows = scheduled_study(p).timeline
    return tidy(
        rows.select(
            "asset_id", "us", "post_train", "evaluation_row",
            F.when(F.col("post_train") & F.col("phase").isin(*P.train_phases), F.col("update_cycle")).alias(
                "update_cycle"
            ),
            F.when(F.col("evaluation_row"), F.col("cycle_id")).alias("cycle_id"),
        )
    )


PREDICTION_KEYS = "workflow_id, asset_id, cycle_id, us"


@query("s9_reread_predictions", sql(f"SELECT {PREDICTION_KEYS} FROM predictions"))
def s9(p):
    path = scratch(p, "predictions")
    sinks.write_predictions(p.distance.predictions, path)
    return sinks.read_predictions(p.spark, path, ["workflow_id", "asset_id", "cycle_id", "us"])


@query(
    "s10_table_sinks",
    sql(
        """SELECT workflow_id, cycle_id::BIGINT AS cycle_id, count(*) AS row_count,
                  round(sum(maintenance_risk), 4) AS risk_sum FROM predictions GROUP BY ALL"""
    ),
)
def s10(p):
    path = scratch(p, "predictions")
    sinks.write_predictions(p.distance.predictions, path)
    back = sinks.read_predictions(
        p.spark, path, ["workflow_id", "cycle_id", "maintenance_risk"]
    )
    return back.groupBy("workflow_id", F.col("cycle_id").cast("bigint").alias("cycle_id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.round(F.sum("maintenance_risk"), 4).alias("risk_sum"),
    )


@query(
    "s11_json_sink",
    sql(
        """SELECT asset_id, event_id, workflow_id, round(ttd_minutes, 6) AS ttd_minutes FROM ttd"""
    ),
)
def s11(p):
    path = scratch(p, "metrics")
    undefined = p.distance.ttd.select(
        "asset_id",
        "event_id",
        "workflow_id",
        F.coalesce("ttd_minutes", F.lit(float("nan"))).alias("ttd_minutes"),
    )
    sinks.write_json(undefined, path)
    back = p.spark.read.schema(undefined.schema).json(path)
    return back.withColumn("ttd_minutes", F.round("ttd_minutes", 6))


@query(
    "s12_prepared_cache",
    sql(
        """SELECT asset_id, count(*) AS row_count, min(ts) AS first_ts, max(ts) AS last_ts,
                  sum(('0x' || substr(md5(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')), 1, 8))::BIGINT)::BIGINT
                  AS mark_sum, true AS unchanged FROM timeline GROUP BY asset_id"""
    ),
)
def s12(p):
    before = fingerprint(p.study.timeline, ["asset_id"])
    after = fingerprint(materialize(p.study.timeline, "cache"), ["asset_id"])
    same = before.select("asset_id", F.col("mark_sum").alias("_mark"), F.col("row_count").alias("_n"))
    return after.join(same, "asset_id", "left").select(
        *after.columns,
        F.coalesce((F.col("mark_sum") == F.col("_mark")) & (F.col("row_count") == F.col("_n")), F.lit(False)).alias(
            "unchanged"
        ),
    )


@query(
    "s12_stored_study",
    sql(
        """SELECT 'same_input' AS study, true AS reused, count(*) AS row_count, sum(us % 1000003)::BIGINT AS us_sum FROM timeline
           UNION ALL SELECT 'changed_input', false, NULL, NULL"""
    ),
)
def s12_stored(p):
    """Prepared tables read back by path for the same input, and refused for a changed one."""
    path = scratch(p, "study")
    save_study(p.study, path)
    again = Study.from_tables(p.spark, p.directory)
    changed = Study.from_tables(p.spark, p.directory)
    changed.base = changed.base.withColumn("value", F.col("value") + F.when(F.col("us") % 7 == 0, 1e-9).otherwise(0))
    reused, refused = load_study(again, path), load_study(changed, path)
    if not reused:
        raise ValueError("the stored study was not taken")
    return again.timeline.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("us") % 1000003).alias("us_sum")).select(
        F.lit("same_input").alias("study"), F.lit(reused).alias("reused"), "row_count", "us_sum"
    ).unionByName(
        p.spark.range(1).select(
            F.lit("changed_input").alias("study"), F.lit(refused).alias("reused"),
            F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("bigint").alias("us_sum"),
        )
    )


@query(
    "s5_input_problems",
    sql(
        f"""SELECT asset_id, 'short_baseline' AS problem, 1::BIGINT AS findings FROM split_rows
            WHERE baseline_rows < {2 * P.sequence_length} OR val_start - {P.sequence_length - 1} < {P.sequence_length}
            UNION ALL
            SELECT asset_id, 'duplicate_timestamp', count(*) FROM (
              SELECT asset_id, us FROM tl GROUP BY ALL HAVING count(*) > 1) GROUP BY asset_id
            UNION ALL
            SELECT asset_id, 'non_finite_scaler_fit', 1 FROM fit_rows GROUP BY asset_id
            HAVING NOT bool_and("""
        + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
        + """) UNION ALL
            SELECT asset_id, 'empty_scaler_fit', 1 FROM stats
            WHERE asset_id NOT IN (SELECT asset_id FROM timeline WHERE baseline_train)"""
    ),
)
def s5_problems(p):
    return p.study.problems


@query("s13_ledger_append", sql("SELECT id, architecture_hash FROM ledger"))
def s13_append(p):
    """Three appends to ledger files, of which the second and third repeat known keys."""
    path, full = scratch(p, "ledger"), candidate_ledger(p)
    added = [
        ledgers.append_new(p.spark, path, rows)
        for rows in (full.filter("obj_error < 0.04"), full.unionByName(full), full)
    ]
    if added[2]:
        raise ValueError("known candidates were appended again")
    return p.spark.read.parquet(path).select("id", "architecture_hash")


@query(
    "s10_csv_sinks",
    sql(
        """SELECT 'sweep' AS table_name, count(*) AS row_count, round(sum(f1), 4) AS total FROM sweep
           UNION ALL SELECT 'comparison', count(*), round(sum(f1), 4) FROM summary
           UNION ALL SELECT 'islands', count(*), round(sum(duration_minutes), 4) FROM islands"""
    ),
)
def s10_csv(p):
    """Sweep, comparison and islands as CSV files and back."""
    e, parts = p.distance, []
    tables = {"sweep": (e.sweep, "f1"), "comparison": (e.comparison, "f1"), "islands": (e.islands, "duration_minutes")}
    for name, (frame, column) in tables.items():
        path = scratch(p, name)
        sinks.write_csv(frame, path)
        back = p.spark.read.option("header", True).csv(path)
        total = F.round(F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)), 4)
        parts.append(
            back.agg(F.count(F.lit(1)).alias("row_count"), total.alias("total")).select(
                F.lit(name).alias("table_name"), "row_count", "total"
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "s13_ledger_insert",
    sql(
        """SELECT id, architecture_hash, status, round(obj_error, 6) AS obj_error FROM ledger
           WHERE study_id = 'study_1'"""
    ),
)
def s13(p):
    full = candidate_ledger(p)
    known = full.filter("obj_error < 0.04")
    # The incoming batch repeats known keys and itself; only absent keys are added, once.
    merged = ledgers.insert_if_absent(known, full.unionByName(full))
    return tidy(
        ledgers.study_rows(merged, "study_1", "contract").select(
            "id", "architecture_hash", "status", "obj_error"
        )
    )


@query(
    "s14_ledger_flatten",
    sql(
        """SELECT id, architecture_hash, json_extract(diagnostics_json, '$.line_count')::DOUBLE
                  AS diagnostic_line_count,
                  json_extract(diagnostics_json, '$.parameter_count')::DOUBLE AS diagnostic_parameter_count
           FROM ledger"""
    ),
)
def s14(p):
    flat = ledgers.flatten_diagnostics(candidate_ledger(p), ["line_count", "parameter_count"])
    return flat.select(
        "id", "architecture_hash", "diagnostic_line_count", "diagnostic_parameter_count"
    )


# Projection, filter and scalar operators -----------------------------------------------------------


@query(
    "p1_feature_names",
    sql(
        """SELECT asset_id, feature, split_part(feature, '__', 1) AS channel,
                  split_part(feature, '__', 2) AS aggregation, fitted_rows FROM scaler"""
    ),
)
def p1(p):
    return p.study.scaler.select(
        "asset_id",
        "feature",
        scalars.base_feature(F.col("feature")).alias("channel"),
        scalars.aggregation_of(F.col("feature")).alias("aggregation"),
        "fitted_rows",
    )


@query("p2_phase_membership", sql("SELECT asset_id, us, phase FROM phased WHERE phase IN (1, 2)"))
def p2(p):
    return p.study.timeline.filter(F.col("phase").isin(1, 2)).select("asset_id", "us", "phase")


@query(
    "p3_mask_algebra",
    sql(
        """SELECT asset_id, count(*) FILTER (evaluation_row) AS evaluation_rows,
                  count(*) FILTER (baseline OR post_train) AS training_rows,
                  count(*) FILTER (baseline AND NOT calibration) AS baseline_other
           FROM timeline GROUP BY asset_id"""
    ),
)
def p3(p):
    c = F.col
    return p.study.timeline.groupBy("asset_id").agg(
        F.count_if(
            ~c("baseline") & ~c("post_train") & (c("phase") != 2) & c("phase").isin(*P.test_phases)
        ).alias("evaluation_rows"),
        F.count_if(c("baseline") | c("post_train")).alias("training_rows"),
        F.count_if(c("baseline") & ~F.coalesce(c("calibration"), F.lit(False))).alias(
            "baseline_other"
        ),
    )


@query(
    "p4_finite_filter",
    sql(
        """SELECT asset_id, us, ln(value) AS log_value FROM tl WHERE value > 0"""
        .replace("ln(value)", "round(ln(value), 6)")
    ),
)
def p4(p):
    # log of 0 is undefined, and a division by 0 gives infinity or NaN in IEEE arithmetic.
    log = F.when(F.col("value") > 0, F.log("value")).otherwise(F.lit(float("-inf")))
    rows = p.study.base.select("asset_id", "us", log.alias("log_value"))
    return tidy(rows.filter(scalars.is_finite(F.col("log_value"))))


@query(
    "p5_single_precision",
    sql("SELECT asset_id, us, value::FLOAT::DOUBLE AS value, k::FLOAT::DOUBLE AS k FROM tl"),
)
def p5(p):
    return p.study.base.select(
        "asset_id", "us", *[F.col(c).cast("float").cast("double").alias(c) for c in ("value", "k")]
    )


@query(
    "p6_clip_unit",
    sql("SELECT asset_id, us, greatest(0.0, least(1.0, (value - 10) / 100)) AS clipped FROM tl"),
)
def p6(p):
    return p.study.base.select(
        "asset_id", "us", scalars.clip_unit((F.col("value") - 10) / 100).alias("clipped")
    )


@query(
    "p7_time_arithmetic",
    sql(
        f"""SELECT asset_id, event_id, start_us - {P.lead_minutes * MINUTE_US} AS warning_us,
                   (start_us - data_start_us) / 6e7 AS minutes_from_start,
                   (data_end_us - end_us) / 6e7 AS minutes_to_end
            FROM aev JOIN stats USING (asset_id)""".replace(
            "(start_us - data_start_us) / 6e7", "round((start_us - data_start_us) / 6e7, 6)"
        ).replace("(data_end_us - end_us) / 6e7", "round((data_end_us - end_us) / 6e7, 6)")
    ),
)
def p7(p):
    joined = p.study.events.join(p.study.stats, "asset_id")
    return tidy(
        joined.select(
            "asset_id",
            "event_id",
            F.unix_micros(
                (F.col("start_ts") - F.make_dt_interval(mins=F.lit(P.lead_minutes))).cast("timestamp")
            ).alias("warning_us"),
            scalars.minutes_between(F.col("data_start_us"), F.col("start_us")).alias(
                "minutes_from_start"
            ),
            scalars.minutes_between(F.col("end_us"), F.col("data_end_us")).alias("minutes_to_end"),
        )
    )


@query(
    "p8_theta_grid",
    sql(
        f"""SELECT round(g.theta, 12) AS theta, count(t.us) AS rows_reached
            FROM (SELECT DISTINCT round(0.10 + i * 0.05, 12) AS theta FROM range(17) AS r(i)
                  UNION SELECT unnest({list(P.extra_thresholds)})) g
            LEFT JOIN tl t ON t.k / 100 >= g.theta GROUP BY g.theta"""
    ),
)
def p8(p):
    """Grid values with the telemetry rows whose scaled channel reaches them."""
    grid = grids.theta_grid(p.spark, P.theta_grid, P.extra_thresholds)
    reached = (
        p.study.base.groupBy(grids.level(F.col("k") / 100, THETAS).alias("_k"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.explode(F.slice(F.array(*[F.lit(t) for t in THETAS]), 1, F.col("_k"))).alias("theta"), "_n")
        .groupBy("theta")
        .agg(F.sum("_n").alias("rows_reached"))
    )
    return grid.join(reached, "theta", "left").select(
        "theta", F.coalesce("rows_reached", F.lit(0)).alias("rows_reached")
    )


@query(
    "p9_lead_grid",
    sql(
        f"""SELECT l.lead_minutes::BIGINT AS lead_minutes, count(t.us) AS rows_within
            FROM leads l CROSS JOIN aev e
            LEFT JOIN tl t ON t.asset_id = e.asset_id AND t.us <= e.start_us
                          AND t.us >= e.start_us - l.lead_minutes::BIGINT * {MINUTE_US}
            GROUP BY 1"""
    ),
)
def p9(p):
    """Lead times with the telemetry rows they cover before maintenance."""
    listed = p.study.events.select(
        F.col("asset_id").alias("_asset"),
        "start_us",
        F.explode(F.array(*[F.lit(v).cast("bigint") for v in LEADS])).alias("lead_minutes"),
    )
    inside = (F.col("asset_id") == F.col("_asset")) & F.col("us").between(
        F.col("start_us") - F.col("lead_minutes") * MINUTE_US, F.col("start_us")
    )
    counted = (
        p.study.base.join(listed, inside)
        .groupBy("lead_minutes")
        .agg(F.count(F.lit(1)).alias("rows_within"))
    )
    return (
        listed.select("lead_minutes")
        .distinct()
        .join(counted, "lead_minutes", "left")
        .select("lead_minutes", F.coalesce("rows_within", F.lit(0)).alias("rows_within"))
    )


@query(
    "p10_normalize_windows",
    sql(
        """SELECT asset_id, start_us, end_us, row_number() OVER (PARTITION BY asset_id
                  ORDER BY start_us, end_us) AS ordinal
           FROM (SELECT asset_id, ts::DATE AS d, min(us) FILTER (is_error = 0) AS start_us,
                        max(us) FILTER (is_error = 1) AS end_us FROM tl GROUP BY ALL)
           WHERE end_us >= start_us"""
    ),
)
def p10(p):
    daily = p.study.base.groupBy("asset_id", F.to_date("ts").alias("_d")).agg(
        F.min(F.when(F.col("is_error") == 0, F.col("us"))).alias("start_us"),
        F.max(F.when(F.col("is_error") == 1, F.col("us"))).alias("end_us"),
    )
    return tidy(normalize_windows(daily, ["asset_id"]).drop("_d"))
