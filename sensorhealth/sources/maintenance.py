"""Maintenance-event source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Maintenance windows of the driver tables (start, end, id, severity).
FLEET_WINDOWS = (
    ("2024-01-13 06:00:00", "2024-01-13 12:00:00", "#1", "high"),
    ("2024-01-15 00:00:00", "2024-01-15 12:00:00", "#2", "high"),
    ("2024-01-15 13:00:00", "2024-01-15 18:00:00", "#3", "high"),
    ("2024-01-19 09:00:00", "2024-01-19 21:00:00", "#4", "high"),
    ("2024-01-24 00:00:00", "2024-01-24 08:00:00", "#5", "high"),
    ("2024-01-27 15:00:00", "2024-01-27 20:00:00", "#6", "high"),
)

# Default maintenance windows of the compressor study.
COMPRESSOR_WINDOWS = (
    ("2020-04-12 11:50:00", "2020-04-12 23:30:00", "#1", "high"),
    ("2020-04-18 00:00:00", "2020-04-18 23:59:00", "#2", "high"),
    ("2020-04-19 00:00:00", "2020-04-19 01:30:00", "#3", "high"),
    ("2020-04-29 03:20:00", "2020-04-29 04:00:00", "#4", "high"),
    ("2020-04-29 22:00:00", "2020-04-29 22:20:00", "#5", "high"),
    ("2020-05-13 14:00:00", "2020-05-13 23:59:00", "#6", "high"),
    ("2020-05-18 05:00:00", "2020-05-18 05:30:00", "#7", "high"),
    ("2020-05-19 10:10:00", "2020-05-19 11:00:00", "#8", "high"),
    ("2020-05-19 22:10:00", "2020-05-19 23:59:00", "#9", "high"),
    ("2020-05-20 00:00:00", "2020-05-20 20:00:00", "#10", "high"),
    ("2020-05-23 09:50:00", "2020-05-23 10:10:00", "#11", "high"),
    ("2020-05-29 23:30:00", "2020-05-29 23:59:00", "#12", "high"),
    ("2020-05-30 00:00:00", "2020-05-30 06:00:00", "#13", "high"),
    ("2020-06-01 15:00:00", "2020-06-01 15:40:00", "#14", "high"),
    ("2020-06-03 10:00:00", "2020-06-03 11:00:00", "#15", "high"),
    ("2020-06-05 10:00:00", "2020-06-05 23:59:00", "#16", "high"),
    ("2020-06-06 00:00:00", "2020-06-06 23:59:00", "#17", "high"),
    ("2020-06-07 00:00:00", "2020-06-07 14:30:00", "#18", "high"),
    ("2020-07-08 17:30:00", "2020-07-08 19:00:00", "#19", "high"),
    ("2020-07-15 14:30:00", "2020-07-15 19:00:00", "#20", "medium"),
    ("2020-07-17 04:30:00", "2020-07-17 05:30:00", "#21", "high"),
)


def typed_events(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Configuration rows as a typed table, in the given order (``position``)."""
    if not rows:
        raise ValueError("at least one maintenance event is required")
    raw = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows, start=1)],
        "position int, start string, end string, event_id string, severity string",
    )
    return raw.select(
        "position",
        "event_id",
        F.col("start").cast("timestamp_ntz").alias("start_ts"),
        F.col("end").cast("timestamp_ntz").alias("end_ts"),
        F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"),
        F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"),
        "severity",
    )


def every_asset(assets: DataFrame, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """The shared schedule repeated for each asset of ``assets`` (a literal, not a join)."""
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(event_id).alias("event_id"),
            F.lit(start).cast("timestamp_ntz").alias("start_ts"),
            F.lit(end).cast("timestamp_ntz").alias("end_ts"),
            F.unix_micros(F.lit(start).cast("timestamp")).alias("start_us"),
            F.unix_micros(F.lit(end).cast("timestamp")).alias("end_us"),
            F.lit(severity).alias("severity"),
        )
        for i, (start, end, event_id, severity) in enumerate(rows, start=1)
    ]
    return assets.select("asset_id", F.explode(F.array(*entries)).alias("e")).select(
        "asset_id", "e.*"
    )


SCHEDULE = ("asset_id", "start", "end", "event_id", "severity")


def table_events(schedule: DataFrame) -> DataFrame:
    """A schedule table, one row per asset and event, as a typed table.

    ``start`` and ``end`` are timestamps or texts that read as timestamps; others become null and
    are reported by ``schedule_problems``. The stated order is a column ``position`` or, without
    one, by start and end.
    """
    missing = [c for c in SCHEDULE if c not in schedule.columns]
    if missing:
        raise ValueError(f"the schedule table lacks {missing}")
    told = schedule.select(
        "asset_id",
        *(["position"] if "position" in schedule.columns else []),
        "event_id",
        F.col("start").try_cast("timestamp_ntz").alias("start_ts"),
        F.col("end").try_cast("timestamp_ntz").alias("end_ts"),
        F.unix_micros(F.col("start").try_cast("timestamp")).alias("start_us"),
        F.unix_micros(F.col("end").try_cast("timestamp")).alias("end_us"),
        "severity",
    )
    if "position" in schedule.columns:
        return told
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us", "event_id")
    return told.withColumn("position", F.row_number().over(order))


def schedule_problems(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events that start before their predecessor (of the same key) or end before they start.

    Without ``keys`` the events are configuration rows of one schedule.
    """
    order = Window.partitionBy(*keys).orderBy("position") if keys else Window.orderBy("position")
    return events.select(
        *keys,
        "event_id",
        F.coalesce(F.col("end_us") < F.col("start_us"), F.lit(True)).alias("ends_before_start"),
        F.coalesce(F.lag("start_us").over(order) > F.col("start_us"), F.lit(False)).alias(
            "out_of_order"
        ),
    ).filter("ends_before_start OR out_of_order")


def check_schedule(rows: Sequence[tuple[str, str, str, str]]) -> None:
    """Refuse a configured schedule that is empty, out of order or has an event that ends before it starts."""
    if not rows:
        raise ValueError("at least one maintenance event is required")
    times = [(datetime.fromisoformat(start), datetime.fromisoformat(end)) for start, end, *_ in rows]
    for i, (start, end) in enumerate(times):
        if end < start or i and start < times[i - 1][0]:
            raise ValueError(f"invalid maintenance schedule: {rows[i]}")


def build_events(spark: SparkSession, rows: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Typed and validated event table; events are configuration, so the check is driver-sized."""
    events = typed_events(spark, rows)
    problems = schedule_problems(events).take(1)
    if problems:
        raise ValueError(f"invalid maintenance schedule: {problems[0].asDict()}")
    return events


def normalize_windows(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events that do not end before they start, numbered by (start, end) within a key."""
    by_start = Window.partitionBy(*keys).orderBy("start_us", "end_us")
    return events.filter("end_us >= start_us").withColumn(
        "ordinal", F.row_number().over(by_start).cast("int")
    )
