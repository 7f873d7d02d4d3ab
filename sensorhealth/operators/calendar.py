"""Maintenance calendar: disjoint labelled intervals per asset and their interval joins.

Every interval table here is disjoint per asset, so a left interval join keeps one row per
timeline row and needs no aggregation afterwards. Intervals are listed once for every time bucket
they touch, and rows meet those of their own bucket: the join key is (asset, bucket), so neither an
asset with many events nor one with many rows is compared as a whole. Disjoint intervals touch at
most as many buckets as their span holds, and one more each. The planner broadcasts the intervals
only below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAY_US, MINUTE_US, StudyParams
from .slices import floor_div

NORMAL, PRE_MAINTENANCE, MAINTENANCE = 0, 1, 2


def buckets(start: Column, end: Column, width: int) -> Column:
    """Every time bucket that ``[start, end]`` touches; none for a null or empty interval."""
    touched = F.sequence(floor_div(start, width), floor_div(end, width))
    return F.explode(F.when(start <= end, touched))


def interval_join(
    rows: DataFrame, intervals: DataFrame, columns: list[str], how: str = "left", width: int = DAY_US
) -> DataFrame:
    """Attach ``columns`` of the interval ``[from_us, to_us]`` of the same asset holding ``us``."""
    right = intervals.select(
        F.col("asset_id").alias("_asset"),
        "from_us",
        "to_us",
        *columns,
        buckets(F.col("from_us"), F.col("to_us"), width).alias("_touched"),
    )
    left = rows.withColumn("_bucket", floor_div(F.col("us"), width))
    condition = (
        (F.col("asset_id") == F.col("_asset"))
        & (F.col("_bucket") == F.col("_touched"))
        & F.col("us").between(F.col("from_us"), F.col("to_us"))
    )
    return left.join(right, condition, how).drop("_asset", "from_us", "to_us", "_bucket", "_touched")


def phase_intervals(events: DataFrame, pre_minutes: int) -> DataFrame:
    """Disjoint pre-maintenance and maintenance intervals; maintenance wins over warning time."""
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us")
    free = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1
    pieces = events.select(
        "asset_id",
        F.col("start_us"),
        F.col("end_us"),
        F.coalesce(free, F.col("start_us") - pre_minutes * MINUTE_US).alias("free_us"),
    ).select(
        "asset_id",
        F.explode(
            F.array(
                F.struct(
                    F.greatest(F.col("start_us") - pre_minutes * MINUTE_US, "free_us").alias("from_us"),
                    (F.col("start_us") - 1).alias("to_us"),
                    F.lit(PRE_MAINTENANCE).alias("phase"),
                ),
                F.struct(
                    F.greatest("start_us", "free_us").alias("from_us"),
                    F.col("end_us").alias("to_us"),
                    F.lit(MAINTENANCE).alias("phase"),
                ),
            )
        ).alias("p"),
    )
    return pieces.select("asset_id", "p.*").filter("from_us <= to_us")


def with_phase(
    rows: DataFrame, events: DataFrame, pre_minutes: int, width: int = DAY_US
) -> DataFrame:
    joined = interval_join(rows, phase_intervals(events, pre_minutes), ["phase"], width=width)
    return joined.withColumn("phase", F.coalesce("phase", F.lit(NORMAL)))


def update_windows(events: DataFrame, stats: DataFrame, post_train_minutes: int) -> DataFrame:
    """Per event: gap to the next event (or data end) and the requested update interval."""
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us")
    return (
        events.join(stats.select("asset_id", "data_end_us"), "asset_id")
        .select(
            "asset_id",
            "event_id",
            F.row_number().over(order).cast("int").alias("cycle_id"),
            "start_us",
            F.col("end_us").alias("gap_start_us"),
            F.coalesce(F.lead("start_us").over(order), F.col("data_end_us")).alias("gap_end_us"),
        )
        .withColumn(
            "update_end_us",
            F.least(F.col("gap_start_us") + post_train_minutes * MINUTE_US, F.col("gap_end_us")),
        )
    )


def cycle_plan(
    rows: DataFrame, events: DataFrame, stats: DataFrame, params: StudyParams, width: int = DAY_US
) -> DataFrame:
    """One row per asset and cycle; cycle 0 precedes the first event.

    ``rows`` is the timeline (``asset_id, us``). A cycle is trainable iff its update interval ends
    before the gap does and holds at least one complete sequence; otherwise it uses the model of
    the latest trainable cycle.
    """
    windows = update_windows(events, stats, params.post_train_minutes)
    intervals = windows.select(
        "asset_id",
        "cycle_id",
        (F.col("gap_start_us") + 1).alias("from_us"),
        F.col("update_end_us").alias("to_us"),
    )
    counts = (
        interval_join(rows.select("asset_id", "us"), intervals, ["cycle_id"], "inner", width)
        .groupBy("asset_id", "cycle_id")
        .agg(F.count(F.lit(1)).alias("update_rows"))
    )
    order = Window.partitionBy("asset_id").orderBy("cycle_id")
    possible = (F.col("gap_end_us") > F.col("update_end_us")) & (
        F.col("update_rows") >= params.sequence_length
    )
    later = (
        windows.join(counts, ["asset_id", "cycle_id"], "left")
        .withColumn("update_rows", F.coalesce("update_rows", F.lit(0)))
        .withColumn("update_possible", possible)
        .withColumn("_latest", F.last(F.when(F.col("update_possible"), F.col("cycle_id")), True).over(order))
        .select(
            "asset_id",
            "cycle_id",
            F.col("event_id").alias("source_event_id"),
            F.when(F.col("update_possible"), F.col("gap_start_us")).alias("update_start_us"),
            F.when(F.col("update_possible"), F.col("update_end_us")).alias("update_end_us"),
            F.when(F.col("update_possible"), F.col("update_end_us"))
            .otherwise(F.col("gap_start_us"))
            .alias("score_start_us"),
            F.col("gap_end_us").alias("score_end_us"),
            "update_possible",
            F.when(~F.col("update_possible"), F.coalesce("_latest", F.lit(0))).alias("alias_to_cycle"),
            "update_rows",
        )
    )
    first = (
        events.groupBy("asset_id")
        .agg(F.min("start_us").alias("score_end_us"))
        .join(stats.select("asset_id", "data_start_us"), "asset_id")
        .select(
            "asset_id",
            F.lit(0).alias("cycle_id"),
            F.lit("before_first").alias("source_event_id"),
            F.lit(None).cast("bigint").alias("update_start_us"),
            F.lit(None).cast("bigint").alias("update_end_us"),
            F.col("data_start_us").alias("score_start_us"),
            "score_end_us",
            F.lit(True).alias("update_possible"),
            F.lit(None).cast("int").alias("alias_to_cycle"),
            F.lit(0).cast("bigint").alias("update_rows"),
        )
    )
    return first.unionByName(later)


def update_intervals(cycles: DataFrame) -> DataFrame:
    return cycles.filter("update_start_us IS NOT NULL").select(
        "asset_id",
        F.col("cycle_id").alias("update_cycle"),
        (F.col("update_start_us") + 1).alias("from_us"),
        F.col("update_end_us").alias("to_us"),
    )


def score_intervals(cycles: DataFrame, baseline_end: DataFrame) -> DataFrame:
    """Scoring interval per cycle: open at its start, open at its end but for the last cycle.

    Cycle 0 starts after the last baseline row (``baseline_end_us`` per asset).
    """
    last = F.max("cycle_id").over(Window.partitionBy("asset_id"))
    start = F.when(F.col("cycle_id") == 0, F.col("baseline_end_us")).otherwise(
        F.col("score_start_us")
    )
    return (
        cycles.withColumn("_last", last)
        .join(baseline_end, "asset_id", "left")
        .select(
            "asset_id",
            "cycle_id",
            (start + 1).alias("from_us"),
            F.when(F.col("cycle_id") == F.col("_last"), F.col("score_end_us"))
            .otherwise(F.col("score_end_us") - 1)
            .alias("to_us"),
        )
        .filter("from_us <= to_us")
    )
