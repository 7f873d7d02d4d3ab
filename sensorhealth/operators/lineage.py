"""Which model scores which cycle, and which rows it is fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import StudyParams
from .runs import run_segments

STATIC, PER_MAINTENANCE = "static", "per_maintenance"


def model_lineage(cycles: DataFrame, workflows: dict[str, str]) -> DataFrame:
    """Status and effective model cycle per workflow, asset and cycle.

    ``workflows`` maps workflow to strategy. Static workflows keep model 0; adaptive ones refit at
    trainable cycles and otherwise use the latest refitted model.
    """
    listed = F.explode(
        F.array(
            *[
                F.struct(F.lit(w).alias("workflow_id"), F.lit(s).alias("strategy"))
                for w, s in workflows.items()
            ]
        )
    ).alias("w")
    order = Window.partitionBy("workflow_id", "asset_id").orderBy("cycle_id")
    rows = cycles.select("asset_id", "cycle_id", "update_possible", listed).select(
        "w.workflow_id", "w.strategy", "asset_id", "cycle_id", "update_possible"
    )
    adaptive = F.col("strategy") == PER_MAINTENANCE
    latest = F.last(F.when(F.col("update_possible"), F.col("cycle_id")), True).over(order)
    return rows.select(
        "workflow_id",
        "asset_id",
        "cycle_id",
        F.when(F.col("cycle_id") == 0, "trained_initial")
        .when(~adaptive, "reused_static")
        .when(F.col("update_possible"), "refitted")
        .otherwise("alias_no_trainable_local_window")
        .alias("model_status"),
        F.when(adaptive, F.coalesce(latest, F.lit(0)))
        .otherwise(F.lit(0))
        .alias("effective_model_cycle"),
    )


def local_segments(timeline: DataFrame, length: int) -> DataFrame:
    """Contiguous pieces of every update interval with their number of complete windows."""
    runs = run_segments(
        timeline.filter("update_cycle IS NOT NULL"), ["asset_id", "update_cycle"], "us", "upd_run"
    )
    return runs.withColumnRenamed("update_cycle", "cycle_id").select(
        "asset_id",
        "cycle_id",
        F.col("upd_run").alias("run_us"),
        "start_us",
        "end_us",
        "row_count",
        F.greatest(F.lit(0), F.col("row_count") - (length - 1)).alias("windows"),
    )


def local_windows(cycles: DataFrame, segments: DataFrame) -> DataFrame:
    """Local segments and complete windows of every cycle after the first event."""
    totals = segments.groupBy("asset_id", "cycle_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("windows").alias("windows")
    )
    return (
        cycles.filter("cycle_id > 0")
        .join(totals, ["asset_id", "cycle_id"], "left")
        .select(
            "asset_id",
            "cycle_id",
            "update_possible",
            F.coalesce("segments", F.lit(0)).alias("segments"),
            F.coalesce("windows", F.lit(0)).alias("windows"),
        )
    )


def cycles_without_windows(cycles: DataFrame, segments: DataFrame) -> DataFrame:
    """Trainable cycles whose local rows hold no complete window: nothing can be refitted there."""
    return (
        local_windows(cycles, segments)
        .filter("update_possible AND windows < 1")
        .drop("update_possible")
    )


def refittable(cycles: DataFrame, segments: DataFrame) -> DataFrame:
    """Cycles where ``update_possible`` also requires a complete local window.

    One series with such a cycle is an input error; in a fleet the asset keeps its previous model
    and the cycle is reported by ``cycles_without_windows``.
    """
    found = local_windows(cycles, segments).select("asset_id", "cycle_id", "windows")
    return cycles.join(found, ["asset_id", "cycle_id"], "left").withColumn(
        "update_possible",
        F.col("update_possible") & ((F.col("cycle_id") == 0) | (F.col("windows") > 0)),
    ).drop("windows")


def split_segments(segments: DataFrame, params: StudyParams) -> DataFrame:
    """Train and validation windows of each usable local segment.

    Validation windows are taken from the end of the interval; inside the one segment that is cut,
    windows sharing rows with validation are left out. When nothing would remain for training, all
    windows train and validation is dropped. Update intervals are bounded in time, but their
    segments are still only ranked per cycle after rows have been reduced to segments.
    """
    embargo = params.sequence_length - 1 if params.validation_embargo else 0
    length = params.sequence_length
    cycle = Window.partitionBy("asset_id", "cycle_id")
    later = cycle.orderBy(F.col("start_us").desc()).rowsBetween(Window.unboundedPreceding, -1)
    usable = segments.filter("windows > 0").withColumn(
        "total_windows", F.sum("windows").over(cycle)
    )
    wanted = F.greatest(
        F.lit(1), F.floor(F.col("total_windows") * params.local_validation_fraction)
    )
    taken = F.greatest(
        F.lit(0), F.least(F.col("windows"), wanted - F.coalesce(F.sum("windows").over(later), F.lit(0)))
    )
    cut = (F.col("_validation") > 0) & (F.col("_validation") < F.col("windows"))
    start = F.col("windows") - F.col("_validation")
    held = F.when(cut, F.least(F.lit(embargo), start)).otherwise(0)
    planned = (
        usable.withColumn("requested_validation_windows", wanted)
        .withColumn("_validation", taken)
        .withColumn("_embargo", held)
        .withColumn("_train", F.col("windows") - F.col("_validation") - F.col("_embargo"))
        .withColumn("fallback", F.sum("_train").over(cycle) < 1)
    )
    fallback = F.col("fallback")
    train = F.when(fallback, F.col("windows")).otherwise(F.col("_train"))
    validation = F.when(fallback, F.lit(0)).otherwise(F.col("_validation"))
    unused = F.when(
        cut & ~fallback,
        start - F.when(F.col("_train") > 0, F.col("_train") + (length - 1)).otherwise(0),
    ).otherwise(0)
    train_rows = (
        F.when(validation == 0, F.col("row_count"))
        .when(train > 0, train + (length - 1))
        .otherwise(0)
    )
    return planned.select(
        "asset_id",
        "cycle_id",
        "run_us",
        "start_us",
        "row_count",
        "windows",
        "total_windows",
        "requested_validation_windows",
        train.cast("bigint").alias("train_windows"),
        validation.cast("bigint").alias("validation_windows"),
        F.when(fallback, 0).otherwise(F.col("_embargo")).cast("bigint").alias("embargo_windows"),
        unused.cast("bigint").alias("unused_rows"),
        train_rows.cast("bigint").alias("train_rows"),
        F.when(validation > 0, F.col("row_count") - validation - (length - 1))
        .cast("bigint")
        .alias("validation_from_row"),
        "fallback",
    )


def baseline_windows(timeline: DataFrame, length: int) -> DataFrame:
    """Complete windows of the baseline training rows per asset."""
    return timeline.groupBy("asset_id").agg(
        F.count_if(F.col("baseline_train") & (F.col("base_pos") >= length)).alias(
            "baseline_total_windows"
        )
    )


def replay_size(local_windows, params: StudyParams):
    """Requested baseline windows for a local training set (rounded half to even)."""
    fraction = params.replay_fraction
    if fraction <= 0:
        return F.lit(0).cast("bigint")
    return F.rint(local_windows * fraction / (1.0 - fraction)).cast("bigint")


def split_policy(
    segments: DataFrame, split: DataFrame, baseline: DataFrame, params: StudyParams
) -> DataFrame:
    """One record per cycle describing its local split and replay."""
    keys = ["asset_id", "cycle_id"]
    every = segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("local_segment_count"),
        F.sum("row_count").alias("local_total_rows"),
    )
    embargo = params.sequence_length - 1 if params.validation_embargo else 0
    used = split.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("usable_local_segment_count"),
        F.count_if(F.col("train_windows") > 0).alias("local_train_segment_count"),
        F.count_if(F.col("validation_windows") > 0).alias("local_validation_segment_count"),
        F.max("total_windows").alias("local_total_windows"),
        F.sum("train_windows").alias("local_train_windows"),
        F.sum("validation_windows").alias("local_validation_windows"),
        F.max("requested_validation_windows").alias("requested_validation_windows"),
        F.sum("embargo_windows").alias("applied_embargo_windows"),
        F.sum("unused_rows").alias("unused_boundary_rows"),
        F.bool_or("fallback").alias("short_local_fallback_applied"),
    )
    strategy = (
        F.when(F.col("short_local_fallback_applied"), "disabled_short_local_fallback")
        .when(
            F.col("usable_local_segment_count") == 1, "chronological_non_overlapping_local"
        )
        .otherwise("chronological_non_overlapping_local_segments")
    )
    return (
        every.join(used, keys)
        .join(baseline, "asset_id")
        .withColumn("requested_embargo_windows", F.lit(embargo).cast("bigint"))
        .withColumn("validation_strategy", strategy)
        .withColumn(
            "baseline_replay_windows",
            F.least(
                F.col("baseline_total_windows"), replay_size(F.col("local_train_windows"), params)
            ),
        )
    )


def is_even_pick(position, total, count):
    """Whether 0-based ``position`` is one of ``floor((i + 0.5) * total / count)``, i < count.

    Only the pick nearest to a position can hit it, so the test is local to the row; its two
    neighbours are checked as well to absorb rounding.
    """
    near = F.ceil(position * count / total - 0.5)
    hits = [
        (near + d >= 0)
        & (near + d < count)
        & (F.floor((near + d + F.lit(0.5)) * total / count) == position)
        for d in (-1, 0, 1)
    ]
    return F.when(count >= total, F.lit(True)).otherwise(
        (count > 0) & (hits[0] | hits[1] | hits[2])
    )


def picks_before(position, total, count):
    """How many of the ``is_even_pick`` positions are smaller than ``position``.

    ``floor((i + 0.5) * total / count) < position`` holds for the ``i`` below
    ``position * count / total - 0.5``.
    """
    below = F.ceil(position * count / total - 0.5)
    return F.when(count >= total, position).otherwise(F.greatest(F.lit(0), F.least(below, count)))


def replay_windows(windows: DataFrame, policy: DataFrame) -> DataFrame:
    """Evenly spread baseline windows per cycle.

    ``windows`` numbers the baseline training windows of an asset (``window_no``, 0-based).
    """
    wanted = policy.select(
        "asset_id", "cycle_id", "baseline_total_windows", "baseline_replay_windows"
    )
    return (
        windows.join(wanted, "asset_id")
        .filter(
            is_even_pick(
                F.col("window_no"),
                F.col("baseline_total_windows"),
                F.col("baseline_replay_windows"),
            )
        )
        .select("asset_id", "cycle_id", "us", "window_no")
    )


def training_mix(timeline: DataFrame, split: DataFrame, replay: DataFrame) -> DataFrame:
    """Training windows of every refitted cycle: replayed baseline windows and local windows."""
    local = (
        timeline.filter("update_cycle IS NOT NULL")
        .select("asset_id", F.col("update_cycle").alias("cycle_id"), F.col("upd_run").alias("run_us"), "us", "upd_pos")
        .join(
            split.select("asset_id", "cycle_id", "run_us", "train_windows", "row_count", "windows"),
            ["asset_id", "cycle_id", "run_us"],
        )
        .filter(
            (F.col("upd_pos") > F.col("row_count") - F.col("windows"))
            & (F.col("upd_pos") <= F.col("row_count") - F.col("windows") + F.col("train_windows"))
        )
        .select("asset_id", "cycle_id", "us", F.lit("local").alias("origin"))
    )
    return replay.select("asset_id", "cycle_id", "us", F.lit("baseline").alias("origin")).unionByName(
        local
    )
