"""Row populations of one study, kept as columns of a single timeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MINUTE_US, StudyParams
from ..session import materialize
from .calendar import MAINTENANCE, interval_join, score_intervals, update_intervals, with_phase
from .runs import is_anchor, label_runs
from .slices import floor_div


def series_stats(base: DataFrame) -> DataFrame:
    return base.groupBy("asset_id").agg(
        F.min("us").alias("data_start_us"),
        F.max("us").alias("data_end_us"),
        F.count(F.lit(1)).alias("row_count"),
    )


def in_baseline(params: StudyParams) -> Column:
    """Rows of the initial interval in a training phase; needs ``data_start_us`` and ``phase``."""
    end = F.col("data_start_us") + params.baseline_minutes * MINUTE_US
    return (F.col("us") <= end) & F.col("phase").isin(*params.train_phases)


def split_points(baseline_rows: Column, params: StudyParams) -> tuple[Column, Column]:
    """Row counts where training stops and validation starts (embargo of L - 1 rows between)."""
    length = params.sequence_length
    validation = F.greatest(
        F.lit(length), F.rint(baseline_rows * params.validation_fraction).cast("bigint")
    )
    start = baseline_rows - validation
    return start - (length - 1), start


def split_problems(baseline: DataFrame, params: StudyParams) -> DataFrame:
    """Assets whose baseline is too short; ``baseline`` has ``asset_id, baseline_rows``."""
    stop, _ = split_points(F.col("baseline_rows"), params)
    length = params.sequence_length
    return (
        baseline.withColumn("train_rows", stop)
        .withColumn("too_short", F.col("baseline_rows") < 2 * length)
        .filter((F.col("baseline_rows") < 2 * length) | (F.col("train_rows") < length))
    )


def label_populations(
    base: DataFrame,
    events: DataFrame,
    stats: DataFrame,
    cycles: DataFrame,
    params: StudyParams,
    slice_us: int,
    channels: Sequence[str] = (),
) -> DataFrame:
    """Timeline with phase, populations, runs, anchors and the scoring cycle of every row.

    ``stats`` needs ``data_start_us`` and ``gap_us`` per asset.
    """
    rows = base.select(
        "asset_id", "ts", "us", *channels, floor_div(F.col("us"), slice_us).alias("slice")
    ).join(stats.select("asset_id", "data_start_us", "gap_us"), "asset_id")
    phased = with_phase(rows, events, params.pre_maintenance_minutes, slice_us).withColumn(
        "baseline", in_baseline(params)
    )
    baseline = materialize(
        phased.filter("baseline")
        .groupBy("asset_id")
        .agg(F.count(F.lit(1)).alias("baseline_rows"), F.max("us").alias("baseline_end_us")),
        "baseline",
    )
    # Without any baseline row cycle 0 has no start, as a null start matches no row.
    intervals = score_intervals(cycles, baseline.select("asset_id", "baseline_end_us"))
    flagged = interval_join(phased, update_intervals(cycles), ["update_cycle"], width=slice_us)
    flagged = interval_join(flagged, intervals, ["cycle_id"], width=slice_us)
    post_train = F.col("update_cycle").isNotNull()
    evaluation_row = (
        ~F.col("baseline")
        & ~post_train
        & (F.col("phase") != MAINTENANCE)
        & F.col("phase").isin(*params.test_phases)
    )
    flagged = flagged.select(
        "*",
        post_train.alias("post_train"),
        evaluation_row.alias("evaluation_row"),
        F.when(F.col("baseline"), F.lit(0)).alias("_baseline"),
        F.when(evaluation_row, F.lit(0)).alias("_evaluation"),
        F.when(evaluation_row, F.col("cycle_id")).alias("_source"),
        F.when(F.col("phase").isin(*params.train_phases), F.col("update_cycle")).alias("_local"),
    )
    labelled = label_runs(
        flagged,
        ["asset_id"],
        "us",
        "slice",
        {"base": "_baseline", "eval": "_evaluation", "src": "_source", "upd": "_local"},
    ).join(baseline.drop("baseline_end_us"), "asset_id", "left")
    stop, start = split_points(F.col("baseline_rows"), params)
    length, stride = params.sequence_length, params.stride
    return labelled.select(
        "asset_id",
        "ts",
        "us",
        "slice",
        *channels,
        "gap_us",
        "phase",
        "baseline",
        F.coalesce(F.col("base_ord") <= stop, F.lit(False)).alias("baseline_train"),
        F.coalesce(F.col("base_ord") > start, F.lit(False)).alias("baseline_validation"),
        "post_train",
        "evaluation_row",
        F.col("_source").alias("cycle_id"),
        F.col("_local").alias("update_cycle"),
        "base_run",
        "base_pos",
        "base_ord",
        "eval_run",
        "eval_pos",
        "src_run",
        "src_pos",
        "upd_run",
        "upd_pos",
        is_anchor(F.col("base_pos"), length, stride).alias("calibration"),
        is_anchor(F.col("eval_pos"), length, stride).alias("evaluation"),
    )


def partition_violations(timeline: DataFrame) -> DataFrame:
    """Evaluation anchors outside every cycle, and rows that two cycles claim."""
    uncovered = timeline.filter("evaluation AND cycle_id IS NULL").select(
        "asset_id", "us", F.lit("uncovered").alias("problem")
    )
    repeated = (
        timeline.filter("evaluation AND cycle_id IS NOT NULL")
        .groupBy("asset_id", "us")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("asset_id", "us", F.lit("overlap").alias("problem"))
    )
    return uncovered.unionByName(repeated)
