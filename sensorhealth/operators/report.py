"""Tables behind the study's reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import MINUTE_US
from .slices import counted, floor_div

BUCKET_US = 30 * MINUTE_US


def bucketed_timeline(alarms: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Mean risk and alarm flag per 30-minute bucket, with empty buckets kept.

    The spine is generated per asset from its first and last bucket. A column ``weight`` counts a row
    several times.
    """
    risk, weight = F.col("maintenance_risk"), counted(alarms)
    known = F.sum(F.when(risk.isNotNull(), weight))
    keys = ["workflow_id", "asset_id"]
    bucket = (floor_div(F.col("us"), bucket_us) * bucket_us).alias("bucket_us")
    filled = alarms.groupBy(*keys, bucket).agg(
        (F.sum(risk * weight) / known).alias("mean_risk"), F.max("alarm").alias("alarm")
    )
    spine = (
        alarms.groupBy(*keys)
        .agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
        .select(
            *keys,
            F.explode(
                F.sequence(
                    floor_div(F.col("_first"), bucket_us) * bucket_us,
                    floor_div(F.col("_last"), bucket_us) * bucket_us,
                    F.lit(bucket_us),
                )
            ).alias("bucket_us"),
        )
    )
    return spine.join(filled, [*keys, "bucket_us"], "left").select(
        *keys, "bucket_us", "mean_risk", F.coalesce("alarm", F.lit(False)).alias("alarm")
    )


def tradeoff_table(sweep: DataFrame, selected: DataFrame) -> DataFrame:
    """Coverage against recall and F1 per threshold, the selected one marked."""
    chosen = selected.select("workflow_id", F.col("maintenance_risk_theta").alias("_theta"))
    return sweep.join(chosen, "workflow_id").select(
        "workflow_id",
        "maintenance_risk_theta",
        "coverage_percent",
        "recall",
        "f1",
        (F.abs(F.col("maintenance_risk_theta") - F.col("_theta")) < 1e-9).alias("selected"),
    )


def comparison_chart(comparison: DataFrame) -> DataFrame:
    """Bars of the comparison chart; undefined detection time and false-alarm rate draw as 0."""
    return comparison.select(
        "position",
        F.regexp_replace("workflow_id", "_", " ").alias("label"),
        "precision",
        "recall",
        "f1",
        "coverage_percent",
        F.coalesce("ttd_minutes", F.lit(0.0)).alias("ttd_minutes"),
        F.coalesce("far_per_day", F.lit(0.0)).alias("far_per_day"),
    )
