"""Table and record sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null

PREDICTION_PARTITIONS = ("workflow_id", "cycle_id")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions by workflow and cycle, so that one cycle can be read or replaced alone.

    Rows are spread by asset and day as well, which bounds the files of a hot workflow.
    """
    day = F.floor(F.col("us") / F.lit(86_400_000_000))
    (
        predictions.repartition(*PREDICTION_PARTITIONS, "asset_id", day)
        .write.partitionBy(*PREDICTION_PARTITIONS)
        .mode("overwrite")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the columns asked for are read from the files."""
    return spark.read.parquet(path).select(*columns)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def write_json(records: DataFrame, path: str) -> None:
    """Records as JSON lines; non-finite numbers become null."""
    safe = [
        finite_or_null(F.col(f.name)).alias(f.name)
        if f.dataType.simpleString() in ("double", "float")
        else F.col(f.name)
        for f in records.schema
    ]
    records.select(*safe).write.mode("overwrite").option("ignoreNullFields", False).json(path)
