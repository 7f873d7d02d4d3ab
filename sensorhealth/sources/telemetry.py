"""Telemetry scans: column resolution, coercion and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Timestamp column names tried in this order.
TIMESTAMP_CANDIDATES = ("timestamp", "Timestamp", "time", "Time", "datetime", "date", "Date")

# Compressor channels and the ones that only take 0 and 1.
COMPRESSOR_CHANNELS = (
    "TP2",
    "TP3",
    "H1",
    "DV_pressure",
    "Reservoirs",
    "Motor_current",
    "Oil_temperature",
    "Caudal_impulses",
    "COMP",
    "DV_eletric",
    "Towers",
    "MPG",
    "LPS",
    "Pressure_switch",
    "Oil_level",
)
COMPRESSOR_BINARY = (
    "COMP",
    "DV_eletric",
    "Towers",
    "MPG",
    "LPS",
    "Pressure_switch",
    "Oil_level",
    "Caudal_impulses",
)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with header, every column read as text so that coercion decides what is missing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def drop_stray_index(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().startswith("unnamed")])


def resolve_timestamp(df: DataFrame, configured: str | None = None) -> DataFrame:
    """Rename the configured column, or the first known candidate, to ``timestamp``."""
    if configured:
        if configured not in df.columns:
            raise ValueError(f"configured timestamp column {configured!r} is missing")
        return df.withColumnRenamed(configured, "timestamp")
    for candidate in TIMESTAMP_CANDIDATES:
        if candidate in df.columns:
            return df.withColumnRenamed(candidate, "timestamp")
    raise ValueError("no timestamp column found; name it in the configuration")


def coerce_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Parse timestamps and drop rows whose timestamp cannot be read."""
    parsed = F.expr(f"try_cast(`{column}` AS TIMESTAMP_NTZ)")
    return df.withColumn(column, parsed).filter(F.col(column).isNotNull())


def micros(column: str):
    """Epoch microseconds of a zone-free timestamp, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def require_channels(df: DataFrame, channels: Sequence[str]) -> None:
    missing = [c for c in channels if c not in df.columns]
    if missing:
        raise ValueError(f"input is missing required channels: {missing}")


def number(expression: str) -> Column:
    """Double, or null where the text is no number or reads as NaN."""
    value = F.expr(f"try_cast({expression} AS DOUBLE)")
    return F.when(~F.isnan(value), value)


def coerce_channels(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Numeric coercion; unreadable values become missing."""
    require_channels(df, channels)
    return df.select(
        *[
            number(f"`{c}`").alias(c) if c in channels else F.col(c)
            for c in df.columns
        ]
    )


def observation_counts(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Numeric observations per channel; all zero means the input must be rejected."""
    return df.agg(*[F.count(c).alias(c) for c in channels])


def require_observations(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    if not any(observation_counts(df, channels).first()):
        raise ValueError("the input holds no numeric observation")
    return df


def duplicate_timestamps(df: DataFrame, keys: Sequence[str], us: str) -> DataFrame:
    return (
        df.groupBy(*keys, us).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")
    )


def load_telemetry(
    df: DataFrame,
    channels: Sequence[str],
    *,
    timestamp_column: str | None = None,
    asset_column: str | None = None,
) -> DataFrame:
    """Raw frame to ``asset_id, ts, us, <channels>``."""
    named = resolve_timestamp(drop_stray_index(df), timestamp_column)
    require_channels(named, channels)
    typed = coerce_channels(coerce_timestamp(named), channels)
    asset = F.col(asset_column) if asset_column else F.lit(0)
    return typed.select(
        asset.cast("bigint").alias("asset_id"),
        F.col("timestamp").alias("ts"),
        micros("timestamp").alias("us"),
        *channels,
    )


def sensor_adapter(events: DataFrame) -> DataFrame:
    """Driver ``events`` table as fleet telemetry: two continuous channels and one binary."""
    return events.select(
        (F.col("user_id") % 8).alias("asset_id"),
        "ts",
        micros("ts").alias("us"),
        number("value").alias("value"),
        number("get_json_object(props, '$.k')").alias("k"),
        (F.col("event_type") == "error").cast("double").alias("is_error"),
    )


SENSOR_CHANNELS = ("value", "k", "is_error")
SENSOR_BINARY = ("is_error",)
