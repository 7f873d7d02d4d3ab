"""Threshold and lead-time grids."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _decimal_grid(specification: str) -> tuple[Decimal, Decimal, int]:
    """First value, distance and number of values of a ``first:last:distance`` grid, exactly."""
    fields = str(specification).split(":")
    if len(fields) != 3:
        raise ValueError(f"a threshold grid has three fields, not {specification!r}")
    first, last, distance = (Decimal(field.strip()) for field in fields)
    if distance <= 0 or first > last:
        raise ValueError(f"a threshold grid ascends in positive steps, unlike {specification!r}")
    return first, distance, int((last - first) // distance) + 1


def theta_list(specification: str, extras: Sequence[float]) -> list[float]:
    """The grid's values and the extra ones, ascending and distinct."""
    first, distance, count = _decimal_grid(specification)
    return sorted({float(first + distance * i) for i in range(count)}.union(map(float, extras)))


def theta_grid(spark: SparkSession, specification: str, extras: Sequence[float]) -> DataFrame:
    """``theta_list`` as a table, made by Spark from whole steps."""
    first, distance, count = _decimal_grid(specification)
    exact = F.lit(first).cast("decimal(18,12)") + F.col("id") * F.lit(distance).cast("decimal(18,12)")
    extra = F.array(*[F.lit(float(x)) for x in extras]).cast("array<double>")
    return (
        spark.range(count)
        .agg(F.collect_set(exact.cast("double")).alias("stepped"))
        .select(F.explode(F.array_union("stepped", extra)).alias("theta"))
    )


def lead_times(sensitivity: Sequence[int] | None, step: int, horizon: int) -> list[int]:
    """Positive leads, from a list or every ``step`` minutes; the horizon is always the last one."""
    asked = range(step, horizon, step) if sensitivity is None else sensitivity
    return [*sorted({int(lead) for lead in asked if lead > 0} - {horizon}), horizon]


def level(value: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds a value reaches; null reaches none."""
    reached = sum((F.when(value >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    return reached.cast("int")
