"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import MINUTE_US


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def clip_unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def minutes_between(start: Column, end: Column) -> Column:
    return (end - start) / F.lit(float(MINUTE_US))


def share(part: Column, whole: Column, undefined: float | None) -> Column:
    """``part / whole``; an empty whole gives ``undefined`` (0.0 or null, by metric)."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(undefined).cast("double"))


def base_feature(name: Column) -> Column:
    """Channel part of an engineered feature name."""
    return F.substring_index(name, "__", 1)


def aggregation_of(name: Column) -> Column:
    return F.substring_index(name, "__", -1)


def f1(precision: Column, recall: Column) -> Column:
    return share(2.0 * precision * recall, precision + recall, 0.0)
