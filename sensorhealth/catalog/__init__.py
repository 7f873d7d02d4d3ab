"""Registered queries with their DuckDB counterparts, by inventory item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.prepared import Prepared, prepared


class Compared(Prepared):
    """Scores with few digits, so that another engine's sums give the same ranks."""

    row_digits, score_digits = 4, 6


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(prepared) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Prepared], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(prepared(spark, directory, Compared))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, integers as bigint."""
    out = []
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind in ("double", "float"):
            out.append(F.round(F.col(field.name).cast("double"), digits).alias(field.name))
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            out.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def load() -> None:
    from . import assembly, candidates, detectors, events, features, risk, sources, timeline  # noqa: F401
