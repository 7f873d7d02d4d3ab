"""Bounded pieces of long series.

One asset may own a third of all rows, so no operator here opens a window over a whole asset.
A series is cut into time slices; windows run inside ``(keys, slice)`` and what has to cross a
slice border is carried: each slice is reduced to a few numbers, the numbers of earlier slices are
combined per key (one row per slice), and the result is joined back on ``(keys, slice)``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DAY_US, HOUR_US


def floor_div(value: Column, width: int) -> Column:
    """Exact integer floor division, also before the epoch."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("bigint")


def counted(rows: DataFrame) -> Column:
    """How often a row counts: its ``weight``, or once in a table without that column."""
    return F.col("weight") if "weight" in rows.columns else F.lit(1).cast("bigint")


def slice_width(busiest: int, target_rows: int, cap: int = DAY_US) -> int:
    """Widest slice, at most ``cap``, that holds about ``target_rows`` in a densest hour of ``busiest`` rows."""
    return int(max(1, min(cap, HOUR_US * target_rows // max(1, busiest))))


def carried(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    summary: Mapping[str, Column],
    carry: Mapping[str, Callable],
) -> DataFrame:
    """One row per slice with values combined from the other slices of the same key.

    ``carry`` maps an output name to ``fn(by_slice, earlier)`` where ``by_slice`` is the window
    over the slices of a key and ``earlier`` its frame of strictly earlier slices.
    """
    per_slice = df.groupBy(*keys, slice_col).agg(*[c.alias(n) for n, c in summary.items()])
    by_slice = Window.partitionBy(*keys).orderBy(slice_col)
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *keys, slice_col, *[fn(by_slice, earlier).alias(n) for n, fn in carry.items()]
    )


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    slice_col: str,
    columns: Mapping[str, str],
    *,
    following: bool = False,
) -> DataFrame:
    """``lag`` (or ``lead``) by one row over the whole series; ``columns`` is source -> output."""
    local = Window.partitionBy(*keys, slice_col).orderBy(us)
    edge = F.min_by if following else F.max_by
    step = F.lead if following else F.lag
    # `_seen` tells a null neighbour value from a missing neighbour row inside the slice.
    border = carried(
        df,
        keys,
        slice_col,
        {f"_{o}": edge(c, us) for c, o in columns.items()},
        {f"_{o}": (lambda w, e, o=o: step(f"_{o}").over(w)) for o in columns.values()},
    )
    inside = df.select(
        "*",
        step(us).over(local).isNotNull().alias("_seen"),
        *[step(c).over(local).alias(o) for c, o in columns.items()],
    )
    joined = inside.join(border, [*keys, slice_col], "left")
    out = [
        F.when(F.col("_seen"), F.col(o)).otherwise(F.col(f"_{o}")).alias(o)
        for o in columns.values()
    ]
    return joined.select(*df.columns, *out)


def value_bin(value: Column) -> Column:
    """Monotone bin of a finite number: 4096 bins per power of two, zero in its own bin."""
    magnitude = F.floor(F.log2(F.abs(value)) * 4096) + F.lit(4_500_000)
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * magnitude).cast("bigint")


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, counts: Mapping[str, Column]
) -> DataFrame:
    """Per distinct value: each count, its running total up to the value, and its grand total.

    Equal values are merged before the shuffle, distinct values are spread over value bins, and
    only bin totals are combined per key. Adds ``n_<c>``, ``upto_<c>`` and ``all_<c>``.
    """
    distinct = (
        df.withColumn("_bin", value_bin(F.col(value)))
        .groupBy(*keys, "_bin", value)
        .agg(*[F.sum(c).cast("bigint").alias(f"n_{n}") for n, c in counts.items()])
    )
    whole = Window.partitionBy(*keys)
    bins = distinct.groupBy(*keys, "_bin").agg(*[F.sum(f"n_{n}").alias(f"_{n}") for n in counts])
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys,
        "_bin",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in counts],
        *[F.sum(f"_{n}").over(whole).alias(f"all_{n}") for n in counts],
    )
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = distinct.select("*", *[F.sum(f"n_{n}").over(inside).alias(f"_in_{n}") for n in counts])
    return local.join(bins, [*keys, "_bin"]).select(
        *keys,
        value,
        *[f"n_{n}" for n in counts],
        *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(f"upto_{n}") for n in counts],
        *[f"all_{n}" for n in counts],
    )


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key without gathering a key: locate its bin first, then rank inside it."""
    source = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .withColumn("_bin", value_bin(F.col("_v")))
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = source.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    placed = bins.select(
        *keys,
        "_bin",
        "_n",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_all"),
    )
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor((F.col("_all") + 2) / 2)
    middle = placed.filter((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low))
    values = (
        source.join(middle.drop("_n"), [*keys, "_bin"])
        .groupBy(*keys, "_bin", "_before", "_all", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    inside = (
        Window.partitionBy(*keys, "_bin")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_upto") >= low, F.col("_v")))
                + F.min(F.when(F.col("_upto") >= high, F.col("_v")))
            )
            / 2
        ).alias(name)
    )
