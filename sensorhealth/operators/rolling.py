"""Rolling features, fills and the frozen scaler."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import AGGREGATIONS
from .slices import carried, floor_div


PARTS = ("n", "s", "s1", "s2", "s3", "lo", "hi", "c")


def channel_parts(channel: str, frame) -> list[Column]:
    """Mergeable aggregates of one channel over a frame, in ``PARTS`` order.

    Powers are taken around the mean of the channel's block, which travels along as ``c``, so that
    neither a far level nor a level that moves between blocks cancels them.
    """
    x, centre = F.col(channel), F.col(f"_centre_{channel}")
    y = x - centre
    zero = F.lit(0.0)
    return [
        F.count(x).over(frame).cast("double"),
        F.coalesce(F.sum(x).over(frame), zero),
        F.coalesce(F.sum(y).over(frame), zero),
        F.coalesce(F.sum(y * y).over(frame), zero),
        F.coalesce(F.sum(y * y * y).over(frame), zero),
        F.min(x).over(frame),
        F.max(x).over(frame),
        centre,
    ]


# Which parts each aggregation reads.
NEEDS = {
    "mean": ("n", "s"),
    "median": (),
    "std": ("n", "s1", "s2", "lo", "hi", "c"),
    "skew": ("n", "s1", "s2", "s3", "lo", "hi", "c"),
    "min": ("lo",),
    "max": ("hi",),
}


def rolling_aggregate(channel: str, aggregation: str) -> Column:
    """One feature from the merged parts; nulls are skipped and one observation suffices.

    The sample standard deviation needs two observations, the bias-adjusted skewness three; both
    are 0 where all observations are equal.
    """
    part = lambda name: F.col(f"_{name}_{channel}")
    if aggregation == "mean":
        return F.when(part("n") > 0, part("s") / part("n"))
    if aggregation == "min":
        return part("lo")
    if aggregation == "max":
        return part("hi")
    n = part("n")
    flat = part("lo") == part("hi")
    shift = part("s1") / n
    squares = part("s2") - part("s1") * shift
    if aggregation == "std":
        spread = F.sqrt(F.greatest(F.lit(0.0), squares / (n - 1)))
        return F.when(n >= 2, F.when(flat, F.lit(0.0)).otherwise(spread))
    if aggregation == "skew":
        cubes = part("s3") - 3 * shift * part("s2") + 2 * n * shift * shift * shift
        shape = (cubes / n) / F.pow(squares / n, 1.5) * F.sqrt(n * (n - 1)) / (n - 2)
        return F.when(
            n >= 3, F.when(flat, F.lit(0.0)).otherwise(F.when(squares > 0, shape))
        )
    raise ValueError(f"unknown rolling aggregation {aggregation!r}")


def feature_names(channels: Sequence[str], aggregations: Sequence[str] = AGGREGATIONS) -> list[str]:
    return [f"{c}__{a}" for c in channels for a in aggregations]


def rolling_features(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    slice_col: str,
    width: int,
    channels: Sequence[str],
    window_us: int,
    aggregations: Sequence[str] = AGGREGATIONS,
    others: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Time-left-open rolling aggregates ``(t - window, t]``, linear in the rows.

    Time is cut into blocks as long as the window, so a window is the tail of one block and the
    head of the next. Heads are running aggregates. Every row also leaves a mark at
    ``t + window``, where it drops out of the window, that holds what then remains of its block;
    the latest mark before a row is the tail of its window. Heads and tails are merged, never
    subtracted, and no frame is evaluated row by row, however many rows a window holds.

    Work is spread by ``slice_col``, a whole number of blocks close to ``width`` microseconds; the
    raw rows of a slice's last block are copied to the next slice, which needs their tails, so one
    shuffle of raw rows is all. Only medians leave the JVM: they are taken first, from channels
    alone, at the price of one more shuffle of raw rows; features never travel. The result stays
    partitioned by ``keys`` and ``slice_col``. ``others`` are passed through. Raw rows travel in a few
    bytes and become a few kilobytes in a task, so tasks are not sized by bytes: ``parts`` says how
    many there are (adaptive execution decides if it is not given).
    """
    spread = [parts] if parts else []
    blocks = max(1, width // window_us)
    used = [p for p in PARTS if any(p in NEEDS[a] for a in aggregations)]
    own = floor_div(F.col("_block"), blocks)
    following = floor_div(F.col("_block") + 1, blocks)
    rows = (
        df.select(*keys, us, *others, *channels)
        .withColumn("_block", floor_div(F.col(us), window_us))
        .withColumn(slice_col, F.explode(F.array_distinct(F.array(own, following))))
    )
    medians = [f"{c}__median" for c in channels] if "median" in aggregations else []
    if medians:
        schema = T.StructType([*rows.schema, *[T.StructField(m, T.DoubleType()) for m in medians]])
        add = rolling_medians(channels, medians, us, window_us)
        dealt = rows.repartition(*spread, *keys, slice_col)
        rows = dealt.groupBy(*keys, slice_col).applyInArrow(add, schema)
    rows = rows.repartition(*spread, *keys, slice_col)
    block = Window.partitionBy(*keys, slice_col, "_block")
    head = block.orderBy(us).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = block.orderBy(F.col(us).desc())
    tail = rest.rowsBetween(Window.unboundedPreceding, -1)
    centred = rows.select("*", *[F.avg(c).over(block).alias(f"_centre_{c}") for c in channels])

    def parts_over(frame) -> Column:
        chosen = [
            part
            for c in channels
            for name, part in zip(PARTS, channel_parts(c, frame), strict=True)
            if name in used
        ]
        return F.array(*chosen) if chosen else F.expr("cast(array() as array<double>)")

    staged = centred.select(
        *keys,
        slice_col,
        us,
        *others,
        *medians,
        "_block",
        parts_over(head).alias("_head"),
        parts_over(tail).alias("_tail"),
        (F.row_number().over(rest) == 1).alias("_closing"),
    )

    def mark(shift: int, at: Column, kind: int, part: str) -> Column:
        return F.struct(
            (F.col("_block") + shift).alias("_block"),
            at.alias("_at"),
            F.lit(kind).alias("_kind"),
            F.col(part).alias("_part"),
        )

    opening = (F.col("_block") + 1) * window_us
    here = following == F.col(slice_col)  # the next block is in this slice
    marks = F.array(
        F.when(own == F.col(slice_col), mark(0, F.col(us), ROW, "_head")),
        F.when(here, mark(1, F.col(us) + window_us, LEAVES, "_tail")),
        F.when(here & F.col("_closing"), mark(1, opening, OPENS, "_head")),
    )
    placed = staged.select(
        *keys, slice_col, *others, *medians, F.explode(F.array_compact(marks)).alias("_m")
    ).select(
        *keys,
        slice_col,
        *[F.when(F.col("_m._kind") == ROW, F.col(c)).alias(c) for c in (*others, *medians)],
        "_m.*",
    )
    so_far = (
        Window.partitionBy(*keys, slice_col, "_block")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = F.last(F.when(F.col("_kind") != ROW, F.col("_part")), ignorenulls=True).over(so_far)
    kept = placed.withColumn("_old", latest).filter(F.col("_kind") == ROW)
    merged = kept.select(
        *keys,
        slice_col,
        F.col("_at").alias(us),
        *others,
        *medians,
        *[
            value.alias(f"_{name}_{c}")
            for i, c in enumerate(channels)
            for name, value in merged_parts(used, i * len(used)).items()
        ],
    )
    made = [
        F.col(f"{c}__median") if a == "median" else rolling_aggregate(c, a).alias(f"{c}__{a}")
        for c in channels
        for a in aggregations
    ]
    return merged.select(*keys, us, slice_col, *others, *made)


# Order of marks at the same instant: the opening of a block, rows that leave, rows that enter.
OPENS, LEAVES, ROW = -1, 0, 1


def merged_parts(used: Sequence[str], start: int) -> dict[str, Column]:
    """Parts of a window from its head (``_part``) and tail (``_old``), of which either may be empty.

    Powers of the tail are moved from its block's centre to that of the head's block.
    """
    place = {name: start + i for i, name in enumerate(used)}
    head = {name: F.get("_part", F.lit(at)) for name, at in place.items()}
    tail = {name: F.get("_old", F.lit(at)) for name, at in place.items()}
    zero = F.lit(0.0)
    old = {name: F.coalesce(tail[name], zero) for name in used if name not in ("lo", "hi", "c")}
    out = {}
    for name in used:
        if name == "lo":
            out[name] = F.least(head[name], tail[name])
        elif name == "hi":
            out[name] = F.greatest(head[name], tail[name])
        elif name in ("n", "s"):
            out[name] = head[name] + old[name]
    if "c" in used:
        d = F.coalesce(tail["c"] - head["c"], zero)
        out["s1"] = head["s1"] + old["s1"] + old["n"] * d
        out["s2"] = head["s2"] + old["s2"] + d * (2 * old["s1"] + old["n"] * d)
        if "s3" in used:
            moved = d * (3 * old["s2"] + d * (3 * old["s1"] + old["n"] * d))
            out["s3"] = head["s3"] + old["s3"] + moved
    return out


def rolling_medians(channels: Sequence[str], names: Sequence[str], us: str, window_us: int):
    """Per slice: rolling medians of the channels as extra columns.

    A framed ``percentile`` sorts every frame anew; keeping the frame ordered while it moves makes
    the cost per row logarithmic in the rows of a window. The block before the slice is present;
    the medians of its own rows are not used here.
    """

    def add(table: pa.Table) -> pa.Table:
        at = table[us].to_numpy()
        order = np.argsort(at, kind="stable")
        values = table.select(list(channels)).take(order).to_pandas()
        values.index = pd.to_datetime(at[order], unit="us")
        rolled = values.rolling(pd.Timedelta(window_us, "us"), min_periods=1).median()
        for c, name in zip(channels, names, strict=True):
            column = np.empty(len(at))
            column[order] = rolled[c].to_numpy()
            table = table.append_column(name, pa.array(column, from_pandas=True))
        return table

    return add


def fill_inside(
    df: DataFrame, keys: Sequence[str], us: str, slice_col: str, columns: Sequence[str]
) -> DataFrame:
    """Forward fill inside each slice."""
    local = (
        Window.partitionBy(*keys, slice_col)
        .orderBy(us)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.select(
        *[F.last(c, ignorenulls=True).over(local).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def fill_borders(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    slice_col: str,
    columns: Sequence[str],
    backward: bool = True,
) -> DataFrame:
    """One row per slice: the last value before it and (``backward``) the first value of its series.

    After a forward fill only rows before the first known value of a series are still empty, so
    back filling needs that one value per series and no reversed window. ``df`` may be filled inside
    its slices or not.
    """
    known = {c: F.when(F.col(c).isNotNull(), F.col(us)) for c in columns}
    summary = {f"_l_{c}": F.max_by(c, known[c]) for c in columns}
    carry = {
        f"_l_{c}": (lambda w, e, c=c: F.last(f"_l_{c}", ignorenulls=True).over(e)) for c in columns
    }
    if backward:
        summary |= {f"_f_{c}": F.min_by(c, known[c]) for c in columns}
        carry |= {
            f"_f_{c}": (
                lambda w, e, c=c: F.first(f"_f_{c}", ignorenulls=True).over(
                    w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                )
            )
            for c in columns
        }
    return carried(df, keys, slice_col, summary, carry)


def fill_across(
    filled: DataFrame,
    borders: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    columns: Sequence[str],
    backward: bool = True,
) -> DataFrame:
    """Rows filled inside their slices, with what ``fill_borders`` carries over from other slices."""
    sources = lambda c: [c, f"_l_{c}", *([f"_f_{c}"] if backward else [])]
    return filled.join(borders, [*keys, slice_col], "left").select(
        *[F.coalesce(*sources(c)).alias(c) if c in columns else F.col(c) for c in filled.columns]
    )


def fill_series(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    slice_col: str,
    columns: Sequence[str],
    *,
    backward: bool = True,
) -> DataFrame:
    """Forward fill across slices, then (with ``backward``) back fill."""
    borders = fill_borders(df, keys, us, slice_col, columns, backward)
    filled = fill_inside(df, keys, us, slice_col, columns)
    return fill_across(filled, borders, keys, slice_col, columns, backward)


def unresolved(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Completeness of the feature table: row count, missing values, features with any value.

    A column that the table lacks counts as missing in every row.
    """
    told = [F.col(c) if c in df.columns else F.lit(None) for c in columns]
    missing = sum((c.isNull().cast("bigint") for c in told), F.lit(0))
    filled = sum(((F.count(c) > 0).cast("bigint") for c in told), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_values"),
        filled.cast("bigint").alias("feature_count"),
    )


def fit_scaler(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], binary: Sequence[str]
) -> DataFrame:
    """Frozen scaling parameters, one row per key and feature.

    Population moments over the rows given; a zero or non-finite spread becomes 1, and features
    of binary channels pass through unchanged.
    """
    passthrough = [c for c in columns if c.split("__", 1)[0] in set(binary)]
    if not passthrough:
        raise ValueError("binary passthrough matched no engineered feature")
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fitted_rows"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    entries = []
    for position, c in enumerate(columns):
        fixed = c in passthrough
        spread = F.col(f"_s_{c}")
        usable = spread.isNotNull() & ~F.isnan(spread) & (spread > 0) & (spread < float("inf"))
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(c).alias("feature"),
                (F.lit(0.0) if fixed else F.col(f"_m_{c}")).alias("mean"),
                (F.lit(1.0) if fixed else F.when(usable, spread).otherwise(1.0)).alias("scale"),
                F.lit(fixed).alias("passthrough"),
            )
        )
    return stats.select(*keys, "fitted_rows", F.explode(F.array(*entries)).alias("_e")).select(
        *keys, "_e.*", "fitted_rows"
    )


def scaler_fit_problems(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys whose fit rows hold non-finite values; an empty fit set shows up as no row at all."""
    bad = sum(
        ((F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("bigint") for c in columns),
        F.lit(0),
    )
    return df.groupBy(*keys).agg(F.sum(bad).alias("non_finite")).filter("non_finite > 0")


def wide_scaler(scaler: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with the mean and scale of every feature."""
    return scaler.groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"_m_{c}") for c in columns],
        *[F.max(F.when(F.col("feature") == c, F.col("scale"))).alias(f"_s_{c}") for c in columns],
    )


def apply_scaler(
    df: DataFrame,
    scaler: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    fitted_columns: Sequence[str] | None = None,
) -> DataFrame:
    """``(x - mean) / scale`` with frozen parameters; names and order must match the fit.

    ``scaler`` may be wide already. Written as such it has a known size, so the planner knows whether
    to broadcast it, and a key with many rows can be split by adaptive execution where it does not.
    """
    if fitted_columns is not None and list(fitted_columns) != list(columns):
        raise ValueError("feature names or order differ from the frozen scaler")
    wide = wide_scaler(scaler, keys, columns) if "feature" in scaler.columns else scaler
    scaled = [
        ((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ]
    return df.join(wide, list(keys)).select(*scaled)


SCALER_SCHEMA = "1.0"


def save_scaler(scaler: DataFrame, path: str) -> None:
    scaler.withColumn("schema_version", F.lit(SCALER_SCHEMA)).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    """Frozen scaler; parameters written under another schema version are refused."""
    table = spark.read.parquet(path)
    if table.filter(F.col("schema_version") != SCALER_SCHEMA).take(1):
        raise ValueError("unsupported scaler schema version")
    return table
