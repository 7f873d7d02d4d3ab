"""Gap-aware runs, anchors and sequence windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import carried, counted, grouped_median, with_neighbour

GAP_FACTOR = 1.5
CHUNK_ROWS = 4096


def median_gap(df: DataFrame, keys: Sequence[str], us: str, slice_col: str) -> DataFrame:
    """Median positive distance between neighbouring rows of each series (``gap_us``)."""
    steps = with_neighbour(
        df.select(*keys, us, slice_col), keys, us, slice_col, {us: "_prev_us"}
    ).withColumn("_step", F.col(us) - F.col("_prev_us"))
    return grouped_median(steps.filter(F.col("_step") > 0), keys, "_step", "gap_us")


def touches(us: Column, previous: Column, gap: Column) -> Column:
    """Whether a row follows its predecessor without a telemetry gap."""
    return previous.isNotNull() & (gap.isNull() | (us - previous <= GAP_FACTOR * gap))


def label_runs(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    slice_col: str,
    selections: Mapping[str, str],
) -> DataFrame:
    """Label maximal runs of selected rows.

    ``selections`` maps an output prefix to a selection column: null means excluded, and a run
    breaks where the selected value changes, at an excluded row, or at a telemetry gap. ``df``
    needs ``gap_us``. Adds per prefix ``<p>_run`` (start of the run in microseconds), ``<p>_pos``
    (1-based position in the run) and ``<p>_ord`` (1-based position among selected rows).
    """
    columns = {us: "_prev_us"} | {c: f"_prev_{p}" for p, c in selections.items()}
    linked = with_neighbour(df, keys, us, slice_col, columns)
    joined = touches(F.col(us), F.col("_prev_us"), F.col("gap_us"))
    local = (
        Window.partitionBy(*keys, slice_col)
        .orderBy(us)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = linked.select(
        *df.columns,
        *[
            (
                F.col(c).isNotNull() & ~F.coalesce(joined & (F.col(f"_prev_{p}") == F.col(c)), F.lit(False))
            ).alias(f"_new_{p}")
            for p, c in selections.items()
        ],
        *[F.count(c).over(local).alias(f"_cnt_{p}") for p, c in selections.items()],
    )
    scanned = marked.select(
        "*",
        *[
            expr
            for p in selections
            for expr in (
                F.max(F.when(F.col(f"_new_{p}"), F.col(us))).over(local).alias(f"_start_{p}"),
                F.max(F.when(F.col(f"_new_{p}"), F.col(f"_cnt_{p}"))).over(local).alias(f"_at_{p}"),
            )
        ],
    )
    summary: dict[str, Column] = {}
    carry = {}
    for p, c in selections.items():
        summary[f"_n_{p}"] = F.count(c)
        summary[f"_s_{p}"] = F.max(F.when(F.col(f"_new_{p}"), F.col(us)))
        summary[f"_a_{p}"] = F.max(F.when(F.col(f"_new_{p}"), F.col(f"_cnt_{p}")))
        carry[f"_base_{p}"] = lambda w, e, p=p: F.coalesce(F.sum(f"_n_{p}").over(e), F.lit(0))
        carry[f"_s_{p}"] = lambda w, e, p=p: F.max(f"_s_{p}").over(e)
        carry[f"_a_{p}"] = lambda w, e, p=p: F.col(f"_a_{p}")
    border = carried(marked, keys, slice_col, summary, carry)
    by_slice = Window.partitionBy(*keys).orderBy(slice_col)
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    border = border.select(
        *keys,
        slice_col,
        *[f"_base_{p}" for p in selections],
        *[F.col(f"_s_{p}").alias(f"_carry_{p}") for p in selections],
        *[
            F.max(F.col(f"_base_{p}") + F.col(f"_a_{p}")).over(earlier).alias(f"_carryat_{p}")
            for p in selections
        ],
    )
    out = []
    for p, c in selections.items():
        chosen = F.col(c).isNotNull()
        order = F.col(f"_base_{p}") + F.col(f"_cnt_{p}")
        start_order = F.coalesce(F.col(f"_base_{p}") + F.col(f"_at_{p}"), F.col(f"_carryat_{p}"))
        out += [
            F.when(chosen, F.coalesce(F.col(f"_start_{p}"), F.col(f"_carry_{p}"))).alias(f"{p}_run"),
            F.when(chosen, order - start_order + 1).alias(f"{p}_pos"),
            F.when(chosen, order).alias(f"{p}_ord"),
        ]
    return scanned.join(border, [*keys, slice_col], "left").select(*df.columns, *out)


def is_anchor(position: Column, length: int, stride: int) -> Column:
    """End row of a complete window: the L-th row of a run, then every ``stride`` rows."""
    return F.coalesce(
        (position >= length) & (F.pmod(position - F.lit(length), F.lit(stride)) == 0), F.lit(False)
    )


def run_segments(df: DataFrame, keys: Sequence[str], us: str, run: str) -> DataFrame:
    """One row per run: first and last row and row count (a column ``weight`` counts a row several times)."""
    return (
        df.filter(F.col(run).isNotNull())
        .groupBy(*keys, run)
        .agg(
            F.min(us).alias("start_us"),
            F.max(us).alias("end_us"),
            F.sum(counted(df)).alias("row_count"),
        )
    )


def run_chunks(df: DataFrame, keys: Sequence[str], run: str, position: str, block: int) -> DataFrame:
    """Rows of runs dealt out by position: ``_chunk`` is a whole number of blocks of ``block`` rows.

    The last block of a chunk is copied to the next chunk (``_copy``), so a row is there at most
    twice, whatever the sampling of its series is. ``_block`` numbers the blocks of a run.
    """
    per_chunk = max(1, CHUNK_ROWS // block)
    number = F.floor((F.col(position) - 1) / block)
    own, following = (F.floor((number + shift) / per_chunk) for shift in (0, 1))
    return (
        df.filter(F.col(run).isNotNull())
        .withColumn("_block", number)
        .withColumn("_chunk", F.explode(F.array_distinct(F.array(own, following))))
        .withColumn("_copy", F.col("_chunk") != own)
        .repartition(*keys, run, "_chunk")
    )


def over_sequence(
    df: DataFrame,
    keys: Sequence[str],
    run: str,
    position: str,
    length: int,
    expressions: Mapping[str, Column],
) -> DataFrame:
    """Aggregates over the last ``length`` rows of a run; ``position`` counts its rows from 1."""
    frame = (
        Window.partitionBy(*keys, run, "_chunk").orderBy(position).rowsBetween(-(length - 1), 0)
    )
    rows = run_chunks(df, keys, run, position, max(1, length - 1))
    return (
        rows.select("*", *[c.over(frame).alias(n) for n, c in expressions.items()])
        .filter(~F.col("_copy"))
        .drop("_copy", "_chunk", "_block")
    )


def mean_over_sequence(
    df: DataFrame,
    keys: Sequence[str],
    run: str,
    position: str,
    length: int,
    value: str,
    output: str,
) -> DataFrame:
    """Mean of ``value`` over the last ``length`` rows of a run, linear in the rows.

    A run is cut into blocks of ``length`` rows: a window is the head of one block and the rest of
    the one before, which stands ``length - 1`` rows earlier. Nulls are skipped.
    """
    in_block = Window.partitionBy(*keys, run, "_chunk", "_block")
    head = in_block.orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = in_block.orderBy(F.col(position).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys, run, "_chunk").orderBy(position)
    whole = F.pmod(F.col(position), F.lit(length)) == 0
    rows = run_chunks(df, keys, run, position, length)
    staged = rows.select(
        "*",
        F.sum(value).over(head).alias("_hs"),
        F.count(value).over(head).alias("_hn"),
        F.sum(value).over(rest).alias("_rs"),
        F.count(value).over(rest).alias("_rn"),
    )

    def total(own: str, before: str) -> Column:
        old = F.lag(before, length - 1).over(earlier) if length > 1 else F.lit(None)
        return F.coalesce(own, F.lit(0)) + F.when(whole, F.lit(0)).otherwise(F.coalesce(old, F.lit(0)))

    summed = staged.select("*", total("_hs", "_rs").alias("_s"), total("_hn", "_rn").alias("_n"))
    mean = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    helpers = ("_copy", "_chunk", "_block", "_hs", "_hn", "_rs", "_rn", "_s", "_n")
    return summed.filter(~F.col("_copy")).withColumn(output, mean).drop(*helpers)
