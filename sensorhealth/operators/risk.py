"""Rolling maintenance risk, threshold sweep and operating point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grids import level
from ..functions.scalars import f1, share
from ..params import MINUTE_US, StudyParams
from ..session import materialize
from .calendar import interval_join
from .runs import label_runs, median_gap
from .slices import carried, counted, floor_div, with_neighbour


def exceeds(risk: Column, quantile: float) -> Column:
    return (risk >= quantile).cast("double")


def segmented_risk(
    rows: DataFrame,
    keys: Sequence[str],
    us: str,
    risk: str,
    params: StudyParams,
    width: int,
    output: str = "maintenance_risk",
) -> DataFrame:
    """Rolling share of exceedances over ``(t - window, t]``, restarted at every run.

    A row enters its window at ``t`` and leaves it at ``t + window``, so the rolling share is the
    ratio of two running integer sums over enter and leave marks. That is exact, linear in the
    rows however many of them a window holds, and carried across time slices.
    """
    sliced = rows.withColumn("_slice", floor_div(F.col(us), width)).withColumn(
        "_sel", F.when(F.col(risk).isNotNull(), F.lit(0))
    )
    gaps = materialize(median_gap(sliced, keys, us, "_slice"), "gaps")
    labelled = materialize(
        label_runs(
            sliced.join(gaps, list(keys), "left"), keys, us, "_slice", {"risk": "_sel"}
        ).drop("gap_us", "_sel", "_slice"),
        "risk-runs",
    )
    series = [*keys, "risk_run"]
    hit = (F.col(risk) >= params.exceedance_quantile).cast("bigint")
    reach = params.risk_window_minutes * MINUTE_US
    others = [c for c in rows.columns if c not in (*keys, us)]
    row = F.struct(*others)

    def mark(at: Column, n: int, x: Column, kept: Column) -> Column:
        return F.struct(at.alias("_at"), F.lit(n).alias("_n"), x.alias("_x"), kept.alias("_row"))

    # The entering mark carries its row, so that no row is fetched again by its result.
    none = F.lit(None).cast(labelled.select(row.alias("r")).schema["r"].dataType)
    at = F.col(us)
    marks = (
        labelled.filter(F.col("risk_run").isNotNull())
        .select(*series, F.explode(F.array(mark(at, 1, hit, row), mark(at + reach, -1, -hit, none))).alias("_m"))
        .select(*series, "_m.*")
        .withColumn("_slice", floor_div(F.col("_at"), width))
    )
    upto = (
        Window.partitionBy(*series, "_slice")
        .orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    border = carried(
        marks,
        series,
        "_slice",
        {"_bn": F.sum("_n"), "_bx": F.sum("_x")},
        {
            "_bn": lambda w, e: F.coalesce(F.sum("_bn").over(e), F.lit(0)),
            "_bx": lambda w, e: F.coalesce(F.sum("_bx").over(e), F.lit(0)),
        },
    )
    sums = marks.select(
        "*", F.sum("_n").over(upto).alias("_sn"), F.sum("_x").over(upto).alias("_sx")
    ).filter("_n > 0")
    rolled = sums.join(border, [*series, "_slice"], "left").select(
        *keys,
        F.col("_at").alias(us),
        "_row.*",
        ((F.col("_sx") + F.col("_bx")) / (F.col("_sn") + F.col("_bn"))).alias(output),
    )
    unrisked = labelled.filter(F.col("risk_run").isNull()).withColumn(output, F.lit(None).cast("double"))
    return rolled.unionByName(unrisked.select(rolled.columns)).select(*rows.columns, output)


def event_slots(
    events: DataFrame, ends: DataFrame, boundary: Column, inclusive: bool, name: str
) -> DataFrame:
    """Disjoint intervals telling how many event boundaries lie before a row.

    With ``inclusive`` a boundary at the row itself counts, otherwise only strictly earlier ones.
    ``ends`` has the last row of every asset (``asset_id, data_end_us``), where its slots end.
    """
    order = Window.partitionBy("asset_id").orderBy("start_us", "end_us")
    shift = 0 if inclusive else 1
    following = F.lead(boundary).over(order) + (shift - 1)
    return events.join(ends.select("asset_id", "data_end_us"), "asset_id").select(
        "asset_id",
        (boundary + shift).alias("from_us"),
        F.least(following, "data_end_us").alias("to_us"),
        F.row_number().over(order).cast("int").alias(name),
    )


def threshold_sweep(
    predictions: DataFrame,
    grid: DataFrame,
    events: DataFrame,
    thresholds: Sequence[float],
    params: StudyParams,
    width: int,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Alarm counts and event scores per workflow, asset and threshold.

    ``predictions`` has ``workflow_id, asset_id, us, maintenance_risk`` and ``linked`` (the
    previous timeline row is also an evaluated row of the same run); ``grid`` lists every
    ``workflow_id, asset_id``; ``ends`` has the last row of every asset (``data_end_us``) and is
    taken from the predictions if it is not given. A column ``weight`` counts a row several times as
    a point.

    A row opens an alarm interval for the thresholds between its predecessor's risk and its own,
    and closes one likewise towards its successor. Rows are therefore reduced to how many
    thresholds they, their predecessor and their successor reach, and to the number of events
    before them; only this small table meets the thresholds. Matching needs just the counts:
    event ``j`` may take intervals ``lo..hi`` where ``hi`` counts the intervals that begin by its
    start and ``lo - 1`` those that end before its warning time.
    """
    keys = ["workflow_id", "asset_id"]
    lead = params.lead_minutes * MINUTE_US
    sliced = predictions.filter(F.col("maintenance_risk").isNotNull()).select(
        *keys,
        "us",
        "linked",
        counted(predictions).alias("_weight"),
        level(F.col("maintenance_risk"), thresholds).alias("_k"),
        floor_div(F.col("us"), width).alias("_slice"),
    )
    back = with_neighbour(sliced, keys, "us", "_slice", {"_k": "_kp"})
    both = with_neighbour(
        back, keys, "us", "_slice", {"_k": "_kn", "linked": "_ln"}, following=True
    )
    if ends is None:
        ends = predictions.groupBy("asset_id").agg(F.max("us").alias("data_end_us"))
    starts = event_slots(events, ends, F.col("start_us"), False, "_opened")
    warnings = event_slots(events, ends, F.col("start_us") - lead, True, "_closed")
    placed = interval_join(both, starts, ["_opened"], width=width)
    placed = interval_join(placed, warnings, ["_closed"], width=width)
    shape = (
        placed.groupBy(
            *keys,
            "_k",
            F.when(F.col("linked"), F.col("_kp")).otherwise(0).alias("_kp"),
            F.when(F.col("_ln"), F.col("_kn")).otherwise(0).alias("_kn"),
            F.coalesce("_opened", F.lit(0)).alias("_opened"),
            F.coalesce("_closed", F.lit(0)).alias("_closed"),
        )
        .agg(F.count(F.lit(1)).alias("_rows"), F.sum("_weight").alias("_points"))
    )
    # Levels are 1-based positions in the grid; a row contributes to the levels it reaches.
    def levels(above: str, kind: str, slot: Column) -> Column:
        return F.when(
            F.col("_k") > F.col(above),
            F.transform(
                F.sequence(F.col(above) + 1, F.col("_k")),
                lambda i: F.struct(
                    i.alias("level"), F.lit(kind).alias("kind"), slot.alias("slot")
                ),
            ),
        )

    contributions = F.flatten(
        F.array_compact(
            F.array(
                levels("_none", "point", F.lit(0)),
                levels("_kp", "open", F.col("_opened")),
                levels("_kn", "close", F.col("_closed")),
            )
        )
    )
    spread = (
        shape.withColumn("_none", F.lit(0))
        .select(*keys, "_rows", "_points", F.explode(contributions).alias("c"))
        .select(*keys, "_rows", "_points", "c.*")
    )

    def total(kind: str, amount: str = "_rows") -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(amount))), F.lit(0))

    # Opened and closed intervals by the events before them; an asset has a slot more than events.
    by_slot = spread.groupBy(*keys, "level", "slot").agg(
        total("point", "_points").alias("_points"), total("open").alias("_opens"), total("close").alias("_closes")
    )
    per_level = by_slot.groupBy(*keys, "level").agg(
        F.sum("_points").alias("alarm_points"),
        F.sum("_opens").alias("intervals"),
        F.array_sort(
            F.collect_list(F.struct("slot", F.col("_opens").alias("opens"), F.col("_closes").alias("closes")))
        ).alias("_slots"),
    )
    points = shape.groupBy(*keys).agg(F.sum("_points").alias("total_points"))
    expected = events.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_events"))
    theta = F.posexplode(F.array(*[F.lit(t) for t in thresholds])).alias("_i", "theta")
    listed = grid.select(*keys, theta).withColumn("level", F.col("_i") + 1)
    matched = F.coalesce(
        F.expr(
            """aggregate(sequence(1, cast(_events as int)),
                 struct(0 as at, cast(0 as bigint) as hi, cast(0 as bigint) as before,
                        cast(0 as bigint) as last, cast(0 as bigint) as tp),
                 (a, j) -> transform(array(if(get(_slots, a.at).slot = j - 1,
                         struct(a.at + 1 as at, a.hi + get(_slots, a.at).opens as hi,
                                a.before + get(_slots, a.at).closes as before, a.last as last, a.tp as tp),
                         a)),
                     b -> if(greatest(b.before + 1, b.last + 1) <= b.hi,
                             struct(b.at as at, b.hi as hi, b.before as before,
                                    greatest(b.before + 1, b.last + 1) as last, b.tp + 1 as tp),
                             b))[0],
                 a -> a.tp)"""
        ),
        F.lit(0),
    )
    zero = F.lit(0).cast("bigint")
    return (
        listed.join(expected, "asset_id", "left")
        .join(per_level, [*keys, "level"], "left")
        .join(points, keys, "left")
        .select(
            *keys,
            "theta",
            matched.alias("tp"),
            (F.coalesce("intervals", zero) - matched).alias("fp"),
            (F.coalesce("_events", zero) - matched).alias("fn"),
            F.coalesce("alarm_points", zero).alias("alarm_points"),
            F.coalesce("total_points", zero).alias("total_points"),
        )
    )


def with_ratios(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``tp, fp, fn``; undefined ratios are 0."""
    tp = F.col("tp")
    return (
        counts.withColumn("precision", share(tp, tp + F.col("fp"), 0.0))
        .withColumn("recall", share(tp, tp + F.col("fn"), 0.0))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
    )


def fleet_sweep(sweep: DataFrame, params: StudyParams) -> DataFrame:
    """Sweep summed over assets before any ratio is formed."""
    counts = ("tp", "fp", "fn", "alarm_points", "total_points")
    summed = sweep.groupBy("workflow_id", "theta").agg(*[F.sum(c).alias(c) for c in counts])
    gap = F.greatest(F.lit(0.0), params.target_recall - F.col("recall")) + F.greatest(
        F.lit(0.0), F.col("coverage") - params.target_coverage
    )
    return (
        with_ratios(summed)
        .withColumn("coverage", share(F.col("alarm_points"), F.col("total_points"), 0.0))
        .withColumn("coverage_percent", F.col("coverage") * 100.0)
        .withColumn("target_gap", gap)
        .withColumnRenamed("theta", "maintenance_risk_theta")
        .withColumn("threshold", F.col("maintenance_risk_theta"))
    )


def operating_point(sweep: DataFrame, params: StudyParams) -> DataFrame:
    """Best feasible threshold per workflow, else the one closest to the targets."""
    feasible = (F.col("recall") >= params.target_recall) & (
        F.col("coverage") < params.target_coverage
    )
    ranked = sweep.withColumn("_feasible", feasible)
    order = Window.partitionBy("workflow_id").orderBy(
        F.col("_feasible").desc(),
        F.when(F.col("_feasible"), F.lit(0.0)).otherwise(F.col("target_gap")).asc(),
        F.col("f1").desc(),
        F.col("precision").desc(),
        F.col("recall").desc(),
        F.col("threshold").asc(),
    )
    return (
        ranked.withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .select(
            *sweep.columns,
            F.when(F.col("_feasible"), "feasible").otherwise("fallback").alias("selection_mode"),
            F.lit(params.target_recall).alias("target_recall"),
            F.lit(params.target_coverage).alias("target_coverage"),
            F.lit(params.selection_scope).alias("selection_scope"),
        )
    )


def alarm_flags(predictions: DataFrame, selected: DataFrame) -> DataFrame:
    """Final alarm per evaluated row at the workflow's operating point."""
    chosen = selected.select("workflow_id", "maintenance_risk_theta")
    alarm = F.coalesce(F.col("maintenance_risk") >= F.col("maintenance_risk_theta"), F.lit(False))
    return predictions.join(chosen, "workflow_id").withColumn("alarm", alarm).drop(
        "maintenance_risk_theta"
    )
