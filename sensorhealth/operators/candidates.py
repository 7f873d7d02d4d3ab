"""Candidate objectives, ledger and multi-objective selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clip_unit, is_finite
from ..params import StudyParams
from ..session import materialize
from .slices import running_totals

OBJECTIVES = ("obj_error", "obj_pdm", "obj_alarm_burden")
MISSING_CLASS = "cycle_zero_search_population_missing_positive_or_negative_class"
LEDGER_KEY = ("study_id", "search_contract_fingerprint", "architecture_hash")


def auroc(rows: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Tie-averaged rank AUROC per key, with class counts; null when a class is missing."""
    hit = F.col(positive).cast("bigint")
    scored = rows.filter(is_finite(F.col(score)))
    totals = running_totals(scored, keys, score, {"pos": hit, "neg": F.lit(1) - hit})
    below = F.col("upto_neg") - F.col("n_neg") / 2
    summed = totals.groupBy(*keys).agg(
        F.max("all_pos").alias("positive_windows"),
        F.max("all_neg").alias("negative_windows"),
        F.sum(F.col("n_pos") * below).alias("_wins"),
    )
    pairs = F.col("positive_windows") * F.col("negative_windows")
    return summed.withColumn(
        "smoothed_auroc", F.when(pairs > 0, F.col("_wins") / pairs)
    ).drop("_wins")


def high_risk_rate(rows: DataFrame, keys: Sequence[str], score: str, positive: str, limit: float):
    """Share of normal rows at or above the burden threshold."""
    return rows.filter(is_finite(F.col(score))).groupBy(*keys).agg(
        F.avg(
            F.when(~F.col(positive), (F.col(score) >= limit).cast("double"))
        ).alias("normal_high_risk_rate")
    )


def diagnostics(
    rows: DataFrame, keys: Sequence[str], score: str, positive: str, params: StudyParams
) -> DataFrame:
    """Search objectives and diagnostics per candidate; a missing class costs 1.0 on both."""
    area = auroc(rows, keys, score, positive)
    burden = high_risk_rate(rows, keys, score, positive, params.alarm_burden_threshold)
    defined = F.col("smoothed_auroc").isNotNull()
    return area.join(burden, list(keys)).select(
        *keys,
        (F.col("positive_windows") + F.col("negative_windows")).alias("search_windows"),
        "positive_windows",
        "negative_windows",
        "smoothed_auroc",
        (2.0 * F.col("smoothed_auroc") - 1.0).alias("smoothed_rank_gap"),
        F.when(defined, clip_unit(1.0 - F.col("smoothed_auroc"))).otherwise(1.0).alias("obj_pdm"),
        F.when(defined, F.col("normal_high_risk_rate")).otherwise(1.0).alias("obj_alarm_burden"),
        F.when(~defined, F.lit(MISSING_CLASS)).alias("pdm_invalid_reason"),
    )


def with_status(candidates: DataFrame, penalty: float) -> DataFrame:
    """Candidates without three finite objectives get the penalty and status ``invalid``."""
    failed = ~(is_finite(F.col(OBJECTIVES[0])) & is_finite(F.col(OBJECTIVES[1])) & is_finite(F.col(OBJECTIVES[2])))
    return candidates.withColumn("_failed", failed).select(
        *[
            F.when(F.col("_failed"), F.lit(penalty)).otherwise(F.col(c)).alias(c)
            if c in OBJECTIVES
            else F.col(c)
            for c in candidates.columns
        ],
        F.when(F.col("_failed"), "invalid").otherwise("valid").alias("status"),
    )


def is_valid(penalty: float) -> Column:
    keep = F.col("status") == "valid"
    for c in OBJECTIVES:
        keep = keep & is_finite(F.col(c)) & (F.col(c) < penalty)
    return keep


def valid_candidates(candidates: DataFrame, penalty: float) -> DataFrame:
    return candidates.filter(is_valid(penalty))


def _undominated(points: np.ndarray) -> np.ndarray:
    """Mask of points no other point dominates (three columns, all minimised), in n log n.

    Points are visited in ascending order, so whatever dominates a point has been visited before it and
    only has to be no larger in the last two columns. A Fenwick tree over the ranks of the second keeps
    the least third column so far. Equal points keep each other.
    """
    keep = np.zeros(len(points), dtype=bool)
    values, ranks = np.unique(points[:, 1], return_inverse=True)
    least = [np.inf] * (len(values) + 1)
    order = np.lexsort(points.T[::-1])
    last, kept = None, False
    for i, point, rank in zip(order.tolist(), points[order].tolist(), (ranks[order] + 1).tolist(), strict=True):
        if point != last:
            last, z, at = point, point[2], rank
            while at and least[at] > z:
                at &= at - 1
            kept = not at
            if kept:
                while rank < len(least):
                    if z < least[rank]:
                        least[rank] = z
                    rank += rank & -rank
        keep[i] = kept
    return keep


def pareto_front(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that no other candidate of their study (``keys``) dominates.

    Distinct points are dealt into ranges of the first objective and thinned there, then the rest into
    ranges of the second; ties are broken by the other objectives, so no value is too frequent to be
    cut. What could still dominate a point lies in an earlier range of both: it does if the least third
    objective of those ranges, a small grid for each study, is no larger. No task holds a whole front,
    and no pair of candidates is ever emitted.
    """
    keys, names = list(keys), list(OBJECTIVES)
    points = candidates.select(
        *keys, *[F.col(c).cast("double").alias(c) for c in names]
    ).distinct()

    def thinned(df: DataFrame, order: list[str], place: str) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField(place, T.IntegerType())])

        def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId()
            rows = [b for b in batches if len(b)]
            for _, group in pd.concat(rows).groupby(keys, sort=False, dropna=False) if rows else ():
                found = group[_undominated(group[names].to_numpy(dtype=float))]
                yield found.assign(**{place: number})

        return df.repartitionByRange(*keys, *order).mapInPandas(thin, schema)

    first = materialize(thinned(points, names, "_i"), "front-first")
    both = materialize(thinned(first, [*names[1:], names[0]], "_j"), "front-second")
    cells = both.groupBy(*keys, "_i", "_j").agg(F.min(names[2]).alias("_least"))
    types = {f.name: f.dataType.simpleString() for f in cells.schema}

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        """The least value of strictly earlier ranges of both kinds, for every cell in use."""
        i, row = np.unique(pdf["_i"].to_numpy(), return_inverse=True)
        j, column = np.unique(pdf["_j"].to_numpy(), return_inverse=True)
        grid = np.full((len(i) + 1, len(j) + 1), np.inf)
        grid[row + 1, column + 1] = pdf["_least"].to_numpy()
        grid = np.minimum.accumulate(np.minimum.accumulate(grid, axis=0), axis=1)
        return pdf.assign(_least=grid[row, column])

    limits = cells.groupBy(*keys).applyInPandas(before, ", ".join(f"{c} {types[c]}" for c in cells.columns))
    renamed = limits.select(*[F.col(c).alias(f"_l{c}") for c in limits.columns])
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_l{c}")) for c in (*keys, "_i", "_j")))
    front = both.join(renamed, same).filter(F.col(names[2]) < F.col("_l_least")).select(*points.columns)
    return candidates.join(front, [*keys, *names], "left_semi")


def winner(
    candidates: DataFrame,
    front: DataFrame,
    keys: Sequence[str],
    params: StudyParams,
) -> DataFrame:
    """Front member closest to the ideal point, with deterministic tie-breaks and counts.

    ``candidates`` are all ledger rows flagged ``_valid``; ``keys`` names the study columns.
    """
    keys = list(keys)
    total = sum(params.winner_weights)
    box = front.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pareto_candidate_count"),
        *[F.min(c).alias(f"_lo_{c}") for c in OBJECTIVES],
        *[F.max(c).alias(f"_hi_{c}") for c in OBJECTIVES],
    )
    distance = F.lit(0.0)
    for c, w in zip(OBJECTIVES, params.winner_weights, strict=True):
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        unit = F.when(span > 0, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(0.0)
        distance = distance + unit * unit * (w / total)
    measured = front.join(box, keys).withColumn("distance", F.sqrt(distance))
    best = measured.groupBy(*keys).agg(F.min("distance").alias("_best"))
    order = Window.partitionBy(*keys).orderBy(
        "obj_alarm_burden", "obj_pdm", "obj_error", "created_at", "id"
    )
    counts = candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.col("_valid")).alias("valid_candidate_count"),
    )
    return (
        measured.join(best, keys)
        .filter(F.col("distance") - F.col("_best") <= 1e-12)
        .withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .join(counts, keys)
        .select(
            *keys,
            "id",
            *OBJECTIVES,
            "distance",
            "candidate_count",
            "valid_candidate_count",
            "pareto_candidate_count",
        )
    )
