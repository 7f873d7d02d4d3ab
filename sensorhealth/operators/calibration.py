"""Empirical-CDF calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip_unit, is_finite
from ..session import materialize
from .slices import running_totals, value_bin

MIN_REFERENCE = 2


def reference_scores(scores: DataFrame, score: str) -> DataFrame:
    return scores.filter(is_finite(F.col(score)))


def reference_problems(reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calibrators with fewer finite reference scores than a CDF needs."""
    return (
        reference.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("reference_count"))
        .filter(F.col("reference_count") < MIN_REFERENCE)
    )


def reference_summary(reference: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return reference.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("reference_count"),
        F.min(score).alias("minimum_score"),
        F.max(score).alias("maximum_score"),
    )


#: Queries of one value bin that one task looks up.
BIN_ROWS = 200_000


def empirical_risk(
    reference: DataFrame,
    queries: DataFrame,
    keys: Sequence[str],
    score: str,
    risk: str,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Share of reference scores not above each query score; null for non-finite scores.

    Reference scores are ranked as distinct values in value bins. Queries are sent once, to their bin,
    where each takes the rank of the last reference score before it; a bin starts with the rank that
    all bins before it give. A bin with more than ``bin_rows`` queries, such as that of a score most
    queries share, is dealt out to several tasks, each with the bin's reference scores.
    """
    keys = list(keys)
    finite = is_finite(F.col(score))
    known = reference_scores(reference, score).select(*keys, score)
    totals = running_totals(known, keys, score, {"ref": F.lit(1)})
    ranks = materialize(
        totals.select(*keys, F.col(score).alias("_v"), value_bin(F.col(score)).alias("_bin"), "upto_ref", "all_ref"),
        "reference-ranks",
    )
    asked = queries.filter(finite).withColumn("_bin", value_bin(F.col(score)))
    bins = materialize(asked.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n")), "query-bins")
    parts = F.ceil(F.col("_n") / bin_rows).cast("int")

    ends = ranks.groupBy(*keys, "_bin").agg(F.max("upto_ref").alias("_upto"), F.max("all_ref").alias("_all"))
    none = F.lit(None).cast("bigint")
    listed = ends.select("*", F.lit(0).alias("_parts")).unionByName(
        bins.select(*keys, "_bin", none.alias("_upto"), none.alias("_all"), parts.alias("_parts"))
    )
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bin").rangeBetween(Window.unboundedPreceding, -1)
    # A key without any reference score has no distribution and leaves its queries undefined.
    starts = listed.select(
        *keys,
        "_bin",
        none.cast("double").alias("_v"),
        F.coalesce(F.max("_upto").over(earlier), F.lit(0)).alias("_upto"),
        F.max("_all").over(whole).alias("_all"),
        "_parts",
    ).filter("_parts > 0")
    inside = ranks.join(bins.select(*keys, "_bin", parts.alias("_parts")), [*keys, "_bin"]).select(
        *keys, "_bin", "_v", F.col("upto_ref").alias("_upto"), F.col("all_ref").alias("_all"), "_parts"
    )
    others = [c for c in queries.columns if c not in keys]
    row = F.struct(*others)
    kind = asked.select(row.alias("r")).schema["r"].dataType
    marks = starts.unionByName(inside).select(
        *keys,
        "_bin",
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
        "_v",
        F.lit(0).alias("_kind"),
        "_upto",
        "_all",
        F.lit(None).cast(kind).alias("_row"),
    )
    large = bins.filter(F.col("_n") > bin_rows).select(*keys, "_bin", parts.alias("_parts"))
    dealt = F.pmod(F.xxhash64(*queries.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    rows = asked.join(large, [*keys, "_bin"], "left").select(
        *keys, "_bin", dealt.alias("_part"), F.col(score).cast("double").alias("_v"), F.lit(1).alias("_kind"),
        none.alias("_upto"), none.alias("_all"), row.alias("_row"),
    )
    upto = (
        Window.partitionBy(*keys, "_bin", "_part")
        .orderBy("_v", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = lambda c: F.last(c, ignorenulls=True).over(upto)
    ranked = marks.unionByName(rows).select(*keys, "_kind", "_row", last("_upto").alias("_u"), last("_all").alias("_a"))
    defined = F.when(F.col("_a") > 0, clip_unit(F.col("_u") / F.col("_a")))
    found = ranked.filter("_kind = 1").select(*keys, "_row.*", defined.alias(risk))
    rest = queries.filter(~finite).withColumn(risk, F.lit(None).cast("double"))
    return found.unionByName(rest.select(found.columns)).select(*queries.columns, risk)
