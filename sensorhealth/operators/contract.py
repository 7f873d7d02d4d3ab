"""Population fingerprints, contract reports and result checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import counted

# Metric families a complete workflow result must hold.
METRIC_FAMILIES = (
    "event_scores",
    "ttd",
    "first_alarm_accuracy",
    "far",
    "coverage",
    "mtia",
    "nab",
    "pr_leadtime",
)


def row_mark(ts: Column) -> Column:
    """Number derived from a row's timestamp text; sums of it do not depend on row order."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def fingerprint(rows: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Order-free fingerprint of a population: count, first, last and mark sum."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.sum(row_mark(F.col(ts))).alias("mark_sum"),
    )


POPULATIONS = (
    "baseline",
    "baseline_train",
    "baseline_validation",
    "calibration",
    "post_train",
    "evaluation",
)


def population_report(timeline: DataFrame) -> DataFrame:
    """Rows and fingerprints of every population and of every cycle's anchors, in one pass.

    ``cycle_id`` is -1 for whole populations.
    """
    entries = [
        F.when(F.col(p), F.struct(F.lit(p).alias("population"), F.lit(-1).alias("cycle_id")))
        for p in POPULATIONS
    ]
    entries.append(
        F.when(
            F.col("evaluation") & F.col("cycle_id").isNotNull(),
            F.struct(F.lit("cycle_anchors").alias("population"), F.col("cycle_id")),
        )
    )
    tagged = timeline.select(
        "asset_id", "ts", F.explode(F.array_compact(F.array(*entries))).alias("p")
    ).select("asset_id", "p.*", "ts")
    return fingerprint(tagged, ["asset_id", "population", "cycle_id"])


def cycle_counts(timeline: DataFrame, cycles: DataFrame) -> DataFrame:
    """Evaluation anchors per cycle; cycles without anchors stay with 0."""
    anchors = (
        timeline.filter("evaluation AND cycle_id IS NOT NULL")
        .groupBy("asset_id", "cycle_id")
        .agg(F.count(F.lit(1)).alias("anchors"))
    )
    return cycles.select("asset_id", "cycle_id").join(
        anchors, ["asset_id", "cycle_id"], "left"
    ).withColumn("anchors", F.coalesce("anchors", F.lit(0)))


def evaluation_status(count: Column) -> Column:
    return F.when(count > 0, "scored").otherwise("no_evaluation_anchors")


def cycle_results(lineage: DataFrame, predictions: DataFrame) -> DataFrame:
    """One record per workflow, asset and cycle, also for cycles that scored nothing."""
    counts = predictions.groupBy("workflow_id", "asset_id", "cycle_id").agg(
        F.count(F.lit(1)).alias("prediction_count")
    )
    joined = lineage.join(counts, ["workflow_id", "asset_id", "cycle_id"], "left")
    return joined.withColumn(
        "prediction_count", F.coalesce("prediction_count", F.lit(0))
    ).withColumn("evaluation_status", evaluation_status(F.col("prediction_count")))


def cycle_problems(contract: DataFrame, results: DataFrame, workflows: Sequence[str]) -> DataFrame:
    """Contract against results per workflow and cycle: missing, unknown, count and status."""
    listed = F.explode(F.array(*[F.lit(w) for w in workflows])).alias("workflow_id")
    expected = contract.select(listed, "asset_id", "cycle_id", F.col("anchors").alias("_expected"))
    both = expected.join(results, ["workflow_id", "asset_id", "cycle_id"], "full_outer")
    problem = (
        F.when(F.col("_expected").isNull(), "unknown_cycle")
        .when(F.col("prediction_count").isNull(), "missing_cycle")
        .when(F.col("prediction_count") != F.col("_expected"), "population_size")
        .when(
            F.col("evaluation_status") != evaluation_status(F.col("_expected")),
            "evaluation_status",
        )
    )
    return both.select(
        "workflow_id", "asset_id", "cycle_id", problem.alias("problem")
    ).filter("problem IS NOT NULL")


def lineage_problems(lineage: DataFrame, cycles: DataFrame, workflows: Sequence[str]) -> DataFrame:
    """Cycles without exactly one lineage row, and models that lie after their cycle or were never fitted."""
    keys = ["workflow_id", "asset_id", "cycle_id"]
    listed = F.explode(F.array(*[F.lit(w) for w in workflows])).alias("workflow_id")
    found = lineage.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    missing = (
        cycles.select(listed, "asset_id", "cycle_id")
        .join(found, keys, "full_outer")
        .filter(F.coalesce("_rows", F.lit(0)) != 1)
        .select(*keys, F.lit("lineage_rows").alias("problem"))
    )
    model = F.col("effective_model_cycle")
    own = lineage.filter("model_status IN ('refitted', 'trained_initial')").select(
        "workflow_id", "asset_id", F.col("cycle_id").alias("_fitted")
    )
    foreign = lineage.join(
        own.withColumnsRenamed({"workflow_id": "_w", "asset_id": "_a"}),
        (F.col("workflow_id") == F.col("_w")) & (F.col("asset_id") == F.col("_a")) & (model == F.col("_fitted")),
        "left_anti",
    )
    later = lineage.filter(model > F.col("cycle_id")).unionByName(foreign).distinct()
    return missing.unionByName(later.select(*keys, F.lit("foreign_model").alias("problem")))


def row_cycle_problems(predictions: DataFrame, timeline: DataFrame) -> DataFrame:
    """Predictions whose cycle is not the one that the timeline gives their row.

    ``weight`` counts the timeline rows of the instant that say so: they are merged first, as pairs
    of rows and predictions that share an instant would grow with the square of its rows.
    """
    told = timeline.filter("evaluation").groupBy("asset_id", "us", F.col("cycle_id").alias("_cycle")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    return (
        predictions.join(told, ["asset_id", "us"], "left")
        .filter(~F.col("cycle_id").eqNullSafe(F.col("_cycle")))
        .withColumn("weight", F.coalesce("_rows", F.lit(1)))
        .drop("_rows")
    )


def row_total_problems(predictions: DataFrame, timeline: DataFrame, workflows: Sequence[str]) -> DataFrame:
    """Workflows and assets whose number of predictions is not that of their anchors."""
    listed = F.explode(F.array(*[F.lit(w) for w in workflows])).alias("workflow_id")
    keys = ["workflow_id", "asset_id"]
    wanted = timeline.groupBy("asset_id").agg(F.count_if("evaluation").alias("anchors"))
    got = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"))
    return (
        wanted.select(listed, "asset_id", "anchors")
        .join(got, keys, "full_outer")
        .filter(F.coalesce("anchors", F.lit(0)) != F.coalesce("predictions", F.lit(0)))
    )


def calibration_problems(calibration: DataFrame, lineage: DataFrame, timeline: DataFrame) -> DataFrame:
    """Models in use whose calibration anchors are not the asset's."""
    keys = ["workflow_id", "asset_id", "model_cycle"]
    used = lineage.select(
        "workflow_id", "asset_id", F.col("effective_model_cycle").alias("model_cycle")
    ).distinct()
    wanted = timeline.filter("calibration").select("asset_id", "us").join(used, "asset_id")
    return population_differences(wanted, calibration, [*keys, "us"])


def population_differences(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one population missing from the other, both ways."""
    keys = list(keys)
    return (
        expected.join(observed.select(*keys), keys, "left_anti")
        .select(*keys, F.lit("missing").alias("problem"))
        .unionByName(
            observed.join(expected.select(*keys), keys, "left_anti").select(
                *keys, F.lit("unexpected").alias("problem")
            )
        )
    )


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def check_summary(named: dict[str, DataFrame]) -> DataFrame:
    """Violations per check, so that a passing check still yields a row; a ``weight`` counts them."""
    parts = [
        df.agg(F.coalesce(F.sum(counted(df)), F.lit(0)).alias("violations")).select(
            F.lit(name).alias("check_name"), "violations"
        )
        for name, df in named.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def family_problems(
    metrics: DataFrame, workflows: Sequence[str], families: Sequence[str] = METRIC_FAMILIES
) -> DataFrame:
    """(workflow, family) pairs that stored results lack: no row, no column, or a null value."""
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(
        [(w, f) for w in workflows for f in families], "workflow_id string, family string"
    )
    found = [
        metrics.filter(F.col(f).isNotNull()).select("workflow_id", F.lit(f).alias("family"))
        for f in families
        if f in metrics.columns
    ]
    if not found:
        return wanted
    held = found[0]
    for more in found[1:]:
        held = held.unionByName(more)
    return wanted.join(held, ["workflow_id", "family"], "left_anti")


def absent(expected: Sequence[str], present: DataFrame, column: str) -> DataFrame:
    """Expected names that a table does not hold."""
    spark = present.sparkSession
    names = spark.createDataFrame([(e,) for e in expected], f"{column} string")
    return names.join(present.select(column).distinct(), column, "left_anti")
