"""Candidate evaluation: a finite set of reconstruction models scored in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import diagnostics, with_status
from ..operators.lineage import STATIC
from ..operators.reconstruction import mean_smape, windows_holding
from ..session import materialize
from .detectors import MODEL, Detectors
from .evaluation import Evaluation


def candidate_models(detectors: Detectors, ranks: Sequence[int]) -> DataFrame:
    """One model per candidate: the leading components of a common decomposition."""
    largest = detectors.components(STATIC)
    listed = F.explode(F.array(*[F.lit(r) for r in ranks])).alias("rank")
    return largest.select(*MODEL, "mean", "components", listed).select(
        F.concat(F.lit("linear_"), F.col("rank").cast("string")).alias("workflow_id"),
        *MODEL,
        "mean",
        F.slice("components", F.lit(1), F.col("rank")).alias("components"),
    )


def evaluate_candidates(detectors: Detectors, ranks: Sequence[int]) -> DataFrame:
    """Reconstruction error, missed early warning and alarm burden of every candidate.

    The candidate is a key column next to the asset, from the row errors to the objectives; all
    scoring uses the rows and anchors of cycle 0.
    """
    study, params = detectors.study, detectors.params
    length = params.sequence_length
    models = materialize(candidate_models(detectors, ranks), "candidates")
    keys, names = ["workflow_id", *MODEL], ("workflow_id", "model_cycle")

    labels = ["us", "slice", "gap_us", "phase", "features"]
    baseline = detectors.rows.filter("baseline").select(
        "asset_id", *labels, F.col("base_run").alias("run"), F.col("base_pos").alias("pos"), "calibration"
    )
    source = detectors.rows.filter("cycle_id = 0")
    sizes = source.groupBy("asset_id", "src_run").agg(F.count(F.lit(1)).alias("_n"))
    source = source.join(sizes, ["asset_id", "src_run"]).select(
        "asset_id",
        *labels,
        F.col("src_run").alias("run"),
        F.col("src_pos").alias("pos"),
        "evaluation",
        windows_holding(F.col("src_pos"), F.col("_n"), length).alias("holding"),
    )
    errors_c = materialize(detectors.errors_under_all(baseline, models, names, smape=False), "candidate-calibration")
    errors_e = materialize(detectors.errors_under_all(source, models, names), "candidate-source")

    smape = mean_smape(errors_e, ["workflow_id"], len(study.features_list)).select(
        "workflow_id", F.col("smape").alias("obj_error")
    )
    calibration = detectors.windowed_by(errors_c, keys, "run", "pos", "row_mse").filter("calibration")
    anchors = detectors.windowed_by(errors_e, keys, "run", "pos", "row_mse").filter("evaluation")
    workflows = {f"linear_{r}": STATIC for r in ranks}
    evaluation = Evaluation(
        study,
        calibration.select(*keys, "us", "anomaly_score"),
        anchors.select(*keys, "us", "anomaly_score", F.lit(0).alias("cycle_id"), "phase"),
        workflows,
    )
    labelled = evaluation.predictions.withColumn("_positive", F.col("phase") == 1)
    searched = diagnostics(labelled, ["workflow_id"], "maintenance_risk", "_positive", params)
    return with_status(searched.join(smape, "workflow_id", "left"), params.invalid_penalty)
