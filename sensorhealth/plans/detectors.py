"""Scores of the detectors at calibration and evaluation anchors.

Every function returns a pair of tables with the same columns
``workflow_id, asset_id, model_cycle, us, anomaly_score`` (the evaluation table also has
``cycle_id`` and ``phase``).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.forest import fit_forest, score_forest
from ..operators.lineage import (
    PER_MAINTENANCE,
    STATIC,
    baseline_windows,
    is_even_pick,
    model_lineage,
    picks_before,
    replay_windows,
    split_policy,
    split_segments,
    training_mix,
)
from ..operators.reconstruction import (
    chained,
    decomposed,
    mean_smape,
    reconstruct,
    row_errors,
    row_moments,
    squared_error,
    summed_smape,
    windows_holding,
)
from ..operators.runs import label_runs, mean_over_sequence
from ..operators.sequences import score_windows, window_moments
from ..session import materialize
from .study import LABELS, Study

MODEL = ["asset_id", "model_cycle"]
COLUMNS = ["workflow_id", "asset_id", "model_cycle", "us", "anomaly_score"]


class Detectors:
    def __init__(self, study: Study) -> None:
        self.study = study
        self.params = study.params

    # Rows -------------------------------------------------------------------------------------

    @cached_property
    def rows(self) -> DataFrame:
        """Scaled features as one array next to the population labels.

        After filling, a feature is missing for a whole asset or not at all. Such assets have no
        feature vector: they train no model and their anchors keep an undefined score.
        """
        vector = F.array(*self.study.features_list)
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.study.features_list])
        scaled = self.study.scaled.select(
            "asset_id", "us", "slice", *LABELS, F.when(complete, vector).alias("features")
        )
        return materialize(scaled, "vectors")

    def anchor_rows(self, labels: list[str]) -> tuple[DataFrame, DataFrame]:
        calibration = self.rows.filter("calibration").select("asset_id", "us", *labels)
        evaluation = self.rows.filter("evaluation").select(
            "asset_id", "us", "cycle_id", "phase", *labels
        )
        return calibration, evaluation

    def windowed(self, rows: DataFrame, run: str, score: str) -> DataFrame:
        """Mean of a row score over the sequence window that ends at each row.

        ``run`` names a run; its position column is called likewise.
        """
        return self.windowed_by(rows, MODEL, f"{run}_run", f"{run}_pos", score)

    def windowed_by(
        self, rows: DataFrame, keys: list[str], run: str, position: str, score: str
    ) -> DataFrame:
        length = self.params.sequence_length
        return mean_over_sequence(rows, keys, run, position, length, score, "anomaly_score")

    # Plain distance scores ----------------------------------------------------------------------

    @cached_property
    def distance_rows(self) -> DataFrame:
        """Reconstruction error of the model that always predicts the baseline mean."""
        squares = F.transform("features", lambda x: x * x)
        total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
        return self.rows.select(
            "asset_id",
            "us",
            "slice",
            "gap_us",
            "phase",
            "cycle_id",
            "base_run",
            "base_pos",
            "src_run",
            "src_pos",
            "calibration",
            "evaluation",
            F.lit(0).alias("model_cycle"),
            (total / len(self.study.features_list)).alias("row_score"),
        )

    def distance_scores(self, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Workflows ``distance_row`` (anchor row) and ``distance_window`` (whole window)."""
        rows = materialize(self.distance_rows if rows is None else rows, "distance")
        windows_c = self.windowed(rows, "base", "row_score").filter("calibration")
        windows_e = self.windowed(rows, "src", "row_score").filter("evaluation")
        named = lambda df, w, s, *more: df.select(
            F.lit(w).alias("workflow_id"), *MODEL, "us", F.col(s).alias("anomaly_score"), *more
        )
        calibration = named(rows.filter("calibration"), "distance_row", "row_score").unionByName(
            named(windows_c, "distance_window", "anomaly_score")
        )
        extra = ("cycle_id", "phase")
        evaluation = named(
            rows.filter("evaluation"), "distance_row", "row_score", *extra
        ).unionByName(named(windows_e, "distance_window", "anomaly_score", *extra))
        return calibration, evaluation

    # Lineage and training populations -------------------------------------------------------------

    def lineage(self, workflow: str, strategy: str) -> DataFrame:
        return model_lineage(self.study.refits, {workflow: strategy})

    @property
    def segments(self) -> DataFrame:
        return self.study.segments

    @cached_property
    def split(self) -> DataFrame:
        return split_segments(self.segments, self.params)

    @cached_property
    def policy(self) -> DataFrame:
        baseline = baseline_windows(self.study.timeline, self.params.sequence_length)
        return split_policy(self.segments, self.split, baseline, self.params)

    @cached_property
    def numbered_windows(self) -> DataFrame:
        """Baseline training windows numbered per asset, in time order."""
        rows = self.study.timeline.select(
            "asset_id",
            "us",
            "slice",
            F.lit(None).cast("double").alias("gap_us"),
            F.when(
                F.col("baseline_train") & (F.col("base_pos") >= self.params.sequence_length),
                F.lit(0),
            ).alias("_sel"),
        )
        numbered = label_runs(rows, ["asset_id"], "us", "slice", {"win": "_sel"})
        return numbered.filter("_sel IS NOT NULL").select(
            "asset_id", "us", (F.col("win_ord") - 1).alias("window_no")
        )

    @cached_property
    def mix(self) -> DataFrame:
        return training_mix(
            self.study.timeline, self.split, replay_windows(self.numbered_windows, self.policy)
        )

    def refit_cycles(self) -> DataFrame:
        return self.study.refits.filter("update_possible").select(
            "asset_id", F.col("cycle_id").alias("model_cycle")
        )

    # Isolation forest -----------------------------------------------------------------------------

    def forest_training(self, strategy: str) -> DataFrame:
        """Baseline training rows, plus the rows of the cycle's own update interval.

        Each row is there once, with the list of the models it trains (``model_cycles``).
        """
        known = self.rows.filter("features IS NOT NULL")
        base = known.filter("baseline_train").select("asset_id", "us", "features")
        if strategy == STATIC:
            return base.withColumn("model_cycles", F.array(F.lit(0)))
        refits = self.refit_cycles()
        every = refits.groupBy("asset_id").agg(F.collect_list("model_cycle").alias("model_cycles"))
        local = known.filter("update_cycle IS NOT NULL").select(
            "asset_id", "us", "features", F.col("update_cycle").alias("model_cycle")
        )
        own = local.join(refits, MODEL, "left_semi").select(
            "asset_id", "us", "features", F.array("model_cycle").alias("model_cycles")
        )
        return base.join(every, "asset_id").unionByName(own)

    def forest(self, strategy: str) -> DataFrame:
        p = self.params
        return materialize(
            fit_forest(
                self.forest_training(strategy),
                MODEL,
                "us",
                "features",
                trees=p.trees,
                tree_rows=p.tree_rows,
                seed=p.seed,
                many="model_cycle",
            ),
            "forest",
        )

    def model_rows(self, lineage: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
        """Anchors, each once, with the models that score them (``model_cycles``).

        Calibration anchors meet every model their asset uses, evaluation anchors the one of their
        cycle.
        """
        calibration, evaluation = self.anchor_rows(labels)
        model = F.col("effective_model_cycle")
        used = lineage.groupBy("asset_id").agg(F.collect_set(model).alias("model_cycles"))
        by_cycle = lineage.select("asset_id", "cycle_id", F.array(model).alias("model_cycles"))
        return calibration.join(used, "asset_id"), evaluation.join(by_cycle, ["asset_id", "cycle_id"])

    def forest_scores(self, workflow: str, strategy: str) -> tuple[DataFrame, DataFrame]:
        lineage = self.lineage(workflow, strategy)
        forest = self.forest(strategy)
        calibration, evaluation = self.model_rows(lineage, ["features"])
        name = F.lit(workflow).alias("workflow_id")

        def score(anchors: DataFrame, *more: str) -> DataFrame:
            return self.forest_anchor_scores(anchors, forest, *more).select(name, *COLUMNS[1:], *more)

        return score(calibration), score(evaluation, "cycle_id", "phase")

    def forest_anchor_scores(self, anchors: DataFrame, forest: DataFrame, *more: str) -> DataFrame:
        """Scores of anchors under each of their models, null without a feature vector."""
        width = self.study.group_us
        return score_forest(
            anchors, forest, MODEL, "us", "features", width, many="model_cycle", others=more
        )

    # Linear reconstruction ------------------------------------------------------------------------

    def component_training(self, strategy: str) -> DataFrame:
        """Training rows weighted by the number of training windows that hold them."""
        length = self.params.sequence_length
        baseline = self.rows.filter("baseline_train AND features IS NOT NULL")
        sizes = baseline.groupBy("asset_id", "base_run").agg(F.count(F.lit(1)).alias("_n"))
        initial = (
            baseline.join(sizes, ["asset_id", "base_run"])
            .select(
                "asset_id",
                F.lit(0).alias("model_cycle"),
                "features",
                windows_holding(F.col("base_pos"), F.col("_n"), length).alias("weight"),
            )
            .filter("weight > 0")
        )
        if strategy == STATIC:
            return initial
        return initial.unionByName(self.mixed_rows)

    @property
    def baseline_runs(self) -> tuple[DataFrame, DataFrame]:
        """Runs of baseline training rows with the windows before them, and each asset's refits."""
        length = self.params.sequence_length
        baseline = self.rows.filter("baseline_train AND features IS NOT NULL")
        by_asset = Window.partitionBy("asset_id").orderBy("base_run")
        runs = baseline.groupBy("asset_id", "base_run").agg(F.count(F.lit(1)).alias("_n"))
        windows = F.greatest(F.lit(0), F.col("_n") - (length - 1))
        before = F.sum(windows).over(by_asset.rowsBetween(Window.unboundedPreceding, -1))
        wanted = self.policy.filter("baseline_replay_windows > 0").groupBy("asset_id").agg(
            F.collect_list(
                F.struct("cycle_id", "baseline_total_windows", "baseline_replay_windows")
            ).alias("_refits")
        )
        return runs.select("asset_id", "base_run", "_n", F.coalesce(before, F.lit(0)).alias("_before")), wanted

    @property
    def local_pieces(self) -> DataFrame:
        """Runs of update rows with the rows before their first window and their training windows."""
        return self.split.select(
            "asset_id",
            F.col("cycle_id").alias("update_cycle"),
            F.col("run_us").alias("upd_run"),
            (F.col("row_count") - F.col("windows")).alias("_skipped"),
            "train_windows",
        )

    @cached_property
    def mixed_rows(self) -> DataFrame:
        """Rows of the training windows of every refit, once per refit, with their window counts.

        The windows that hold a row end at it or up to one window length later in its run, so how
        many of them a refit uses is a difference of ranks: no window is joined to its rows.
        """
        length = self.params.sequence_length
        known = self.rows.filter("features IS NOT NULL")
        baseline = known.filter("baseline_train")
        runs, wanted = self.baseline_runs
        position = F.col("base_pos")
        first = F.col("_before") + F.greatest(position, F.lit(length)) - length
        last = F.col("_before") + F.least(position + (length - 1), F.col("_n")) - length

        def picked(refit):
            total, count = refit["baseline_total_windows"], refit["baseline_replay_windows"]
            return picks_before(last + 1, total, count) - picks_before(first, total, count)

        replayed = (
            baseline.join(runs, ["asset_id", "base_run"])
            .filter(F.col("_n") >= length)
            .join(wanted, "asset_id")
            .select(
                "asset_id",
                "features",
                F.explode(
                    F.transform("_refits", lambda r: F.struct(r["cycle_id"], picked(r).alias("weight")))
                ).alias("_r"),
            )
            .select("asset_id", F.col("_r.cycle_id").alias("model_cycle"), "features", "_r.weight")
        )
        end = F.col("_skipped") + F.col("train_windows")
        held = F.least(end, F.col("upd_pos") + (length - 1)) - F.greatest(
            F.col("_skipped"), F.col("upd_pos") - 1
        )
        local = (
            known.filter("update_cycle IS NOT NULL")
            .join(self.local_pieces, ["asset_id", "update_cycle", "upd_run"])
            .select("asset_id", F.col("update_cycle").alias("model_cycle"), "features", held.alias("weight"))
        )
        return (
            replayed.unionByName(local)
            .filter("weight > 0")
            .withColumn("weight", F.col("weight").cast("bigint"))
        )

    def adapted(self, moments: DataFrame, strategy: str) -> DataFrame:
        """Moments of adaptive models, each of which starts from the model refitted before it."""
        if strategy == STATIC:
            return moments
        return chained(moments, MODEL, "model_cycle", self.params.adaptation_memory)

    def components(self, strategy: str) -> DataFrame:
        size = len(self.study.features_list)
        moments = row_moments(self.component_training(strategy), MODEL, "features", size)
        fitted = decomposed(self.adapted(moments, strategy), MODEL, size, self.params.components)
        return materialize(fitted, "components")

    # Linear reconstruction of whole windows --------------------------------------------------------

    def sequence_moments(self, strategy: str) -> DataFrame:
        """Moments of the training windows of every model, before any adaptation.

        Baseline windows train model 0 and the refits that replay them, local windows their refit.
        """
        length = self.params.sequence_length
        known = self.rows.filter("features IS NOT NULL")
        baseline = known.filter("baseline_train")
        zero = F.array(F.lit(0))
        if strategy == STATIC:
            listed = baseline.withColumn("model_cycles", zero)
        else:
            runs, wanted = self.baseline_runs
            number = F.col("_before") + F.col("base_pos") - length
            picks = F.filter(
                "_refits",
                lambda r: is_even_pick(number, r["baseline_total_windows"], r["baseline_replay_windows"]),
            )
            replayed = F.coalesce(F.concat(zero, F.transform(picks, lambda r: r["cycle_id"])), zero)
            listed = (
                baseline.join(runs, ["asset_id", "base_run"])
                .join(wanted, "asset_id", "left")
                .withColumn("model_cycles", replayed)
            )
        of = lambda rows, run, position: window_moments(
            rows, ["asset_id"], run, position, "features", "model_cycles", "model_cycle", length
        )
        moments = of(listed, "base_run", "base_pos")
        if strategy == STATIC:
            return moments
        place = F.col("upd_pos") - F.col("_skipped")
        trains = (place >= 1) & (place <= F.col("train_windows"))
        local = (
            known.filter("update_cycle IS NOT NULL")
            .join(self.local_pieces, ["asset_id", "update_cycle", "upd_run"])
            .withColumn("model_cycles", F.when(trains, F.array("update_cycle")))
        )
        both = moments.unionByName(of(local, "upd_run", "upd_pos"))
        return both.groupBy(*MODEL, "cell").agg(F.sum("amount").alias("amount"))

    def sequence_components(self, strategy: str) -> DataFrame:
        size = len(self.study.features_list) * self.params.sequence_length
        moments = self.adapted(self.sequence_moments(strategy), strategy)
        return materialize(decomposed(moments, MODEL, size, self.params.components), "sequence-components")

    def sequence_errors(
        self, rows: DataFrame, run: str, position: str, models: DataFrame, *others: str
    ) -> DataFrame:
        """Error of the window at every row under each of its ``model_cycles``."""
        return score_windows(
            rows,
            models,
            ["asset_id"],
            "us",
            run,
            position,
            "features",
            "model_cycles",
            "model_cycle",
            self.params.sequence_length,
            self.study.group_us,
            others,
        )

    def sequence_scores(self, workflow: str, strategy: str) -> tuple[DataFrame, DataFrame]:
        """Scores of windows as ordered sequences at every anchor."""
        lineage = self.lineage(workflow, strategy)
        models = self.sequence_components(strategy)
        model = F.col("effective_model_cycle")
        used = lineage.groupBy("asset_id").agg(F.collect_set(model).alias("_used"))
        by_cycle = lineage.select("asset_id", "cycle_id", F.array(model).alias("_used"))
        listed = lambda flag: F.when(F.col(flag), F.col("_used"))
        baseline = self.rows.filter("baseline").join(used, "asset_id").withColumn("model_cycles", listed("calibration"))
        source = self.rows.filter("src_run IS NOT NULL").join(by_cycle, ["asset_id", "cycle_id"])
        source = source.withColumn("model_cycles", listed("evaluation"))
        name = F.lit(workflow).alias("workflow_id")
        extra = ("cycle_id", "phase")
        return (
            self.sequence_errors(baseline, "base_run", "base_pos", models).select(name, *COLUMNS[1:]),
            self.sequence_errors(source, "src_run", "src_pos", models, *extra).select(name, *COLUMNS[1:], *extra),
        )

    def reconstruction_rows(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        """Errors of rows under the one model of their ``model_cycle``."""
        return self.row_errors_of(
            rows.join(models.select(*MODEL, "mean", "components"), MODEL, "left")
        )

    def row_errors_of(self, fitted: DataFrame) -> DataFrame:
        rebuilt = reconstruct(F.col("features"), F.col("mean"), F.col("components"))
        return row_errors(fitted.withColumn("_fit", rebuilt), "features").drop(
            "_fit", "mean", "components", "features"
        )

    def errors_under_all(
        self, rows: DataFrame, models: DataFrame, names: tuple[str, ...] = ("model_cycle",), smape: bool = True
    ) -> DataFrame:
        """``row_mse`` and (with ``smape``) ``row_smape`` of rows under every model of their asset.

        An asset's models (told apart by ``names``) are one row, so its rows meet them all at once and
        are copied afterwards, without their features.
        """
        listed = models.groupBy("asset_id").agg(
            F.collect_list(F.struct(*names, "mean", "components")).alias("_models")
        )

        def error(m):
            own = F.col("features")
            rebuilt = reconstruct(own, m["mean"], m["components"])
            return F.transform(
                F.array(rebuilt),
                lambda r: F.struct(
                    *[m[n].alias(n) for n in names],
                    squared_error(r, own).alias("row_mse"),
                    *([summed_smape(r, own).alias("row_smape")] if smape else []),
                ),
            )[0]

        return (
            rows.join(listed, "asset_id")
            .withColumn("_e", F.explode(F.transform("_models", error)))
            .select(*[c for c in rows.columns if c != "features"], "_e.*")
        )

    def component_rows(
        self, workflow: str, strategy: str, rank: int | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """``row_mse`` of baseline rows under every model in use, and of source rows under theirs.

        ``rank`` keeps so many leading components; 0 leaves the mean of each model's training mix.
        """
        models = self.lineage(workflow, strategy).select(
            "asset_id", "cycle_id", F.col("effective_model_cycle").alias("model_cycle")
        )
        fitted = self.components(strategy)
        if rank is not None:
            fitted = fitted.withColumn("components", F.slice("components", 1, rank))
        labels = ["us", "slice", "gap_us", "phase", "features"]
        baseline = self.rows.filter("baseline").select(
            "asset_id", *labels, "base_run", "base_pos", "calibration"
        )
        source = self.rows.filter("src_run IS NOT NULL").select(
            "asset_id", *labels, "src_run", "src_pos", "cycle_id", "evaluation"
        )
        return (
            self.errors_under_all(
                baseline,
                models.select(*MODEL).distinct().join(fitted.select(*MODEL, "mean", "components"), MODEL, "left"),
                smape=False,
            ),
            self.reconstruction_rows(source.join(models, ["asset_id", "cycle_id"]), fitted),
        )

    def window_scores(
        self, workflow: str, calibration: DataFrame, evaluation: DataFrame
    ) -> tuple[DataFrame, DataFrame]:
        """Mean row error of the sequence window at every anchor."""
        name = F.lit(workflow).alias("workflow_id")
        scored_c = self.windowed(calibration, "base", "row_mse")
        scored_e = self.windowed(evaluation, "src", "row_mse")
        return (
            scored_c.filter("calibration").select(name, *COLUMNS[1:]),
            scored_e.filter("evaluation").select(name, *COLUMNS[1:], "cycle_id", "phase"),
        )

    def component_scores(self, workflow: str, strategy: str) -> tuple[DataFrame, DataFrame]:
        return self.window_scores(workflow, *self.component_rows(workflow, strategy))

    def smape(self, models: DataFrame, keys: list[str]) -> DataFrame:
        """Reconstruction SMAPE over all windows of the cycle-0 source rows."""
        length = self.params.sequence_length
        source = self.rows.filter("cycle_id = 0")
        sizes = source.groupBy("asset_id", "src_run").agg(F.count(F.lit(1)).alias("_n"))
        rows = (
            source.join(sizes, ["asset_id", "src_run"])
            .withColumn("holding", windows_holding(F.col("src_pos"), F.col("_n"), length))
            .filter("holding > 0")
            .select("asset_id", "us", "features", "holding", F.lit(0).alias("model_cycle"))
        )
        return mean_smape(
            self.reconstruction_rows(rows, models), keys, len(self.study.features_list)
        )


STRATEGIES = {
    "iforest_static": STATIC,
    "iforest_per_maintenance": PER_MAINTENANCE,
    "linear_static": STATIC,
    "linear_per_maintenance": PER_MAINTENANCE,
    "sequence_static": STATIC,
    "sequence_per_maintenance": PER_MAINTENANCE,
}


def workflow_scores(detectors: Detectors, workflow: str) -> tuple[DataFrame, DataFrame]:
    """Scores of one of the study's workflows."""
    strategy = STRATEGIES[workflow]
    if workflow.startswith("iforest"):
        return detectors.forest_scores(workflow, strategy)
    if workflow.startswith("sequence"):
        return detectors.sequence_scores(workflow, strategy)
    return detectors.component_scores(workflow, strategy)
