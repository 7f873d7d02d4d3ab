"""From detector scores to calibrated risk, operating point and event metrics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grids import lead_times, theta_list
from ..operators import events as ev
from ..operators.calibration import empirical_risk, reference_scores, reference_summary
from ..operators.contract import cycle_results
from ..operators.lineage import model_lineage
from ..operators.risk import (
    alarm_flags,
    fleet_sweep,
    operating_point,
    segmented_risk,
    threshold_sweep,
)
from ..operators.runs import is_anchor
from ..session import materialize
from .study import Study

CALIBRATOR = ["workflow_id", "asset_id", "model_cycle"]
CYCLE = ["workflow_id", "asset_id", "cycle_id"]
INSTANT = ["workflow_id", "asset_id", "us"]


class Evaluation:
    """Shared evaluation of any number of workflows (a key column of every table)."""

    def __init__(
        self,
        study: Study,
        calibration: DataFrame,
        evaluation: DataFrame,
        workflows: dict[str, str],
    ) -> None:
        self.study = study
        self.params = study.params
        self.calibration = calibration
        self.scores = evaluation
        self.workflows = workflows

    @cached_property
    def thresholds(self) -> list[float]:
        return theta_list(self.params.theta_grid, self.params.extra_thresholds)

    @cached_property
    def reference(self) -> DataFrame:
        return reference_scores(self.calibration, "anomaly_score")

    @cached_property
    def calibration_summary(self) -> DataFrame:
        return reference_summary(self.reference, CALIBRATOR, "anomaly_score")

    @cached_property
    def risk(self) -> DataFrame:
        return materialize(
            empirical_risk(self.reference, self.scores, CALIBRATOR, "anomaly_score", "risk_score"),
            "risk",
        )

    @cached_property
    def predictions(self) -> DataFrame:
        smoothed = segmented_risk(
            self.risk, CYCLE, "us", "risk_score", self.params, self.study.slice_us
        )
        return materialize(
            smoothed.select(
                *CYCLE,
                "us",
                "phase",
                "anomaly_score",
                "risk_score",
                "maintenance_risk",
            ),
            "predictions",
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Every workflow and asset."""
        names = F.explode(F.array(*[F.lit(w) for w in self.workflows])).alias("workflow_id")
        return self.study.stats.select(names, "asset_id")

    @property
    def anchors(self) -> DataFrame:
        """The timeline's evaluation rows.

        ``linked`` says that the previous timeline row is evaluated too and belongs to the same
        run; ``chain`` is equal on rows linked to each other.
        """
        length, stride = self.params.sequence_length, self.params.stride
        linked = is_anchor(F.col("eval_pos") - 1, length, stride)
        chain = F.col("eval_run") if stride == 1 else F.col("us")
        return self.study.timeline.filter("evaluation").select(
            "asset_id", "us", linked.alias("linked"), chain.alias("chain")
        )

    def with_workflows(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(*[F.lit(w) for w in self.workflows])).alias("workflow_id"), "*")

    @cached_property
    def aligned(self) -> DataFrame:
        """Predictions on the timeline's evaluation rows of every workflow."""
        return self.with_workflows(self.anchors).join(
            self.predictions.select(*INSTANT, "maintenance_risk"), INSTANT, "left"
        )

    @cached_property
    def merged(self) -> DataFrame:
        """``aligned`` with its equal linked rows merged; ``weight`` counts them.

        Rows of an asset that share an instant meet all predictions of that instant, so their pairs
        grow with the square of its rows. Pairs that are linked and alike stand next to each other and open
        and close nothing between them, so they are counted and never made. A row that is not
        linked begins a run: its pairs stay apart.
        """
        anchors = self.anchors.groupBy("asset_id", "us", "linked", "chain").agg(
            F.count(F.lit(1)).alias("_anchors")
        )
        found = self.predictions.groupBy(*INSTANT, "maintenance_risk").agg(F.count(F.lit(1)).alias("_found"))
        pairs = F.col("_anchors") * F.coalesce("_found", F.lit(1))
        apart = F.array_repeat(F.lit(1).cast("bigint"), pairs.cast("int"))
        return self.with_workflows(anchors).join(found, INSTANT, "left").select(
            *INSTANT,
            "linked",
            "chain",
            "maintenance_risk",
            F.explode(F.when(F.col("linked"), F.array(pairs)).otherwise(apart)).alias("weight"),
        )

    @cached_property
    def asset_sweep(self) -> DataFrame:
        return threshold_sweep(
            self.merged,
            self.grid,
            self.study.events,
            self.thresholds,
            self.params,
            self.study.slice_us,
            self.study.stats,
        )

    @cached_property
    def sweep(self) -> DataFrame:
        return materialize(fleet_sweep(self.asset_sweep, self.params), "sweep")

    @cached_property
    def selected(self) -> DataFrame:
        return operating_point(self.sweep, self.params)

    @cached_property
    def alarms(self) -> DataFrame:
        """Alarm and ``weight`` of every row of ``merged``."""
        return materialize(alarm_flags(self.merged, self.selected), "alarms")

    @cached_property
    def intervals(self) -> DataFrame:
        return materialize(ev.alarm_intervals(self.alarms, self.study.slice_us), "intervals")

    @cached_property
    def listed(self) -> DataFrame:
        return ev.event_grid(self.grid, self.study.events)

    @cached_property
    def eligible(self) -> DataFrame:
        return materialize(
            ev.warned(
                self.intervals, self.study.events, self.params.lead_minutes, self.study.slice_us
            ),
            "eligible",
        )

    @cached_property
    def counts(self) -> DataFrame:
        return materialize(ev.interval_counts(self.intervals, self.grid), "counts")

    @cached_property
    def matches(self) -> DataFrame:
        return materialize(
            ev.greedy_match(self.eligible, self.listed, ev.KEYS), "matches"
        )

    @cached_property
    def event_scores(self) -> DataFrame:
        return ev.match_counts(self.matches, self.counts, [])

    @cached_property
    def leads(self) -> list[int]:
        p = self.params
        return lead_times(p.sensitivity_leads, p.lead_step_minutes, p.lead_minutes)

    @cached_property
    def lead_scores(self) -> DataFrame:
        matched = ev.lead_time_matches(
            self.intervals, self.listed, self.params, self.leads, self.study.slice_us
        )
        return ev.match_counts(matched, self.counts, ["lead_minutes"], "matched_no")

    @cached_property
    def ttd(self) -> DataFrame:
        return materialize(
            ev.time_to_detection(self.alarms, self.listed, self.params, self.study.slice_us), "ttd"
        )

    @cached_property
    def ttd_summary(self) -> DataFrame:
        return ev.ttd_summary(self.ttd)

    @cached_property
    def lead_histogram(self) -> DataFrame:
        return ev.lead_histogram(self.ttd, self.params)

    @cached_property
    def first_alarm(self) -> DataFrame:
        return ev.first_alarm_accuracy(self.eligible, self.grid)

    @cached_property
    def far(self) -> DataFrame:
        minutes = ev.evaluated_minutes(self.study.timeline, self.study.stats)
        return ev.false_alarm_rate(
            self.intervals, self.study.events, self.grid, minutes, self.params, self.study.slice_us
        )

    @cached_property
    def coverage(self) -> DataFrame:
        return ev.alarm_coverage(self.alarms)

    @cached_property
    def timed(self) -> DataFrame:
        return ev.with_duration(self.intervals, self.study.stats)

    @cached_property
    def mtia(self) -> DataFrame:
        return ev.time_in_alarm(self.timed, self.grid)

    @cached_property
    def nab(self) -> DataFrame:
        return ev.nab_scores(self.matches, self.listed, self.counts, self.params)

    @cached_property
    def islands(self) -> DataFrame:
        return materialize(
            ev.alarm_islands(self.timed, self.eligible, self.study.slice_us), "islands"
        )

    @cached_property
    def island_summary(self) -> DataFrame:
        return ev.island_summary(self.islands, self.coverage)

    @cached_property
    def metrics(self) -> DataFrame:
        """All metric families of a workflow in one row."""
        profiles = [n for n, *_ in ev.NAB_PROFILES]
        nab = self.nab.groupBy("workflow_id").agg(
            *[
                F.max(F.when(F.col("profile") == n, F.col("nab_score_normalized"))).alias(f"nab_{n}")
                for n in profiles
            ]
        )
        leads = self.lead_scores.groupBy("workflow_id").agg(
            F.sort_array(
                F.collect_list(F.struct("lead_minutes", "precision", "recall", "f1"))
            ).alias("pr_leadtime")
        )
        bins = self.lead_histogram.groupBy("workflow_id").agg(
            F.sort_array(F.collect_list(F.struct("bin", "events"))).alias("lead_bins")
        )
        families = {
            "event_scores": self.event_scores,
            "ttd": self.ttd_summary,
            "first_alarm_accuracy": self.first_alarm,
            "far": self.far,
            "coverage": self.coverage,
            "mtia": self.mtia,
        }
        out = self.grid.select("workflow_id").distinct()
        for name, table in families.items():
            fields = [c for c in table.columns if c != "workflow_id"]
            out = out.join(
                table.select("workflow_id", F.struct(*fields).alias(name)), "workflow_id", "left"
            )
        packed = nab.select("workflow_id", F.struct(*[f"nab_{n}" for n in profiles]).alias("nab"))
        return out.join(packed, "workflow_id", "left").join(leads, "workflow_id", "left").join(
            bins, "workflow_id", "left"
        )

    @cached_property
    def summary(self) -> DataFrame:
        """Workflow summary; one row per workflow."""
        islands = self.island_summary.select(
            "workflow_id",
            F.col("island_count").alias("alarm_islands"),
            F.col("false_alarm_island_count").alias("false_alarm_islands"),
        )
        picked = self.selected.select(
            "workflow_id", "selection_scope", "selection_mode", "maintenance_risk_theta"
        )
        return (
            picked.join(self.metrics, "workflow_id")
            .join(islands, "workflow_id")
            .select(
                "workflow_id",
                "selection_scope",
                "selection_mode",
                "maintenance_risk_theta",
                "event_scores.tp",
                "event_scores.fp",
                "event_scores.fn",
                "event_scores.precision",
                "event_scores.recall",
                "event_scores.f1",
                F.col("ttd.mean_ttd").alias("ttd_minutes"),
                F.col("first_alarm_accuracy.first_alarm_accuracy").alias("faa"),
                "far.far_per_day",
                F.col("coverage.alarm_coverage").alias("coverage"),
                F.col("coverage.alarm_coverage_percent").alias("coverage_percent"),
                "mtia.mtia_minutes",
                "nab.nab_standard",
                "nab.nab_low_fp",
                "nab.nab_low_fn",
                "alarm_islands",
                "false_alarm_islands",
            )
        )

    @cached_property
    def comparison(self) -> DataFrame:
        """Summaries in the configured workflow order (``position`` from 1)."""
        order = F.array(*[F.lit(w) for w in self.workflows])
        return self.summary.withColumn(
            "position", F.array_position(order, F.col("workflow_id")).cast("int")
        )

    @cached_property
    def lineage(self) -> DataFrame:
        return model_lineage(self.study.refits, self.workflows)

    @cached_property
    def results(self) -> DataFrame:
        return cycle_results(self.lineage, self.predictions)
