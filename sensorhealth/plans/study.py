"""A study: one telemetry table, its maintenance schedule, one set of parameters.

The schedule is a list of events that all assets share, or a table with the events of each asset
(``asset_id, start, end, event_id, severity``). An asset without events has no cycles and is not
scored.

Tables that several steps read are written once to the shared folder (``materialize``) and stay
there until ``session.delete_tables``, or the end of a ``session.temporary_tables`` block; nothing is
collected and nothing is kept between studies.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import cycle_plan
from ..operators.lineage import local_segments, refittable
from ..operators.populations import label_populations, series_stats, split_problems
from ..operators.rolling import (
    apply_scaler,
    feature_names,
    fill_across,
    fill_borders,
    fill_inside,
    fit_scaler,
    rolling_features,
    scaler_fit_problems,
    wide_scaler,
)
from ..operators.runs import median_gap
from ..operators.slices import floor_div, slice_width
from ..params import DAY_US, HOUR_US, StudyParams
from ..session import configure, materialize
from ..sources.maintenance import (
    COMPRESSOR_WINDOWS,
    FLEET_WINDOWS,
    check_schedule,
    every_asset,
    normalize_windows,
    schedule_problems,
    table_events,
)
from ..sources.telemetry import (
    COMPRESSOR_BINARY,
    COMPRESSOR_CHANNELS,
    SENSOR_BINARY,
    SENSOR_CHANNELS,
    duplicate_timestamps,
    load_telemetry,
    read_csv,
    sensor_adapter,
)

ASSET = ["asset_id"]
GROUP_ROWS = 200_000
#: Rows of one task, and of one slice where a window leaves room for it, while features are made.
FEATURE_ROWS = 100_000
# Timeline columns that scaling and scoring read next to the features.
LABELS = [
    "gap_us",
    "phase",
    "baseline",
    "baseline_train",
    "cycle_id",
    "update_cycle",
    "base_run",
    "base_pos",
    "src_run",
    "src_pos",
    "upd_run",
    "upd_pos",
    "calibration",
    "evaluation",
]


class Study:
    def __init__(
        self,
        spark: SparkSession,
        base: DataFrame,
        windows: Sequence[tuple[str, str, str, str]] | DataFrame,
        channels: Sequence[str],
        binary: Sequence[str],
        params: StudyParams | None = None,
    ) -> None:
        self.spark = configure(spark)
        self.base = base
        self.windows = windows
        self.channels = list(channels)
        self.binary = list(binary)
        self.params = params or StudyParams()
        self.features_list = feature_names(self.channels)

    @classmethod
    def from_tables(cls, spark: SparkSession, directory: str, params: StudyParams | None = None):
        """Study over the driver ``events`` table."""
        configure(spark)
        base = sensor_adapter(spark.read.parquet(f"{directory}/events.parquet"))
        return cls(spark, base, FLEET_WINDOWS, SENSOR_CHANNELS, SENSOR_BINARY, params)

    @classmethod
    def compressor(
        cls,
        spark: SparkSession,
        path: str,
        columns: Sequence[str],
        asset_column: str | None = None,
        params: StudyParams | None = None,
    ):
        """Study of compressor telemetry in CSV files (``columns`` in file order) and its known schedule."""
        configure(spark)
        base = load_telemetry(read_csv(spark, path, columns), COMPRESSOR_CHANNELS, asset_column=asset_column)
        return cls(spark, base, COMPRESSOR_WINDOWS, COMPRESSOR_CHANNELS, COMPRESSOR_BINARY, params)

    @cached_property
    def profile(self) -> Row:
        """Rows of the densest hour of an asset, and a fingerprint of every input row, in one pass.

        The fingerprint is a row count and two order-free sums of row hashes.
        """
        mark = F.xxhash64("asset_id", "us", *self.channels)
        hours = self.base.groupBy("asset_id", floor_div(F.col("us"), HOUR_US).alias("_hour")).agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(mark.cast("decimal(38,0)")).alias("_sum"),
            F.bit_xor(mark).alias("_mix"),
        )
        return hours.agg(
            F.coalesce(F.max("_n"), F.lit(0)).alias("busiest"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.sum("_sum").alias("mark_sum"),
            F.bit_xor("_mix").alias("mark_mix"),
        ).first()

    @cached_property
    def slice_us(self) -> int:
        if self.params.slice_us:
            return self.params.slice_us
        return slice_width(self.profile["busiest"], self.params.slice_rows)

    @cached_property
    def feature_us(self) -> int:
        """Width of the slices that features are made in."""
        return min(self.slice_us, slice_width(self.profile["busiest"], FEATURE_ROWS))

    @cached_property
    def feature_parts(self) -> int:
        """Tasks that make features: they grow with the rows, so that a task does not."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.profile["row_count"] // FEATURE_ROWS))

    @cached_property
    def sliced(self) -> DataFrame:
        return self.base.withColumn("slice", floor_div(F.col("us"), self.slice_us))

    @cached_property
    def stats(self) -> DataFrame:
        """Per asset: first and last row, row count and median sampling gap."""
        gaps = median_gap(self.sliced, ASSET, "us", "slice")
        return materialize(series_stats(self.base).join(gaps, "asset_id", "left"), "stats")

    @cached_property
    def events(self) -> DataFrame:
        """Maintenance events per asset (``ordinal`` by start)."""
        if isinstance(self.windows, DataFrame):
            known = self.scheduled.join(self.stats.select("asset_id"), "asset_id", "left_semi")
            return materialize(normalize_windows(known, ASSET), "events")
        check_schedule(self.windows)
        return normalize_windows(every_asset(self.stats.select("asset_id"), self.windows), ASSET)

    @cached_property
    def scheduled(self) -> DataFrame:
        """Every event of a schedule table as it stands, valid or not."""
        return table_events(self.windows)

    @cached_property
    def problems(self) -> DataFrame:
        """Input problems per asset (``asset_id, problem, findings``); the study goes on without them."""
        rows = self.timeline.groupBy("asset_id").agg(F.count_if("baseline").alias("baseline_rows"))
        train = self.feature_table.filter("baseline_train")
        found = {
            "duplicate_timestamp": duplicate_timestamps(self.base, ASSET, "us"),
            "short_baseline": split_problems(rows, self.params),
            "non_finite_scaler_fit": scaler_fit_problems(train, ASSET, self.features_list),
            "empty_scaler_fit": self.stats.join(train.select("asset_id"), "asset_id", "left_anti"),
        }
        if isinstance(self.windows, DataFrame):
            found["invalid_event"] = schedule_problems(self.scheduled, ASSET)
            found["no_event"] = self.stats.join(self.events, "asset_id", "left_anti")
        parts = [
            df.groupBy("asset_id").agg(F.count(F.lit(1)).alias("findings")).select(
                "asset_id", F.lit(name).alias("problem"), "findings"
            )
            for name, df in found.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def cycles(self) -> DataFrame:
        return materialize(cycle_plan(self.base, self.events, self.stats, self.params, self.slice_us), "cycles")

    @cached_property
    def segments(self) -> DataFrame:
        """Contiguous local pieces of the update intervals."""
        return local_segments(self.timeline, self.params.sequence_length)

    @cached_property
    def refits(self) -> DataFrame:
        """The cycle plan whose ``update_possible`` is what adaptive workflows really refit."""
        return materialize(refittable(self.cycles, self.segments), "refits")

    @cached_property
    def timeline(self) -> DataFrame:
        """Labelled timeline; it carries the channels so that no later step joins rows back."""
        labelled = label_populations(
            self.base,
            self.events,
            self.stats,
            self.cycles,
            self.params,
            self.slice_us,
            self.channels,
        )
        return materialize(labelled, "timeline")

    def with_features(self, rows: DataFrame) -> DataFrame:
        """Filled rolling features next to every other column of ``rows``.

        Features are filled inside the slices that they are computed in, and written once; what a
        slice takes from others is a small table that every read joins.
        """
        others = [c for c in rows.columns if c not in ("slice", *ASSET, "us", *self.channels)]
        rolled = rolling_features(
            rows,
            ASSET,
            "us",
            "_filled",
            self.feature_us,
            self.channels,
            self.params.rolling_us,
            others=others,
            parts=self.feature_parts,
        )
        names = self.features_list
        written = materialize(fill_inside(rolled, ASSET, "us", "_filled", names), "features")
        borders = materialize(fill_borders(written, ASSET, "us", "_filled", names), "feature-borders")
        filled = fill_across(written, borders, ASSET, "_filled", names).drop("_filled")
        return filled.withColumn("slice", floor_div(F.col("us"), self.slice_us))

    @cached_property
    def features(self) -> DataFrame:
        """Features of the raw telemetry, without populations."""
        return self.with_features(self.base)

    @cached_property
    def feature_table(self) -> DataFrame:
        """Labelled timeline with features."""
        return self.with_features(self.timeline.select(*ASSET, "us", *LABELS, *self.channels))

    @cached_property
    def scaler(self) -> DataFrame:
        train = self.feature_table.filter("baseline_train")
        return materialize(fit_scaler(train, ASSET, self.features_list, self.binary), "scaler")

    @cached_property
    def scaled(self) -> DataFrame:
        names = self.features_list
        wide = materialize(wide_scaler(self.scaler, ASSET, names), "wide-scaler")
        return apply_scaler(self.feature_table, wide, ASSET, names)

    @cached_property
    def group_us(self) -> int:
        """Time span of one Python group: as wide as its row target allows."""
        return slice_width(self.profile["busiest"], GROUP_ROWS, cap=10 * 366 * DAY_US)
