"""Alarm intervals and event-level early-warning metrics.

Keys are ``workflow_id, asset_id``; metrics match events inside one asset and are summed over
assets before ratios are formed, so a single asset gives the single-series metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between, share
from ..params import DAY_US, MINUTE_US, NAB_PROFILES, StudyParams
from .calendar import buckets
from .risk import with_ratios
from .runs import label_runs, run_segments
from .slices import carried, counted, floor_div, grouped_median

KEYS = ["workflow_id", "asset_id"]


def alarm_intervals(alarms: DataFrame, width: int) -> DataFrame:
    """Alarm islands: ``workflow_id, asset_id, start_us, end_us, row_count``.

    ``alarms`` holds every evaluated row with ``alarm`` and ``chain``, equal on rows that follow
    each other on the full timeline without a gap; a column ``weight`` counts a row several times.
    """
    rows = alarms.select(
        *KEYS,
        "us",
        counted(alarms).alias("weight"),
        F.when(F.col("alarm"), F.col("chain")).alias("_sel"),
        floor_div(F.col("us"), width).alias("_slice"),
        F.lit(None).cast("double").alias("gap_us"),
    )
    labelled = label_runs(rows, KEYS, "us", "_slice", {"alarm": "_sel"})
    return run_segments(labelled, KEYS, "us", "alarm_run").drop("alarm_run")


def warned(
    intervals: DataFrame, events: DataFrame, lead_minutes: int, width: int = DAY_US
) -> DataFrame:
    """Overlap join: an interval may warn of an event it reaches within the lead time.

    Intervals and warning windows are listed for every time bucket they touch and meet in the first
    bucket that both of them touch, so a pair is found once and no asset is compared as a whole.
    """
    warning = F.col("start_us") - lead_minutes * MINUTE_US
    right = events.select(
        F.col("asset_id").alias("_asset"),
        "ordinal",
        F.col("start_us").alias("event_start_us"),
        F.col("end_us").alias("event_end_us"),
        warning.alias("warning_us"),
        buckets(warning, F.col("start_us"), width).alias("_touched"),
    )
    left = intervals.withColumn("_bucket", buckets(F.col("start_us"), F.col("end_us"), width))
    first = floor_div(F.greatest("start_us", "warning_us"), width)
    condition = (
        (F.col("asset_id") == F.col("_asset"))
        & (F.col("_bucket") == F.col("_touched"))
        & (F.col("start_us") <= F.col("event_start_us"))
        & (F.col("end_us") >= F.col("warning_us"))
        & (F.col("_bucket") == first)
    )
    return left.join(right, condition).drop("_asset", "_bucket", "_touched")


def greedy_match(
    eligible: DataFrame, event_grid: DataFrame, keys: list[str]
) -> DataFrame:
    """One-to-one assignment: events in order of start each take the first unused interval.

    ``eligible`` has ``keys, ordinal, start_us``; ``event_grid`` lists ``keys, ordinal`` for every
    event. Intervals are disjoint and the eligible spans move forward, so "unused" means "starts
    after the last one taken", and an event never needs more of its first intervals than its key has
    events: each earlier event takes one of them at most. Adds ``matched_us``, null for a missed event.
    """
    first = Window.partitionBy(*keys, "ordinal").orderBy("start_us")
    events_of = event_grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("_events"))
    short = (
        eligible.select(*keys, "ordinal", "start_us", F.row_number().over(first).alias("_rank"))
        .join(events_of, keys)
        .filter(F.col("_rank") <= F.col("_events"))
        .groupBy(*keys, "ordinal")
        .agg(F.array_sort(F.collect_list("start_us")).alias("_starts"))
    )
    folded = (
        event_grid.select(*keys, "ordinal")
        .join(short, [*keys, "ordinal"], "left")
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("ordinal", F.coalesce("_starts", F.expr("cast(array() as array<bigint>)")).alias("starts"))
                )
            ).alias("_events")
        )
        .withColumn(
            "_taken",
            F.expr(
                """aggregate(_events,
                     struct(cast(-9000000000000000000 as bigint) as last,
                            cast(array() as array<struct<ordinal:int,matched_us:bigint>>) as taken),
                     (a, e) -> struct(
                         coalesce(get(filter(e.starts, s -> s > a.last), 0), a.last) as last,
                         concat(a.taken, array(struct(e.ordinal as ordinal,
                             get(filter(e.starts, s -> s > a.last), 0) as matched_us))) as taken),
                     a -> a.taken)"""
            ),
        )
    )
    return folded.select(*keys, F.explode("_taken").alias("t")).select(*keys, "t.*")


def interval_counts(intervals: DataFrame, grid: DataFrame) -> DataFrame:
    counts = intervals.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("intervals"))
    return grid.join(counts, KEYS, "left").withColumn("intervals", F.coalesce("intervals", F.lit(0)))


def event_grid(grid: DataFrame, events: DataFrame) -> DataFrame:
    """Every workflow, asset and event."""
    return grid.join(
        events.select("asset_id", "ordinal", "event_id", "start_us", "end_us"), "asset_id"
    )


def match_counts(
    matches: DataFrame, counts: DataFrame, extra: list[str], matched: str = "matched_us"
) -> DataFrame:
    """Fleet ``tp, fp, fn`` and ratios per workflow (and ``extra`` keys)."""
    per_asset = matches.groupBy(*KEYS, *extra).agg(
        F.count(matched).alias("tp"), F.count(F.lit(1)).alias("_events")
    )
    summed = (
        per_asset.join(counts, KEYS)
        .groupBy("workflow_id", *extra)
        .agg(
            F.sum("tp").alias("tp"),
            F.sum(F.col("intervals") - F.col("tp")).alias("fp"),
            F.sum(F.col("_events") - F.col("tp")).alias("fn"),
        )
    )
    return with_ratios(summed)


def lead_time_matches(
    intervals: DataFrame,
    listed: DataFrame,
    params: StudyParams,
    leads: list[int],
    width: int = DAY_US,
) -> DataFrame:
    """Greedy matches per required lead: the interval must start by ``event start - lead``.

    Intervals are disjoint and in order, so those an event may take are a span of their numbers:
    it starts after the intervals that end before the warning time and ends with the last one that
    starts by the deadline. Both numbers are running counts over interval borders, event times and
    deadlines, merged once in time slices; intervals and events are never paired. ``matched_no`` is
    the number of the interval an event takes, null for a missed event.
    """
    keys = [*KEYS, "lead_minutes"]
    none = F.lit(None)
    start, end = F.col("start_us"), F.col("end_us")

    def mark(at: Column, opened: int, closed: int, ordinal: Column, lead: Column) -> Column:
        return F.struct(
            at.alias("_at"),
            F.lit(opened).alias("_opened"),
            F.lit(closed).alias("_closed"),
            ordinal.cast("int").alias("ordinal"),
            lead.cast("int").alias("lead_minutes"),
        )

    # An interval that ends at the warning time still counts: its end takes effect just after.
    borders = intervals.select(
        *KEYS, F.explode(F.array(mark(start, 1, 0, none, none), mark(end + 1, 0, 1, none, none))).alias("_m")
    )
    # An interval that starts after the event's end is too late whatever the lead is.
    asked = listed.select(
        *KEYS,
        F.explode(
            F.array(
                mark(start - params.lead_minutes * MINUTE_US, 0, 0, F.col("ordinal"), none),
                *[
                    mark(F.least(start - v * MINUTE_US, end), 0, 0, F.col("ordinal"), F.lit(v))
                    for v in leads
                ],
            )
        ).alias("_m"),
    )
    marks = borders.unionByName(asked).select(*KEYS, "_m.*").withColumn("_slice", floor_div(F.col("_at"), width))
    upto = (
        Window.partitionBy(*KEYS, "_slice")
        .orderBy("_at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = ("_opened", "_closed")
    border = carried(
        marks,
        KEYS,
        "_slice",
        {f"_b{c}": F.sum(c) for c in counts},
        {f"_b{c}": (lambda w, e, c=c: F.coalesce(F.sum(f"_b{c}").over(e), F.lit(0))) for c in counts},
    )
    counted = (
        marks.select("*", *[F.sum(c).over(upto).alias(f"_n{c}") for c in counts])
        .filter("ordinal IS NOT NULL")
        .join(border, [*KEYS, "_slice"], "left")
        .select(*KEYS, "ordinal", "lead_minutes", *[(F.col(f"_n{c}") + F.col(f"_b{c}")).alias(c) for c in counts])
    )
    spans = counted.groupBy(*KEYS, "ordinal").agg(
        F.max(F.when(F.col("lead_minutes").isNull(), F.col("_closed"))).alias("_low"),
        F.collect_list(
            F.when(F.col("lead_minutes").isNotNull(), F.struct("lead_minutes", F.col("_opened").alias("high")))
        ).alias("_highs"),
    )
    per_lead = spans.select(*KEYS, "ordinal", "_low", F.explode("_highs").alias("_h")).select(
        *KEYS, "_h.lead_minutes", "ordinal", (F.col("_low") + 1).alias("low"), "_h.high"
    )
    folded = per_lead.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "low", "high"))).alias("_events")
    )

    def take(state: Column, event: Column) -> Column:
        number = F.greatest(event["low"], state["last"] + 1)
        fits = number <= event["high"]
        one = F.struct(event["ordinal"].alias("ordinal"), F.when(fits, number).alias("matched_no"))
        return F.struct(
            F.when(fits, number).otherwise(state["last"]).alias("last"),
            F.concat(state["taken"], F.array(one)).alias("taken"),
        )

    empty = F.expr("cast(array() as array<struct<ordinal:int,matched_no:bigint>>)")
    state = F.struct(F.lit(0).cast("bigint").alias("last"), empty.alias("taken"))
    taken = F.aggregate("_events", state, take, lambda s: s["taken"])
    return folded.select(*keys, F.explode(taken).alias("t")).select(*keys, "t.*")


def time_to_detection(
    alarms: DataFrame, listed: DataFrame, params: StudyParams, width: int = DAY_US
) -> DataFrame:
    """Per event: minutes from the first alarm row in the closed warning window to its start.

    Warning windows are listed for every time bucket they touch; alarm rows meet those of theirs.
    """
    warning = F.col("start_us") - params.lead_minutes * MINUTE_US
    right = listed.select(
        F.col("workflow_id").alias("_workflow"),
        F.col("asset_id").alias("_asset"),
        "ordinal",
        warning.alias("_warning_us"),
        F.col("start_us").alias("_event_us"),
        buckets(warning, F.col("start_us"), width).alias("_touched"),
    )
    hits = (
        alarms.filter("alarm")
        .select(*KEYS, "us", floor_div(F.col("us"), width).alias("_bucket"))
        .join(
            right,
            (F.col("workflow_id") == F.col("_workflow"))
            & (F.col("asset_id") == F.col("_asset"))
            & (F.col("_bucket") == F.col("_touched"))
            & F.col("us").between(F.col("_warning_us"), F.col("_event_us")),
        )
        .groupBy(*KEYS, "ordinal")
        .agg(F.min("us").alias("first_alarm_us"))
    )
    return listed.join(hits, [*KEYS, "ordinal"], "left").select(
        *KEYS,
        "ordinal",
        "event_id",
        "first_alarm_us",
        minutes_between(F.col("first_alarm_us"), F.col("start_us")).alias("ttd_minutes"),
    )


def spread(df: DataFrame, keys: list[str], value: str, names: dict[str, str]) -> DataFrame:
    """Mean, population std, min, max and exact median of a value per key."""
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias(names["mean"]),
        F.stddev_pop(value).alias(names["std"]),
        F.min(value).alias(names["min"]),
        F.max(value).alias(names["max"]),
    )
    return moments.join(grouped_median(df, keys, value, names["median"]), keys, "left")


def ttd_summary(ttd: DataFrame) -> DataFrame:
    names = {n: f"{n}_ttd" for n in ("mean", "std", "min", "max", "median")}
    counts = ttd.groupBy("workflow_id").agg(
        F.count("ttd_minutes").alias("detected_events"),
        F.count_if(F.col("ttd_minutes").isNull()).alias("missed_events"),
    )
    return counts.join(spread(ttd, ["workflow_id"], "ttd_minutes", names), "workflow_id", "left")


def lead_histogram(ttd: DataFrame, params: StudyParams) -> DataFrame:
    """Detections per lead-time bin; the last bin is closed on the right, empty bins count 0.

    A workflow without any detection lists ``max(1, lead // step)`` zero bins.
    """
    step, lead = params.lead_step_minutes, params.lead_minutes
    edges = list(range(0, lead + step, step))
    bins = len(edges) - 1
    empty = max(1, lead // step)
    found = ttd.groupBy("workflow_id").agg(F.count("ttd_minutes").alias("_detected"))
    size = F.when(F.col("_detected") > 0, bins).otherwise(empty)
    spine = found.select(
        "workflow_id", F.explode(F.sequence(F.lit(0), size - 1)).alias("bin")
    )
    counted = (
        ttd.filter("ttd_minutes IS NOT NULL AND ttd_minutes <= " + str(edges[-1]))
        .groupBy(
            "workflow_id",
            F.least(F.floor(F.col("ttd_minutes") / step), F.lit(bins - 1)).cast("int").alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return spine.join(counted, ["workflow_id", "bin"], "left").select(
        "workflow_id",
        "bin",
        (F.col("bin") * step).alias("bin_start_minutes"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def first_alarm_accuracy(eligible: DataFrame, grid: DataFrame) -> DataFrame:
    """Share of warned events whose earliest overlapping interval starts inside the window."""
    first = eligible.groupBy(*KEYS, "ordinal", "warning_us").agg(
        F.min("start_us").alias("first_us")
    )
    counts = first.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("tp_events"),
        F.count_if(F.col("first_us") >= F.col("warning_us")).alias("first_alarm_in_window"),
    )
    return (
        grid.select("workflow_id")
        .distinct()
        .join(counts, "workflow_id", "left")
        .select(
            "workflow_id",
            F.coalesce("tp_events", F.lit(0)).alias("tp_events"),
            F.coalesce("first_alarm_in_window", F.lit(0)).alias("first_alarm_in_window"),
        )
        .withColumn(
            "first_alarm_accuracy",
            share(F.col("first_alarm_in_window"), F.col("tp_events"), None),
        )
    )


def sample_minutes(stats: DataFrame) -> DataFrame:
    """Median sampling period per asset in minutes; 1 when undefined."""
    return stats.select(
        "asset_id",
        F.coalesce(F.col("gap_us") / float(MINUTE_US), F.lit(1.0)).alias("sample_minutes"),
    )


def evaluated_minutes(timeline: DataFrame, stats: DataFrame) -> DataFrame:
    """Evaluated time per asset: evaluated rows times the sampling period."""
    rows = timeline.groupBy("asset_id").agg(F.count_if("evaluation").alias("evaluation_rows"))
    return rows.join(sample_minutes(stats), "asset_id").withColumn(
        "evaluated_minutes", F.col("evaluation_rows") * F.col("sample_minutes")
    )


def false_alarm_rate(
    intervals: DataFrame,
    events: DataFrame,
    grid: DataFrame,
    minutes: DataFrame,
    params: StudyParams,
    width: int = DAY_US,
) -> DataFrame:
    """Intervals that warn of no event, per day and per week of evaluated time."""
    warning = warned(intervals, events, params.lead_minutes, width).select(*KEYS, "start_us")
    false = intervals.join(warning, [*KEYS, "start_us"], "left_anti")
    per_asset = (
        interval_counts(intervals, grid)
        .join(false.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_false")), KEYS, "left")
        .join(minutes.select("asset_id", "evaluated_minutes"), "asset_id", "left")
    )
    summed = per_asset.groupBy("workflow_id").agg(
        F.sum("intervals").alias("total_alarm_intervals"),
        F.coalesce(F.sum("_false"), F.lit(0)).alias("fp_intervals"),
        (F.coalesce(F.sum("evaluated_minutes"), F.lit(0.0)) / 1440.0).alias("total_days"),
    )
    return summed.withColumn("total_weeks", F.col("total_days") / 7.0).select(
        "*",
        share(F.col("fp_intervals"), F.col("total_days"), None).alias("far_per_day"),
        share(F.col("fp_intervals"), F.col("total_weeks"), None).alias("far_per_week"),
    )


def alarm_coverage(alarms: DataFrame) -> DataFrame:
    """Alarmed share of the evaluated rows (``alarms`` holds exactly those, a ``weight`` counts them)."""
    weight = counted(alarms)
    return (
        alarms.groupBy("workflow_id")
        .agg(
            F.sum(F.when(F.col("alarm"), weight).otherwise(0)).alias("alarm_points"),
            F.sum(weight).alias("total_points"),
        )
        .withColumn("alarm_coverage", share(F.col("alarm_points"), F.col("total_points"), 0.0))
        .withColumn("alarm_coverage_percent", F.col("alarm_coverage") * 100.0)
    )


def with_duration(intervals: DataFrame, stats: DataFrame) -> DataFrame:
    length = F.greatest(F.lit(0.0), minutes_between(F.col("start_us"), F.col("end_us")))
    return (
        intervals.join(sample_minutes(stats), "asset_id")
        .withColumn("duration_minutes", length + F.col("sample_minutes"))
        .drop("sample_minutes")
    )


def time_in_alarm(timed: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean, spread and count of alarm durations per workflow; null spreads without alarms."""
    names = {
        "mean": "mtia_minutes",
        "std": "std_minutes",
        "min": "min_minutes",
        "max": "max_minutes",
        "median": "median_minutes",
    }
    counts = timed.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("num_intervals"))
    return (
        grid.select("workflow_id")
        .distinct()
        .join(counts, "workflow_id", "left")
        .withColumn("num_intervals", F.coalesce("num_intervals", F.lit(0)))
        .join(spread(timed, ["workflow_id"], "duration_minutes", names), "workflow_id", "left")
    )


def nab_scores(
    matches: DataFrame, listed: DataFrame, counts: DataFrame, params: StudyParams
) -> DataFrame:
    """Benchmark score per workflow and profile, scaled to 0..100.

    The score of a match falls as the alarm starts later, so the best unused interval is the
    first unused one and the greedy assignment applies to every profile.
    """
    profile = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("profile"),
                    F.lit(tp).alias("w_tp"),
                    F.lit(fp).alias("w_fp"),
                    F.lit(fn).alias("w_fn"),
                )
                for n, tp, fp, fn in NAB_PROFILES
            ]
        )
    ).alias("p")
    warning = F.col("start_us") - params.lead_minutes * MINUTE_US
    position = minutes_between(warning, F.greatest("matched_us", warning)) / float(
        params.lead_minutes
    )
    scored = (
        matches.join(listed, [*KEYS, "ordinal"])
        .select(*KEYS, "matched_us", position.alias("position"), profile)
        .select(*KEYS, "matched_us", "position", "p.*")
    )
    per_asset = scored.groupBy(*KEYS, "profile", "w_tp", "w_fp", "w_fn").agg(
        F.sum(
            F.when(
                F.col("matched_us").isNotNull(),
                F.col("w_tp") / (1.0 + F.exp(5.0 * (F.col("position") - 0.5))),
            ).otherwise(-F.col("w_fn"))
        ).alias("window_score"),
        F.count("matched_us").alias("matched"),
        F.count(F.lit(1)).alias("events"),
    )
    summed = (
        per_asset.join(counts, KEYS)
        .groupBy("workflow_id", "profile", "w_tp", "w_fp", "w_fn")
        .agg(
            F.sum("window_score").alias("window_score"),
            F.sum(F.col("intervals") - F.col("matched")).alias("num_fp"),
            F.sum("events").alias("events"),
            F.sum("intervals").alias("intervals"),
        )
    )
    raw = F.col("window_score") - F.col("num_fp") * F.col("w_fp")
    top = F.col("events") * F.col("w_tp")
    bottom = -F.col("events") * F.col("w_fn") - F.col("intervals") * F.col("w_fp")
    return summed.select(
        "workflow_id",
        "profile",
        raw.alias("nab_score_raw"),
        share(100.0 * (raw - bottom), top - bottom, 0.0).alias("nab_score_normalized"),
        "num_fp",
    )


def alarm_islands(
    timed: DataFrame, eligible: DataFrame, width: int
) -> DataFrame:
    """Island report with running ids, gap to the previous island and matched event ordinals."""
    slotted = timed.withColumn("_slice", floor_div(F.col("start_us"), width))
    local = Window.partitionBy(*KEYS, "_slice").orderBy("start_us")
    border = carried(
        slotted,
        KEYS,
        "_slice",
        {"_n": F.count(F.lit(1)), "_end": F.max("end_us")},
        {
            "_before": lambda w, e: F.coalesce(F.sum("_n").over(e), F.lit(0)),
            "_prior": lambda w, e: F.max("_end").over(e),
        },
    )
    numbered = (
        slotted.select(
            "*",
            F.row_number().over(local).alias("_rank"),
            F.lag("end_us").over(local).alias("_lag"),
        )
        .join(border, [*KEYS, "_slice"], "left")
        .select(
            *KEYS,
            (F.col("_before") + F.col("_rank")).alias("island_id"),
            "start_us",
            "end_us",
            "duration_minutes",
            F.col("row_count").alias("point_count"),
            minutes_between(F.coalesce("_lag", "_prior"), F.col("start_us")).alias(
                "gap_from_previous_minutes"
            ),
        )
    )
    matched = eligible.groupBy(*KEYS, "start_us").agg(
        F.array_sort(F.collect_list("ordinal")).alias("_ordinals")
    )
    return numbered.join(matched, [*KEYS, "start_us"], "left").select(
        *numbered.columns,
        F.col("_ordinals").isNotNull().alias("is_true_positive"),
        F.coalesce(
            F.array_join(F.transform("_ordinals", lambda x: x.cast("string")), ","), F.lit("")
        ).alias("matched_event_ids"),
    )


def island_summary(islands: DataFrame, coverage: DataFrame) -> DataFrame:
    """Island counts, durations and coverage per workflow."""
    counted = islands.groupBy("workflow_id").agg(
        F.count(F.lit(1)).alias("island_count"),
        F.count_if("is_true_positive").alias("true_positive_island_count"),
        F.avg("duration_minutes").alias("mean_duration_minutes"),
        F.max("duration_minutes").alias("max_duration_minutes"),
    )
    middle = grouped_median(islands, ["workflow_id"], "duration_minutes", "median_duration_minutes")
    zero = F.lit(0)
    return (
        coverage.join(counted, "workflow_id", "left")
        .join(middle, "workflow_id", "left")
        .select(
            "workflow_id",
            F.coalesce("island_count", zero).alias("island_count"),
            F.coalesce("true_positive_island_count", zero).alias("true_positive_island_count"),
            (
                F.coalesce("island_count", zero) - F.coalesce("true_positive_island_count", zero)
            ).alias("false_alarm_island_count"),
            "mean_duration_minutes",
            "median_duration_minutes",
            "max_duration_minutes",
            "alarm_points",
            F.col("total_points").alias("total_evaluation_points"),
            F.col("alarm_coverage").alias("coverage"),
            F.col("alarm_coverage_percent").alias("coverage_percent"),
        )
    )
