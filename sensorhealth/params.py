"""Study parameters; the defaults are the settings used on the driver tables."""

from __future__ import annotations

from dataclasses import dataclass

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# Rolling aggregations in output order.
AGGREGATIONS = ("mean", "median", "std", "skew", "min", "max")

# Threshold extras added to the stepped grid.
EXTRA_THRESHOLDS = (0.925, 0.95, 0.975, 0.985, 0.99, 0.995)

# Benchmark profiles as (name, true-positive, false-positive, miss weight).
NAB_PROFILES = (
    ("standard", 1.0, 0.11, 1.0),
    ("low_fp", 1.0, 0.22, 1.0),
    ("low_fn", 1.0, 0.11, 2.0),
)


@dataclass(frozen=True)
class StudyParams:
    rolling_us: int = 2 * HOUR_US
    baseline_minutes: int = 10 * 24 * 60
    post_train_minutes: int = 24 * 60
    pre_maintenance_minutes: int = 12 * 60
    sequence_length: int = 4
    stride: int = 1
    validation_fraction: float = 0.10
    train_phases: tuple[int, ...] = (0, 1)
    test_phases: tuple[int, ...] = (0, 1)
    risk_window_minutes: int = 24 * 60
    exceedance_quantile: float = 0.95
    theta_grid: str = "0.10:0.90:0.05"
    extra_thresholds: tuple[float, ...] = EXTRA_THRESHOLDS
    target_recall: float = 0.60
    target_coverage: float = 0.20
    lead_minutes: int = 12 * 60
    sensitivity_leads: tuple[int, ...] = (180, 360, 540)
    lead_step_minutes: int = 180
    replay_fraction: float = 0.50
    local_validation_fraction: float = 0.20
    validation_embargo: bool = True
    alarm_burden_threshold: float = 0.95
    winner_weights: tuple[float, float, float] = (0.20, 0.50, 0.30)
    invalid_penalty: float = 9e10
    selection_scope: str = "retrospective_full_timeline"
    trees: int = 100
    tree_rows: int = 256
    seed: int = 42
    components: int = 3
    # Weight of the predecessor's training moments in an adapted model; 0 forgets it.
    adaptation_memory: float = 0.5
    # Rows one time slice of one asset should hold; see operators/slices.py.
    slice_rows: int = 1_000_000
    slice_us: int | None = None
