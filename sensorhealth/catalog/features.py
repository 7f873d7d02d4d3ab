"""Rolling features, fills and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling
from ..params import AGGREGATIONS
from ..session import materialize
from . import query, tidy
from .oracle import FEATURES, P, SENSOR_BINARY, SENSOR_CHANNELS, sql


def one_aggregation(p, aggregation: str):
    s = p.study
    rolled = rolling.rolling_features(
        s.base, ["asset_id"], "us", "slice", s.feature_us, s.channels, P.rolling_us, [aggregation], parts=s.feature_parts
    )
    return tidy(rolled.drop("slice"))


def register_aggregation(position: int, aggregation: str) -> None:
    columns = ", ".join(
        f"round({c}__{aggregation}, 6) AS {c}__{aggregation}" for c in SENSOR_CHANNELS
    )
    name = f"f{position}_rolling_{aggregation}"
    query(name, sql(f"SELECT asset_id, us, {columns} FROM rolled"))(
        lambda p: one_aggregation(p, aggregation)
    )


for _position, _aggregation in enumerate(AGGREGATIONS, start=1):
    register_aggregation(_position, _aggregation)

SPREADS = [f for f in FEATURES if f.endswith(("__std", "__skew"))]


def rolled_spreads(p):
    s = p.study
    return materialize(
        rolling.rolling_features(
            s.base, ["asset_id"], "us", "slice", s.feature_us, s.channels, P.rolling_us, ["std", "skew"], parts=s.feature_parts
        ),
        "spreads",
    )


def rounded(columns, table: str) -> str:
    return f"SELECT asset_id, us, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM {table}"


@query("f7_forward_fill", sql(rounded(SPREADS, "forward")))
def f7(p):
    filled = rolling.fill_series(
        rolled_spreads(p), ["asset_id"], "us", "slice", SPREADS, backward=False
    )
    return tidy(filled.select("asset_id", "us", *SPREADS))


@query("f8_back_fill", sql(rounded(SPREADS, "feats")))
def f8(p):
    full = rolling.fill_series(rolled_spreads(p), ["asset_id"], "us", "slice", SPREADS)
    return tidy(full.select("asset_id", "us", *SPREADS))


@query(
    "f9_completeness",
    sql(
        "SELECT count(*) AS row_count, sum("
        + " + ".join(f"({f} IS NULL)::BIGINT" for f in FEATURES)
        + ")::BIGINT AS missing_values, "
        + " + ".join(f"(count({f}) > 0)::BIGINT" for f in FEATURES)
        + " AS feature_count FROM feats"
    ),
)
def f9(p):
    return rolling.unresolved(p.study.feature_table, p.study.features_list)


@query(
    "f9_tampered_completeness",
    sql(
        "SELECT count(*) AS row_count, (sum("
        + " + ".join(f"({f} IS NULL)::BIGINT" for f in FEATURES[2:])
        + ") + count(*) + count(*) FILTER (asset_id = 3 OR "
        + f"{FEATURES[1]} IS NULL))::BIGINT AS missing_values, "
        + " + ".join(f"(count({f}) > 0)::BIGINT" for f in FEATURES[1:])
        + " AS feature_count FROM feats"
    ),
)
def f9_tampered(p):
    """The same of a table that lost one feature, and another one for one asset."""
    gone, partly = p.study.features_list[:2]
    table = p.study.feature_table.drop(gone).withColumn(partly, F.when(F.col("asset_id") != 3, F.col(partly)))
    return rolling.unresolved(table, p.study.features_list)


@query(
    "f10_scaler_fit",
    sql(
        """SELECT asset_id, position::BIGINT AS position, feature, round(mean, 6) AS mean,
                  round(scale, 6) AS scale, passthrough, fitted_rows FROM scaler"""
    ),
)
def f10(p):
    train = p.study.feature_table.filter("baseline_train")
    return tidy(rolling.fit_scaler(train, ["asset_id"], p.study.features_list, p.study.binary))


@query("f11_scaler_apply", sql(rounded(FEATURES, "scaled")))
def f11(p):
    names = p.study.features_list
    wide = rolling.wide_scaler(p.study.scaler, ["asset_id"], names)
    scaled = rolling.apply_scaler(
        p.study.feature_table, materialize(wide, "wide-scaler"), ["asset_id"], names, rolling.feature_names(SENSOR_CHANNELS)
    )
    return tidy(scaled.select("asset_id", "us", *names))


@query(
    "f12_scaler_reload",
    sql(
        """SELECT asset_id, feature, round(mean, 6) AS mean, round(scale, 6) AS scale, '1.0' AS schema_version
           FROM scaler"""
    ),
)
def f12(p):
    from ..session import scratch_path

    path = scratch_path(p.spark, "scaler")
    rolling.save_scaler(p.study.scaler, path)
    back = rolling.load_scaler(p.spark, path)
    return tidy(back.select("asset_id", "feature", "mean", "scale", "schema_version"))
