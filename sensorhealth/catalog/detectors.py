"""Detectors: fitting, scoring, reload, adaptation and lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.contract import check_summary, population_differences
from ..operators.forest import fit_forest
from ..operators.lineage import PER_MAINTENANCE, STATIC, model_lineage
from ..operators.reconstruction import (
    SMAPE_EPSILON,
    decomposed,
    fit_components,
    mean_smape,
    row_errors,
    windows_holding,
)
from ..plans.detectors import MODEL, STRATEGIES, workflow_scores
from ..plans.evaluation import Evaluation
from ..session import scratch_path
from . import query, tidy
from .oracle import FEATURES, L, P, sql

NODES = ["feature", "cut", "depth"]


@query("m1_forest_fit")
def m1(p):
    forest = p.detectors.forest(STATIC)
    return forest.select(*MODEL, "tree", "sample", F.size(F.filter("feature", lambda f: f >= 0)).alias("cuts"))


SAMPLE = f"least({P.tree_rows}, n)::BIGINT AS sample"
TREES = f"unnest(range({P.trees}))::BIGINT AS tree"


@query(
    "m1_forest_trees",
    sql(
        f"""SELECT asset_id, 0::BIGINT AS model_cycle, {TREES}, {SAMPLE}
            FROM (SELECT asset_id, count(*) AS n FROM timeline WHERE baseline_train
                  AND asset_id IN (SELECT asset_id FROM complete) GROUP BY asset_id HAVING count(*) > 1)"""
    ),
)
def m1_trees(p):
    """Every model's trees and the rows that each of them was grown on."""
    return tidy(p.detectors.forest(STATIC).select(*MODEL, "tree", "sample"))


@query(
    "m1_vector_trees",
    sql(
        f"""SELECT label::BIGINT AS label, {TREES}, {SAMPLE}
            FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1)"""
    ),
)
def m1_vector_trees(p):
    return tidy(m1_vectors(p).select("label", "tree", "sample"))


@query("m1_forest_fit_vectors")
def m1_vectors(p):
    """One forest per label over the embedding vectors."""
    rows = p.table("embeddings").select(
        "label", "vec_id", F.col("embedding").cast("array<double>").alias("features")
    )
    forest = fit_forest(
        rows, ["label"], "vec_id", "features", trees=P.trees, tree_rows=P.tree_rows, seed=P.seed
    )
    return forest.select("label", "tree", "sample", F.size(F.filter("feature", lambda f: f >= 0)).alias("cuts"))


@query("m2_forest_score")
def m2(p):
    _, evaluation = p.detectors.forest_scores("iforest_static", STATIC)
    return tidy(evaluation)


@query(
    "m2_forest_population",
    sql(
        """SELECT t.asset_id, t.us, t.cycle_id::BIGINT AS cycle_id, t.phase::BIGINT AS phase,
                  c.asset_id IS NOT NULL AS scored, true AS in_range
           FROM timeline t LEFT JOIN complete c USING (asset_id) WHERE t.evaluation"""
    ),
)
def m2_population(p):
    """Every anchor once; a score between -0.5 and 0.5 exactly where there is a feature vector."""
    _, evaluation = p.detectors.forest_scores("iforest_static", STATIC)
    score = F.col("anomaly_score")
    return tidy(
        evaluation.select(
            "asset_id", "us", "cycle_id", "phase", score.isNotNull().alias("scored"),
            F.coalesce(score.between(-0.5, 0.5), F.lit(True)).alias("in_range"),
        )
    )


@query("m3_forest_reload")
def m3(p):
    """Calibration anchors scored with a forest written and read back."""
    return tidy(_calibration_scores(p, _reloaded(p, p.detectors.forest(STATIC))))


def _reloaded(p, forest):
    path = scratch_path(p.spark, "forest")
    forest.write.partitionBy("model_cycle").parquet(path)
    return p.spark.read.parquet(path).select(*MODEL, "tree", "sample", *NODES)


def _calibration_scores(p, forest):
    calibration, _ = p.detectors.model_rows(p.detectors.lineage("iforest_static", STATIC), ["features"])
    return p.detectors.forest_anchor_scores(calibration.filter("features IS NOT NULL"), forest)


@query(
    "m3_reload_difference",
    sql(
        """SELECT asset_id, count(*) AS anchors, 0.0::DOUBLE AS largest_difference FROM timeline
           WHERE calibration AND asset_id IN (SELECT asset_id FROM complete) GROUP BY asset_id"""
    ),
)
def m3_difference(p):
    """Scores before and after the forest was written and read back."""
    forest = p.detectors.forest(STATIC)
    before = _calibration_scores(p, forest)
    after = _calibration_scores(p, _reloaded(p, forest)).withColumnRenamed("anomaly_score", "_again")
    both = before.join(after, [*MODEL, "us"])
    return tidy(
        both.groupBy("asset_id").agg(
            F.count(F.lit(1)).alias("anchors"),
            F.max(F.abs(F.col("anomaly_score") - F.col("_again"))).alias("largest_difference"),
        )
    )


@query(
    "m4_refit_training_rows",
    sql(
        """SELECT asset_id, cycle_id::BIGINT AS model_cycle, base_rows + local_rows AS training_rows
           FROM (SELECT c.asset_id, c.cycle_id,
                        (SELECT count(*) FROM timeline t WHERE t.asset_id = c.asset_id
                         AND t.baseline_train) AS base_rows,
                        (SELECT count(*) FROM timeline t WHERE t.asset_id = c.asset_id
                         AND t.update_cycle = c.cycle_id) AS local_rows
                 FROM refit_cycles c WHERE c.asset_id IN (SELECT asset_id FROM complete))"""
    ),
)
def m4(p):
    """Rows that train each refit: those with a feature vector, each row listing its models."""
    training = p.detectors.forest_training(PER_MAINTENANCE)
    counts = training.groupBy("asset_id", "model_cycles").agg(F.count(F.lit(1)).alias("_n"))
    by_model = counts.select("asset_id", F.explode("model_cycles").alias("model_cycle"), "_n")
    return tidy(by_model.groupBy(*MODEL).agg(F.sum("_n").alias("training_rows")))


@query("m4_forest_refit_scores")
def m4_scores(p):
    _, evaluation = workflow_scores(p.detectors, "iforest_per_maintenance")
    return tidy(evaluation)


@query(
    "m5_window_score",
    sql(
        """SELECT asset_id, us, cycle_id::BIGINT AS cycle_id, anomaly_score FROM evs
           WHERE workflow_id = 'distance_window'"""
    ),
)
def m5(p):
    rows = p.distance_rows
    scored = p.detectors.windowed(rows, "src", "row_score").filter("evaluation")
    return tidy(scored.select("asset_id", "us", "cycle_id", "anomaly_score"))


@query("m5_linear_window_score")
def m5_linear(p):
    _, evaluation = workflow_scores(p.detectors, "linear_static")
    return tidy(evaluation)


@query(
    "m6_window_smape",
    sql(
        f"""SELECT asset_id, round(sum(window_sum) / (count(*) * {L * len(FEATURES)}), 6) AS smape,
                   (count(*) * {L})::BIGINT AS weighted_rows
            FROM (SELECT asset_id, src_pos, sum(row_smape) OVER (PARTITION BY asset_id, src_run
                         ORDER BY us ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS window_sum
                  FROM (SELECT t.asset_id, t.us, t.src_run, t.src_pos, """
        + " + ".join(f"2.0 * abs(s.{f}) / (abs(s.{f}) + {SMAPE_EPSILON})" for f in FEATURES)
        + f""" AS row_smape
                        FROM timeline t JOIN scaled s USING (asset_id, us) WHERE t.cycle_id = 0))
            WHERE src_pos >= {L} GROUP BY asset_id"""
    ),
)
def m6(p):
    """SMAPE of the mean model, which reconstructs every scaled feature as 0."""
    source = p.detectors.rows.filter("cycle_id = 0")
    sizes = source.groupBy("asset_id", "src_run").agg(F.count(F.lit(1)).alias("_n"))
    rows = (
        source.join(sizes, ["asset_id", "src_run"])
        .withColumn("holding", windows_holding(F.col("src_pos"), F.col("_n"), L))
        .filter("holding > 0")
        .withColumn("_fit", F.transform("features", lambda x: F.lit(0.0)))
    )
    return tidy(mean_smape(row_errors(rows, "features"), ["asset_id"], len(FEATURES)))


@query("m6_linear_smape")
def m6_linear(p):
    return tidy(p.detectors.smape(p.detectors.components(STATIC), ["asset_id"]))


@query("m7_linear_fit")
def m7(p):
    models = p.detectors.components(STATIC)
    return models.select(
        *MODEL, "fitted_rows", F.size("mean").alias("features"), F.size("components").alias("rank")
    )


MEANS = ", ".join(f"round(m_{f}, 6)" for f in FEATURES)


@query(
    "m7_model_checks",
    sql(
        f"""SELECT asset_id, model_cycle::BIGINT AS model_cycle, fitted_rows, i::BIGINT AS position,
                   [{MEANS}][i + 1] + 0.0 AS mean, 0.0::DOUBLE AS not_orthonormal
            FROM mix_mean CROSS JOIN range({len(FEATURES)}) AS t(i)"""
    ),
)
def m7_checks(p):
    """Fitted rows and mean of every model, and how far its components are from orthonormal."""
    models = p.detectors.components(PER_MAINTENANCE)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    off = F.flatten(
        F.transform(
            "components",
            lambda a, i: F.transform("components", lambda b, j: F.abs(dot(a, b) - (i == j).cast("double"))),
        )
    )
    checked = models.select(
        *MODEL, "fitted_rows", F.array_max(off).alias("not_orthonormal"), F.posexplode("mean").alias("position", "mean")
    )
    return tidy(checked.withColumn("mean", F.round("mean", 6) + F.lit(0.0)))


@query(
    "m7_full_rank_error",
    sql(
        """SELECT asset_id, count(*) AS rows_checked, 0.0::DOUBLE AS largest_error FROM timeline
           WHERE baseline_train AND asset_id IN (SELECT asset_id FROM complete) GROUP BY asset_id"""
    ),
)
def m7_full_rank(p):
    """A model with all components rebuilds its training rows."""
    d = p.detectors
    size = len(p.study.features_list)
    full = fit_components(d.component_training(STATIC), MODEL, "features", size, size)
    rows = d.rows.filter("baseline_train AND features IS NOT NULL").select(
        "asset_id", F.lit(0).alias("model_cycle"), "us", "features"
    )
    errors = d.reconstruction_rows(rows, full)
    return tidy(
        errors.groupBy("asset_id").agg(
            F.count(F.lit(1)).alias("rows_checked"), F.round(F.max("row_mse"), 9).alias("largest_error")
        )
    )


MEAN_LIST = ", ".join(f"round(m_{f}, 6)" for f in FEATURES)


@query(
    "m8_chained_models",
    sql(
        """SELECT asset_id, model_cycle::BIGINT AS model_cycle, step::BIGINT AS step,
                  lag(model_cycle) OVER (PARTITION BY asset_id ORDER BY model_cycle)::BIGINT AS predecessor,
                  own_rows, fitted_rows, round(1 - own_rows / fitted_rows, 6) AS carried_share
           FROM mix_mean"""
    ),
)
def m8_chain(p):
    """What every refitted model takes from its own training mix and from the model before it."""
    d = p.detectors
    own = d.component_training(PER_MAINTENANCE).groupBy(*MODEL).agg(F.sum("weight").cast("double").alias("own_rows"))
    order = Window.partitionBy("asset_id").orderBy("model_cycle")
    models = d.components(PER_MAINTENANCE).join(own, MODEL)
    return tidy(
        models.select(
            *MODEL,
            F.row_number().over(order).alias("step"),
            F.lag("model_cycle").over(order).alias("predecessor"),
            "own_rows",
            "fitted_rows",
            F.round(1 - F.col("own_rows") / F.col("fitted_rows"), 6).alias("carried_share"),
        )
    )


@query(
    "m8_cycle_models",
    sql(
        f"""SELECT w.workflow_id, c.asset_id, c.cycle_id::BIGINT AS cycle_id, m.model_cycle::BIGINT AS model_cycle,
                   m.fitted_rows, i::BIGINT AS position, [{MEAN_LIST}][i + 1] + 0.0 AS mean
            FROM lineage c CROSS JOIN (SELECT unnest(['linear_static', 'linear_per_maintenance']) AS workflow_id) w
            JOIN mix_mean m ON m.asset_id = c.asset_id
             AND m.model_cycle = CASE WHEN w.workflow_id = 'linear_static' THEN 0 ELSE c.model_cycle END
            CROSS JOIN range({len(FEATURES)}) AS t(i)"""
    ),
)
def m8_cycles(p):
    """Weight and mean of the model that each cycle is scored with: static, refitted or aliased."""
    parts = []
    for workflow in ("linear_static", "linear_per_maintenance"):
        d, strategy = p.detectors, STRATEGIES[workflow]
        used = d.lineage(workflow, strategy).withColumnRenamed("effective_model_cycle", "model_cycle")
        fitted = used.join(d.components(strategy), MODEL)
        parts.append(
            fitted.select("workflow_id", "asset_id", "cycle_id", "model_cycle", "fitted_rows", F.posexplode("mean").alias("position", "mean"))
        )
    both = parts[0].unionByName(parts[1])
    return tidy(both.withColumn("mean", F.round("mean", 6) + F.lit(0.0)))


@query("m5_sequence_score")
def m5_sequence(p):
    _, evaluation = workflow_scores(p.detectors, "sequence_static")
    return tidy(evaluation)


@query(
    "m5_sequence_population",
    sql(
        """SELECT t.asset_id, t.us, t.cycle_id::BIGINT AS cycle_id, t.phase::BIGINT AS phase,
                  l.model_cycle::BIGINT AS model_cycle, c.asset_id IS NOT NULL AS scored
           FROM timeline t JOIN lineage l USING (asset_id, cycle_id) LEFT JOIN complete c USING (asset_id)
           WHERE t.evaluation"""
    ),
)
def m5_sequence_population(p):
    """Every anchor once under the model of its cycle; a score where there are feature vectors."""
    _, evaluation = workflow_scores(p.detectors, "sequence_per_maintenance")
    return tidy(
        evaluation.select(
            "asset_id", "us", "cycle_id", "phase", "model_cycle", F.col("anomaly_score").isNotNull().alias("scored")
        )
    )


@query(
    "m7_lagged_products",
    sql(
        """SELECT a.asset_id, a.model_cycle::BIGINT AS model_cycle, a.i::BIGINT AS older, b.i::BIGINT AS newer,
                  count(*)::DOUBLE AS windows, round(avg(a.x * b.x), 6) + 0.0 AS mean_product
           FROM mix_held a JOIN mix_held b ON a.asset_id = b.asset_id AND a.model_cycle = b.model_cycle
            AND a.run = b.run AND a.pos = b.pos AND a.replayed = b.replayed
           WHERE a.i <= b.i GROUP BY a.asset_id, a.model_cycle, a.i, b.i"""
    ),
)
def m7_lagged(p):
    """Mean lagged product of the first feature over the training windows of every model."""
    size = len(FEATURES)
    moments = p.detectors.sequence_moments(PER_MAINTENANCE)
    windows = moments.filter("cell = 0").select(*MODEL, F.col("amount").alias("windows"))
    place = F.col("cell") - (1 + L * size)
    lag = lambda c: F.floor(c / size).cast("int")
    older, newer = F.floor(place / (L * size)).cast("int"), F.pmod(place, F.lit(L * size))
    products = moments.filter((place >= 0) & (F.pmod(older, F.lit(size)) == 0) & (F.pmod(newer, F.lit(size)) == 0)).select(
        *MODEL, lag(older).alias("older"), lag(newer).alias("newer"), "amount"
    )
    mean = F.round(F.col("amount") / F.col("windows"), 6) + F.lit(0.0)
    return tidy(
        products.filter("older <= newer").join(windows, MODEL).select(*MODEL, "older", "newer", "windows", mean.alias("mean_product"))
    )


@query(
    "m7_full_rank_windows",
    sql(
        f"""SELECT asset_id, count(*) AS windows_checked, 0.0::DOUBLE AS largest_error FROM timeline
            WHERE baseline_train AND base_pos >= {L} AND asset_id IN (SELECT asset_id FROM complete)
            GROUP BY asset_id"""
    ),
)
def m7_full_rank_windows(p):
    """A window model with all components rebuilds its training windows."""
    d, size = p.detectors, len(FEATURES) * L
    full = decomposed(d.sequence_moments(STATIC), MODEL, size, size)
    rows = d.rows.filter("baseline_train").withColumn("model_cycles", F.array(F.lit(0)))
    errors = d.sequence_errors(rows, "base_run", "base_pos", full)
    return tidy(
        errors.filter("anomaly_score IS NOT NULL").groupBy("asset_id").agg(
            F.count(F.lit(1)).alias("windows_checked"), F.round(F.max("anomaly_score"), 9).alias("largest_error")
        )
    )


@query("m8_linear_adaptation")
def m8(p):
    models = p.detectors.components(PER_MAINTENANCE)
    return models.select(
        *MODEL, "fitted_rows", F.size("mean").alias("features"), F.size("components").alias("rank")
    )


@query(
    "m8_adaptation_rows",
    sql(
        f"""SELECT asset_id, model_cycle::BIGINT AS model_cycle, sum(w)::BIGINT AS weighted_rows FROM (
              SELECT asset_id, 0 AS model_cycle, count(*) * {L} AS w FROM base_windows GROUP BY asset_id
              UNION ALL SELECT asset_id, cycle_id, count(*) * {L} FROM replay GROUP BY ALL
              UNION ALL SELECT asset_id, cycle_id, sum(train_windows) * {L} FROM split GROUP BY ALL)
            WHERE asset_id IN (SELECT asset_id FROM complete) GROUP BY ALL"""
    ),
)
def m8_rows(p):
    """Training windows times their length, counted from the weighted training rows."""
    rows = p.detectors.component_training(PER_MAINTENANCE)
    return tidy(rows.groupBy(*MODEL).agg(F.sum("weight").alias("weighted_rows")))


@query(
    "m9_model_lineage",
    sql(
        """SELECT w.workflow_id, c.asset_id, c.cycle_id::BIGINT AS cycle_id,
                  CASE WHEN c.cycle_id = 0 THEN 'trained_initial'
                       WHEN w.workflow_id LIKE '%_static' THEN 'reused_static'
                       WHEN l.model_cycle = c.cycle_id THEN 'refitted'
                       ELSE 'alias_no_trainable_local_window' END AS model_status,
                  CASE WHEN w.workflow_id LIKE '%_static' THEN 0 ELSE l.model_cycle END::BIGINT
                  AS effective_model_cycle
           FROM cycles c JOIN lineage l USING (asset_id, cycle_id) CROSS JOIN (SELECT unnest("""
        + str(list(STRATEGIES))
        + ") AS workflow_id) w"
    ),
)
def m9(p):
    return tidy(model_lineage(p.study.refits, STRATEGIES))


@query(
    "m10_cycle_scores",
    sql(
        """SELECT workflow_id, cycle_id::BIGINT AS cycle_id, count(*) AS scored_anchors,
                  0::BIGINT AS problems FROM evs GROUP BY workflow_id, cycle_id"""
    ),
)
def m10(p):
    """Scored anchors per cycle with the anchors missing from, or foreign to, each population."""
    e = p.distance
    names = F.explode(F.array(*[F.lit(w) for w in e.workflows])).alias("workflow_id")
    keys = ["workflow_id", "cycle_id", "asset_id", "us"]
    expected = p.study.timeline.filter("evaluation").select(names, "cycle_id", "asset_id", "us")
    problems = population_differences(expected, e.scores, keys)
    found = problems.groupBy("workflow_id", "cycle_id").agg(F.count(F.lit(1)).alias("problems"))
    scored = e.scores.groupBy("workflow_id", "cycle_id").agg(F.count(F.lit(1)).alias("scored_anchors"))
    return tidy(
        scored.join(found, ["workflow_id", "cycle_id"], "left").select(
            "workflow_id",
            "cycle_id",
            "scored_anchors",
            F.coalesce("problems", F.lit(0)).alias("problems"),
        )
    )


@query("m10_linear_per_maintenance")
def m10_linear(p):
    """Risk of the adaptive linear workflow on every evaluation anchor."""
    calibration, evaluation = workflow_scores(p.detectors, "linear_per_maintenance")
    e = Evaluation(
        p.study, calibration, evaluation, {"linear_per_maintenance": PER_MAINTENANCE}
    )
    return tidy(e.risk)
