"""Reuse of a prepared study while its input stays the same.

Preparing a study is the expensive shared step, so its tables are written once and reloaded by
later runs of the same session, but only if a fingerprint over every input row still matches.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import PER_MAINTENANCE, STATIC
from ..session import delete_tables, materialize
from .detectors import Detectors
from .evaluation import Evaluation
from .study import Study

#: Workflows whose scores have a closed form. The last one refits a mean after every maintenance.
DISTANCE_WORKFLOWS = {
    "distance_row": STATIC,
    "distance_window": STATIC,
    "mean_per_maintenance": PER_MAINTENANCE,
}


def input_fingerprint(study: Study) -> tuple:
    """Row count and order-free sums of row hashes; read in the same pass as the study's density."""
    return tuple(study.profile[c] for c in ("row_count", "mark_sum", "mark_mix"))


#: Prepared tables that a stored study holds.
STORED = ("stats", "cycles", "timeline", "refits", "feature_table", "scaler")


def save_study(study: Study, path: str) -> None:
    """Write a study's prepared tables, and last the fingerprint of the input they came from."""
    for name in STORED:
        getattr(study, name).write.mode("overwrite").parquet(f"{path}/{name}")
    rows, total, mixed = input_fingerprint(study)
    mark = [(rows, str(total), mixed, repr(study.params), ",".join(study.channels))]
    study.spark.createDataFrame(mark, MARK).write.mode("overwrite").parquet(f"{path}/mark")


MARK = "row_count bigint, mark_sum string, mark_mix bigint, params string, channels string"


def load_study(study: Study, path: str) -> bool:
    """Take prepared tables from ``path`` if they fit this study's input and parameters.

    A stored study is usable only once its mark is there; with another input, parameters or
    channels nothing is taken and the study prepares itself as usual.
    """
    files = study.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mark/_SUCCESS")
    if not files.getFileSystem(study.spark._jsc.hadoopConfiguration()).exists(files):
        return False
    stored = study.spark.read.schema(MARK).parquet(f"{path}/mark").first()
    rows, total, mixed = input_fingerprint(study)
    if tuple(stored) != (rows, str(total), mixed, repr(study.params), ",".join(study.channels)):
        return False
    for name in STORED:
        study.__dict__[name] = study.spark.read.parquet(f"{path}/{name}")
    return True


class Prepared:
    """One study with its detectors and the evaluation of the workflows with a closed form."""

    #: Digits of row scores and anomaly scores; None keeps them as they are.
    row_digits: int | None = None
    score_digits: int | None = None

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory
        self.study = Study.from_tables(spark, directory)
        self.detectors = Detectors(self.study)

    @staticmethod
    def _with_digits(df: DataFrame, column: str, digits: int | None) -> DataFrame:
        return df if digits is None else df.withColumn(column, F.round(column, digits))

    @property
    def distance_rows(self) -> DataFrame:
        return self._with_digits(self.detectors.distance_rows, "row_score", self.row_digits)

    @cached_property
    def distance(self) -> Evaluation:
        adaptive = "mean_per_maintenance"
        rows = self.detectors.component_rows(adaptive, PER_MAINTENANCE, rank=0)
        means = self.detectors.window_scores(
            adaptive, *(self._with_digits(r, "row_mse", self.row_digits) for r in rows)
        )
        static = self.detectors.distance_scores(self.distance_rows)
        calibration, evaluation = (
            self._with_digits(a.unionByName(b), "anomaly_score", self.score_digits)
            for a, b in zip(static, means, strict=True)
        )
        return Evaluation(
            self.study,
            materialize(calibration, "calibration-scores"),
            materialize(evaluation, "evaluation-scores"),
            DISTANCE_WORKFLOWS,
        )

    def table(self, name: str):
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")


_known: dict[tuple[str, str, type], tuple[tuple, Prepared]] = {}


def prepared(spark: SparkSession, directory: str, kind: type[Prepared] = Prepared) -> Prepared:
    key = (spark.sparkContext.applicationId, directory, kind)
    fresh = kind(spark, directory)
    mark = input_fingerprint(fresh.study)
    if key not in _known or _known[key][0] != mark:
        _known[key] = (mark, fresh)
    return _known[key][1]


def forget(spark: SparkSession | None = None) -> None:
    """Drop every prepared study, so that the next query starts from the input tables.

    With the session, the tables that its studies have written are deleted too.
    """
    _known.clear()
    if spark is not None:
        delete_tables(spark)
