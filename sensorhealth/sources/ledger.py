"""Candidate-result ledger kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.candidates import LEDGER_KEY
from ..session import materialize


def new_candidates(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose key is not in the ledger; the first row of a repeated key wins."""
    # Copies of a key are merged before the shuffle, however many there are.
    rest = [c for c in incoming.columns if c not in LEDGER_KEY]
    first = F.min_by(F.struct(*rest), F.struct("created_at", "id"))
    once = (
        incoming.groupBy(*LEDGER_KEY)
        .agg(first.alias("_row"))
        .select(*LEDGER_KEY, "_row.*")
        .select(*incoming.columns)
    )
    return once.join(ledger.select(*LEDGER_KEY), list(LEDGER_KEY), "left_anti")


def insert_if_absent(ledger: DataFrame, incoming: DataFrame) -> DataFrame:
    return ledger.unionByName(new_candidates(ledger, incoming))


def append_new(spark: SparkSession, path: str, incoming: DataFrame) -> int:
    """Append the incoming rows whose key the ledger files lack; how many there were.

    The new rows are written once before they are appended, so a retried append adds the same.
    """
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        known = spark.read.schema(incoming.schema).parquet(path)
    else:
        known = incoming.limit(0)
    fresh = materialize(new_candidates(known, incoming), "ledger-rows")
    fresh.write.mode("append").parquet(path)
    return fresh.count()


def study_rows(ledger: DataFrame, study_id: str, contract: str) -> DataFrame:
    """Rows of one study and search contract, in insertion order."""
    return ledger.filter(
        (F.col("study_id") == study_id) & (F.col("search_contract_fingerprint") == contract)
    ).orderBy("id")


def flatten_diagnostics(ledger: DataFrame, names: Sequence[str]) -> DataFrame:
    """Diagnostics JSON as ``diagnostic_*`` columns."""
    parsed = ledger.withColumn("_d", F.from_json("diagnostics_json", "map<string,double>"))
    return parsed.select(
        *[c for c in ledger.columns if c != "diagnostics_json"],
        *[F.col("_d").getItem(n).alias(f"diagnostic_{n}") for n in names],
    )
