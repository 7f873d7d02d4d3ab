"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Language ID, quality rules and near-duplicate removal drop documents and keep the columns of those
that stay; personal data is replaced in the texts; packing ends with one row for each piece of a
sequence. Nulls, empty texts, repeated rows, empty tables and further columns are handled as each
operator's docstring states: texts without letters go at the first stage, texts that fail the base rule
at the second, and one document of each group of near-duplicates stays at the third: SimHash proposes
them, MinHash what SimHash leaves, and a similarity of 0.8 or more of their five-word shingles decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorhealth.llm import copies, language, packing, pseudonyms, quality
from sensorhealth.llm.queries import tokenizer_path
from sensorhealth.llm.tables import settle, small_batches, table
from sensorhealth.session import ship


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.keep_first(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.protect(docs, pseudonyms.session_key(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


def _stage(fn):
    return lambda spark, docs, sf_dir: fn(small_batches(ship(spark)), docs, sf_dir)


STAGES = [
    ("language", _stage(keep_known_language)),
    ("quality", _stage(keep_good_quality)),
    ("near_duplicates", _stage(drop_near_duplicates)),
    ("personal_data", _stage(replace_personal_data)),
    ("packing", _stage(pack_sequences)),
]

#: Hashed trigrams, 64-bit shingle hashes, digests and byte-level merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
