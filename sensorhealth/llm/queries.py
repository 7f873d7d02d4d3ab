"""Queries of the numbered operators with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship
from . import chat, infill, language, lexicon, licenses, packing, pseudonyms, quality, simhash, turns, urls, vectors, warc
from .tables import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return fn(small_batches(ship(spark)), directory)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _control_pattern() -> str:
    return "|".join(c.replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROL)


_ESCAPED_CHARS = rf"length(regexp_replace(replace({{0}}, '\', '\\'), '({_control_pattern()})', '\1_', 'g'))"

CHAT_SQL = rf"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
    (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(20 + CASE WHEN role = 'user' THEN 13 ELSE 0 END + {_ESCAPED_CHARS.format("role")}
        + {_ESCAPED_CHARS.format("text")}) AS BIGINT) AS formatted_chars,
    CAST(0 AS BIGINT) AS n_attachments
FROM rows GROUP BY conv_id"""


@query("op1_chat_format", CHAT_SQL)
def _op1(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], rows.schema)
    formatted = chat.format_conversations(chat.text_turns(rows.unionByName(probe)))
    return chat.read_back(formatted)


WARC_SQL = """
WITH rows AS (SELECT page_id, sha1(coalesce(html, '')) AS digest,
    CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
first AS (SELECT *, max(CASE WHEN bytes >= 1000 THEN page_id END) OVER (PARTITION BY digest) AS top FROM rows)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
    CASE WHEN bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM first"""


@query("op2_warc", WARC_SQL)
def _op2(spark: SparkSession, directory: str) -> DataFrame:
    path = scratch_path(spark, "llm/warc")
    warc.archive(table(spark, directory, "pages"), path)
    return warc.inventory(spark, path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_bpe_lexicon")
def _op3(spark: SparkSession, directory: str) -> DataFrame:
    docs, tokenizer = table(spark, directory, "documents"), tokenizer_path()
    encoded = lexicon.encode(docs, lexicon.share_lexicon(docs, tokenizer), tokenizer)
    decoded = lexicon.decode(encoded, tokenizer)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_adaptive_scan")
def _op4(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.nearest(table(spark, directory, "embeddings"), F.col("vec_id") % 20 == 0)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))


def _rules_sql(rules) -> str:
    def test(r: quality.Rule) -> str:
        scale = r.denominator or "1"
        low = [] if r.low is None else [f"{r.numerator} < {r.low}::DOUBLE * {scale}"]
        high = [] if r.high is None else [f"{r.numerator} > {r.high}::DOUBLE * {scale}"]
        return " OR ".join(low + high)

    return " OR ".join(test(r) for r in rules)


QUALITY_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM texts),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM cut WHERE len(w) >= 5),
windows AS (SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM starts),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS t(k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS BIGINT) AS n_stop_words
    FROM cut LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({_rules_sql(quality.RULES)}) AS kept
FROM j"""


@query("op5_quality_rules", QUALITY_SQL)
def _op5(spark: SparkSession, directory: str) -> DataFrame:
    return quality.assess(table(spark, directory, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op6_url_filter", urls.judge_sql())
def _op6(spark: SparkSession, directory: str) -> DataFrame:
    return urls.judge(table(spark, directory, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op7_pseudonyms")
def _op7(spark: SparkSession, directory: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, directory, "documents"), pseudonyms.session_key(spark))


@query("op8_language_id")
def _op8(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    held = language.held_out(F.col("doc_id"))
    return language.label(docs, language.fit(docs.filter(~held))).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


@query("op9_packing")
def _op9(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"), tokenizer_path())


@query("op10_simhash")
def _op10(spark: SparkSession, directory: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, directory, "documents")).select(
        "doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query("op11_license_scan", licenses.summary_sql())
def _op11(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, directory, "documents")))


@query("op12_turn_repair")
def _op12(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    return turns.read_back(turns.repair(turns.damage(rows)))


@query("op13_infill", infill.INFILL_SQL)
def _op13(spark: SparkSession, directory: str) -> DataFrame:
    return infill.transform(table(spark, directory, "documents"))
