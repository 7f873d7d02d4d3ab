"""Quality rules: a threshold table compiled into one Spark projection.

``features`` computes the base measures of a text as one struct expression, ``RULES`` names ratios of
them with their limits, and ``verdict`` compiles the table into expressions over that struct. There
are no user functions, no shuffle and no join: one pass over the rows.

Words are runs of characters other than the six ASCII white space characters. Repeated word windows
are found by sorting 64-bit hashes of the windows of one text; two different windows of a text of n
windows share a hash with odds below n^2 / 2^65.

Defined results: a null or empty text has no words and fails the base rule; a ratio whose denominator
is 0 is 0; repeated rows each get their own verdict; other columns are untouched, as the measures
travel in one struct and the filter adds no column. Whole texts are measured, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import let

WORD_WINDOW = 5

#: Frequent function words of the supported languages, lower case.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by are this at from "
    "de la que el en y los las se del un por con no una su para es al lo "
    "le et les des du une est pour par dans avec qui pas sur au "
    "der die und den von zu das sich mit auf für ist im nicht dem ein eine als"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; a null limit is open."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


#: Hard limits whose failure is ``base_failed``.
BASE = (
    Rule("word_count", "n_words", low=10),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=0.2),
)
#: The method's own limits.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbol_ratio", "n_symbols", "word_chars", high=0.05),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more."""
    n, k = F.size(words), WORD_WINDOW

    def of_sorted(entries: Column) -> Column:
        again = F.filter(
            entries,
            lambda x, i: F.coalesce(F.get(entries, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(entries, i + 1)["h"] == x["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("covered"), F.lit(-k).alias("last")),
            lambda a, i: F.struct(
                (a["covered"] + F.least(F.lit(k), i - a["last"])).alias("covered"), i.alias("last")
            ),
            lambda a: a["covered"],
        )

    def of_hashes(hashes: Column) -> Column:
        entries = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(entries, of_sorted)
        )

    windows = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(n < k, F.lit(0)).otherwise(let(windows, of_hashes))


def features(text: Column) -> Column:
    """The measures of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        return let(
            F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
            lambda lines: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
                F.size(lines).cast("bigint").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
                _repeat_words(words).cast("bigint").alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS)))
                .cast("bigint")
                .alias("n_stop_words"),
            ),
        )

    return let(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), of_words)


def _fails(rule: Rule, measured: Column) -> Column:
    """The rule's limits as one comparison; ratios are compared without dividing."""
    value, scale = measured[rule.numerator], F.lit(1)
    if rule.denominator is not None:
        scale = measured[rule.denominator]
    tests = []
    if rule.low is not None:
        tests.append(value < F.lit(rule.low) * scale)
    if rule.high is not None:
        tests.append(value > F.lit(rule.high) * scale)
    return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


def compile_rules(rules: tuple[Rule, ...], measured: Column) -> Column:
    """Names of the rules that fail, as an array, in the table's order."""
    return F.filter(
        F.array(*(F.when(_fails(r, measured), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()
    )


def verdict(text: Column, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> Column:
    """Measures, failed rules, ``base_failed`` and ``kept`` of a text as one struct."""

    def judged(m: Column) -> Column:
        low = F.size(compile_rules(base, m)) > 0
        own = compile_rules(rules, m)
        return F.struct(
            m.alias("measures"),
            own.alias("failed_rules"),
            low.alias("base_failed"),
            (~low & (F.size(own) == 0)).alias("kept"),
        )

    return let(features(text), judged)


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with its measures and verdict."""
    judged = docs.select("doc_id", verdict(F.col("text"), rules).alias("v"))
    return judged.select("doc_id", "v.measures.*", "v.failed_rules", "v.base_failed", "v.kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    return docs.filter(verdict(F.col("text"), rules)["kept"])
