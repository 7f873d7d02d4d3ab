"""Language of documents and of the spans of mixed-language texts.

Words (runs between white space) are scored per language by their letter trigrams. Unicode script
ranges narrow a word's candidates to the languages that use its script. Viterbi decoding over the
words, with a penalty for switching, labels spans; a document's language is the one with most letters.

The classifier is fitted on a bounded sample of labelled rows (``per_language`` rows of each language,
chosen by a hash of the id); trigram and script counts of the sample are summed in Spark. Everything
else covers all rows and whole texts.

A text is decoded only if a switch can pay: if no stretch of words favours another language over the
overall best one by more than half the penalty, no labelling with a switch scores higher.

A word is evidence for a language if the language uses its scripts and its trigrams are together likelier
there, by ``EVIDENCE`` a letter, than in text of evenly frequent trigrams. A text's score is the share of its
letters in words that are labelled with its language and are evidence for it. Texts in other scripts or
languages still get the learned language that fits least badly, with a score of or near 0.

Defined results: null, empty and letterless texts are ``und`` with score 0 and no spans; ties go to the
language that sorts first; rows without a language are not learned from; with no labelled rows every
text is ``und``; repeated rows get equal results; other columns are ignored. Each text is held by one
task, with one byte per word and language while it is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe

BUCKETS = 1 << 16
PER_LANGUAGE = 3000
#: A model holds a number for each bucket and language; more languages than this are an error.
MOST_LANGUAGES = 2000
#: Cost of a switch between languages, in units of the words' log odds.
PENALTY = 24.0
#: Log odds a letter, against evenly frequent trigrams, from which a word is evidence for a language.
EVIDENCE = 1.0
UNKNOWN = "und"

#: First code points of script blocks (public Unicode ranges); 0 marks blocks common to scripts.
SCRIPTS = (
    (0x0000, "common"), (0x0041, "latin"), (0x02B0, "common"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"),
    (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "common"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0xFFA0, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_FIRST = np.array([c for c, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket, script) of every letter of letters-only words, and the words' ends and sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    a, b, c = code[:-2], code[1:-1], code[2:]
    mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    buckets = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    inside = np.ones(len(b), bool)
    if len(words) > 1:
        inside[np.cumsum(sizes + 1)[:-1] - 1] = False  # the spaces between words
    inside = inside[: len(b)]
    scripts = _SCRIPT[np.searchsorted(_FIRST, b, "right") - 1]
    return buckets[inside], scripts[inside], np.cumsum(sizes), sizes


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # bucket x language: log odds against the languages' mean
    allowed: np.ndarray  # script x language: the language uses the script
    odds: np.ndarray | None = None  # bucket x language: log odds against evenly frequent trigrams

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores per language (0 is neutral), letter counts and evidence of words as they stand in a text."""
        own = [letters(w) for w in words]
        out = np.zeros((len(words), len(self.languages)), np.float32)
        proof = np.zeros(out.shape, bool)
        filled = [i for i, w in enumerate(own) if w]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        if filled:
            buckets, scripts, ends, n = features([own[i] for i in filled])
            starts = ends - n
            total = np.add.reduceat(self.scores[buckets], starts, axis=0)
            usable = np.logical_and.reduceat(self.allowed[scripts], starts, axis=0)
            some = usable.any(axis=1)
            total = np.where(usable, total, -30.0 * n[:, None])
            total[~some] = 0
            out[filled] = total - total.max(axis=1, keepdims=True)
            likely = np.add.reduceat(self.odds[buckets], starts, axis=0) >= EVIDENCE * n[:, None]
            proof[filled] = usable & likely
        return out, sizes, proof


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (doc_id, lang, text) rows; about ``per_language`` of each language."""
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    languages = tuple(sorted(r["_lang"] for r in counts.limit(MOST_LANGUAGES + 1).collect()))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is the language column free text?")
    shares = counts.select("_lang", F.least(F.lit(1.0), F.lit(per_language) / F.col("_n")).alias("_share"))
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fit")), F.lit(10**12))
    chances = F.broadcast(shares)  # a row for each language, MOST_LANGUAGES at most
    met = labelled.join(chances, labelled["lang"] == chances["_lang"])
    sample = met.filter(drawn < F.col("_share") * 10**12).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in bytebpe.blocks(batch.column(1)):
                for lang, text in zip(langs[at : at + len(texts)], texts, strict=True):
                    words = [w for w in map(letters, text.split()) if w]
                    if not words:
                        continue
                    buckets, scripts, _, _ = features(words)
                    own = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    own[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(scripts, minlength=len(SCRIPT_NAMES))
        for lang, own in sums.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(cells), pa.string()), "cell": cells, "n": own[cells]}
            )

    cells = sample.mapInArrow(run, "lang string, cell bigint, n bigint")
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    # at most a row for each bucket and language
    for r in cells.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        table[r["cell"], languages.index(r["lang"])] = r["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    rates = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS))
    centred = rates - rates.mean(axis=1, keepdims=True)
    centred[grams.sum(axis=1) == 0] = 0
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
    used[SCRIPT_NAMES.index("common")] = True
    odds = rates + np.log(BUCKETS)
    return Model(languages, centred.astype(np.float32), used, odds.astype(np.float32))


def viterbi(rows: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of several sequences of scores (words x languages), side by side."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
    at = 0
    while at < len(order):
        longest, width = len(rows[order[at]]), rows[0].shape[1]
        group = order[at : at + max(1, (24 << 20) // max(1, longest * width * 4))]
        at += len(group)
        sizes = np.array([len(rows[i]) for i in group])
        score = np.zeros((longest, len(group), width), np.float32)
        for k, i in enumerate(group):
            score[: len(rows[i]), k] = rows[i]
        active = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
        best = score[0].astype(np.float64)
        stay = np.ones(score.shape, bool)
        origin = np.zeros(score.shape[:2], np.int32)
        for t in range(1, longest):
            k = active[t]
            v = best[:k]
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top] - penalty
            keep = v >= jump[:, None]
            stay[t, :k], origin[t, :k] = keep, top
            best[:k] = np.where(keep, v, jump[:, None]) + score[t, :k]
        labels = np.zeros(score.shape[:2], np.int32)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            labels[t, :k] = now[:k]
            if t:
                keep = stay[t, np.arange(k), now[:k]]
                now[:k] = np.where(keep, now[:k], origin[t, :k])
        for k, i in enumerate(group):
            out[i] = labels[: sizes[k], k]
    return out


class Labeller:
    """Labels texts with a model; scores of words that were met are kept up to a bound."""

    def __init__(self, model: Model, penalty: float, most: int = 300_000):
        self.model, self.penalty, self.most = model, penalty, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.proof = np.zeros((0, len(self.model.languages)), bool)

    def learn(self, split: list[list[str]]) -> None:
        if len(self.index) > self.most:
            self.clear()
        met: set[str] = set()
        for words in split:
            met.update(words)
        new = [w for w in met if w not in self.index]
        if new:
            scores, sizes, proof = self.model.word_scores(new)
            self.index.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, sizes])
            self.proof = np.concatenate([self.proof, proof])

    def can_switch(self, rows: np.ndarray, best: int) -> bool:
        """Some stretch favours another language by over half the penalty."""
        ahead = np.cumsum(rows - rows[:, best : best + 1], axis=0, dtype=np.float64)
        low = np.minimum.accumulate(np.minimum(ahead, 0), axis=0)
        before = np.vstack([np.zeros((1, rows.shape[1])), low[:-1]])
        return bool((ahead - before).max() > self.penalty / 2)

    def label(self, texts: list[str]) -> list[dict]:
        """Per text: language, score, spans of words [start, stop) with their language, and known.

        ``known`` is the share of letters in words that are evidence for their span's language.
        """
        split = [t.split() for t in texts]
        nothing = {"lang_pred": UNKNOWN, "score": 0.0, "spans": [], "known": 0.0}
        out = [nothing] * len(texts)
        if not self.model.languages:
            return out
        self.learn(split)
        mixed: list[tuple[int, np.ndarray, np.ndarray]] = []  # text, its words' rows and scores
        for i, words in enumerate(split):
            rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            sizes = self.letters[rows]
            if not sizes.any():
                continue
            scores = self.scores[rows]
            best = int(scores.sum(axis=0, dtype=np.float64).argmax())
            if self.can_switch(scores, best):
                mixed.append((i, rows, scores))
            else:
                name = self.model.languages[best]
                span = {"start": 0, "stop": len(words), "lang": name}
                share = float(sizes[self.proof[rows, best]].sum() / sizes.sum())
                out[i] = {"lang_pred": name, "score": share, "spans": [span], "known": share}
        for (i, rows, _), labels in zip(mixed, viterbi([m[2] for m in mixed], self.penalty), strict=True):
            sizes = self.letters[rows]
            by_language = np.bincount(labels, weights=sizes, minlength=len(self.model.languages))
            best = int(by_language.argmax())
            proven = np.bincount(labels, weights=sizes * self.proof[rows, labels], minlength=len(by_language))
            cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            out[i] = {
                "lang_pred": self.model.languages[best],
                "score": float(proven[best] / sizes.sum()),
                "known": float(proven.sum() / sizes.sum()),
                "spans": [
                    {"start": a, "stop": b, "lang": self.model.languages[labels[a]]}
                    for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                ],
            }
        return out


LABELS = "lang_pred string, score double, spans array<struct<start:bigint,stop:bigint,lang:string>>"


def label(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(LABELS)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = list(to_arrow_schema(schema))[1:]
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            for at, texts in bytebpe.blocks(batch.column(1)):
                found = labeller.label(texts)
                columns = [pa.array([r[f.name] for r in found], f.type) for f in kind]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *columns], names=["doc_id", *(f.name for f in kind)]
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, least_score: float = 0.25, penalty: float = PENALTY, **options) -> DataFrame:
    """The documents with ``least_score`` of the letters in words of learned languages, columns as they are.

    The languages of a mixed text count together.
    """
    model = fit(docs.filter(~held_out(F.col("doc_id"))), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for at, texts in bytebpe.blocks(batch.column(text)):
                keep = [r["lang_pred"] != UNKNOWN and r["known"] >= least_score for r in labeller.label(texts)]
                yield batch.slice(at, len(texts)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
