import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorhealth.llm import language

DATA = "/root/testdata/sf0.01/documents.parquet"


def one_by_one(scores, penalty):
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: (best[i], -i))
        back.append([i if best[i] >= best[top] - penalty else top for i in range(len(best))])
        best = [max(v, best[top] - penalty) + s for v, s in zip(best, row)]
    return max(best)


def value(scores, labels, penalty):
    return sum(scores[t][k] for t, k in enumerate(labels)) - penalty * int(np.count_nonzero(np.diff(labels)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(*[st.integers(-5, 0)] * 3), min_size=1, max_size=12), min_size=1, max_size=5))
def test_viterbi_finds_the_best_labels(texts):
    rows = [np.array(t, np.float32) for t in texts]
    for own, labels in zip(rows, language.viterbi(rows, 4.0)):
        assert len(labels) == len(own)
        assert value(own.tolist(), labels, 4.0) == pytest.approx(one_by_one(own.tolist(), 4.0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-5, 0)] * 3), min_size=1, max_size=14))
def test_no_switch_pays_where_none_is_tried(rows):
    scores = np.array(rows, np.float32)
    best = int(scores.sum(axis=0).argmax())
    model = language.Model(("a", "b", "c"), np.zeros((1, 3), np.float32), np.zeros((1, 3), bool))
    if not language.Labeller(model, 6.0).can_switch(scores, best):
        assert one_by_one(scores.tolist(), 6.0) == pytest.approx(scores[:, best].sum())


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(DATA)
    return language.fit(docs.filter(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(DATA).filter(language.held_out(F.col("doc_id")))
    rows = language.label(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_is_cut_where_the_language_changes(spark, model, docs):
    texts = {r["lang"]: r["text"] for r in spark.read.parquet(DATA).filter("n_chars > 2000").collect()}
    words = [w for lang in ("de", "fr") for w in texts[lang].split()[:100]]
    row = language.label(docs([(1, " ".join(words))]), model).first()
    assert {s["lang"] for s in row["spans"]} == {"de", "fr"} and row["spans"][0]["start"] == 0
    cut = row["spans"][1]["start"]
    assert abs(cut - 100) <= 4 and row["spans"][-1]["stop"] == 200
    assert 0.4 < row["score"] < 0.7


def test_scripts_narrow_candidates(spark, docs):
    rows = docs([(i, t) for i in range(8) for t in ("мир и труд", "peace and work")])
    rows = rows.withColumn("lang", F.when(F.col("text").startswith("м"), "ru").otherwise("en"))
    model = language.fit(rows)
    asked = docs([(1, "дом"), (2, "tree"), (3, "中文"), (4, "12 34"), (5, None), (6, ""), (6, "tree"), (None, "tree " * 40000)])
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in language.label(asked, model).collect()))
    assert got == [(0, "en"), (1, "ru"), (2, "en"), (3, "en"), (4, "und"), (5, "und"), (6, "en"), (6, "und")]
    kept = language.keep_known(rows)
    assert kept.columns == rows.columns and kept.count() == 16


def test_nothing_to_learn_from(spark, docs):
    none = language.fit(docs([(1, None)]))
    assert language.label(docs([(1, "text")]), none).first()["lang_pred"] == "und"
    assert language.label(docs([]), none).collect() == []


def test_texts_in_unknown_languages_are_rejected(spark, model, docs):
    others = [
        "Все люди рождаются свободными и равными в своём достоинстве и правах",
        "人人生而自由 在尊严和权利上一律平等",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    ]
    told = language.label(docs(list(enumerate(others))), model).collect()
    assert all(r["lang_pred"] in model.languages and r["score"] < 0.25 for r in told)
    assert [r["score"] for r in told if r["doc_id"] < 3] == [0, 0, 0]
    known = {r["lang"]: r["text"] for r in spark.read.parquet(DATA).filter("n_chars > 2000").collect()}
    mixed = " ".join(w for lang in sorted(known) for w in known[lang].split()[:60])
    texts = [*others, *known.values(), mixed]
    labelled = spark.read.parquet(DATA).withColumn("source", F.lit("given"))
    asked = docs(list(enumerate(texts, 10**6))).select(*labelled.columns).withColumn("lang", F.lit(None).cast("string"))
    kept = language.keep_known(labelled.unionByName(asked)).filter("source = 'src'")
    assert sorted(r["doc_id"] - 10**6 for r in kept.collect()) == list(range(len(others), len(texts)))


def plain_bucket(a, b, c):
    mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) % 2**32
    mixed ^= mixed >> 15
    return (mixed * 0x2C1B3C6D % 2**32) >> 16


def plain_script(char):
    return [name for first, name in language.SCRIPTS if first <= ord(char)][-1]


def plain_words(text):
    """Letters of each word, in lower case."""
    return ["".join(c for c in w if c.isalpha()).lower() for w in (text or "").split()]


def plain_grams(word):
    told = f" {word} "
    return [plain_bucket(*map(ord, told[i : i + 3])) for i in range(len(word))]


def plain_model(rows):
    """(languages, log rates by trigram bucket, scripts in use) from (lang, text) rows."""
    grams, scripts = {}, {}
    for lang, text in rows:
        for w in plain_words(text):
            for g, c in zip(plain_grams(w), w):
                grams.setdefault(lang, {}).setdefault(g, 0)
                grams[lang][g] += 1
                scripts.setdefault(lang, {}).setdefault(plain_script(c), 0)
                scripts[lang][plain_script(c)] += 1
    languages = sorted(grams)
    total = {x: sum(grams[x].values()) for x in languages}
    met = {g for x in languages for g in grams[x]}
    rate = {x: {g: np.log((grams[x].get(g, 0) + 0.5) / (total[x] + 0.5 * language.BUCKETS)) for g in met} for x in languages}
    none = {x: np.log(0.5 / (total[x] + 0.5 * language.BUCKETS)) for x in languages}
    used = {x: {s for s, n in scripts[x].items() if n >= 0.01 * total[x]} | {"common"} for x in languages}
    return languages, rate, none, used, met


def plain_label(text, model):
    """(language, score) by decoding every text word by word."""
    languages, rate, none, used, met = model
    words = plain_words(text)
    if not any(words):
        return "und", 0.0
    scores, proof = [], []
    for w in words:
        fits = [all(plain_script(c) in used[x] for c in w) for x in languages]
        if not w:
            scores.append([0.0] * len(languages))
            proof.append([False] * len(languages))
            continue
        own, likely = [], []
        for x in languages:
            known = [g for g in plain_grams(w) if g in met]
            mean = [np.mean([rate[y][g] for y in languages]) for g in known]
            own.append(sum(rate[x][g] - m for g, m in zip(known, mean)))
            odds = sum((rate[x][g] if g in met else none[x]) + np.log(language.BUCKETS) for g in plain_grams(w))
            likely.append(odds >= language.EVIDENCE * len(w))
        own = [s if f else -30.0 * len(w) for s, f in zip(own, fits)] if any(fits) else [0.0] * len(own)
        scores.append([s - max(own) for s in own])
        proof.append([f and p for f, p in zip(fits, likely)])
    best, back = list(scores[0]), []
    for row in scores[1:]:
        top = max(range(len(best)), key=lambda i: (best[i], -i))
        back.append([i if best[i] >= best[top] - language.PENALTY else top for i in range(len(best))])
        best = [max(v, best[top] - language.PENALTY) + s for v, s in zip(best, row)]
    at = max(range(len(best)), key=lambda i: (best[i], -i))
    labels = [at]
    for step in reversed(back):
        at = step[at]
        labels.append(at)
    labels.reverse()
    held, proven = [0] * len(languages), [0] * len(languages)
    for w, k, p in zip(words, labels, proof):
        held[k] += len(w)
        proven[k] += len(w) * p[k]
    k = max(range(len(held)), key=lambda i: (held[i], -i))
    return languages[k], proven[k] / sum(map(len, words))


def test_fit_score_and_label_against_plain_code(spark):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.001"))
    rows = docs.select("doc_id", "lang", "text").collect()
    learned = docs.filter(~language.held_out(F.col("doc_id")))
    ids = {r["doc_id"] for r in learned.collect()}
    model = plain_model([(r["lang"], r["text"]) for r in rows if r["doc_id"] in ids and r["lang"] and r["text"]])
    got = {r["doc_id"]: r for r in language.label(docs, language.fit(learned)).collect()}
    for r in rows:
        lang, score = plain_label(r["text"], model)
        told = got[r["doc_id"]]
        assert told["lang_pred"] == lang and told["score"] == pytest.approx(score, abs=1e-9), r["doc_id"]
    assert len(rows) == 200


def test_free_text_is_no_language(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    rows = spark.createDataFrame([(i, f"l{i}", "some text") for i in range(4)], "doc_id bigint, lang string, text string")
    assert len(language.fit(rows.filter("doc_id < 3")).languages) == 3
    with pytest.raises(ValueError):
        language.fit(rows)
