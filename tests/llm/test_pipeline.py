import corpus_pipeline
from sensorhealth.llm import language, simhash
from sensorhealth.llm.queries import tokenizer_path
from sensorhealth.llm.tables import settle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .test_copies import brute
from .test_quality import plain

SMALL = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("kept", F.lit("own"))
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SMALL), f"test_{name}")
        assert sorted(docs.columns) == sorted(columns)
        frames.append(docs)
    rows = [{r["doc_id"]: r["text"] for r in f.collect()} for f in frames]
    model = language.fit(frames[0].filter(~language.held_out(F.col("doc_id"))))
    ids = sorted(rows[0])
    told = dict(zip(ids, language.Labeller(model, language.PENALTY).label([rows[0][i] or "" for i in ids])))
    assert set(rows[1]) == {i for i, r in told.items() if r["lang_pred"] != "und" and r["known"] >= 0.25}
    assert set(rows[2]) == {i for i, t in rows[1].items() if plain(t)["kept"]}
    ids = sorted(rows[2])
    group = brute([rows[2][i].encode().lower() for i in ids])
    assert set(rows[3]) == {ids[k] for k in group}
    assert set(rows[4]) == set(rows[3]) and rows[4] != rows[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    tokens = Tokenizer.from_file(tokenizer_path())
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == {
        i: len(tokens.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[4].items()
    }
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())
    assert corpus_pipeline.run(spark, SMALL).count() == len(pieces)


def test_odd_and_empty_tables(spark, docs, odd_rows):
    for rows in (odd_rows, []):
        table = docs(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            table = settle(stage(spark, table, SMALL), f"odd_{name}")
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SMALL)
        assert {r["doc_id"] for r in packed.collect()} <= {4}


def test_stage_names_and_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    assert simhash.near_duplicates.__defaults__[:2] == (3, 3)
