import numpy as np
import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from sensorhealth.llm import copies

from .test_simhash import classes, slow_print


def brute(texts, similarity=0.8):
    """Component labels by exact similarity of the sets of five-word shingles."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(min(1, len(w)), len(w) - 4))})
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) - 1e-9 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def texts(rng):
    words = np.array([f"w{i}" for i in range(4000)])
    out = []
    for size in (4, 5, 9, 40, 200, 200, 600):
        base = rng.choice(words, size)
        for share in np.linspace(0, 0.06, 12):
            own = base.copy()
            at = rng.random(size) < share
            own[at] = rng.choice(words, at.sum())
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("bucket_rows,block_rows", [(32, 256), (3, 4)])
def test_replaced_words_against_brute_force(spark, docs, bucket_rows, block_rows):
    made = texts(np.random.default_rng(5))
    label = brute(made)
    assert len(set(made)) > len(set(label)) > 7
    kept = copies.keep_first(docs(list(enumerate(made))), bucket_rows=bucket_rows, block_rows=block_rows)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_ids_that_repeat_clash_or_are_null(spark, docs, odd_rows):
    one, two, three = (" ".join(f"{c}{i}" for i in range(100)) for c in "abc")
    rows = [(1, one), (1, two), (2, one), (3, three), (3, three), (None, three), (None, "x y"), (None, "x y")]
    kept = copies.keep_first(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "x y"), (1, one), (1, two), (3, three)]
    assert sorted(r["doc_id"] or 0 for r in copies.keep_first(docs(odd_rows)).collect()) == [0, 1, 4, 6, 7, 8]
    assert copies.keep_first(docs([])).collect() == []


def test_simhash_alone_proposes_what_its_bits_allow(spark, docs):
    """Without bands, sets are linked through fingerprints, and only if they are similar."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(4000)])
    base = rng.choice(words, 3000)
    near, far = base.copy(), rng.choice(words, 3000)
    near[7] = "other"
    made = docs(list(enumerate([" ".join(base), " ".join(near), " ".join(far), "a b", "a b c"])))
    own = copies.signatures(made)
    sets = {r["doc_id"]: r["set"] for r in own.collect()}
    classes = own.select("set", F.expr("cast(array() as array<bigint>)").alias("keys"), "fp")
    found = {(r["a"], r["b"]) for r in copies.links(made, classes, 0.8, 32, 256).collect()}
    assert found == {tuple(sorted((sets[0], sets[1])))}
    # fingerprints that agree do not make texts alike: the exact check decides
    forced = classes.withColumn("fp", F.lit(0).cast("bigint"))
    found = {(r["a"], r["b"]) for r in copies.links(made, forced, 0.8, 32, 256).collect()}
    least = min(sets.values())
    assert found <= {tuple(sorted((sets[0], sets[1])))} and (least not in (sets[0], sets[1]) or found)


def test_the_pipelines_stage_on_given_texts(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 100")
    rows = sorted((r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect())
    want = {rows[k][0] for k in brute([t.encode().lower() for _, t in rows])}
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r["doc_id"] for r in stage(spark, given, "").collect()} == want
    assert len(want) < len(set(classes([slow_print(t) for _, t in rows])))  # three bits leave some


def test_crowds_of_near_copies_are_copied_linearly(spark, docs, monkeypatch):
    """20,000 near copies of a page, and others that share its template, at a constant number of rows a text."""
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(50_000)])
    template, other = rng.choice(words, 60), rng.choice(words, 60)

    def made(base, own, n, changes):
        out = []
        for _ in range(n):
            text = base.copy()
            text[rng.choice(len(text), changes, replace=False)] = rng.choice(words, changes)
            out.append(" ".join([*text, *own]))
        return out

    rows = made(template, [], 20_000, 1) + [" ".join(other), *made(other, [], 299, 1)]
    rows += [" ".join([*template[:45], *rng.choice(words, 15)]) for _ in range(40)]  # the template, but not similar
    shipped = []
    plain = copies.crowd_links

    def watched(members, sets, *args):
        shipped.append((members.count(), members.filter("few").count()))
        return plain(members, sets, *args)

    monkeypatch.setattr(copies, "crowd_links", watched)
    kept = copies.keep_first(docs(list(enumerate(rows))))
    got = sorted(r["doc_id"] for r in kept.collect())
    alone = [i for i in range(20_300, 20_340)]
    assert got == [0, 20_000, *alone]
    (n, few), = shipped
    assert n > 19_000 and few <= 300  # what hubs leave, in either page's crowd, is one chunk or two
