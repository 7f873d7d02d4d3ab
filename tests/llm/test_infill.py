import hashlib
import re

import pytest

from sensorhealth.llm import infill
from sensorhealth.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    told, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(units)
    h = [int(told[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 80
    out = f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), sha(out), sha(text)


order = lambda r: tuple(map(str, r))


@pytest.mark.parametrize("units", [1, 3, infill.PIECE_UNITS])
def test_odd_rows(spark, docs, odd_rows, units):
    again = [(i, f"row {i} has some words <P of text> and\tends  \n") for i in range(60)]
    rows = [*odd_rows, *again, *again[:20], (61, "a<P>b"), (62, "a <M>"), (63, "< S> <p>"), (None, "other text"), (None, "a row without an id")]
    rows += [(i, "same id, other text") for i in range(20)]
    got = [tuple(r) for r in infill.transform(docs(rows), units=units).collect()]
    assert sorted(got, key=order) == sorted((slow(i, t) for i, t in rows), key=order)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert infill.transform(docs([])).collect() == []


def test_output_texts():
    text = " one two\n three  four "
    for i in range(200):
        made = infill.plan(i, text, 5)
        assert sha(infill.assemble(text, made, 2)) == slow(i, text)[5]
    assert infill.plan(0, "", 0).form == infill.plan(0, "a<S>", 1).form == "plain"


def test_given_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in QUERIES["op13_infill"](spark, SMALL).collect()]
    assert sorted(got, key=order) == sorted((slow(*r) for r in rows), key=order)


def test_texts_are_shuffled_once(docs, odd_rows):
    told = infill.transform(docs(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert told.count("Exchange") == 1 and told.count("Sort ") == 2
