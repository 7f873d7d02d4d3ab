import random
import re

import pytest

from sensorhealth.llm import licenses
from sensorhealth.llm.licenses import Scanner, Template, parse
from sensorhealth.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ends(items, words, at):
    """Where the items may stop when they start at a word, by trying every way."""
    if not items:
        return {at}
    (kind, *what), rest = items[0], items[1:]
    if kind == "optional":
        return ends(rest, words, at) | {e for m in ends(what[0], words, at) for e in ends(rest, words, m)}
    if kind == "replace":
        return {e for n in range(what[0], what[1] + 1) if at + n <= len(words) for e in ends(rest, words, at + n)}
    listed = what if kind == "word" else what[0]
    return ends(rest, words, at + 1) if at < len(words) and words[at] in listed else set()


def slow_places(templates, words):
    """Furthest stop of each accepted start; of starts that share a stop only the first."""
    out = set()
    for k, t in enumerate(templates):
        stops = {}
        for at in range(len(words)):
            for e in ends(parse(t.markup), words, at):
                stops.setdefault(e, at)
        starts = {}
        for e, at in stops.items():
            starts[at] = max(starts.get(at, 0), e)
        out |= {(k, at, e) for at, e in starts.items()}
    return sorted(out)


def test_random_templates_against_brute_force():
    rng = random.Random(2)

    def items(depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            pick = rng.random()
            if pick < 0.5 or depth > 1:
                out.append(rng.choice("abc"))
            elif pick < 0.65:
                out.append(f"[any {'|'.join(rng.sample('abcd', 2))}]")
            elif pick < 0.8:
                low = rng.randrange(3)
                out.append(f"[replace {low}-{low + rng.randrange(3)}]")
            else:
                out.append(f"[optional] {items(depth + 1)} [/optional]")
        return " ".join(out)

    for _ in range(300):
        templates = tuple(Template(f"t{k}", f"{rng.choice('abc')} {items(0)}") for k in range(3))
        scanner = Scanner(templates, most=rng.choice([1, 3, 1000]))
        for _ in range(4):
            words = [rng.choice("aabbccdx") for _ in range(rng.randrange(30))]
            assert scanner.places(words) == slow_places(templates, words), (templates, words)


def test_regions():
    scanner = Scanner((Template("x", "the [any big|small] cat [optional] or [replace 0-2] dog [/optional] sat"),))
    accepted = lambda t: bool(scanner.scan(t)[1])
    assert accepted("The BIG cat sat") and accepted("a the small cat, or the old dog: sat.") and accepted("the big cat or dog sat")
    assert not accepted("the cat sat") and not accepted("the big cat or the very old dog sat") and not accepted("the big cat or sat")


@pytest.mark.parametrize("markup", ["[optional] a", "a [/optional]", "[optional] [/optional] a", "[replace 3-1] a", "[replace 1-2]", "a-b", "[any a|b c] d", ""])
def test_bad_markup(markup):
    with pytest.raises(ValueError):
        Scanner((Template("x", markup),))


def slow(doc_id, text):
    words = words_of(text)
    found = [(licenses.TEMPLATES[k], at) for k, at, _ in slow_places(licenses.TEMPLATES, words)]
    starts = [at for t, at in found if t.base]
    most = max((licenses.mandatory(parse(t.markup)) for t, _ in found), default=0)
    names = lambda chosen: ",".join(sorted({t.label for t in chosen}))
    return (doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None),
            names(t for t, _ in found if t.base), names(t for t, _ in found), most / (most + 4))


def test_notices_and_odd_rows(spark, docs, odd_rows):
    rows = [
        *odd_rows,
        (10, "This work is licensed under the GNU General Public License, version 3."), (11, "Released under the MIT License."),
        (12, "Licensed under CC BY-NC 4.0."), (13, "Licensed under the Apache License, Version 2.0."), (14, "cc by cc by CC-BY; mit\nlicense"),
        (15, "The Foo program is distributed under the terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 2 of the License"),
        (16, "released under the mıt license MİT LICENSE mit licenses xmit license İmit license"), (17, "gnu general public licence cc 4 by"),
        (18, "apache license " * 20000), (19, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (20, "中文 mit license 中文"), (20, "ms-by cc\x00by"), (None, "mit license"),
    ]
    got = licenses.summary(licenses.scan(docs(rows))).collect()
    order = lambda r: (str(r[0]), r[1:3], r[6])
    assert sorted(map(tuple, got), key=order) == sorted((slow(i, t) for i, t in rows), key=order)
    assert licenses.scan(docs([])).collect() == []
    told = {r["doc_id"]: r["labels"] for r in got}
    assert [told[i] for i in (10, 11, 12, 13)] == ["gpl,gpl-3.0", "mit,mit-grant", "cc-by,cc-by-nc-4.0", "apache,apache-2.0"]
    assert told[15] == "gpl,gpl-2.0" and told[19] == "" and told[20] in ("cc-by", "mit")


def test_given_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_license_scan"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(slow(*r) for r in rows)
    assert any(r["labels"] for r in got)


def test_no_shuffle(docs, odd_rows):
    told = licenses.summary(licenses.scan(docs(odd_rows)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in told
