"""License scans by template markup.

A template is mandatory wording with marked regions: ``[optional] ... [/optional]`` may be left out as a
whole (and may be nested), ``[replace 1-4]`` stands for one to four words of any kind, ``[any a|b]`` for
one of the listed words. All templates are compiled into one automaton over words, which
``Scanner`` makes deterministic as it goes: one step for each word of a text, however many templates there
are, and no place of the text is tried twice. A text is accepted where every mandatory word matches
exactly and in order; the same automaton read backwards then tells where the accepted wording starts.

Words are runs of ASCII letters, digits and characters from U+0080 on, with A-Z in lower case. Each row is
scanned on its own, whole, in the task that reads it: no shuffle, no group, no broadcast.

Defined results: a null, empty or word-free text has no words and no matches; repeated rows and rows
without an id each give a row; an accepted template with an optional or replaceable end is reported once
for each start, with its furthest end; other columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z to a-z and nothing else, as ``str.lower`` would change other alphabets too.
LOWER = {c: c + 32 for c in range(65, 91)}
_MARKUP = re.compile(r"\[(/?optional|replace \d+-\d+|any [^\]]+)\]|(\S+)")


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    #: A plain phrase whose places are counted, beside the method's own templates.
    base: bool = False


BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

_UNDER = "[any licensed|released|distributed|available] under [optional] the terms of [/optional]"
_GNU = (
    f"[optional] [any this|the] [replace 1-3] is [/optional] {_UNDER} [optional] the [/optional] gnu general public "
    "license [optional] as published by the free software foundation [/optional] [optional] either [/optional] version"
)
_CC = f"{_UNDER} [optional] [any a|the] [/optional] [optional] creative commons [/optional] cc by"

#: Mandatory wording of common grants and notices: fixed values.
TEMPLATES = (
    *BASE,
    Template("gpl-2.0", f"{_GNU} 2"),
    Template("gpl-3.0", f"{_GNU} 3"),
    Template(
        "apache-2.0",
        f"{_UNDER} the apache license [optional] version [/optional] 2 0 [optional] the license you may not use "
        "this [replace 1-3] except in compliance with the license [/optional]",
    ),
    Template("mit-grant", f"{_UNDER} the mit license"),
    Template(
        "mit-notice",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction [optional] including without "
        "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software [/optional]",
    ),
    Template(
        "isc-notice",
        "permission to use copy modify and [optional] or [/optional] distribute this software for any purpose with or "
        "without fee is hereby granted",
    ),
    Template(
        "bsd-notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met [replace 0-60] neither the name of [replace 1-12] may be used to endorse or "
        "promote products derived from this software without specific prior written permission",
    ),
    Template("cc-by-4.0", f"{_CC} 4 0"),
    Template("cc-by-sa-4.0", f"{_CC} sa 4 0"),
    Template("cc-by-nc-4.0", f"{_CC} nc 4 0"),
)


def parse(markup: str) -> list:
    """Markup as a list of ("word", w), ("any", words), ("replace", low, high) and ("optional", list)."""
    top: list = []
    open_ = [top]
    for mark, word in _MARKUP.findall(markup.translate(LOWER)):
        if word:
            found = WORD.findall(word)
            if "".join(found) != word:
                raise ValueError(f"not a word: {word!r}")
            open_[-1].append(("word", word))
        elif mark == "optional":
            open_.append([])
        elif mark == "/optional":
            if len(open_) == 1 or not open_[-1]:
                raise ValueError("an optional region is empty or ends without a start")
            inner = open_.pop()
            open_[-1].append(("optional", inner))
        elif mark.startswith("any "):
            words = tuple(w.strip() for w in mark[4:].split("|"))
            if not all(WORD.fullmatch(w) for w in words):
                raise ValueError(f"not words: {mark!r}")
            open_[-1].append(("any", words))
        else:
            low, high = map(int, mark[8:].split("-"))
            if low > high:
                raise ValueError(f"bad region: {mark!r}")
            open_[-1].append(("replace", low, high))
    if len(open_) > 1:
        raise ValueError("an optional region has no end")
    if not mandatory(top):
        raise ValueError("a template needs a mandatory word")
    return top


def mandatory(items: list) -> int:
    """How many words of the wording are fixed (an ``any`` counts: its words are)."""
    return sum(kind in ("word", "any") for kind, *_ in items)


def reverse(items: list) -> list:
    return [("optional", reverse(i[1])) if i[0] == "optional" else i for i in reversed(items)]


class Automaton:
    """Words lead from state to state; ``None`` is every word. Skips over regions are folded into the edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[str | None, int]]] = []
        self.skips: list[list[int]] = []
        self.accepts: dict[int, int] = {}

    def state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _append(self, at: int, words: Iterable[str | None]) -> int:
        to = self.state()
        self.edges[at] += [(w, to) for w in words]
        return to

    def _add(self, at: int, items: list) -> int:
        for kind, *what in items:
            if kind == "word":
                at = self._append(at, what)
            elif kind == "any":
                at = self._append(at, what[0])
            elif kind == "replace":
                low, high = what
                end_points = []
                for n in range(high):
                    if n >= low:
                        end_points.append(at)
                    at = self._append(at, (None,))
                for p in end_points:
                    self.skips[p].append(at)
            else:
                start, at = at, self._add(at, what[0])
                self.skips[start].append(at)
        return at

    def add(self, items: list, index: int) -> int:
        start = self.state()
        self.accepts[self._add(start, items)] = index
        return start

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo += self.skips[s]
        return frozenset(out)

    def step(self, states: frozenset[int], word: str | None) -> frozenset[int]:
        return self.closed(to for s in states for w, to in self.edges[s] if w is None or w == word)

    def accepted(self, states: frozenset[int]) -> tuple[int, ...]:
        return tuple(sorted(self.accepts[s] for s in states if s in self.accepts))


class _Row(dict):
    """A deterministic state: the next state by word id, and the templates accepted on entering it."""

    __slots__ = ("states", "accepted")


@dataclass
class Scanner:
    """Finds all places of all templates in one pass over the words."""

    templates: tuple[Template, ...] = TEMPLATES
    #: Deterministic states kept; beyond it the table starts anew, with the same results.
    most: int = 20_000
    rows: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.forward, self.back = Automaton(), Automaton()
        items = [parse(t.markup) for t in self.templates]
        self.mandatory = [mandatory(i) for i in items]
        self.starts = self.forward.closed([self.forward.add(i, k) for k, i in enumerate(items)])
        self.ends = [self.back.closed([self.back.add(reverse(i), k)]) for k, i in enumerate(items)]
        words = sorted({w for edges in self.forward.edges for w, _ in edges if w is not None})
        self.ids = {w: i for i, w in enumerate(words, 1)}
        self.words = [None, *words]
        if any(k in self.forward.accepted(self.starts) for k in range(len(items))):
            raise ValueError("a template accepts nothing at all")

    def _row(self, states: frozenset[int]) -> _Row:
        row = self.rows.get(states)
        if row is None:
            if len(self.rows) >= self.most:
                self.rows.clear()
            row = self.rows[states] = _Row()
            row.states, row.accepted = states, self.forward.accepted(states)
        return row

    def _next(self, row: _Row, word: int) -> _Row:
        # an unlisted word takes the edges for every word only
        to = self._row(self.forward.step(row.states, self.words[word]) | self.starts)
        if len(row) < len(self.words):
            row[word] = to
        return to

    def places(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(template, start, stop) of accepted wording, by words."""
        row, told, get = self._row(self.starts), [], self.ids.get
        for i, word in enumerate(words):
            known = get(word, 0)
            to = row.get(known)
            row = to if to is not None else self._next(row, known)
            if row.accepted:
                told += [(k, i + 1) for k in row.accepted]
        furthest: dict[tuple[int, int], int] = {}
        for k, stop in told:  # by growing ends
            furthest[k, self._start(k, words, stop)] = stop
        return sorted((k, start, stop) for (k, start), stop in furthest.items())

    def _start(self, template: int, words: list[str], stop: int) -> int:
        states, at, found = self.ends[template], stop, stop
        while states and at:
            at -= 1
            states = self.back.step(states, words[at])
            if self.back.accepted(states):
                found = at
        return found

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int]]]:
        words = WORD.findall(text.translate(LOWER))
        return len(words), self.places(words)


MATCH = "struct<template:int,label:string,base:boolean,mandatory:int,start:bigint,stop:bigint>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches) of every row; a match names its label and its run of words."""
    Scanner(templates)  # bad markup fails here, not in the tasks
    schema = T.StructType(
        [docs.schema["doc_id"], *T._parse_datatype_string(f"n_words bigint, matches array<{MATCH}>")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind, scanner = to_arrow_schema(schema), Scanner(templates)
        for batch in batches:
            for at, texts in bytebpe.blocks(batch.column(1)):
                counts, matches = [], []
                for text in texts:
                    n, places = scanner.scan(text)
                    counts.append(n)
                    matches.append(
                        [
                            {"template": k, "label": templates[k].label, "base": templates[k].base,
                             "mandatory": scanner.mandatory[k], "start": start, "stop": stop}
                            for k, start, stop in places
                        ]
                    )
                ids = batch.column(0).slice(at, len(texts)).cast(kind[0].type)
                columns = [pa.array(v, f.type) for v, f in zip((counts, matches), list(kind)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *columns], schema=kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def confidence(mandatory: Column) -> Column:
    """A score from 0 to 1 that grows with the longest mandatory wording accepted: m / (m + 4)."""
    return F.coalesce(mandatory / (mandatory + F.lit(4)), F.lit(0.0))


def summary(scanned: DataFrame) -> DataFrame:
    """Places of base phrases, labels and score of every scanned row."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])

    def names(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        confidence(F.array_max(F.transform("matches", lambda m: m["mandatory"]))).alias("score"),
    )


def _regex(items: list) -> str:
    def one(kind: str, *what) -> str:
        if kind == "word":
            return f" {what[0]}"
        if kind == "any":
            return f" (?:{'|'.join(what[0])})"
        if kind == "replace":
            return f"(?: [^ ]+){{{what[0]},{what[1]}}}"
        return f"(?:{_regex(what[0])})?"

    return "".join(one(*i) for i in items)


def summary_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same from the same markup by another way: a regular expression for each template."""
    items = [parse(t.markup) for t in templates]
    plain = [(t, i) for t, i in zip(templates, items, strict=True) if t.base]
    places = ",\n    ".join(
        f"list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(i) - 1}] = "
        f"[{', '.join(repr(word) for _, word in i)}]) AS p{k}"
        for k, (_, i) in enumerate(plain)
    )
    every = f"list_concat({', '.join(f'p{k}' for k in range(len(plain)))})"
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{t.label}' END" for k, (t, _) in enumerate(plain))
    tests = [f"regexp_matches(s, '{_regex(i)} ')" for i in items]
    more = ", ".join(f"CASE WHEN {x} THEN '{t.label}' END" for x, t in zip(tests, templates, strict=True))
    most = ", ".join(f"CASE WHEN {x} THEN {mandatory(i)} ELSE 0 END" for x, i in zip(tests, items, strict=True))
    tidy = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    return rf"""
WITH cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s,
    {places} FROM cut),
told AS (SELECT *, {every} AS starts, greatest({most}) AS m FROM found)
SELECT doc_id, n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) - 1 AS first_word,
    list_max(starts) - 1 AS last_word, {tidy.format(labels)} AS base_labels, {tidy.format(more)} AS labels,
    m / (m + 4) AS score FROM told"""
