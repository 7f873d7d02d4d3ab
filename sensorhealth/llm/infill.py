"""Fill-in-middle transformation by secondary sort.

A text is cut into units (white space and the word after it; white space alone at the end). ``plan`` draws
a document's two cuts and its form from a keyed digest of its id. A transformed document is emitted as
pieces of a bounded number of units, keyed by document and position in the output. Documents are dealt out
by key and sorted within partitions by (document, position) - the DataFrame form of
repartitionAndSortWithinPartitions - so that a task streams the pieces of one document after another into
an incremental digest and holds one piece at a time. The pieces that leave that stream are read by their
sentinels alone, get their position in the original, and are sorted again within the same partitions:
texts are shuffled once. Plain documents need no assembly: they are digested where they are read and only
their finished rows travel along, without a text.

Defined results: a null text is empty; an empty text, one that holds a sentinel, and one not drawn are
plain; a null id is drawn as an empty id; rows that repeat an id and text give a row each, rows that share
an id with other texts are told apart by a 128-bit digest of the text; a unit is never cut, so a piece
holds one unit at least, however long; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bytebpe

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Positions leave room for this many pieces of one part.
_PART = 1 << 40
PIECE_UNITS = 1024


@dataclass(frozen=True)
class Rates:
    """Percent of documents that are transformed, and of these in suffix-prefix-middle order."""

    seed: int = 42
    fim: int = 50
    spm: int = 80


@dataclass(frozen=True)
class Plan:
    form: str
    n: int
    first: int = 0
    second: int = 0

    @property
    def order(self) -> tuple[str, ...]:
        return (PREFIX, SUFFIX, MIDDLE) if self.form == "psm" else (SUFFIX, PREFIX, MIDDLE)


def draws(doc_id: int | None, seed: int) -> list[int]:
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def plan(doc_id: int | None, text: str, n: int, rates: Rates = Rates()) -> Plan:
    h = draws(doc_id, rates.seed)
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rates.fim:
        return Plan("plain", n)
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return Plan("spm" if h[3] % 100 < rates.spm else "psm", n, first, second)


def pieces(text: str, ends: list[int], made: Plan, units: int) -> Iterator[tuple[int, str]]:
    """(position in the output, piece): sentinels stand alone, parts come in runs of units."""
    parts = {PREFIX: (0, made.first), MIDDLE: (made.first, made.second), SUFFIX: (made.second, made.n)}
    position = 0
    for sentinel in made.order:
        yield position, sentinel
        position += 1
        a, b = parts[sentinel]
        for k in range(a, b, units):
            start, stop = ends[k - 1] if k else 0, ends[min(k + units, b) - 1]
            yield position, text[start:stop]
            position += 1


def assemble(text: str, made: Plan, units: int = PIECE_UNITS) -> str:
    """The output of one text as a whole."""
    if made.form == "plain":
        return text
    return "".join(p for _, p in pieces(text, [m.end() for m in UNIT.finditer(text)], made, units))


EMITTED = (
    "key binary, position bigint, piece string, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
    "output_sha256 string"
)

TRANSFORMED = (
    "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
)


def emit(docs: DataFrame, rates: Rates = Rates(), units: int = PIECE_UNITS) -> DataFrame:
    """Pieces of transformed documents; plain ones are one finished row with a null position."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(EMITTED)])

    def rows(doc_id: int | None, text: str) -> Iterator[tuple]:
        import xxhash

        ends = [m.end() for m in UNIT.finditer(text)]
        made, key = plan(doc_id, text, len(ends), rates), xxhash.xxh3_128_digest(text.encode())
        if made.form == "plain":
            yield doc_id, key, None, None, made.n, "plain", None, None, hashlib.sha256(text.encode()).hexdigest()
            return
        cuts = [ends[k - 1] if k else 0 for k in (made.first, made.second)]
        for position, piece in pieces(text, ends, made, units):
            yield doc_id, key, position, piece, made.n, made.form, cuts[0], cuts[1] - cuts[0], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in bytebpe.blocks(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts)).to_pylist()
                yield from _batches((r for i, t in zip(ids, texts, strict=True) for r in rows(i, t)), schema)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _batches(rows: Iterable[tuple], schema: T.StructType, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of few rows, as a row may hold a large piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, held = to_arrow_schema(schema), []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else ([] for _ in kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield batch()
            held = []
    yield batch()


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


_SAME = ("doc_id", "key")


def _output(rows: Iterator[dict]) -> Iterator[tuple]:
    """Sorted pieces in, the same pieces out with their positions in the original, then the output's digest.

    The positions come from the sentinels in the output alone; equal rows are counted at position 0.
    """
    group = digest = last = None
    part, at, copies = 0, 0, 0

    def done() -> Iterator[tuple]:
        if last is not None:
            yield (last["doc_id"], last["key"], -1, None, last["n"], last["form"], last["prefix_chars"],
                   last["middle_chars"], digest.hexdigest(), copies)

    for row in rows:
        if row["position"] is None:
            yield *row.values(), 1
            continue
        if (own := tuple(row[c] for c in _SAME)) != group:
            yield from done()
            group, digest, last, copies = own, hashlib.sha256(), None, 0
        if row["position"] == 0:
            copies += 1
        if last is not None and row["position"] == last["position"]:
            continue
        last, piece = row, row["piece"]
        digest.update(piece.encode())
        if piece in SENTINELS:
            part, at = (PREFIX, MIDDLE, SUFFIX).index(piece), 0
            continue
        yield row["doc_id"], row["key"], part * _PART + at, piece, None, None, None, None, None, None
        at += 1
    yield from done()


def _restored(rows: Iterator[dict]) -> Iterator[tuple]:
    """Pieces in the original's order, after the output's own row (position -1): one row for each copy."""
    group = digest = head = None

    def told(row: dict) -> tuple:
        return tuple(row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"))

    def done() -> Iterator[tuple]:
        if head is not None:
            for _ in range(head["copies"]):
                yield *told(head), digest.hexdigest()

    for row in rows:
        if row["position"] is None:
            yield *told(row), row["output_sha256"]
            continue
        if (own := tuple(row[c] for c in _SAME)) != group:
            yield from done()
            group, digest, head = own, hashlib.sha256(), row
        else:
            digest.update(row["piece"].encode())
    yield from done()


def transform(docs: DataFrame, rates: Rates = Rates(), units: int = PIECE_UNITS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    own = docs.schema["doc_id"]
    sent = emit(docs, rates, units)
    between = T.StructType([*sent.schema.fields, T.StructField("copies", T.LongType())])
    result = T.StructType([own, *T._parse_datatype_string(TRANSFORMED)])

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_output(_told(batches)), between)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(_restored(_told(batches)), result)

    order = ("doc_id", "key", "position")
    dealt = sent.repartition("doc_id", "key").sortWithinPartitions(*order)
    return dealt.mapInArrow(out, between).sortWithinPartitions(*order).mapInArrow(back, result)


INFILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a,
    greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
        THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS pre, coalesce(array_to_string(t[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(t[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p"""
