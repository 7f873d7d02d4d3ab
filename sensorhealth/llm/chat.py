"""Chat formatting over typed content parts.

A turn is a list of parts (text, image, audio, document). ``PartVisitor`` flattens them in order:
text is escaped into the output, every other part becomes a numbered placeholder, is recorded as
an attachment reference with its position, and is charged the tokens it will expand to.

The template marks turns with control strings. A backslash after the first character of every
control string that occurs inside a text (and a doubled backslash for every backslash) keeps texts
and marks apart, so ``parse`` gets every role and part back exactly.

Defined results: a null text part is empty, a null role is empty, an unknown kind is treated as a
document; a turn without parts is an empty turn; rows of one conversation are ordered by turn
(null first), then role, then parts, and repeated rows are kept; a null conversation id is a
conversation of its own; other columns of the input are ignored.

One conversation is one output row, hence one group: its text must fit a task, as any row must.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"

#: Template: <s>[ROLE]role[/ROLE]body</s>; a user's body stands between [INST] and [/INST].
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[IMAGE:", "[AUDIO:", "[DOCUMENT:")
_MARK = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL) + r"|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACE = re.compile(r"\[(IMAGE|AUDIO|DOCUMENT):(\d+)\]")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\])?(.*?)(?:\[/INST\])?</s>", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Costs:
    """Tokens that a non-text part expands to."""

    image_patch: int = 28  # pixels of one patch side
    image_cap: int = 1280  # tokens of one image at most, as encoders resize larger ones
    audio_per_second: float = 25.0
    document_per_page: int = 768

    def tokens(self, kind: str, part: dict) -> int:
        if kind == "image":
            patches = math.prod(
                max(1, math.ceil((part.get(side) or 0) / self.image_patch)) for side in ("width", "height")
            )
            return min(self.image_cap, patches)
        if kind == "audio":
            return math.ceil((part.get("seconds") or 0) * self.audio_per_second)
        return self.document_per_page * max(1, part.get("pages") or 1)


@dataclass
class PartVisitor:
    """Flattens parts into one string; ``size`` is its length so far in code points."""

    costs: Costs = Costs()
    out: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[dict] = field(default_factory=list)

    def mark(self, control: str) -> None:
        self.out.append(control)
        self.size += len(control)

    def visit(self, part: dict) -> None:
        kind = (part.get("kind") or "document").lower()
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.mark(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def _attach(self, kind: str, part: dict) -> None:
        index = len(self.attachments)
        self.attachments.append(
            {
                "index": index,
                "kind": kind,
                "uri": part.get("uri"),
                "position": self.size,
                "tokens": self.costs.tokens(kind, part),
            }
        )
        self.mark(f"[{kind.upper()}:{index}]")


def render(turns: list[dict], loss_roles: frozenset[str], costs: Costs) -> dict:
    """One conversation as text, with the loss mask as spans of code points, and attachments."""
    visitor, spans = PartVisitor(costs), []
    for turn in turns:
        role = turn["role"] or ""
        visitor.mark(f"<s>[ROLE]{escape(role)}[/ROLE]" + "[INST]" * (role == "user"))
        start = visitor.size
        for part in turn["parts"] or ():
            if part is not None:
                visitor.visit(part)
        if role in loss_roles:
            spans.append({"start": start, "stop": visitor.size})
        visitor.mark("[/INST]" * (role == "user") + "</s>")
    return {
        "formatted": "".join(visitor.out),
        "loss_spans": spans,
        "attachments": visitor.attachments,
        "attachment_tokens": sum(a["tokens"] for a in visitor.attachments),
    }


def parse(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Roles and parts of a formatted conversation: ("text", text) or (kind, attachment index)."""
    turns = []
    for m in _TURN.finditer(formatted):
        parts, at, body = [], 0, m.group(2)
        for place in _PLACE.finditer(body):
            if place.start() > at:
                parts.append(("text", unescape(body[at : place.start()])))
            parts.append((place.group(1).lower(), place.group(2)))
            at = place.end()
        if at < len(body):
            parts.append(("text", unescape(body[at:])))
        turns.append((unescape(m.group(1)), parts))
    return turns


def text_turns(rows: DataFrame) -> DataFrame:
    """Turn rows with a text column as turn rows with one text part each."""
    blank = {"kind": F.lit("text"), "text": F.col("text")}
    names = [f.name for f in T._parse_datatype_string(PART)]
    part = F.struct(*(blank.get(n, F.lit(None)).alias(n) for n in names)).cast(PART)
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


FORMATTED = (
    "formatted string, loss_spans array<struct<start:bigint,stop:bigint>>, "
    "attachments array<struct<index:int,kind:string,uri:string,position:bigint,tokens:bigint>>, "
    "attachment_tokens bigint"
)


def format_conversations(
    turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), costs: Costs = Costs()
) -> DataFrame:
    """One row per conversation from turn rows (conv_id, turn, role, parts)."""
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "parts"))).alias("turns")
    )
    schema = T.StructType([grouped.schema["conv_id"], *T._parse_datatype_string(FORMATTED)])
    roles = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [render(t, roles, costs) for t in part.column("turns").to_pylist()]
                ids = part.column("conv_id")
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(kind)[1:]]
                yield pa.RecordBatch.from_arrays([ids.cast(kind[0].type), *columns], schema=kind)

    return grouped.mapInArrow(run, schema)


DIGESTS = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
    "n_attachments bigint"
)


def _digest(row: dict) -> dict:
    formatted, turns = row["formatted"], parse(row["formatted"])
    spans = row["loss_spans"] or ()
    loss = "".join(unescape(formatted[s["start"] : s["stop"]]) for s in spans)
    told = "".join(
        f"{role}\n{''.join(p if kind == 'text' else f'[{kind}]' for kind, p in parts)}\n"
        for role, parts in turns
    )
    return {
        "n_turns": len(turns),
        "turns_sha256": hashlib.sha256(told.encode()).hexdigest(),
        "loss_chars": len(loss),
        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
        "formatted_chars": len(formatted),
        "n_attachments": len(row["attachments"] or ()),
    }


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask hold, by parsing them."""
    schema = T.StructType([formatted.schema["conv_id"], *T._parse_datatype_string(DIGESTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            rows = [_digest(r) for r in batch.to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(kind)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").cast(kind[0].type), *columns], schema=kind)

    return formatted.select("conv_id", "formatted", "loss_spans", "attachments").mapInArrow(run, schema)
