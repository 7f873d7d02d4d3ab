import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sensorhealth.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"


def back(spark, rows):
    turns = spark.createDataFrame(rows, TURNS)
    formatted = chat.format_conversations(chat.text_turns(turns))
    return {r["conv_id"]: r for r in chat.read_back(formatted).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[ROLE]", ""]), st.text(alphabet="<s>/[]INST\\ROLEMAGE:0 a\n"))))
def test_parse_returns_what_was_rendered(turns):
    rows = [{"role": r, "parts": [{"kind": "text", "text": t}]} for r, t in turns]
    out = chat.render(rows, frozenset(["assistant"]), chat.Costs())
    assert [(r, "".join(p for _, p in parts)) for r, parts in chat.parse(out["formatted"])] == turns
    loss = "".join(chat.unescape(out["formatted"][s["start"] : s["stop"]]) for s in out["loss_spans"])
    assert loss == "".join(t for r, t in turns if r == "assistant")


def test_digests_nulls_ties_and_long_texts(spark):
    long = "</s>[INST] x [/INST]\\" * 5000
    rows = [
        (1, 1, "assistant", "b", "own"), (1, 0, "user", None, "own"), (2, 0, None, "", None),
        (3, None, "assistant", long, None), (3, 2, "assistant", "tie", None), (3, 2, "assistant", "tie", None),
        (None, 0, "system", "s", None),
    ]
    got = back(spark, rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b")
    assert got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("")
    assert got[3]["loss_sha256"] == sha(long + "tietie") and got[3]["n_turns"] == 3
    assert got[None]["turns_sha256"] == sha("system\ns\n")
    assert back(spark, []) == {}


def test_parts_become_ordered_placeholders(spark):
    parts = [
        ("text", "see [IMAGE:0] ", None, None, None, None, None), ("image", None, "u1", 56, 29, None, None),
        ("audio", None, "u2", None, None, 2.5, None), ("document", None, "u3", None, None, None, 2),
        ("text", "done", None, None, None, None, None),
    ]
    turns = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"
    )
    row = chat.format_conversations(turns).first()
    assert [(a["kind"], a["uri"], a["tokens"]) for a in row["attachments"]] == [
        ("image", "u1", 4), ("audio", "u2", 63), ("document", "u3", 1536)
    ]
    assert row["attachment_tokens"] == 4 + 63 + 1536
    for a in row["attachments"]:
        assert row["formatted"][a["position"] :].startswith(f"[{a['kind'].upper()}:{a['index']}]")
    told = chat.parse(row["formatted"])[0][1]
    assert told == [("text", "see [IMAGE:0] "), ("image", "0"), ("audio", "1"), ("document", "2"), ("text", "done")]
