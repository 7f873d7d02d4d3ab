import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

from pyspark.sql import functions as F

from sensorhealth.llm import turns
from sensorhealth.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
CONV = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        told = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(told.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def key(row):
    told = hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()
    return (row[1] is not None, row[1] or 0, row[2].encode(), told)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("sound" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def slow_edits(initials, found):
    """(cost, audit, role initials) by trying every edit at every row; strings are compared whole."""
    best = {("", ""): 0}  # (role initials, audit) -> cost; inserts after each row
    legal = re.compile("s?(ua)*u?")
    limit = 2 * len(found)

    def widen(states):
        out, todo = dict(states), list(states.items())
        while todo:
            (roles, audit), cost = todo.pop()
            for role in "ua":
                new = (roles + role, audit + "I")
                if cost + 5 <= limit and legal.fullmatch(new[0]) and out.get(new, 99**9) > cost + 5:
                    out[new] = cost + 5
                    todo.append((new, cost + 5))
        return out

    best = widen(best)
    for initial, fault in zip(initials, found):
        after = {}
        for (roles, audit), cost in best.items():
            ways = [("D", 2, roles)]
            if fault in ("sound", "truncated"):
                more = 5 * (fault == "truncated")
                ways += [("K", more, roles + initial)] if initial else []
                ways += [("R", 1 + more, roles + r) for r in "ua"]
            for edit, more, new in ways:
                if cost + more <= limit and legal.fullmatch(new):
                    at = (new, audit + edit)
                    after[at] = min(after.get(at, 99**9), cost + more)
        best = widen(after)
    done = [(c, a, r) for (r, a), c in best.items() if re.fullmatch("(s?(ua)+)?", r)]
    return min(done)


def slow_report(conv, rows):
    rows = sorted(rows, key=key)
    found, initials = faults(rows), [r[2][:1] for r in rows]
    cost, audit, roles = slow_edits(initials, found)
    names, left, lines = {"u": "user", "a": "assistant"}, iter(rows), []
    given = iter(roles)
    for edit in audit:
        if edit == "I":
            lines.append(f"{names[next(given)]}:")
            continue
        row = next(left)
        if edit != "D":
            role = next(given)
            lines.append(f"{row[2] if edit == 'K' else names[role]}:{row[3]}")
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    counts = (found.count(f) for f in ("blank", "duplicate", "truncated"))
    return (conv, gaps, *counts, illegal, cost, audit, digest)


def slow(rows):
    after = slow_damage(rows)
    return [slow_report(c, [r for r in after if r[0] == c]) for c in dict.fromkeys(r[0] for r in rows)]


order = lambda r: str(r[:1] + r[1:])


def test_cheapest_edits_against_brute_force():
    rng = random.Random(4)
    for _ in range(600):
        n = rng.randrange(7)
        initials = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(n)]
        found = [rng.choice(["sound"] * 4 + ["truncated", "blank"]) for _ in range(n)]
        codes = bytearray({"sound": 0, "truncated": 1, "blank": 2}[f] for f in found)
        assert turns.cheapest(turns.Lattice(initials, codes)) == slow_edits(initials, found)[:2], (initials, found)


def test_both_sides_are_searched():
    lattice = turns.Lattice(list("ua" * 4000) + list("uu"), bytearray(8002))
    assert turns.cheapest(lattice) == (1, "K" * 8001 + "R")
    assert turns.cheapest(turns.Lattice([], bytearray())) == (0, "")


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_turn_repair"](spark, SMALL).collect()]
    assert sorted(got, key=order) == sorted(slow(rows), key=order)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = [
        (rng.choice([None, *range(40)]), rng.choice([None, *range(5)]), rng.choice(["user", "assistant", "system", "tool", "", None]),
         rng.choice([None, "", " \n", "Yes.", "No", "Why? \t", "ünï …", "a.b!", "x" * 50000]))
        for _ in range(120)
    ]
    rows += [(0, 3, "user", "again."), (0, 3, "user", "again.")] + [(99, None, None, None)]
    rows = [r for r in rows if r[0] != 7] + [(7, 30, "user", "x")] * (zlib.crc32(b"7:30") % 20 == 0)
    table = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("own") for c in ("kind", "state", "digest", "copies", "audit")})
    made = turns.read_back(turns.repair(turns.damage(table)))
    assert sorted((tuple(r) for r in made.collect()), key=order) == sorted(slow(rows), key=order)
    assert turns.read_back(turns.repair(turns.damage(table.limit(0)))).collect() == []


def test_a_conversation_whose_rows_are_all_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "x.")], CONV)
    (row,) = turns.read_back(turns.repair(turns.damage(table))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hm."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Ok.")]
    made = turns.repair(turns.text_rows(spark.createDataFrame(rows, CONV)))
    told = {c: [(r["edit"], r["role"], r["text"]) for r in sorted(made.collect(), key=lambda r: r["position"]) if r["conv_id"] == c and r["edit"]] for c in (1, 2)}
    assert told[1] == [("K", "user", "Hm."), ("K", "assistant", "Yes.")] and told[2] == []
    audit = {r["conv_id"]: (r["audit"], r["cost"]) for r in made.collect() if r["position"] == -1}
    assert audit == {1: ("DKK", 2), 2: ("D", 2)}


def test_edges_agree():
    rng = random.Random(1)
    initials = [rng.choice("sua x") for _ in range(30)]
    lattice = turns.Lattice(initials, bytearray(rng.randrange(3) for _ in range(30)))
    nodes = range(4 * 31)
    ahead = {(a, e, c, b) for a in nodes for e, c, b in lattice.after(a)}
    back = {(a, e, c, b) for b in nodes for e, c, a in lattice.before(b)}
    assert ahead == back


def test_long_conversations_take_linear_memory():
    rng = random.Random(2)
    peaks = []
    for n in (5_000, 40_000):
        lattice = turns.Lattice([rng.choice("ua") for _ in range(n)], bytearray(rng.choice([0] * 9 + [1, 2]) for _ in range(n)))
        tracemalloc.start()
        cost, audit = turns.cheapest(lattice)
        peaks.append(tracemalloc.get_traced_memory()[1] / n)
        tracemalloc.stop()
        assert cost > 0 and len(audit) >= n
    assert max(peaks) < 600 and peaks[1] < 1.5 * peaks[0]
