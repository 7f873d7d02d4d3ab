import re
from collections import Counter

from sensorhealth.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    out = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w.lower() in quality.STOP_WORDS for w in words),
    }
    low = len(words) < 10 or 100 * len(covered) > 20 * len(words)

    def fails(r):
        scale = out[r.denominator] if r.denominator else 1
        return r.low is not None and out[r.numerator] < r.low * scale or r.high is not None and out[r.numerator] > r.high * scale

    return out | {"base_failed": low, "kept": not low and not any(map(fails, quality.RULES))}


def test_equals_brute_force(spark, docs, odd_rows):
    again = "one two three four five six seven eight nine ten eleven twelve"
    more = [
        (20, again + " x " + again), (21, "the a b c d the a b c d the a b c d e f g h i"), (22, "a\n\na\n \nb\r\na"),
        (23, "# $ % the word is | here and < there > of & it *" * 3), (24, " lead and trail the of \x0b\x0c\x1c\x85 \xa0x "),
        (25, "\n".join(["the same line of words"] * 9)), (26, "a b c d e"), (27, "der die das und " * 4 + "x y z"),
    ]
    rows = [*odd_rows, *more]
    got = quality.assess(docs(rows)).collect()
    order = lambda r: str(sorted(r.items()))
    found = [{k: v for k, v in r.asDict().items() if k != "failed_rules"} for r in got]
    want = [{"doc_id": i} | plain(t) for i, t in rows]
    assert sorted(found, key=order) == sorted(want, key=order)
    assert quality.assess(docs([])).collect() == []


def test_filter_keeps_columns(spark, docs, odd_rows):
    table = docs(odd_rows)
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in odd_rows if plain(t)["kept"]} == {4}


def test_one_projection_without_python(docs, odd_rows):
    told = quality.keep_good(docs(odd_rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in told and "Exchange" not in told
