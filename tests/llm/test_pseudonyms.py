import datetime
import hashlib
import re

from pyspark.sql import functions as F

from sensorhealth.llm import pseudonyms as p

KEY = "a test's key"


def digest(key, tag, *parts):
    return int(hashlib.sha256("|".join([key, tag, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def permuted(value, a, b, tag, key=KEY):
    left, right = divmod(value, b)
    for i in range(p.ROUNDS):
        if i % 2 == 0:
            left = (left + digest(key, tag, i, right)) % a
        else:
            right = (right + digest(key, tag, i, left)) % b
    return left * b + right


def digits(text, tag):
    n = len(text)
    return str(permuted(int(text), 10 ** (n - n // 2), 10 ** (n // 2), f"{tag}{n}")).zfill(n)


def luhn(text):
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def swapped(spark, docs, texts):
    rows = p.pseudonymise(docs(list(enumerate(texts))), KEY).collect()
    return [r for _, r in sorted((r["doc_id"], r) for r in rows)]


def test_feistel_is_a_permutation(spark):
    a, b = F.lit(13), F.lit(17)
    rows = spark.range(13 * 17).select("id", p.permute(F.col("id"), a, b, F.lit("t"), "k").alias("v")).collect()
    assert sorted(r["v"] for r in rows) == list(range(13 * 17))
    assert all(r["v"] == permuted(r["id"], 13, 17, "t", "k") for r in rows)


def test_values_keep_their_formats(spark, docs):
    text = (
        "card 4539578763621486, 4539-5787-6362-1486 or 371449635398431; not 4539578763621487 +1 (017) 555-7713 "
        "+49 30 123456 ip 97.51.17.173 not 256.1.1.1 or 1.2.3.4.5, born 2004-02-29, 31.12.1999, 12/25/2020, "
        "25/12/2020, not 2023-02-30, 1750-01-01 mail it.34@mail7.example.com."
    )
    got = swapped(spark, docs, [text, "again 4539578763621486!!", "x4539578763621486 4539578763621486x"])
    out = got[0]["text"]
    card = digits("453957876362148", "card")
    last = next(c for c in "0123456789" if luhn(card + c))
    card += last
    assert f"card {card}, {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]} or " in out
    assert got[1]["text"] == f"again {card}!!" and got[2]["text"] == "x4539578763621486 4539578763621486x"
    assert "not 4539578763621487 " in out and "not 256.1.1.1 or 1.2.3.4.5," in out and "not 2023-02-30, 1750-01-01" in out
    phone = digits("0175557713", "phone")
    assert f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} +49 " in out
    v = permuted(int.from_bytes(bytes([97, 51, 17, 173]), "big"), 65536, 65536, "ip")
    assert f"ip {'.'.join(map(str, v.to_bytes(4, 'big')))} not" in out
    first = datetime.date(1800, 1, 1)
    moved = lambda *d: first + datetime.timedelta(permuted((datetime.date(*d) - first).days, *p.CYCLE, "date"))
    christmas = moved(2020, 12, 25)
    assert f"born {moved(2004, 2, 29)}, {moved(1999, 12, 31):%d.%m.%Y}, {christmas:%m/%d/%Y}, {christmas:%d/%m/%Y}," in out
    assert re.search(r"mail u[0-9a-f]{12}@mail7\.example\.com\.$", out)
    told = {k: got[0][f"n_{k}"] for k in p.KINDS}
    assert told == {"card": 3, "phone": 2, "ip": 1, "date": 4, "email": 1}


def test_phones_of_one_digit_areas_and_many_groups(spark, docs):
    numbers = ["+33 6 12 34 56 78", "+33 1 42 68 53 00", "+61 2 9374 4000", "+33 6 123 45 67 89", "+49 30 12 34 56 78"]
    got = swapped(spark, docs, [f"call {n}, today" for n in numbers])
    for r, n in zip(got, numbers):
        lead, rest = n[:3], n[3:]
        new = iter(digits(re.sub(r"\D", "", rest), "phone"))
        assert r["text"] == f"call {lead}{re.sub(r'[0-9]', lambda _: next(new), rest)}, today" and r["n_phone"] == 1


def test_odd_rows_and_columns(spark, docs, odd_rows):
    rows = [*odd_rows, (30, "1.2.3.4 " * 3000), (31, "a@b " + "1" * 50000), (32, "@" * 20000 + "+")]
    table = docs(rows)
    out = p.protect(table, KEY)
    assert out.columns == table.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    changed = {i for i, t in rows if got[i] != t}
    assert changed == {30} and len(set(got[30].split())) == 1
    assert p.pseudonymise(docs([]), KEY).collect() == []


def test_no_python_in_the_plan(docs, odd_rows):
    assert "Python" not in p.protect(docs(odd_rows), KEY)._jdf.queryExecution().executedPlan().toString()


def test_the_key_is_the_sessions(spark, docs):
    own = p.session_key(spark)
    assert len(own) == 64 and p.session_key(spark) == own
    spark.conf.set(p.KEY_SETTING, "named")
    try:
        assert p.session_key(spark) == "named"
    finally:
        spark.conf.unset(p.KEY_SETTING)
    texts = [p.pseudonymise(docs([(1, "ip 97.51.17.173")]), k).first()["text"] for k in ("a", "b", "a")]
    assert texts[0] == texts[2] != texts[1]
