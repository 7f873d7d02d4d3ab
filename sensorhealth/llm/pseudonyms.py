"""Personal data to format-preserving pseudonyms, by a keyed Feistel network in Spark expressions.

A value is recognised by shape, then validated (cards by their check digit, addresses by their octets,
dates by the calendar), read as a number of its format's domain, split into two residues and put
through rounds that add a keyed digest of one half to the other. That is a permutation of the domain
for every key: equal values stay equal in all documents, different ones stay different, and the
result has the format of the original (separators, digit count, a valid check digit, a valid date).

* card: all digits but the last are permuted, the last is the check digit of the result
* phone (international): the digits after the country code are permuted
* ip: the four octets as one number
* date (2001-02-03, 2001/02/03, 03.02.2001, 02/03/2001): the day's number in the 400-year cycle from
  1800, permuted over 189 x 773 = 146,097 days
* email: an address has no bounded domain, so its local part becomes a keyed digest; the domain stays

The key is a secret that the caller gives: whoever knows it can undo the permutations. IBANs and national
numbers with check digits of their own are not recognised.

What fails validation is left as it is. Only built-in expressions run; there is no shuffle.

Defined results: null text stays null, empty text stays empty; texts of any length are scanned whole;
repeated rows give equal results; other columns are untouched.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import let

ROUNDS = 8
KEY_SETTING = "spark.sensorhealth.pseudonyms.key"

EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}])"
#: An area or trunk group of one to four digits, then two to four groups; four only up to 14 digits in all.
PHONE = (
    r"\+\d{1,3}[ .-]?\(?(?:"
    r"(?:\d{1,2}\)?(?:[ .-]?\d{2,3}){4}|\d{3,4}\)?(?:[ .-]?\d{2}){4}|\d{1,4}\)?(?:[ .-]?\d{2,4}){2,3})(?!\d))"
)
CARD = r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])"
FOUND = rf"(?<![\p{{L}}\p{{N}}._%+-])(?:{EMAIL}|{IP}|{DATE}|{PHONE}|{CARD})"
KINDS = ("card", "phone", "ip", "date", "email")
CYCLE_DAYS, CYCLE = 146_097, (189, 773)


def _digest(key: str, tag: Column, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", F.lit(key), tag, *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permute(value: Column, a: Column, b: Column, tag: Column, key: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1, by a Feistel network over Z_a x Z_b."""

    def step(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(
            i % 2 == 0,
            F.struct(F.pmod(left + F.pmod(_digest(key, tag, i, right), a), a).alias("l"), right.alias("r")),
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(_digest(key, tag, i, left), b), b).alias("r")))

    start = F.struct(
        _div(value, b).alias("l"),
        F.pmod(value, b).alias("r"),
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"]
    )


def _div(value: Column, by: Column) -> Column:
    """Whole-number quotient, exact for all bigints."""
    return F.call_function("div", value, by)


def _power(n: Column) -> Column:
    """10 to the power n (0 to 18) as a bigint, exactly."""
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("bigint")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _permute_digits(digits: Column, tag: str, key: str) -> Column:
    """A string of up to 18 digits, permuted among those of its length."""

    def of(n: Column) -> Column:
        low = _div(n, F.lit(2)).cast("int")
        out = permute(
            digits.cast("bigint"), _power(n - low), _power(low), F.concat(F.lit(tag), n.cast("string")), key
        )
        return F.lpad(out.cast("string"), n, F.lit("0"))

    return let(F.length(digits), of)


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        start,
        lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def _check_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second one (from index ``doubled``) doubled."""
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: let(
            c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + d)


def _card(text: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = _permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
        filled = let(
            body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_check_sum(b, 0), F.lit(10)), F.lit(10)).cast("string"))
        )
        return F.when(F.pmod(_check_sum(digits, 1), F.lit(10)) == 0, _refill(text, filled))

    return let(_digits(text), of)


def _phone(text: Column, key: str) -> Column:
    lead = F.regexp_extract(text, r"^\+\d{1,3}?(?=[ .(-])|^\+\d", 0)
    rest = F.substring(text, F.length(lead) + 1, F.length(text))
    digits = _digits(rest)
    own = _permute_digits(digits, "phone", key)
    return F.when(F.length(digits).between(6, 14), F.concat(lead, _refill(rest, own)))


def _ip(text: Column, key: str) -> Column:
    def of(octets: Column) -> Column:
        number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o)
        side = F.lit(65536).cast("bigint")
        dotted = let(
            permute(number, side, side, F.lit("ip"), key),
            lambda v: F.concat_ws(
                ".", *(F.pmod(F.shiftright(v, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))
            ),
        )
        return F.when(F.forall(octets, lambda o: o < 256), dotted)

    return let(F.transform(F.split(text, r"\."), lambda o: o.cast("bigint")), of)


def _date(text: Column, key: str) -> Column:
    """Tries the format that the separators tell; month first for slashes, else day first."""
    out = F.lit(None).cast("string")
    shapes = (
        (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
        (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{4}-", "yyyy-MM-dd"),
    )
    origin = F.lit("1800-01-01").cast("date")
    a, b = (F.lit(n).cast("bigint") for n in CYCLE)
    for shape, fmt in shapes:
        day = F.datediff(F.to_date(F.try_to_timestamp(text, F.lit(fmt))), origin).cast("bigint")
        moved = F.date_add(origin, permute(day, a, b, F.lit("date"), key).cast("int"))
        fits = text.rlike(shape) & day.between(0, CYCLE_DAYS - 1)
        out = F.when(fits, F.date_format(moved, fmt)).otherwise(out)
    return out


def _email(text: Column, key: str) -> Column:
    code = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(text)), 256), 1, 12)
    return F.concat(F.lit("u"), code, F.regexp_extract(text, r"@.*$", 0))


def kind_of(found: Column) -> Column:
    """Kind that a found string's shape tells."""
    return (
        F.when(found.contains("@"), "email")
        .when(found.startswith("+"), "phone")
        .when(found.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), "ip")
        .when(found.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$|^\d{2}[./]\d{2}[./]\d{4}$"), "date")
        .otherwise("card")
    )


def replacement(found: Column, key: str) -> Column:
    """(kind, value) of a found string; a null value where it fails validation."""
    makers = {"card": _card, "phone": _phone, "ip": _ip, "date": _date, "email": _email}

    def of(kind: Column) -> Column:
        value = F.lit(None).cast("string")
        for name in KINDS:
            value = F.when(kind == name, makers[name](found, key)).otherwise(value)
        return F.struct(kind.alias("kind"), value.alias("value"))

    return let(kind_of(found), of)


def scan(text: Column, key: str) -> Column:
    """(text, counts by kind) of a text with its personal data replaced, as one struct."""
    none = F.struct(text.alias("text"), *(F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS))

    def rebuilt(found: Column, swaps: Column) -> Column:
        between = F.split(text, FOUND, -1)
        filled = F.zip_with(found, swaps, lambda f, s: F.coalesce(s["value"], f))
        joined = F.array_join(F.zip_with(between, filled, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")
        count = lambda k: F.size(
            F.filter(swaps, lambda s: (s["kind"] == k) & s["value"].isNotNull())
        ).cast("bigint")
        return F.struct(joined.alias("text"), *(count(k).alias(f"n_{k}") for k in KINDS))

    def of(found: Column) -> Column:
        swaps = F.transform(found, lambda f: replacement(f, key))
        return F.when(F.size(found) == 0, none).otherwise(let(swaps, lambda s: rebuilt(found, s)))

    return F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), of)).otherwise(none)


_KEYS: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key that ``spark.sensorhealth.pseudonyms.key`` names, else a random one for this application.

    Name one where pseudonyms of several applications have to agree.
    """
    named = spark.conf.get(KEY_SETTING, None)
    return named or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per document: text with pseudonyms, and how many of each kind were replaced."""
    return docs.select("doc_id", scan(F.col("text"), key).alias("_s")).select("doc_id", "_s.*")


def protect(docs: DataFrame, key: str) -> DataFrame:
    """The documents with their columns, texts pseudonymised."""
    return docs.select(
        *(scan(F.col("text"), key)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)
    )
