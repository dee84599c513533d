"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Numbers that pass their format's validation (card numbers by the Luhn digit, IPv4 octets, telephone and social-security forms, calendar dates)
and e-mail addresses go through a keyed Feistel network within their format: a digit stays a digit, a letter a
letter of its case, separators stay, cards keep a right Luhn digit, dates stay dates in their own layout, social-security numbers stay in the valid ranges, addresses keep four octets. The
network permutes each format's valid values, so equal values have equal pseudonyms in every document, and different ones differ.

Known limits: the domain of an e-mail address and a telephone number's country code stay as they are. Dates with month names or two-digit years are not
found. Of a run of digit groups that can be read as a card number in several ways, the first reading that fits is tried alone. dd/MM is read before MM/dd.
"""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matches import let, replaced

ROUNDS = 8
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<!\d)\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!\d)\d{3}-\d{3}-\d{4}(?!\d)"
#: Groups of 4-4-4-4 and 4-6-5, 13 to 19 digits on end, or any grouping that doesn't hold such a run.
CARD = (
    r"(?<!\d)(?:\d{4}(?<g1>[ -])\d{4}\k<g1>\d{4}\k<g1>\d{4}|\d{4}(?<g2>[ -])\d{6}\k<g2>\d{5}|\d{13,19}|(?!(?:\d{1,12}[ -])+\d{13,19}(?!\d))\d(?:[ -]?\d){12,18})(?!\d)"
)
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IP, DATE, SSN, PHONE, CARD))
# Country calling codes of one and of two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: First days of the spans within which dates are permuted (a date before LATELY stays before it), and the first day after them.
FIRST_DAY, OLD, LATELY, END_DAY = "1800-01-01", "1900-01-01", "2026-01-01", "2101-01-01"
#: Steps of a walk that looks for a value of the valid set; each fails with a probability of 0.4 at most.
WALK = 64


def _round_bytes(key: str, salt, part: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), salt.cast("string"), part), 256)


def _shifted(chars: Column, by: Column) -> Column:
    """Each ASCII digit or letter moved within its class by a byte of the hexadecimal text `by`."""

    def move(c, i):
        step = F.conv(F.substring(by, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i.cast("int")
        code = F.ascii(c)

        def within(first: int, size: int) -> Column:
            return F.char(F.lit(first) + (code - first + step) % size)

        plain = F.octet_length(c) == 1
        return F.when(plain & code.between(48, 57), within(48, 10)).when(plain & code.between(97, 122), within(97, 26)).when(plain & code.between(65, 90), within(65, 26)).otherwise(c)

    return F.transform(chars, move)


def feistel(value: Column, key: str) -> Column:
    """A keyed permutation of the strings that share a layout: halves take turns to move the other one's characters within their classes."""
    chars = F.split(value, "")
    half = F.floor(F.size(chars) / 2).cast("int")
    zero = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.size(chars) - half).alias("b"))

    def step(acc, r):
        return F.struct(acc["b"].alias("a"), _shifted(acc["a"], _round_bytes(key, r, F.array_join(acc["b"], ""))).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step, lambda acc: F.concat(F.array_join(acc["a"], ""), F.array_join(acc["b"], "")))


def feistel_number(value: Column, bits: int, key: str) -> Column:
    """A keyed permutation of 0 .. 2 ** bits - 1 (bits even)."""
    side = 1 << (bits // 2)
    zero = F.struct(F.floor(value / side).cast("long").alias("a"), (value % side).cast("long").alias("b"))

    def step(acc, r):
        more = F.conv(F.substring(_round_bytes(key, r, acc["b"].cast("string")), 1, 8), 16, 10).cast("long")
        return F.struct(acc["b"].alias("a"), ((acc["a"] + more) % side).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step, lambda acc: acc["a"] * side + acc["b"])


def feistel_below(value: Column, n: int, key: str) -> Column:
    """A keyed permutation of 0 .. n - 1: a network over a square of at most n values, on the numbers and then on the numbers turned half round.

    A network with modular additions permutes a square of any side; what lies beyond it in one turn lies inside it in the other.
    """
    side = math.isqrt(n)

    def network(x: Column, salt: str) -> Column:
        zero = F.struct(F.floor(x / side).cast("long").alias("a"), (x % side).cast("long").alias("b"))

        def step(acc, r):
            more = F.conv(F.substring(_round_bytes(key + salt, r, acc["b"].cast("string")), 1, 12), 16, 10).cast("long")
            return F.struct(acc["b"].alias("a"), ((acc["a"] + more) % side).alias("b"))

        inside = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step, lambda acc: acc["a"] * side + acc["b"])
        return F.when(x < side * side, inside).otherwise(x)

    return let(network(value.cast("long"), "1"), lambda x: network((x + n // 2) % n, "2"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    back = F.split(F.reverse(digits), "")
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _relaid(value: Column, digits: Column) -> Column:
    """The layout of value with its digits replaced, in order, so equal numbers stay equal in any layout."""
    zero = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(acc, c):
        digit = c.rlike("^[0-9]$")
        return F.struct((acc["i"] + digit.cast("int")).alias("i"), F.concat(acc["out"], F.when(digit, F.substring(digits, acc["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(value, ""), zero, step, lambda acc: acc["out"])


def _numeric(value: Column, key: str) -> Column:
    return _relaid(value, feistel(_digits(value), key))


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    head = feistel(F.substring(digits, F.lit(1), F.length(digits) - 1), key)
    check = (10 - luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
    return _relaid(value, F.concat(head, check.cast("string")))


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.cast("int"))


def is_ip(value: Column) -> Column:
    return F.forall(_octets(value), lambda o: o <= 255)


def _ip(value: Column, key: str) -> Column:
    number = feistel_number(F.aggregate(_octets(value), F.lit(0).cast("long"), lambda a, o: a * 256 + o), 32, key)
    return F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda s: F.floor(number / F.pow(F.lit(2), s)).cast("long") % 256), ".")


#: Shape and layout; a value is read in the first layout in which it is a date.
_LAYOUTS = (
    (r"^\d{4}-", "yyyy-MM-dd"),
    (r"^\d{4}/", "yyyy/MM/dd"),
    (r"^\d{2}\.\d{2}\.", "dd.MM.yyyy"),
    (r"^\d{2}/\d{2}/", "dd/MM/yyyy"),
    (r"^\d{2}/\d{2}/", "MM/dd/yyyy"),
)


def _as_date(value: Column, layout: str) -> Column:
    at = {c: layout.index(c) + 1 for c in "yMd"}
    text = F.concat_ws("-", F.substring(value, at["y"], 4), F.substring(value, at["M"], 2), F.substring(value, at["d"], 2))
    day = F.try_to_date(text, "yyyy-MM-dd")
    return F.when((day >= F.lit(FIRST_DAY).cast("date")) & (day < F.lit(END_DAY).cast("date")), day)


def _moved_day(day: Column, key: str) -> Column:
    """The pseudonym of a date, within its span."""
    spans = ((FIRST_DAY, OLD), (OLD, LATELY), (LATELY, END_DAY))
    out = F.lit(None).cast("date")
    for k, (first, last) in enumerate(spans):
        n = (datetime.date.fromisoformat(last) - datetime.date.fromisoformat(first)).days
        start = F.lit(first).cast("date")
        out = F.when((day >= start) & (day < F.lit(last).cast("date")), F.date_add(start, feistel_below(F.datediff(day, start), n, f"{key}{k}").cast("int"))).otherwise(out)
    return out


def _date(value: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for shape, layout in reversed(_LAYOUTS):
        day = _as_date(value, layout)
        moved = _moved_day(day, key)
        if layout == "MM/dd/yyyy":  # only days that dd/MM can't be read from: the walk along the permutation until it comes to such a day again
            walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved, lambda d, _: F.when(F.dayofmonth(d) > 12, d).otherwise(_moved_day(d, key)))
            moved = walk
        out = F.when(value.rlike(shape) & day.isNotNull(), F.date_format(moved, layout)).otherwise(out)
    return out


def is_date(value: Column) -> Column:
    out = F.lit(False)
    for shape, layout in reversed(_LAYOUTS):
        out = F.when(value.rlike(shape) & _as_date(value, layout).isNotNull(), F.lit(True)).otherwise(out)
    return out


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999 are numbered, and the number permuted."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def shown(n):
        area_ = F.floor(n / (99 * 9999)).cast("long") + 1
        parts = (area_ + (area_ >= 666).cast("long"), F.floor(n / 9999).cast("long") % 99 + 1, n % 9999 + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in zip(parts, (3, 2, 4))])

    return let(feistel_below(number, 898 * 99 * 9999, key), shown)


def kind_of(value: Column) -> Column:
    """email, ip, date, ssn, phone or card; null if the value's own validation fails."""
    whole = lambda p: value.rlike(rf"^(?:{p})$")
    return (
        F.when(value.contains("@"), "email")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(is_ip(value), "ip"))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[./]\d{2}[./]\d{4}"), F.when(is_date(value), "date"))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(value.rlike(r"^[+(]") | whole(r"\d{3}-\d{3}-\d{4}"), F.when(F.length(_digits(value)).between(7, 15), "phone"))
        .when(is_card(value), "card")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value; itself if it isn't valid."""
    kind = kind_of(value)
    prefix = F.regexp_extract(value, COUNTRY, 0)
    phone = F.concat(prefix, _numeric(F.substring(value, F.length(prefix) + 1, F.length(value)), key + "phone"))
    email = F.concat(feistel(F.substring_index(value, "@", 1), key + "email"), F.lit("@"), F.substring_index(value, "@", -1))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", _ip(value, key + "ip"))
        .when(kind == "date", _date(value, key + "date"))
        .when(kind == "ssn", _ssn(value, key + "ssn"))
        .when(kind == "phone", phone)
        .when(kind == "card", _card(value, key + "card"))
        .otherwise(value)
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced; all other columns and rows stay, repeated rows alike. Null texts stay null, empty ones empty.

    key: the secret of the networks; an empty one is refused. A text without a digit or an at sign can hold none, and is passed on as it is.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    changed = replaced(F.col(text), ANY, lambda m: pseudonym(m, key))
    return docs.withColumn(text, F.when(F.col(text).rlike("[0-9@]"), changed).otherwise(F.col(text)))


def pii(docs: DataFrame, key: str) -> DataFrame:
    """Per row of docs: doc_id, text (pseudonymised), n_found (valid values that were replaced). Null texts: 0 found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("text").alias("papyra_raw"))
    out = pseudonymised(rows, key)
    found = F.regexp_extract_all("papyra_raw", F.lit(ANY), F.lit(0))
    n = F.when(F.col("papyra_raw").rlike("[0-9@]"), F.size(F.filter(found, lambda m: kind_of(m).isNotNull()))).otherwise(F.lit(0))
    return out.select("doc_id", "text", F.coalesce(n, F.lit(0)).cast("long").alias("n_found"))
