"""Secret scans in DataFrame functions: assignment, access-key and long-hex patterns, and a sliding entropy window.

Candidate strings of a character class get the Shannon entropy of every window of `WINDOW` characters; a window's symbol counts follow from the
last one's by the character that enters and the one that leaves. The span from the first to the last window over the
class's limit is a secret. Windows that touch a pattern's span, or a placeholder of the allow-list, don't count; the rest of
their candidate does. Time is linear in the text and in the candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .matches import between, blocks, let, located, piece

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Candidates, and the bits a character from which a window counts, by character class.
CLASSES = ((r"(?<![A-Za-z0-9+/_=-])[A-Fa-f0-9]{20,}(?![A-Za-z0-9+/_=-])", 3.0), (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 3.8))
#: Candidates, or what placeholders leave of them, that are no secrets: no digit or no letter, and UUIDs.
ALLOWED = r"^[^0-9]*$|^[^A-Za-z]*$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Parts of candidates that no window may touch: one symbol over and over, alphabets and placeholders.
PLACEHOLDER = r"(.)\1{7,}|(?i:abcdefgh|12345678|example|placeholder|changeme|your[_-])"
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Counts of twelve symbols lie in one long, five bits each.
_A_LONG = 12
#: n log2 n of a count, in whole 2 ** -32, so that sums over millions of steps stay exact.
_XLOGX = [round(n * math.log2(n) * 2**32) if n else 0 for n in range(WINDOW + 2)]


def hot_range(value: Column, limit: float) -> Column:
    """struct<first, last>: the ends (from 1) of the first and the last window whose entropy is at least the limit; 0 if there is none."""
    table = F.array(*[F.lit(x) for x in _XLOGX])
    most = int((math.log2(WINDOW) - limit + 1e-9) * WINDOW * 2**32)
    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(_SYMBOLS)) - 1)
    steps = let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("enters"), F.coalesce(F.get(cs, i - WINDOW), F.lit(-1)).alias("leaves"), (i + 1).alias("end"))))

    def one(code):
        return F.call_function("shiftleft", F.lit(1).cast("long"), code % _A_LONG * 5)

    def held(counts, code):
        return F.call_function("shiftright", F.get(counts, F.floor(code / _A_LONG).cast("int")), code % _A_LONG * 5).bitwiseAND(F.lit(31)).cast("int")

    def cost(n):
        return F.get(table, n + 1) - F.get(table, n)

    def step(acc, s):
        enters, leaves = s["enters"], s["leaves"]
        more = cost(held(acc["counts"], enters)) - F.when(leaves >= 0, cost(held(acc["counts"], leaves) - 1)).otherwise(F.lit(0).cast("long"))
        total = acc["total"] + F.when(enters == leaves, F.lit(0).cast("long")).otherwise(more)
        add = lambda c, k: c + F.when(F.floor(enters / _A_LONG) == k, one(enters)).otherwise(F.lit(0)) - F.when((leaves >= 0) & (F.floor(leaves / _A_LONG) == k), one(leaves)).otherwise(F.lit(0))
        counts = F.when(enters == leaves, acc["counts"]).otherwise(F.transform(acc["counts"], add))
        hot = (s["end"] >= WINDOW) & (total <= most)
        first = F.when((acc["first"] == 0) & hot, s["end"]).otherwise(acc["first"])
        return F.struct(counts.alias("counts"), total.alias("total"), first.alias("first"), F.when(hot, s["end"]).otherwise(acc["last"]).alias("last"))

    none = F.array_repeat(F.lit(0).cast("long"), -(-len(_SYMBOLS) // _A_LONG))
    zero = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _outside(text: Column, spans: Column) -> Column:
    """array<struct<at, value>>: the parts of a text that no span covers and a window fits in."""
    gaps = F.filter(between(spans, F.length(text)), lambda g: g["to"] - g["from"] >= WINDOW)
    cut = let(blocks(text), lambda parts: F.transform(gaps, lambda g: F.struct(g["from"].alias("at"), piece(parts, g["from"], g["to"] - g["from"]).alias("value"))))
    return F.when(F.size(spans) > 0, cut).otherwise(F.array(F.struct(F.lit(0).alias("at"), text.alias("value"))))


def _moved(parts: Column, by: Column) -> Column:
    return F.transform(parts, lambda p: F.struct((p["at"] + by).alias("at"), p["value"].alias("value")))


def _entropic(text: Column, base: Column) -> Column:
    """Spans over a class's limit, of the parts of candidates that neither base spans nor placeholders touch."""
    out = []
    for pattern, limit in CLASSES:
        as_parts = lambda found: F.transform(found, lambda m: F.struct(m["start"].alias("at"), m["value"].alias("value")))
        candidates = F.flatten(F.transform(_outside(text, base), lambda s: _moved(as_parts(located(s["value"], pattern)), s["at"])))
        candidates = F.filter(candidates, lambda c: ~c["value"].rlike(ALLOWED))
        parts = F.flatten(F.transform(candidates, lambda c: F.when(c["value"].rlike(PLACEHOLDER), _moved(_outside(c["value"], located(c["value"], PLACEHOLDER)), c["at"])).otherwise(F.array(c))))
        parts = F.filter(parts, lambda p: ~p["value"].rlike(ALLOWED))
        hot = F.transform(parts, lambda p: F.struct(p["at"].alias("at"), hot_range(p["value"], limit).alias("hot")))
        out.append(F.transform(F.filter(hot, lambda h: h["hot"]["first"] > 0), lambda h: F.struct((h["at"] + h["hot"]["first"] - WINDOW).alias("start"), F.lit(3).alias("kind"), (h["at"] + h["hot"]["last"]).alias("end"))))
    return F.array_distinct(F.concat(*out))


def found(docs: DataFrame, text: str = "text", spans: str = "papyra_spans") -> DataFrame:
    """docs with a column of the given name: array<struct<start, kind, end>>, sorted; kind is a place in KINDS, code points, end exclusive.

    Null and empty texts have no spans. Patterns of one kind don't overlap; spans of different kinds may, and equal entropy spans of
    two classes are one. Every row comes back, repeated ones each with the same spans. A column of that name would be replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(located(body, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6)
    base = F.array_sort(F.concat(_spans(assign, 0), _spans(located(body, ACCESS), 1), _spans(located(body, HEX), 2)))
    held = fresh(docs, "papyra_base")
    with_base = docs.withColumn(held, base)
    return with_base.withColumn(spans, F.array_sort(F.concat(held, _entropic(body, F.col(held))))).drop(held)


def redacted(docs: DataFrame, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by the mask; overlapping spans share one.

    Null texts stay null, empty ones empty; no row goes, and all other columns stay, whatever their names.
    """
    spans = fresh(docs, "papyra_spans")
    out = found(docs, text, spans)
    body = F.col(text)

    def rebuilt(parts):
        kept = F.filter(between(F.col(spans), F.length(body)), lambda g: g["to"] >= g["from"])
        return F.array_join(F.transform(kept, lambda g: F.when(g["to"] > g["from"], piece(parts, g["from"], g["to"] - g["from"])).otherwise(F.lit(""))), mask)

    return out.withColumn(text, F.when(F.size(spans) > 0, let(blocks(body), rebuilt)).otherwise(body)).select(*[f"`{c}`" for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans. Null and empty texts: no spans; rows of equal or null id each come back."""
    out = found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda k: F.size(F.filter("papyra_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("papyra_spans", lambda s: s["kind"] < 3)
    return out.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("papyra_spans")).alias("spans"))
