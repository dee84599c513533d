"""Rewriting of texts with a map from old places to new ones, so that spans survive any chain of rewrites.

A map is an array of pieces in order, struct<raw, raw_end, out, out_end, same>: places of the old text, of the new one, and whether
the piece is unchanged. Inside an unchanged piece a place moves with it; inside a changed one a span takes the whole piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two up to the largest number of pieces.
_STEPS = 30


def running(values: Column) -> Column:
    """Sums of an array's first 1, 2, ... values, in as many passes as its size has binary digits."""
    return let(values, _running)


def _running(values: Column) -> Column:
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(_STEPS)]), lambda step: step < F.size(values))
    return F.aggregate(steps, values, lambda acc, step: F.transform(acc, lambda x, i: x + F.when(i >= step, F.get(acc, i - step)).otherwise(F.lit(0))))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(text: Column, pattern: str, made) -> Column:
    """array<struct<raw, made, same>>: the text cut at the pattern's matches; made: what becomes of a match. Empty pieces are left out."""
    return let(text, lambda t: _parts(t, pattern, made))


def _parts(text: Column, pattern: str, made) -> Column:
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def pair(piece, mark):
        kept = F.struct(piece.alias("raw"), piece.alias("made"), F.lit(True).alias("same"))
        return F.array(kept, let(made(mark), lambda new: F.struct(mark.alias("raw"), new.alias("made"), (new == mark).alias("same"))))

    return F.filter(F.flatten(F.zip_with(F.split(text, pattern, -1), marks, pair)), lambda p: p["raw"] != "")


def replaced(text: Column, pattern: str, made) -> Column:
    """The text with each match replaced by what made gives for it."""
    return F.array_join(F.transform(parts(text, pattern, made), lambda p: p["made"]), "")


def rewritten(text: Column, pattern: str, made) -> Column:
    """struct<text, map>: the text with each match of the pattern replaced, and the map of places. Null stays null."""
    return joined(parts(text, pattern, made))


def joined(pieces: Column) -> Column:
    """struct<text, map> of the pieces that parts() gives."""
    sums = lambda p: F.struct(p.alias("p"), running(F.transform(p, lambda x: F.length(x["raw"]))).alias("r"), running(F.transform(p, lambda x: F.length(x["made"]))).alias("o"))

    def made(x):
        piece = lambda p, i: F.struct((F.get(x["r"], i) - F.length(p["raw"])).alias("raw"), F.get(x["r"], i).alias("raw_end"), (F.get(x["o"], i) - F.length(p["made"])).alias("out"), F.get(x["o"], i).alias("out_end"), p["same"].alias("same"))
        return F.struct(F.array_join(F.transform(x["p"], lambda p: p["made"]), "").alias("text"), F.transform(x["p"], piece).alias("map"))

    return let(let(pieces, sums), made)


def moved(start: Column, end: Column, places: Column) -> Column:
    """struct<start, end>: a span of the old text in the new one. Empty spans stay empty; a span in a changed piece takes all of it."""
    first = F.get(F.filter(places, lambda p: (p["raw"] <= start) & (start < p["raw_end"])), F.lit(0))
    last = F.get(F.filter(places, lambda p: (p["raw"] < end) & (end <= p["raw_end"])), F.lit(0))
    size = F.coalesce(F.get(places, F.size(places) - 1)["out_end"], F.lit(0))
    new = F.when(first.isNull(), F.when(start <= 0, 0).otherwise(size)).when(first["same"], first["out"] + start - first["raw"]).otherwise(first["out"])
    until = F.when(last.isNull(), F.when(end <= 0, 0).otherwise(size)).when(last["same"], last["out"] + end - last["raw"]).otherwise(last["out_end"])
    return F.struct(new.cast("int").alias("start"), F.when(end <= start, new).otherwise(until).cast("int").alias("end"))


def carried(spans: Column, maps: list[Column]) -> Column:
    """Spans (struct<start, end>) of a text after a chain of rewrites, whose maps come in order."""
    for places in maps:
        spans = _carried(spans, places)
    return spans


def _carried(spans: Column, places: Column) -> Column:
    return F.transform(spans, lambda s: moved(s["start"], s["end"], places))
