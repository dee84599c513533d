"""Regular-expression matches with places, pieces of long texts, and rebuilding a text around matches, in DataFrame functions alone.

Every fold here is linear in the text, or takes a logarithm of the number of matches more: places are prefix sums by doubling, and a
piece of a text is cut from its block, not from the text's beginning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the blocks that pieces are cut from.
BLOCK = 4096


def let(value: Column, body) -> Column:
    """body(value), the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge) -> Column:
    """The running merge of an array (sums, maxima ...), by doubling: each of log2(n) passes merges with the element 1, 2, 4 ... places before."""
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(31)]), F.lit(1), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))

    def double(acc, step):
        return F.transform(acc, lambda x, i: F.when(i >= step, merge(F.get(acc, i - step), x)).otherwise(x))

    return F.aggregate(steps, values, double)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>: code points, end exclusive; value is the given group.

    The pattern must not match the empty string. Places follow from the lengths of the pieces between matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def placed(ms):
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(ms)), ms, lambda g, m: g + F.length(m))
        ends = running(both, lambda a, b: a + b)
        return F.zip_with(F.zip_with(ends, ms, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))), values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))

    return let(found, lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(none))


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, for piece()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(parts: Column, start: Column, size: Column) -> Column:
    """`size` code points from `start` (from 0) of a text in blocks; only the blocks that hold them are read."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((start + F.greatest(size, F.lit(1)) - 1) / BLOCK).cast("int")
    held = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.substring(held, (start % BLOCK + 1).cast("int"), size.cast("int"))


def between(spans: Column, size: Column) -> Column:
    """The parts of 0 .. size that sorted spans (start, end) leave, as array<struct<from, to>>, one before each span and one behind the last.

    Where spans overlap, the part before the later one is empty or ends before it begins.
    """
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    none = F.array(F.struct(F.lit(0).alias("from"), size.alias("to")))

    def cut(r):
        before = F.transform(spans, lambda s, i: F.struct(F.coalesce(F.get(r, i - 1), F.lit(0)).alias("from"), s["start"].alias("to")))
        return F.concat(before, F.array(F.struct(F.get(r, F.size(r) - 1).alias("from"), size.alias("to"))))

    return F.when(F.size(spans) > 0, let(reach, cut)).otherwise(none)


def replaced(text: Column, pattern: str, change) -> Column:
    """The text with each match m replaced by change(m)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), F.concat(F.transform(found, change), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)
