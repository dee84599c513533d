"""View blocks: the part of a question behind its <보기> mark as a one-cell table, and back.

A question here is its text and the text of its view cell, or null where it has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.offsets import let
from papyra.functions.text import SPACE

# Marks of view blocks, whole and as misread ones may look; what follows a mark that only refers to a block; how a question ends; marks of propositions.
MARK = r"(?:<|＜|〈|《|\[|【)\s*보\s*기\s*(?:>|＞|〉|》|\]|】)"
LOOSE = r"(?<![A-Za-z가-힣])(?:(?:<|＜|〈|《|\[|【)\s*보\s*기\s*(?:>|＞|〉|》|\]|】)?|보\s*기\s*(?:>|＞|〉|》|\]|】)|보\s+기\s*)"
REFERENCE = r"^\s*(?:중|에서|의|는|은|상|와|과|를|을|에)(?=\s|[「『\[('“\"A-Za-z가-힣]|$)"
ATTACHED = r"^(?:에서|의|는|은|와|과|를|을|에)(?=\s|[「『\[(A-Za-z가-힣]|$)"
ASKS = r"(?:것은|것인가|무엇인가|누구인가|몇\s*개\s*인가|몇\s*명\s*인가|나열한\s*것은|고른\s*것은)"
TAIL = rf"(?:[?？]|{ASKS}\s*[279]?)\s*$"
PROPOSITION, CANONICAL, SHORTEST_TAIL = "[㉠-㉭]", "<보기>", 6


def _trim(t: Column) -> Column:
    return F.regexp_replace(t, f"^[{SPACE}]+|[{SPACE}]+$", "")


def _asks(t: Column) -> Column:
    """Whether a text ends as a question does."""
    bare = F.trim(F.regexp_replace(t, f"[{SPACE}]+", " "))
    return (F.length(bare) >= SHORTEST_TAIL) & bare.rlike("(?U)" + TAIL)


def _mended_tail(t: Column) -> Column:
    """A question mark that was read as 2, 7 or 9."""
    return F.regexp_replace(_trim(t), rf"(?U)({ASKS})\s*[279]\s*$", "$1?")


def _cuts(text: Column, pattern: str) -> Column:
    """array<struct<before, mark, after>>: the text around each match of a pattern, in order."""

    def of(t):
        def around(x):
            upto = lambda k: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), lambda j: F.when(j == k, F.array(F.get(x["p"], j))).otherwise(F.array(F.get(x["p"], j), F.get(x["m"], j))))), "")
            made = lambda m, i: let(upto(i), lambda before: F.struct(before.alias("before"), m.alias("mark"), F.substring(t, F.length(before) + F.length(m) + 1, F.length(t)).alias("after")))
            return F.transform(x["m"], made)

        return let(F.struct(F.regexp_extract_all(t, F.lit("(?U)" + pattern), F.lit(0)).alias("m"), F.split(t, "(?U)" + pattern, -1).alias("p")), around)

    return let(text, of)


def repaired(text: Column, cell: Column) -> Column:
    """struct<text, cell, changed>: a view cell that holds the end of the question gives it back to the text.

    That is so where the cell's mark is followed by a word that refers to a block (중, 에서, ...) and the block itself comes later: behind a second mark, at a proposition behind a question's end, or behind a question mark.
    """

    def of(x):
        body = F.when(x["c"].rlike(rf"(?U)^\s*{MARK}"), _trim(F.regexp_replace(_trim(x["c"]), rf"(?U)^{MARK}", "")))

        def found(b):
            full = lambda c: (_trim(c["before"]) != "") & (_trim(c["after"]) != "")
            second = F.get(F.filter(_cuts(b, LOOSE), full), F.lit(0))
            proposition = let(F.get(F.filter(_cuts(b, PROPOSITION), lambda c: _asks(c["before"])), F.lit(0)), lambda c: F.when(c.isNotNull(), F.struct(c["before"].alias("before"), F.lit("").alias("mark"), F.concat(c["mark"], c["after"]).alias("after"))))
            mark = let(F.get(F.filter(_cuts(b, "[?？]"), lambda c: _trim(c["after"]) != ""), F.lit(0)), lambda c: F.when(c.isNotNull(), F.struct(F.concat(c["before"], c["mark"]).alias("before"), F.lit("").alias("mark"), c["after"].alias("after"))))
            return F.when(b.rlike("(?U)" + REFERENCE), F.coalesce(second, proposition, mark))

        def made(cut):
            tail, view = _mended_tail(cut["before"]), _trim(cut["after"])
            good = F.coalesce((tail != "") & (view != ""), F.lit(False))
            owner = F.regexp_replace(x["t"], f"[{SPACE}]+$", "")
            owner = F.when(F.substring(owner, -16, 16).rlike("(?U)" + MARK), owner).otherwise(_trim(F.concat(owner, F.lit(f" {CANONICAL}"))))
            joined = _trim(F.concat(owner, F.when(tail.rlike("(?U)" + ATTACHED), "").otherwise(" "), tail))
            return F.struct(F.when(good, joined).otherwise(x["t"]).alias("text"), F.when(good, F.concat(F.lit(f"{CANONICAL}\n"), view)).otherwise(x["c"]).alias("cell"), good.alias("changed"))

        return let(let(body, found), made)

    return let(F.struct(F.coalesce(text, F.lit("")).alias("t"), cell.alias("c")), of)


def misplaced(text: Column, cell: Column) -> Column:
    """Q01 (misplaced_view_reference): whether a view cell still holds a part of the question."""
    return repaired(text, cell)["changed"]


def promoted(text: Column, cell: Column | None = None) -> Column:
    """struct<text, cell, changed>: what stands behind the last view mark as the view cell, behind its mark; a question that has one keeps it, mended where it holds a part of the question.

    A broken mark (without one of its brackets, or in two parts) counts where a question ends before it and something follows. A question without a mark stays.
    """
    have = F.lit(None).cast("string") if cell is None else cell

    def of(x):
        explicit = F.element_at(F.concat(_cuts(x["t"], MARK), F.expr("cast(array(null) as array<struct<before:string,mark:string,after:string>>)")), -2)
        explicit = F.when(x["t"].rlike("(?U)" + MARK), explicit)
        broken = F.filter(_cuts(x["t"], LOOSE), lambda c: ~c["mark"].rlike(rf"(?U)^\s*{MARK}\s*$") & (_trim(c["after"]) != "") & _asks(c["before"]))
        loose = F.when(F.size(broken) > 0, F.element_at(broken, -1))

        def later(y):
            last = F.coalesce(F.length(y["b"]["before"]), F.lit(-1)) > F.coalesce(F.length(y["a"]["before"]), F.lit(-1))
            return F.when(last, F.struct(y["b"]["before"].alias("before"), F.lit(CANONICAL).alias("mark"), y["b"]["after"].alias("after"))).otherwise(F.struct(y["a"]["before"].alias("before"), F.trim(y["a"]["mark"]).alias("mark"), y["a"]["after"].alias("after")))

        def made(cut):
            trailing = _trim(cut["after"])
            return F.struct(_mended_tail(cut["before"]).alias("text"), F.when(trailing == "", cut["mark"]).otherwise(F.concat(cut["mark"], F.lit("\n"), trailing)).alias("cell"))

        new = let(let(F.struct(explicit.alias("a"), loose.alias("b")), later), made)
        mended = let(new, lambda n: repaired(n["text"], n["cell"]))
        none = F.struct(x["t"].alias("text"), F.lit(None).cast("string").alias("cell"), F.lit(False).alias("changed"))
        own = let(mended, lambda m: F.when(m["cell"].isNull(), none).otherwise(F.struct(m["text"].alias("text"), m["cell"].alias("cell"), F.lit(True).alias("changed"))))
        return F.when(x["c"].isNotNull(), repaired(x["t"], x["c"])).otherwise(own)

    return let(F.struct(F.coalesce(text, F.lit("")).alias("t"), have.alias("c")), of)


def restored(text: Column, cell: Column, place: Column) -> Column:
    """The text with its view cell back at a place (code points before it), on lines of its own."""
    left, right = F.regexp_replace(F.substring(text, F.lit(1), place), f"[{SPACE}]+$", ""), F.regexp_replace(F.substring(text, place + 1, F.length(text)), f"^[{SPACE}]+", "")
    return F.array_join(F.filter(F.array(left, _trim(F.coalesce(cell, F.lit(""))), right), lambda p: p != ""), "\n")
