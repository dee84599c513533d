"""Formulas in pasted and extracted text as LaTeX, with the spans that they take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import offsets

# Private-use glyphs of formula fonts and the signs that they show.
GLYPHS = {
    "\ue000": "A", "\ue001": "B", "\ue002": "C", "\ue003": "D", "\ue004": "E", "\ue008": "I", "\ue00b": "L", "\ue00d": "N", "\ue00f": "P", "\ue011": "R", "\ue013": "T", "\ue015": "V", "\ue016": "W", "\ue017": "X",
    "\ue034": "1", "\ue035": "2", "\ue036": "3", "\ue037": "4", "\ue03d": "0", "\ue044": "(", "\ue045": ")", "\ue046": "-", "\ue047": "=", "\ue048": "+", "\ue053": ".", "\ue054": "/", "\ue055": "<", "\ue056": ">", "\ue05c": "√", "\ue06d": "¯",
    "\ue09e": "β", "\ue0a4": "θ", "\ue0ac": "π", "\ue0e5": "a", "\ue0e6": "b", "\ue0e9": "e", "\ue0ea": "f", "\ue0eb": "g", "\ue0ec": "h", "\ue0ed": "i", "\ue0ef": "k", "\ue0f0": "l", "\ue0f1": "m", "\ue0f2": "n", "\ue0f3": "o", "\ue0f4": "p",
    "\ue0f6": "r", "\ue0f7": "s", "\ue0f8": "t", "\ue0fb": "w", "\uf000": "I",
}
# Notations of formulas, in the order in which they are tried at a place.
ATOM = r"[0-9]+(?:\.[0-9]+)?|[A-Za-z][A-Za-z0-9_]*"
SIGNS = r"[A-Za-z0-9\\{}\s√×·ㆍ∙•+\-*/^().,θΘ]"
TELLING = r"√|\\sqrt|×|\\times|θ|\\theta|(?<![A-Za-z])(?:cos|sin|tan)\s*[A-Za-z\\θ]"
NOTATIONS = {
    "round": r"\\\((?s:.*?)\\\)",
    "dollar": r"\$[^$]+\$",
    "command": r"\\?(?:sqrt|overline)\s*\{[^{}]+\}",
    "root": r"(?i:ROOT)\s*\(\s*[^)]+?\s*\)",
    "equation": rf"[A-Za-z]\s*=\s*(?={SIGNS}*?(?:{TELLING})){SIGNS}+",
    "sign_round": r"√\s*\(\s*[^)]+?\s*\)",
    "sign_brace": r"√\s*\{\s*[^{}]+?\s*\}",
    "sign_bar": rf"√\s*[¯‾]\s*(?:{ATOM})",
    "bar": "[A-Za-z0-9]\u0305",
    "sign_digit": r"√\s*[0-9](?=[0-9A-Za-z])",
    "sign_atom": rf"√\s*(?:{ATOM})",
}
DOTS = "[·ㆍ∙•]"
_ANY = "(?U)" + "|".join(NOTATIONS.values())


def glyphs(text: Column, table: dict[str, str] | None = None) -> Column:
    """Private-use glyphs as readable signs; a root sign and its bar before a sign are the root sign alone. Null counts as empty."""
    table = GLYPHS if table is None else table
    rooted = F.regexp_replace(F.coalesce(text, F.lit("")), "\ue05c\ue06d?([\ue000-\uf8ffA-Za-z0-9])", "√$1")
    return F.translate(rooted, "".join(table), "".join(table.values()))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _inner(text: Column) -> Column:
    """What stands under a root or a bar: dots are products, signs stand without blanks."""
    dots = F.regexp_replace(_trimmed(text), rf"(?U)\s*{DOTS}\s*", r" \\cdot ")
    return _trimmed(F.regexp_replace(F.regexp_replace(dots, r"(?U)\s*([+=\-])\s*", "$1"), r"(?U)\s+", " "))


def _in_braces(text: Column, command: str) -> Column:
    return F.concat(F.lit(f"\\{command}{{"), _inner(text), F.lit("}"))


def _equation(text: Column) -> Column:
    """An equation's roots as commands, then its signs, functions and blanks."""
    out = _trimmed(text)
    out = F.regexp_replace(out, r"(?U)(?i)(?<!\\)sqrt\s*\{\s*([^{}]+?)\s*\}|√\s*\{\s*([^{}]+?)\s*\}", r"\\sqrt{$1$2}")
    out = F.regexp_replace(out, rf"(?U)√\s*[¯‾]\s*({ATOM})", r"\\sqrt{$1}")
    out = F.regexp_replace(out, r"(?U)√\s*([0-9])(?=[0-9A-Za-z\\θ])", r"\\sqrt{$1}")
    out = F.regexp_replace(out, rf"(?U)√\s*({ATOM})", r"\\sqrt{$1}")
    out = offsets.replaced(out, r"\\sqrt\{[^{}]*\}", lambda m: _in_braces(F.substring(m, F.lit(7), F.length(m) - 7), "sqrt"))
    out = F.regexp_replace(out, "[Θθ]", r"\\theta")
    out = F.regexp_replace(out, r"(?U)(?<!\\)\b(cos|sin|tan)\s*(?=\\theta|[A-Za-z])", r"\\$1")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\\(cos|sin|tan)\s+\\theta", r"\\$1\\theta"), r"(?U)\s*=\s*", "=")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\s*(?:×|\\times)\s*", r" \\times "), rf"(?U)\s*(?:{DOTS}|\\cdot)\s*", r" \\cdot ")
    return _trimmed(F.regexp_replace(out, r"(?U)\s+", " "))


def _latex(m: Column) -> Column:
    """The LaTeX of a match, by the notation that it has; a blank formula stays as it is."""
    bare = lambda n: _trimmed(F.substring(m, F.lit(n + 1), F.length(m) - 2 * n))
    named = lambda x: F.when(x.rlike("^(?:sqrt|overline)"), F.concat(F.lit("\\"), x)).otherwise(x)
    under = lambda pattern, k=1: F.regexp_extract(m, "(?U)(?s)" + pattern, k)
    return (
        F.when(m.startswith("\\("), F.when(bare(2) == "", m).otherwise(named(bare(2))))
        .when(m.startswith("$"), F.when(bare(1) == "", m).otherwise(named(bare(1))))
        .when(m.rlike(r"(?U)^\\?sqrt\s*\{"), _in_braces(under(r"\{(.*)\}$"), "sqrt"))
        .when(m.rlike(r"(?U)^\\?overline\s*\{"), _in_braces(under(r"\{(.*)\}$"), "overline"))
        .when(m.rlike(r"(?U)^(?i:root)\s*\("), _in_braces(under(r"\(\s*(.*)\)$"), "sqrt"))
        .when(m.rlike(r"(?U)^[A-Za-z]\s*="), _equation(m))
        .when(m.endswith("\u0305"), _in_braces(F.substring(m, 1, 1), "overline"))
        .otherwise(_in_braces(under(r"^√\s*[(\{¯‾]?\s*(.*?)[)\}]?$"), "sqrt"))
    )


def normalized(text: Column) -> Column:
    """struct<text, spans, map>: glyphs made readable, formulas as LaTeX, their spans (struct<start, end, latex>) and the map of places.

    Null counts as empty. A formula that is written as LaTeX without signs around it still has a span; blank formulas stay text.
    """
    pieces = offsets.parts(glyphs(text), _ANY, _latex)
    # what is written as LaTeX already is a formula too, though it stays the same
    formula = lambda p: ~p["same"] | p["raw"].rlike("^(?:" + _ANY + ")$") & ~p["raw"].rlike(r"(?U)^(?:\$\s*\$|\\\(\s*\\\))$")

    def made(x):
        spans = F.zip_with(x["p"], x["j"]["map"], lambda p, m: F.when(formula(p), F.struct(m["out"].alias("start"), m["out_end"].alias("end"), p["made"].alias("latex"))))
        return F.struct(x["j"]["text"].alias("text"), F.array_compact(spans).alias("spans"), x["j"]["map"].alias("map"))

    return offsets.let(offsets.let(pieces, lambda p: F.struct(p.alias("p"), offsets.joined(p).alias("j"))), made)
