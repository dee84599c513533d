"""The search over a question bank: optional filters, tags, text in any surface, canonical order; point lookup; mounts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators.relational import nested

#: Canonical order: newest year and session first, then number; ids break ties.
ORDER = (F.desc, "year"), (F.desc, "session"), (F.asc, "number"), (F.asc, "id")


def filters(exam=None, subject=None, year=None, year_from=None, year_to=None, session=None, numbers=None, ids=None) -> Column:
    """equality filters that are given; a year overrides the range of years; numbers are a set."""
    made = [F.col(c) == v for c, v in (("exam", exam), ("subject", subject), ("session", session)) if v is not None and v != ""]
    if year is not None:
        made.append(F.col("year") == year)
    else:
        made += [F.col("year") >= year_from] if year_from is not None else []
        made += [F.col("year") <= year_to] if year_to is not None else []
    if numbers:
        made.append(F.col("number").isin(sorted({int(n) for n in numbers})))
    if ids is not None:
        made.append(F.col("id").isin(list(ids)))
    return reduce(lambda a, b: a & b, made, F.lit(True))


def search(questions: DataFrame, choices: DataFrame | None = None, surfaces: list[str] = ("text",), tag_query: str = "", search_text: str = "", limit: int | None = None, choice_text: str = "choice_text", **given) -> DataFrame:
    """Questions (id, exam, subject, year, session, number, tags and the surfaces) that meet the filters.

    Tags: one token of the query at least is a tag. Text: every token is in a surface or in a choice of the question; the choices that hold a token
    are reduced to question ids before they are joined. Canonical order; with a limit, just a top-k.
    """
    found = questions.where(filters(**given))
    if tag_query:
        found = found.where(X.tagged(F.col("tags"), tag_query))
    for k, token in enumerate(sorted({t.lower() for t in search_text.split()})):
        hit = reduce(lambda a, b: a | b, [X.contains_literal(F.col(s), token) for s in surfaces], F.lit(False))
        if choices is not None:
            mark = f"papyra_hit{k}"
            ids = choices.where(X.contains_literal(F.col(choice_text), token)).select("id").distinct().withColumn(mark, F.lit(True))
            found = found.join(ids, "id", "left").where(hit | F.col(mark).isNotNull()).drop(mark)
        else:
            found = found.where(hit)
    order = [f(c) for f, c in ORDER]
    return found.orderBy(*order) if limit is None else found.orderBy(*order).limit(limit)


def point(questions: DataFrame, choices: DataFrame, id_, order: list[str], fields: list[str]) -> DataFrame:
    """The question of an id with its choices nested; no row if there is none. The id is pushed to both scans."""
    return nested(questions.where(F.col("id") == id_), choices.where(F.col("id") == id_), "id", order, fields)


def blank(column: str) -> Column:
    """null, empty or white space only."""
    return F.trim(F.coalesce(F.col(column), F.lit(""))) == ""


def in_year_range(column: str, low: int | None, high: int | None) -> Column:
    """a whole number within the range, either end open; what is no whole number doesn't count."""
    year = F.col(column).try_cast("int")
    return year.isNotNull() & (F.lit(True) if low is None else year >= low) & (F.lit(True) if high is None else year <= high)


def whole_groups(rows: DataFrame, group: str, key: str, good: Column) -> DataFrame:
    """rows of units all of whose members are good; rows without a group are units of their own. An anti join to the failing units."""
    unit = F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("q:"), F.col(key).cast("string")))
    marked = rows.withColumn("papyra_unit", unit)
    failing = marked.where(~F.coalesce(good, F.lit(False))).select("papyra_unit").distinct()
    return marked.join(failing, "papyra_unit", "left_anti").drop("papyra_unit")


def with_status(rows: DataFrame, statuses: str, key: str, status: str) -> DataFrame:
    """distinct keys whose status is in a comma-separated list."""
    wanted = [s.strip() for s in statuses.split(",") if s.strip()]
    return rows.where(F.col(status).isin(*wanted)).select(key).distinct()


def blocking(findings: DataFrame, key: str, codes: list[str]) -> DataFrame:
    """keys with their distinct blocking codes, in order."""
    return findings.where(F.col("code").isin(*codes)).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))


def pruned(mounts: dict[str, DataFrame], code: str | None, other: str | None = None) -> dict[str, DataFrame]:
    """The mounts that namespaced codes name: one, all without a code, none if two codes name different mounts."""
    named = [c.split("::", 1)[0] for c in (code, other) if c and "::" in c]
    if not named:
        return mounts
    return {m: df for m, df in mounts.items() if m == named[0]} if len(set(named)) == 1 else {}


def namespaced(mounts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Distinct (mount, code, columns) options of all mounts, ordered by name and code."""
    made = [df.select(F.lit(m).alias("mount"), *columns).distinct() for m, df in sorted(mounts.items())]
    return reduce(lambda a, b: a.unionByName(b), made).withColumn("code", F.concat_ws("::", "mount", F.col(columns[0]).cast("string")))
