"""Grouped counts, extremes and merges of partial statistics: DataFrames in, lazy DataFrames out, partial sums before every shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def next_number(rows: DataFrame, column: str, name: str = "next_id") -> DataFrame:
    """The number behind the largest one, 1 for an empty table; one row."""
    return rows.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias(name))


def counts_with_zero(parents: DataFrame, children: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Parents (key and the columns to keep) with their number of children, 0 kept."""
    per = children.groupBy(key).agg(F.count("*").alias("n"))
    return parents.select(key, *(keep or [])).join(per, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def domain_rollup(exams: DataFrame, domain: str, key: str, name: str, count: str, most: int = 12) -> DataFrame:
    """A10: per domain its exams, their questions, and the names of the first `most` by key.

    Only those first rows are collected, by a bounded aggregate of ranked rows.
    """
    from pyspark.sql import Window

    per = exams.groupBy(domain).agg(F.count("*").alias("exam_count"), F.sum(count).alias("question_count"))
    first = exams.withColumn("papyra_r", F.row_number().over(Window.partitionBy(domain).orderBy(key))).where(F.col("papyra_r") <= most)
    named = first.groupBy(domain).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, name))), lambda x: x[name]).alias("examples"))
    return per.join(named, domain, "left")


def distinct_in_order(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place at which each first stands."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def merged_stats(partial: DataFrame, mount: str, year: str, n: str, exams: str) -> DataFrame:
    """Partial statistics (mount, year, n, exams) per mount: sums (exams are summed, not distinct) and the year map in order."""
    years = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(year, n))), lambda x: F.concat_ws(":", x[year].cast("string"), x[n].cast("string"))), ",")
    return partial.groupBy(mount).agg(F.sum(exams).alias("exam_count"), F.sum(n).alias("question_count"), years.alias("years"))


def counted_if(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """The number of rows of each key and of those that meet each condition, in one pass."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def mean_or(rows: DataFrame, keys: list[str], value: str, default: float, places: int, name: str) -> DataFrame:
    """Rounded mean, a default where there is no value."""
    return rows.groupBy(*keys).agg(F.round(F.coalesce(F.avg(value), F.lit(default)), places).alias(name))


def near_median(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The exact median of each key and how many values lie within `share` of it."""
    middle = rows.groupBy(*keys).agg(F.median(value).alias("middle"))
    return rows.join(middle, keys).groupBy(*keys).agg(F.max("middle").alias("middle"), F.count_if(F.abs(F.col(value) - F.col("middle")) <= share * F.col("middle")).alias("near"))


def longest_first(rows: DataFrame, keys: list[str], size: Column, order: list[str]) -> DataFrame:
    """The row of the greatest size of each key, the first in order among equals; a max over structs, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct((-size).alias("papyra_minus"), F.struct(*order).alias("papyra_order"), F.struct(*rest).alias("papyra_rest"))).alias("papyra_best"))
    return best.select(*keys, "papyra_best.papyra_rest.*")


def box_union(boxes: DataFrame, key: str) -> DataFrame:
    """The least box around the boxes of each key."""
    return boxes.groupBy(key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def summed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The element-wise sum of result rows, 0 for none."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def character_classes(chars: DataFrame, column: str) -> DataFrame:
    """Occurrences of characters by class: line end, space, letter, digit or other."""
    c = F.col(column)
    kind = F.when(c == "\n", "line").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("other")
    return chars.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def extra_numbers(rows: DataFrame, key: str, number: str, expected: int, last: int) -> DataFrame:
    """Per key its rows, whether they aren't `expected`, the numbers that come more than once, and how many rows lie beyond `last`."""
    per = rows.groupBy(key, number).agg(F.count("*").alias("c"))
    doubles = F.array_join(F.sort_array(F.collect_set(F.when(F.col("c") > 1, F.col(number).cast("string")))), ",")
    out = per.groupBy(key).agg(F.sum("c").alias("n"), doubles.alias("doubles"), F.coalesce(F.sum(F.when(F.col(number) > last, F.col("c"))), F.lit(0)).alias("beyond"))
    return out.withColumn("off", F.col("n") != expected)


def table_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per table its rows and how many repeat an id."""
    parts = [df.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct(F.col(key))).alias("doubles")).select(F.lit(name).alias("name"), "n", "doubles") for name, (df, key) in tables.items()]
    return reduce(lambda a, b: a.union(b), parts)


def findings_by_source(found: DataFrame, keys: list[str], listing: DataFrame, source: str) -> DataFrame:
    """Findings by source with their number, and whether a listing holds the source."""
    per = found.groupBy(*keys).agg(F.count("*").alias("n"))
    known = listing.select(source).distinct().withColumn("papyra_known", F.lit(1))
    out = per.join(known, source, "left")
    return out.withColumn("availability", F.when(F.col("papyra_known").isNull(), "missing").otherwise("available")).drop("papyra_known")


def graded(answers: DataFrame, marks: DataFrame, key: str, subject: str) -> DataFrame:
    """Per subject total, correct and score (half up to one place), with the overall score of all marks."""
    per = answers.join(marks, key).groupBy(subject).agg(F.count("*").alias("total"), F.sum("right").alias("correct"))
    overall = marks.agg(F.round(F.sum("right") * 100.0 / F.count("*"), 1).alias("overall"))
    return per.withColumn("score", F.round(F.col("correct") * 100.0 / F.col("total"), 1)).crossJoin(F.broadcast(overall))  # a single row
