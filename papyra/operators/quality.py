"""Data-quality rules: each rule is a condition; findings are its rows with code and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Q01-Q11: one row per broken rule: key, code, severity. All rules are evaluated in one pass."""
    made = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules]))
    return rows.select(key, F.explode(made).alias("f")).select(key, "f.code", "f.severity")


def rolled_up(found: DataFrame, key: str) -> DataFrame:
    """Q11: per key the number of findings, their codes, and error if one is an error."""
    worst = F.when(F.bool_or(F.col("severity") == "error"), "error").otherwise("warning")
    return found.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"), worst.alias("severity"))


def contiguous(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Per key the count, whether numbers run from 1 without a gap or a repeat, and how many are missing."""
    n, high = F.count("*"), F.max(number)
    return rows.groupBy(key).agg(n.alias("n"), ((F.min(number) == 1) & (high == n) & (F.count_distinct(F.col(number)) == n)).alias("complete"), (high - F.count_distinct(F.col(number))).cast("long").alias("missing"))
