"""First-wins deduplication by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import canonical, negative, numbers


def keyed(rows: DataFrame, text: str) -> DataFrame:
    """The content key's parts: canonical prompt, numbers, polarity."""
    return rows.withColumn("prompt", canonical(F.col(text))).withColumn("numbers", numbers(F.col(text))).withColumn("negative", negative(F.col(text)))


def exact(rows: DataFrame, key: str, text: str) -> DataFrame:
    """P04 with equal keys: the smallest id of each content key. Partial minima are made before the shuffle."""
    return keyed(rows, text).groupBy(F.sha2(F.concat_ws("|", "prompt", "numbers", F.col("negative").cast("string")), 256).alias("content_key")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def fuzzy(rows: DataFrame, key: str, text: str) -> DataFrame:
    """P02/P04 without choices and groups: keys of the rows that are like no earlier kept row, in key order; prompts of any length."""
    from papyra.operators import selection

    k, none = F.col(key), F.lit(None)
    questions = rows.select(k.alias("id"), k.cast("long").alias("idx"), none.cast("long").alias("group_id"), none.cast("int").alias("group_order"), none.cast("int").alias("number"), F.col(text).alias("text"), none.cast("array<string>").alias("choices"), none.cast("string").alias("shared"))
    return selection.first_wins(selection.units(questions)).select(F.get("ids", F.lit(0)).alias(key))
