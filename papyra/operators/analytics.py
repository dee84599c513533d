"""Topic analytics over classified rows (subject, year, l1, l2, l3, confidence, risk, review): distributions, matrices, percentiles, priorities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.ordered import evenly_spaced
from papyra.sources.scratch import stored

#: Weights of the priority score and its buckets.
WEIGHTS = (0.50, 0.30, 0.20)
BUCKETS = ((0.75, "first"), (0.55, "high"), (0.35, "middle"))
#: Ranges that distinct values are dealt to before they are ranked.
RANGES = 256


def fixed(value, places: int):
    """A number to so many places, half up; what float sums leave beside a half (1e-9) doesn't matter."""
    return F.floor(value * 10**places + 0.5 + 1e-9) / 10**places


def recent_years(rows: DataFrame, year: str, count: int = 3) -> DataFrame:
    """The largest distinct years; a handful of rows."""
    return rows.where(F.col(year).isNotNull()).select(F.col(year).cast("long").alias("year")).distinct().orderBy(F.desc("year")).limit(count)


def _recent(rows: DataFrame) -> DataFrame:
    """rows with a flag recent, for the years of recent_years()."""
    years = F.broadcast(recent_years(rows, "year").withColumn("recent", F.lit(True)))  # three rows
    return rows.withColumn("year", F.col("year").cast("long")).join(years, "year", "left").withColumn("recent", F.coalesce("recent", F.lit(False)))


def ranked_share(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """counts (value, n) with a column: n of all values at most as large. Distinct values are dealt to ranges; one window sees the ranges' sums alone."""
    cuts = counts.agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")  # a single row
    sums = dealt.groupBy("range").agg(F.sum(n).alias("in_range"))
    before = sums.select("range", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum(n).over(Window.partitionBy("range").orderBy(value))
    return dealt.join(F.broadcast(before), "range").withColumn(name, F.col("before") + inside).drop("range", "before")  # RANGES rows


def percentile_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the number of values at most as large, less one, over all values less one; 1 if there is one value alone."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ranked = ranked_share(counts, value, "n", "upto").crossJoin(F.broadcast(total))  # a single row
    share = F.when(F.col("total") == 1, 1.0).otherwise((F.col("upto") - 1) / (F.col("total") - 1))
    return rows.select(key, value).join(ranked.select(value, share.alias("percentile")), value).select(key, value, "percentile")


def topic_distribution(rows: DataFrame) -> DataFrame:
    """Nine measures of each (subject, l1, l2, l3) of the classified rows."""
    valid = _recent(rows).where("l1 <> 'unknown'")
    per = valid.groupBy("subject", "l1", "l2", "l3").agg(
        F.count("*").alias("total_questions"), F.array_join(F.sort_array(F.collect_set(F.col("year").cast("string"))), ";").alias("years_present"), F.count_if("recent").alias("recent_count"),
        fixed(F.avg("confidence"), 2).alias("avg_confidence"), F.count_if("review").alias("needs_review"), fixed(F.avg("risk"), 2).alias("avg_risk"),
    )
    total = per.agg(F.sum("total_questions").alias("all"))
    out = per.crossJoin(F.broadcast(total))  # a single row
    out = out.withColumn("percent_all", fixed(F.col("total_questions") * 100.0 / F.col("all"), 2)).withColumn("recent_percent", fixed(F.col("recent_count") * 100.0 / F.col("total_questions"), 2))
    return out.drop("all")


def topic_matrix(rows: DataFrame) -> DataFrame:
    """Counts of each (year, subject, l1, l2) with their share within (year, subject)."""
    per = rows.where("l1 <> 'unknown'").groupBy(F.col("year").cast("long").alias("year"), "subject", "l1", "l2").agg(F.count("*").alias("question_count"), F.count_if("review").alias("needs_review"))
    share = F.col("question_count") * 100.0 / F.sum("question_count").over(Window.partitionBy("year", "subject"))
    return per.withColumn("percent_within", fixed(share, 2))


def topic_priority(rows: DataFrame) -> DataFrame:
    """Topics weighted by the percentiles of their counts, of their recent counts, and by their risk, in four buckets."""
    valid = _recent(rows).where("l1 <> 'unknown'")
    per = stored(valid.groupBy("l1", "l2", "l3").agg(F.count("*").alias("total_count"), F.count_if("recent").alias("recent_count"), F.avg("risk").alias("mean_risk")).withColumn("topic", F.struct("l1", "l2", "l3")))  # a row a topic
    f = percentile_map(per, "topic", "total_count").select("topic", F.col("percentile").alias("f"))
    r = percentile_map(per, "topic", "recent_count").select("topic", F.col("percentile").alias("r"))
    out = per.join(f, "topic").join(r, "topic").withColumn("x", WEIGHTS[0] * F.col("f") + WEIGHTS[1] * F.col("r") + WEIGHTS[2] * F.col("mean_risk"))
    bucket = F.lit("low")
    for least, label in reversed(BUCKETS):
        bucket = F.when(F.col("x") >= least, label).otherwise(bucket)
    return out.select(
        "l1", "l2", "l3", "total_count", "recent_count", fixed(F.col("f"), 4).alias("frequency_percentile"), fixed(F.col("r"), 4).alias("recent_percentile"), fixed(F.col("mean_risk"), 4).alias("risk"), fixed(F.col("x"), 4).alias("priority_score"), bucket.alias("priority")
    )


def most_common(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The most frequent keys with their counts, ties by key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(count)


def spot_check(rows: DataFrame, order: list[str], share: float = 0.05, least: int = 10) -> DataFrame:
    """`share` of the rows, `least` at least, evenly spaced in the given order, first and last included. Places come from ranges of the first order column."""
    return evenly_spaced(rows, order, share, least, "place")
