"""Operators over ordered rows: previous and nearest events, gaps, intervals, segments, samples, first-wins choices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.sources.scratch import stored


def walked(rows: DataFrame, partition: str, order: list[str], number: str, step, start, name: str, kind: str) -> DataFrame:
    """rows with a column made by a walk along each partition in order: step(carry, number) gives (carry, value), start is the first carry.

    Partitions are dealt by key and sorted; a walk goes over a task's rows batch by batch and holds a carry alone, so a long partition is never one group in memory.
    """
    place = [rows.columns.index(partition), rows.columns.index(number)]

    def run(batches):
        import pyarrow as pa

        first, key, carry = True, None, start
        for batch in batches:
            out = []
            for k, n in zip(*(batch.column(i).to_pylist() for i in place)):
                if first or k != key:
                    first, key, carry = False, k, start
                carry, value = step(carry, n)
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, spark_kind)], names=[*batch.schema.names, name])

    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"{name} {kind}").fields])
    spark_kind = to_arrow_type(schema[-1].dataType)
    return rows.repartition(partition).sortWithinPartitions(partition, *order, number).mapInArrow(run, schema)


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, stored in order over range partitions: papyra_part is a row's partition, papyra_at its place there, from 0. Equal rows may lie on either side of a border."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("papyra_part", F.spark_partition_id()).withColumn("papyra_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """rows with dense numbers in order. No task sees all rows: places count within range partitions, and a row a partition says how many precede it."""
    dealt = ranged(rows, order)
    before = F.coalesce(F.sum("n").over(Window.orderBy("papyra_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    offsets = dealt.groupBy("papyra_part").agg(F.count("*").alias("n")).select("papyra_part", before.alias("papyra_before"))
    out = dealt.join(F.broadcast(offsets), "papyra_part")  # a row a partition
    return out.withColumn(name, (F.col("papyra_before") + F.col("papyra_at") + start).cast("long")).drop("papyra_part", "papyra_at", "papyra_before")


def placed(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with their places in their groups, from 0. A group may fill many tasks: rows are numbered over all groups, from which the number of its first row is taken."""
    every = stored(numbered(rows, [group, *order], "papyra_n", 0))
    heads = every.groupBy(group).agg(F.min("papyra_n").alias("papyra_head")).withColumnRenamed(group, "papyra_group")
    out = every.join(heads, F.col(group).eqNullSafe(F.col("papyra_group")))
    return out.withColumn(name, F.col("papyra_n") - F.col("papyra_head")).drop("papyra_n", "papyra_head", "papyra_group")


def previous(rows: DataFrame, partition: str, order: list[str], value: str, matches: Column) -> DataFrame:
    """J27, backward part: the value of the last earlier row that matches."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(F.when(matches, F.col(value)), ignorenulls=True).over(w))


def nearest(rows: DataFrame, partition: str, order: list[str], at: str, matches: Column) -> DataFrame:
    """J26 along one axis: the distance to the nearest other row that matches, before or after."""
    w = Window.partitionBy(partition).orderBy(*order)
    before = F.last(F.when(matches, F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(matches, F.col(at)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("distance", F.least(F.col(at) - before, after - F.col(at)))


def sessions(rows: DataFrame, partition: str, order: list[str], at: str, gap: float) -> DataFrame:
    """Rows numbered by runs whose steps are at most `gap`."""
    w = Window.partitionBy(partition).orderBy(*order)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("long")
    return rows.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("new").over(w)).drop("new")


def merged(intervals: DataFrame, partition: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals as one."""
    w = Window.partitionBy(partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(partition, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("run")


def segments(rows: DataFrame, partition: str, order: str, starts: Column) -> DataFrame:
    """Rows numbered by the starting row that they follow; those before the first one have 0."""
    w = Window.partitionBy(partition).orderBy(order)
    return rows.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def latest(rows: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Per group the last value that isn't blank, the first row's if all are."""
    at = F.struct(*order)
    good = F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != "")
    return rows.groupBy(partition).agg(F.coalesce(F.max_by(F.when(good, F.col(value)), F.when(good, at)), F.min_by(value, at)).alias(value))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("papyra_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("papyra_n = 1").drop("papyra_n")


def round_robin(rows: DataFrame, group: str, order: list[str], each: int) -> DataFrame:
    """The first `each` rows of every group, dealt in turns."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn.cast("long")).where(F.col("turn") <= each)


def systematic(rows: DataFrame, group: str, order: list[str], step: int) -> DataFrame:
    """Every step-th row of every group, from the first."""
    return placed(rows, group, order).where(F.col("place") % step == 0)


def evenly_spaced(rows: DataFrame, order: list[str], share: float = 0.05, least: int = 10, place: str | None = None) -> DataFrame:
    """A sample (place: with the rows' numbers from 1) of `share` of all rows, rounded up, `least` at least, evenly spaced from the first row to the last: the k-th is round(k (n - 1) / (size - 1)), halves to even."""
    every = numbered(rows, order, "papyra_n", 0)
    shown = lambda df: (df.withColumn(place, F.col("papyra_n") + 1) if place else df).drop("papyra_n")
    n = every.count()
    size = max(least, math.ceil(n * share))
    if n <= size:
        return shown(every)
    # the sample's k whose place is this row, if there is one: the rounding moves it by half a row at most
    k = F.lit(size - 1) * F.col("papyra_n") / F.lit(n - 1)
    hit = lambda x: F.bround(x * F.lit(n - 1) / F.lit(size - 1)).cast("long") == F.col("papyra_n")
    return shown(every.where(hit(F.floor(k)) | hit(F.ceil(k))))


def spot_checked(sample: DataFrame, pages: DataFrame, keys: list[str], text: str, excerpt: str, excused: Column) -> DataFrame:
    """One row: checked, page_hits, evidence_hits. A sampled row hits its page if that has text, and its evidence if the page's text holds three of the excerpt's
    first eight words of four signs or more (all, if there are fewer), or if it is excused."""
    page = pages.groupBy(*keys).agg(F.last(text).alias("papyra_page"))
    words = F.slice(F.filter(F.split(F.coalesce(excerpt, F.lit("")), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4), 1, 8)
    both = sample.join(page, keys, "left").withColumn("papyra_page", F.trim(F.regexp_replace(F.coalesce("papyra_page", F.lit("")), r"\s+", " "))).withColumn("papyra_words", words)
    found = F.size(F.filter("papyra_words", lambda w: F.contains(F.col("papyra_page"), w)))
    hit = F.col("papyra_page") != ""
    evidence = (hit & (F.size("papyra_words") > 0) & (found >= F.least(F.lit(3), F.size("papyra_words")))) | F.coalesce(excused, F.lit(False))
    return both.agg(F.count("*").alias("checked"), F.count_if(hit).alias("page_hits"), F.count_if(evidence).alias("evidence_hits"))


def exact_sample(rows: DataFrame, key: Column, count: int, seed: int) -> DataFrame:
    """P09 with single units: exactly `count` rows (all if there are fewer), those of the least md5 of key and seed."""
    return rows.withColumn("rank", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))).orderBy("rank").limit(count)


def asof(rows: DataFrame, partition: str, order: list[str], value: str, matches: Column, default) -> DataFrame:
    """The value of the last earlier row that matches, else of the first later one, else the default."""
    w = Window.partitionBy(partition).orderBy(*order)
    seen = F.when(matches, F.col(value))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("asof", F.coalesce(before, after, F.lit(default)))


def monotone(rows: DataFrame, partition: str, order: list[str], number: str, most: int = 8) -> DataFrame:
    """Rows whose number is larger than the last kept one's, by `most` at most; the first row of a partition is kept, and null numbers go. The walk is linear and carries the last kept number."""

    def step(last, n):
        keep = n is not None and (last is None or 0 < n - last <= most)
        return (n if keep else last), keep

    own = rows.select(partition, *[c for c in order if c != partition], *([] if number in (partition, *order) else [number]))
    return walked(own, partition, order, number, step, None, "papyra_kept", "boolean").where("papyra_kept").drop("papyra_kept")


def subject_switches(rows: DataFrame, partition: str, order: list[str], number: str, full: int = 25, reset: int = 20) -> DataFrame:
    """Rows with the index of their subject: it moves on at a number 1 behind `reset` or more, or when `full` rows of it have passed. The walk carries the last number, the count and the index."""

    def step(carry, n):
        last, count, subject = carry
        over = (n == 1 and last is not None and last >= reset) or count >= full
        carry = (n, 1, subject + 1) if over else (n, count + 1, subject)
        return carry, carry[2]

    own = rows.select(partition, *[c for c in order if c != partition], *([] if number in (partition, *order) else [number]))
    return walked(own, partition, order, number, step, (None, 0, 0), "subject", "int")


def wide_gaps(rows: DataFrame, partition: str, order: list[str], low: str, high: str, least: float) -> DataFrame:
    """Rows with the gap to their left neighbour's end, where it is at least `least`."""
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("gap", F.col(low) - F.lag(high).over(w)).where(F.col("gap") >= least)


def cluster_means(rows: DataFrame, partition: str, order: list[str], at: str, gap: float) -> DataFrame:
    """(partition, session, mean, n): runs of values whose steps are at most `gap`, with their means."""
    return sessions(rows, partition, order, at, gap).groupBy(partition, "session").agg(F.avg(at).alias("mean"), F.count("*").alias("n"))


def split_by_median(rows: DataFrame, partition: str, order: list[str], at: str, factor: float = 1.55, least: float = 45.0) -> DataFrame:
    """Rows numbered by runs that part where a gap is over `factor` times the partition's median gap, and over `least`."""
    w = Window.partitionBy(partition).orderBy(*order)
    gaps = rows.withColumn("gap", F.col(at) - F.lag(at).over(w))
    middle = gaps.groupBy(partition).agg(F.coalesce(F.median("gap"), F.lit(0.0)).alias("middle"))
    marked = gaps.join(middle, partition).withColumn("new", F.coalesce((F.col("gap") > F.greatest(F.col("middle") * factor, F.lit(least))).cast("long"), F.lit(0)))
    return marked.withColumn("run", F.sum("new").over(w)).drop("gap", "middle", "new")


def missing_between(rows: DataFrame, partition: str, number: str) -> DataFrame:
    """Numbers n + 1 that are missing between neighbours n and n + 2."""
    w = Window.partitionBy(partition).orderBy(number)
    return rows.withColumn("next", F.lead(number).over(w)).where(F.col("next") == F.col(number) + 2).select(partition, (F.col(number) + 1).alias("missing"))


def kth_pairs(left: DataFrame, right: DataFrame, partition: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of the left side beside the k-th of the right side, in each partition."""
    k = lambda df, order: df.withColumn("k", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
    return k(left, left_order).join(k(right, right_order), [partition, "k"])


def rotated(rows: DataFrame, partition: str, order: list[str], offset: int) -> DataFrame:
    """Places from 0 after a rotation by the offset, so that a resumed run goes on where the last one ended."""
    w = Window.partitionBy(partition)
    place = F.row_number().over(w.orderBy(*order)) - 1
    total = F.count("*").over(w)
    return rows.withColumn("place", F.pmod(place - F.lit(offset) % total, total).cast("long"))


def occurrences(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The running number of each key's rows, from 1: a session number."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def first_band(rows: DataFrame, partition: str, order: list[str], low: str, high: str, gap: float) -> DataFrame:
    """The rows from the first one on up to the first gap over `gap`."""
    return sessions_by_gap(rows, partition, order, low, high, gap).where("session = 0")


def sessions_by_gap(rows: DataFrame, partition: str, order: list[str], low: str, high: str, gap: float) -> DataFrame:
    """Rows numbered by runs in which each begins at most `gap` behind the furthest end so far."""
    w = Window.partitionBy(partition).orderBy(*order)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("new", F.coalesce((F.col(low) - reach > gap).cast("long"), F.lit(0))).withColumn("session", F.sum("new").over(w)).drop("new")


def exam_sets(pages: DataFrame, document: str, page: str, meta: str, first_number: str) -> DataFrame:
    """Pages numbered by exam set: a set begins where the forward-filled heading changes, or where numbering falls back to 1."""
    w = Window.partitionBy(document).orderBy(page)
    filled = pages.withColumn("heading", F.last(meta, ignorenulls=True).over(w))
    change = ~F.col("heading").eqNullSafe(F.lag("heading").over(w)) | ((F.col(first_number) == 1) & (F.lag(first_number).over(w) > 1))
    begins = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(change, F.lit(False)).cast("int"))
    return filled.withColumn("begins", begins).withColumn("set", F.sum("begins").over(w).cast("long")).drop("begins")


def child_order(rows: DataFrame, group: str, order: str, number: str, index: str) -> DataFrame:
    """The place of each child in its group: those with an order by it, then those with a number by that, then the others; input breaks ties."""
    kind = F.when(F.col(order).isNotNull(), 0).when(F.col(number).isNotNull(), 1).otherwise(2)
    w = Window.partitionBy(group).orderBy(kind, F.coalesce(F.col(order).cast("double"), F.col(number).cast("double"), F.col(index).cast("double")), index)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def reading_order(blocks: DataFrame, page: str, x0: str, x1: str, y0: str, width: float, divider: float) -> DataFrame:
    """The place of each block of a page: a full-width block of the top (its width over half the page, above all others) first, then columns left to right, each from the top."""
    w = Window.partitionBy(page)
    top = (F.col(x1) - F.col(x0) > width / 2) & (F.col(y0) == F.min(y0).over(w))
    column = F.when(top, -1).when(F.col(x0) < divider, 0).otherwise(1)
    return blocks.withColumn("column", column).withColumn("place", F.row_number().over(w.orderBy("column", y0, x0)).cast("long"))


def balanced(rows: DataFrame, group: str, order: list[str], limit: int) -> DataFrame:
    """`limit` rows, dealt in turns from the groups in name order; all rows if there are no more."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn.cast("long")).where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)
