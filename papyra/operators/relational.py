"""Searches, joins, aggregations, set operations and changes over relations: DataFrames in, lazy DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Parents with their children as an ordered array of structs (empty if there are none)."""
    packed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("children"))
    return parents.join(packed, key, "left").withColumn("children", F.coalesce("children", F.array().cast(packed.schema["children"].dataType)))


def fallback(left: DataFrame, exact: DataFrame, default: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Value by key, else by group."""
    by_key = exact.select(key, F.col(value).alias("by_key"))
    by_group = default.select(group, F.col(value).alias("by_group"))
    return left.join(by_key, key, "left").join(by_group, group, "left").withColumn(value, F.coalesce("by_key", "by_group")).drop("by_key", "by_group")


def banded(rows: DataFrame, number: Column, bands: list[tuple[int, int, str]]) -> DataFrame:
    """Each row with the label of the inclusive band that holds its number; rows outside all bands go."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        out = F.when(number.between(low, high), F.lit(label)).otherwise(out)
    return rows.withColumn("band", out).where(F.col("band").isNotNull())


def overlapping(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs (a_id, b_id, area) of boxes (id, x0, y0, x1, y1) that overlap, met in grid cells and counted once, in the cell of the overlap's corner."""

    def celled(df: DataFrame, p: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / cell)
        named = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        named = named.withColumn("cx", F.explode(F.sequence(at(f"{p}_x0"), at(f"{p}_x1")))).withColumn("cy", F.explode(F.sequence(at(f"{p}_y0"), at(f"{p}_y1"))))
        return named

    met = celled(a, "a").join(celled(b, "b"), ["cx", "cy"])
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - x0, F.least("a_y1", "b_y1") - y0
    once = (F.floor(x0 / cell) == F.col("cx")) & (F.floor(y0 / cell) == F.col("cy"))
    return met.where((w > 0) & (h > 0) & once).select("a_id", "b_id", (w * h).alias("area"))


#: Ids that one list holds, about; and a box's corners.
_LIST, _CORNERS = 1024, ["x0", "y0", "x1", "y1"]


def overlap_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """overlapping() for boxes of which many share a place.

    Only different places meet in the grid cells. The ids of a place stand in lists, and each pair of lists is dealt to the tasks before it is written out, so a task holds two lists
    and its work is the pairs that it returns.
    """

    def places(df: DataFrame) -> DataFrame:
        return df.groupBy(*_CORNERS).agg(F.count("*").alias("n"))

    def lists(df: DataFrame, of: DataFrame, p: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / _LIST))
        held = df.join(of, _CORNERS).groupBy(*_CORNERS, part.alias(f"{p}_part")).agg(F.collect_list(F.struct("id")).alias(f"{p}_ids"))
        return held.withColumnsRenamed({c: f"{p}_{c}" for c in _CORNERS})

    spark = a.sparkSession
    of_a, of_b = places(a), places(b)
    at = F.struct(*_CORNERS).alias("id")
    both = overlapping(of_a.select(at, *_CORNERS), of_b.select(at, *_CORNERS), cell)
    both = both.select(*[F.col(f"{p}_id.{c}").alias(f"{p}_{c}") for p in "ab" for c in _CORNERS], "area")
    for df, of, p in ((a, of_a, "a"), (b, of_b, "b")):
        both = both.join(lists(df, of, p), [f"{p}_{c}" for c in _CORNERS])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = both.repartition(tasks, *[f"{p}_{c}" for p in "ab" for c in (*_CORNERS, "part")])
    each = dealt.select("area", "b_ids", F.explode("a_ids").alias("a")).select("area", "a", F.explode("b_ids").alias("b"))
    return each.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "area")


def compared(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Key, old and new value and added, removed, changed or same."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    both = a.withColumn("in_old", F.lit(1)).join(b.withColumn("in_new", F.lit(1)), key, "full")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed").otherwise("same")
    return both.withColumn("state", state).drop("in_old", "in_new")


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base with rows replaced or added by key, and how each row came about."""
    kept = base.join(changes, key, "left_anti").withColumn("origin", F.lit("kept"))
    known = base.select(key).withColumn("known", F.lit(1))
    put = changes.join(known, key, "left").withColumn("origin", F.when(F.col("known").isNull(), "inserted").otherwise("updated")).drop("known")
    return kept.unionByName(put)


def swapped(base: DataFrame, wanted: DataFrame, key: str, column: str) -> DataFrame:
    """Compare-and-set: rows of wanted (key, before, after) change base only where its value is `before`; all or nothing."""
    hit = base.join(wanted, key).where(F.col(column).eqNullSafe(F.col("before")))
    every = wanted.agg(F.count("*").alias("asked")).withColumn("one", F.lit(1)).join(hit.agg(F.count("*").alias("met")).withColumn("one", F.lit(1)), "one")
    ok = every.select((F.col("asked") == F.col("met")).alias("ok"), "one")
    out = base.withColumn("one", F.lit(1)).join(F.broadcast(ok), "one").join(wanted, key, "left")  # a single row
    done = F.col("ok") & F.col("after").isNotNull()
    return out.withColumn(column, F.when(done, F.col("after")).otherwise(F.col(column))).withColumn("applied", done).drop("one", "ok", "before", "after")


def remapped(rows: DataFrame, key: str, start: int = 1) -> DataFrame:
    """(old_id, new_id): dense new ids in key order. Ids are counted per range of 4,096 keys, ranges per 4,096 ranges, so one window sees a row for 16 million keys."""
    ranged = rows.select(F.col(key).alias("old_id")).distinct().withColumn("range", F.floor(F.col("old_id") / 4096))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("upper", F.floor(F.col("range") / 4096))
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upper = counts.groupBy("upper").agg(F.sum("n").alias("n")).select("upper", upto(Window.orderBy("upper")).alias("far"))
    before = counts.withColumn("near", upto(Window.partitionBy("upper").orderBy("range"))).join(upper, "upper").select("range", (F.col("near") + F.col("far")).alias("before"))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy("old_id")))
    return inside.join(before, "range").select("old_id", (F.col("rank") + F.col("before") + start - 1).cast("long").alias("new_id"))


def prefix_siblings(files: DataFrame, key: str, prefix: str, is_answer: str) -> DataFrame:
    """Each question file with the first answer file that shares its prefix; an equi-join on the derived prefix, one answer a prefix."""
    first = files.where(F.col(is_answer) & (F.col(prefix) != "")).groupBy(prefix).agg(F.min(key).alias("answer_id"))
    return files.where(~F.col(is_answer)).join(first, prefix, "left")


def counters_added(counters: DataFrame, more: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Counters with more added by key; new keys come in."""
    return counters.select(*keys, n).unionByName(more.select(*keys, n)).groupBy(*keys).agg(F.sum(n).alias(n))
