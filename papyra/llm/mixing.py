"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key u ** (1 / weight), u a uniform number from its id and the seed; the largest keys come first.
Whole epochs of a source precede its fractional selection, which takes documents by key until the budget is
full. The boundary is found by two levels of key intervals per source, so that only one narrow
interval of each source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Key intervals per level.
PARTS = 256
#: Source weights by code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): `share` of all sizes dealt by weight, at most `most` times a source's size.

    The excess goes to the other sources by weight: target = min(cap, level * weight) with the one level that spends the
    whole. One row per source, null included, so the windows over all sources see a handful of rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    order = Window.orderBy("full_at", F.col("source").isNull(), F.col("source").cast("binary"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / rest)
    first = F.when(F.col("level") <= F.col("full_at"), F.struct(F.row_number().over(order).alias("n"), F.col("level").alias("level")))
    per = per.withColumn("first", first)
    level = F.min("first").over(everything)["level"]
    return per.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def uniform(key, seed: int):
    """A number in (0, 1) from a key column and a seed; SQL engines agree on it."""
    return (F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def plan(docs: DataFrame, quality=None, seed: int = 7, cut: bool = True, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, copies (whole copies), rest (words of a further, cut one).

    quality: (doc_id, weight) with positive weights, at most a row an id; others weigh 1. A row's order is its key, then
    its id; rows of equal id and source are taken alike, by one key, in a fixed order. cut: the document at the boundary gives just the
    words that are missing; else it is taken whole if that brings its source nearer to its target. Documents without
    words, and null texts, are never selected beyond whole epochs. Null ids and null sources take part as values.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), C.n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("weight", F.lit(1.0)) if quality is None else sized.join(quality.select("doc_id", "weight"), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = C.stored(sized.withColumn("k", 1 - F.pow(uniform(F.col("doc_id"), seed), 1 / F.col("weight"))).drop("weight"))
    keyed = rows.withColumn("p1", F.least(F.floor(F.col("k") * PARTS), F.lit(PARTS - 1)))
    keyed = keyed.withColumn("p2", F.least(F.floor((F.col("k") * PARTS - F.col("p1")) * PARTS), F.lit(PARTS - 1)))
    targets = source_targets(rows.select("source", "size"), weights, share, most)
    targets = targets.withColumn("copies", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    targets = C.stored(targets.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")))

    def boundary(sums: DataFrame, bounds: DataFrame, part: str, name: str) -> DataFrame:
        """The interval of each source in which its words pass the budget, and the words before it."""
        upto = Window.partitionBy("source").orderBy(part)
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        held = sums.alias("s").join(bounds.alias("t"), F.expr("s.source <=> t.source")).where("s.upto > t.budget - t.before and s.upto - s.words <= t.budget - t.before")
        found = held.groupBy("s.source").agg(F.min(part).alias(name), F.min_by(F.col("upto") - F.col("words"), part).alias("more"))
        return bounds.alias("t").join(found.alias("f"), F.expr("t.source <=> f.source"), "left").select("t.*", f"f.{name}", F.coalesce("f.more", F.lit(0)).alias("more")).withColumn("before", F.col("before") + F.col("more")).drop("more")

    bounds = targets.withColumn("before", F.lit(0).cast("long"))
    bounds = C.stored(boundary(keyed.groupBy("source", "p1").agg(F.sum("size").alias("words")), bounds, "p1", "b1"))
    inside = keyed.alias("k").join(bounds.alias("b"), F.expr("k.source <=> b.source and k.p1 = b.b1"), "left_semi")
    bounds = C.stored(boundary(inside.groupBy("source", "p2").agg(F.sum("size").alias("words")), bounds, "p2", "b2"))

    all_ = keyed.alias("k").join(bounds.alias("b"), F.expr("k.source <=> b.source"), "left").select("k.*", "b.source_size", "b.target", "b.copies", "b.budget", "b.before", "b.b1", "b.b2")
    edge = F.coalesce((F.col("p1") == F.col("b1")) & (F.col("p2") == F.col("b2")), F.lit(False))
    # a source without a boundary takes everything that its budget covers
    whole = F.col("b1").isNull() & (F.col("budget") >= F.col("source_size")) | (F.col("p1") < F.col("b1")) | (F.col("p1") == F.col("b1")) & (F.col("b2").isNull() | (F.col("p2") < F.col("b2")))
    plain = all_.where(~edge).withColumn("part", F.when(whole, F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    taken = F.greatest(F.least("size", left), F.lit(0)) if cut else F.when(F.col("size") <= 2 * left, F.col("size")).otherwise(F.lit(0))
    at_edge = all_.where(edge).withColumn("part", taken)
    part = F.col("part").cast("long")
    out = plain.unionByName(at_edge).withColumn("taken", F.col("copies") * F.col("size") + part)
    more = ((F.col("size") > 0) & (part == F.col("size"))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), (F.col("copies") + more).cast("long").alias("n_copies"), F.when(more == 0, part).otherwise(F.lit(0)).cast("long").alias("rest_words"))


def quality_weights(labels: DataFrame, low: float = 0.5) -> DataFrame:
    """(doc_id, weight): 1 for documents of quality 1, `low` for quality 0; of repeated labels the best counts."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.max("quality") == 0, low).otherwise(1.0).alias("weight"))


def mixed(docs: DataFrame, quality=None, seed: int = 7, **options) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as the plan takes it whole (boundary documents are whole or absent).

    Whole epochs repeat every document of the source, also those without words (null and empty texts). Rows of equal id are told apart by their source and
    number of words, and are taken alike; null ids and sources are values. An empty table gives an empty mix.
    """
    copies, size = C.fresh(docs, "papyra_copies"), C.fresh(docs, "papyra_size")
    taken = plan(docs, quality, seed, cut=False, **options).groupBy("doc_id", "source", "size").agg(F.max("n_copies").alias(copies))
    sized = docs.withColumn(size, C.n_words(F.col("text")))
    match = sized.doc_id.eqNullSafe(taken.doc_id) & sized.source.eqNullSafe(taken.source) & (sized[size] == taken["size"])
    held = sized.join(taken.where(F.col(copies) > 0), match).select(*[sized[f"`{c}`"] for c in docs.columns], copies)
    return held.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)
