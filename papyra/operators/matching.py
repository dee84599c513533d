"""Joins with rules: fallbacks, ranges, best overlaps, prefixes, aliases, unique matches, spines and merges. All are equi-joins or carry a proven bound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_or_exists(rows: DataFrame, condition: Column, children: DataFrame, key: str, child_condition: Column) -> DataFrame:
    """Rows that meet the condition, or of whose children one meets the other one. Matching keys are pre-aggregated, as no semi join can stand under OR."""
    hits = children.where(child_condition).select(key).distinct().withColumn("papyra_hit", F.lit(True))
    return rows.join(hits, key, "left").where(condition | F.col("papyra_hit").isNotNull()).drop("papyra_hit")


def positional_answers(rows: DataFrame, answers: DataFrame, exact: list[str], loose: list[str], number: str, order: str, value: str) -> DataFrame:
    """The number-th value, in order, of the answers of the exact keys, else of the loose ones. The position is a join key, so no list of a hot key is collected."""

    def placed(keys: list[str], name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return answers.withColumn("papyra_n", n).select(*keys, "papyra_n", F.col(value).alias(name))

    has = answers.select(*exact).distinct().withColumn("papyra_has", F.lit(True))
    by_exact = placed(exact, "papyra_exact").withColumnRenamed("papyra_n", number)
    by_loose = placed(loose, "papyra_loose").withColumnRenamed("papyra_n", number)
    out = rows.join(has, exact, "left").join(by_exact, [*exact, number], "left").join(by_loose, [*loose, number], "left")
    return out.withColumn("answer", F.when(F.col("papyra_has"), F.col("papyra_exact")).otherwise(F.col("papyra_loose"))).drop("papyra_has", "papyra_exact", "papyra_loose")


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with each range (inclusive whole numbers) that holds their number. Ranges are written out as numbers, so it is an equi-join; question ranges are short."""
    spread = ranges.withColumn(number, F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"))))
    return rows.withColumn(number, F.col(number).cast("long")).join(spread, number)


def range_members(rows: DataFrame, key: str, number: str, low: str, high: str, ranges: DataFrame) -> DataFrame:
    """Per range whether the numbers of its key's rows that lie in it are just its whole numbers, each once at least.

    Both sides are dealt by key once, into a number of tasks that isn't reduced again, and all steps keep that deal. Numbers that occur are bits of a range's
    words of 64, so memory holds an entry a word, not one a number.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt, given = rows.select(key, F.col(number).cast("long").alias(number)).repartition(tasks, key), ranges.repartition(tasks, key)
    inside = dealt.join(given.select(key, low, high), key).where(F.col(number).between(F.col(low), F.col(high)))
    place = F.col(number) - F.col(low).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    words = inside.groupBy(key, low, high, F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.count("*").alias("rows"))
    held = words.groupBy(key, low, high).agg(F.sum(F.bit_count("bits").cast("long")).alias("held"), F.sum("rows").alias("rows"))
    out = given.join(held, [key, low, high], "left").na.fill(0, ["held", "rows"])
    return out.withColumn("complete", F.col("held") == F.col(high) - F.col(low) + 1).withColumn("repeats", F.col("rows") - F.col("held"))


def best_owner(boxes: DataFrame, owners: DataFrame, cell: float, least: float = 0.50) -> DataFrame:
    """Each box (id, x0, y0, x1, y1) with the owner that holds the largest share of it, `least` at least; the smaller owner among equals, none if two are equal in both.

    Boxes of one place are one, and so are owners, with their number: the different places meet in grid cells, and a place's candidates are reduced by
    two minima over structs, combined before the shuffle. So the work grows with the pairs of different places, not of boxes.
    """
    from papyra.operators.relational import overlapping

    corners = ["x0", "y0", "x1", "y1"]
    at = F.struct(*[F.col(c).alias(c) for c in corners])
    area = lambda s: (F.col(f"{s}.x1") - F.col(f"{s}.x0")) * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))
    owned = owners.where("id is not null").groupBy(*corners).agg(F.count("*").alias("same"), F.min("id").alias("owner"))
    places, holders = boxes.select(at.alias("id"), *corners).distinct(), owned.select(F.struct(*corners, "same", "owner").alias("id"), *corners)
    sized = overlapping(places, holders, cell).select("a_id", F.col("b_id.same").alias("same"), F.col("b_id.owner").alias("owner"), (F.col("area") / area("a_id")).alias("share"), area("b_id").alias("size"))
    eligible = sized.where(F.col("share") >= least)
    rank = F.struct((-F.col("share")).alias("minus"), F.col("size").alias("size"))
    best = eligible.groupBy("a_id", rank.alias("rank")).agg(F.sum("same").alias("ties"), F.min("owner").alias("owner")).groupBy("a_id").agg(F.min(F.struct("rank", "ties", "owner")).alias("best"))
    found = best.select(*[F.col(f"a_id.{c}").alias(c) for c in corners], F.when(F.col("best.ties") == 1, F.col("best.owner")).alias("owner"))
    return boxes.select("id", *corners).join(found, corners, "left").select("id", "owner")


def in_cells(points: DataFrame, xs: list[float], ys: list[float]) -> DataFrame:
    """Points (x, y) with the row and column of the grid cell that holds them; those outside go. Edges belong to the cell behind them."""
    place = lambda c, edges: F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(c))) - 1
    out = points.withColumn("col", place("x", xs)).withColumn("row", place("y", ys))
    return out.where(F.col("col").between(0, len(xs) - 2) & F.col("row").between(0, len(ys) - 2))


def first_prefix(rows: DataFrame, text: str, rules: DataFrame, prefix: str, order: str) -> DataFrame:
    """Rows with the first rule, in order, whose prefix their text begins with, null if there is none. Rows meet rules on prefixes of the lengths that occur; repeated rows stay."""
    sizes = F.array_distinct(F.collect_list(F.length(prefix)))
    lengths = rules.agg(sizes.alias("papyra_sizes"))
    own = rows.select(F.monotonically_increasing_id().alias("papyra_row"), F.struct(*rows.columns).alias("papyra_own"), F.col(text).alias("papyra_text"))
    cut = own.crossJoin(F.broadcast(lengths)).withColumn(prefix, F.explode_outer(F.transform("papyra_sizes", lambda n: F.substring("papyra_text", F.lit(1), n))))  # a single row
    rest = [c for c in rules.columns if c != prefix]
    hit = cut.join(rules, prefix, "left")
    rule = F.min(F.when(F.col(order).isNotNull(), F.struct(order, prefix, *[c for c in rest if c != order]))).alias("rule")
    return hit.groupBy("papyra_row").agg(F.first("papyra_own").alias("papyra_own"), rule).select("papyra_own.*", "rule")


def without_known(rows: DataFrame, known: DataFrame, key: str, aliases) -> DataFrame:
    """Rows none of whose alias keys is an alias key of a known row; `aliases` makes an array column of aliases."""
    taken = known.select(F.explode(aliases(known)).alias("papyra_alias")).distinct()
    hits = rows.select(key, F.explode(aliases(rows)).alias("papyra_alias")).join(taken, "papyra_alias", "left_semi").select(key).distinct()
    return rows.join(hits, key, "left_anti")


def positional_diff(a: DataFrame, b: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Per group how many places of two ordered lists differ (a missing place differs from a null too), and how many there are."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    left = a.select(group, n.alias("place"), F.struct(F.col(value).alias("v")).alias("left"))
    right = b.select(group, n.alias("place"), F.struct(F.col(value).alias("v")).alias("right"))
    both = left.join(right, [group, "place"], "full")
    return both.groupBy(group).agg(F.count_if(~F.col("left").eqNullSafe(F.col("right"))).alias("differ"), F.count("*").alias("places"))


def replaced_if_valid(base: DataFrame, candidates: DataFrame, key: str, value: str, valid: Column) -> DataFrame:
    """Base with the candidate's value where there is a valid one (valid: a condition on column candidate)."""
    joined = base.join(candidates.select(key, F.col(value).alias("candidate")), key, "left")
    good = F.coalesce(valid, F.lit(False))
    return joined.withColumn("replaced", good).withColumn(value, F.when(good, F.col("candidate")).otherwise(F.col(value))).drop("candidate")


def match_states(wanted: DataFrame, rows: DataFrame, keys: list[str], allow_unmatched: bool = False) -> DataFrame:
    """Wanted with the number of rows that match and a state: ok for just one, ambiguous, or missing (unmatched where that is allowed)."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("matches"))
    out = wanted.join(counts, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.withColumn("state", F.when(F.col("matches") == 1, "ok").when(F.col("matches") > 1, "ambiguous").otherwise("unmatched" if allow_unmatched else "missing"))


def matched_once(wanted: DataFrame, rows: DataFrame, keys: list[str], allow_unmatched: bool = False) -> DataFrame:
    """The inner join, refused with an error if a wanted row has not just one match (or none, where that is allowed)."""
    states = match_states(wanted, rows, keys, allow_unmatched)
    bad = states.where(~F.col("state").isin("ok", "unmatched")).select(*keys, "state").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].state} match: {bad[0].asDict()}")
    return wanted.join(rows, keys)


def two_tier(rows: DataFrame, dims: DataFrame, first: list[str], second: list[str], value: str) -> DataFrame:
    """The value by the first keys, else by the second ones; a tier counts only where it is unique."""

    def tier(keys: list[str], name: str) -> DataFrame:
        return dims.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("papyra_most")).where(F.col(name) == F.col("papyra_most")).drop("papyra_most")

    out = rows.join(tier(first, "papyra_1"), first, "left").join(tier(second, "papyra_2"), second, "left")
    return out.withColumn(value, F.coalesce("papyra_1", "papyra_2")).drop("papyra_1", "papyra_2")


def nearest_label(rows: DataFrame, labels: DataFrame, partition: str, at: str, label: str, tolerance: float | None = None) -> DataFrame:
    """Each row with the label nearest along `at` in its partition, the earlier one among equals, null beyond the tolerance.

    Labels and rows are sorted together, so a row sees the last label before and the first behind it: no pairs are made.
    """
    both = rows.withColumn("papyra_label", F.lit(None).cast("struct<at:double,label:string>")).unionByName(
        labels.select(partition, F.col(at).cast("double").alias(at), F.struct(F.col(at).cast("double").alias("at"), F.col(label).cast("string").alias("label")).alias("papyra_label")), allowMissingColumns=True
    )
    w = Window.partitionBy(partition).orderBy(at)
    # all labels at the same place count as before and behind
    before = F.last("papyra_label", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("papyra_label", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col(at) - before["at"] <= after["at"] - F.col(at), before).otherwise(after)
    out = both.withColumn("papyra_near", near).where("papyra_label is null")
    found = out["papyra_near"]["label"] if tolerance is None else F.when(F.abs(out["papyra_near"]["at"] - F.col(at)) <= tolerance, out["papyra_near"]["label"])
    return out.withColumn("nearest", found).drop("papyra_label", "papyra_near")


def preferred(rows: DataFrame, candidates: DataFrame, bucket: str, priority: str, name: str) -> DataFrame:
    """Each row with its bucket's candidate of the least (priority, name)."""
    best = candidates.groupBy(bucket).agg(F.min(F.struct(priority, name)).alias("papyra_best"))
    return rows.join(best.select(bucket, F.col(f"papyra_best.{name}").alias(name)), bucket, "left")


def provenance_states(inventory: DataFrame, provenance: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Inventory rows with a state against their provenance: missing, ambiguous, or different and in which fields, else equal."""
    per = provenance.groupBy(key).agg(F.count("*").alias("papyra_n"), *[F.min(f).alias(f"papyra_{f}") for f in fields])
    out = inventory.join(per, key, "left")
    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"papyra_{f}")), f) for f in fields])), ",")
    state = F.when(F.col("papyra_n").isNull(), "missing").when(F.col("papyra_n") > 1, "ambiguous").when(differ != "", F.concat(F.lit("different:"), differ)).otherwise("equal")
    return out.select(key, state.alias("state"))


def merged_choices(old: DataFrame, new: DataFrame, keys: list[str], text: str, payload: str) -> DataFrame:
    """New choices, with the old text and payload where the new ones are blank and the old ones are not; old choices with a payload stay."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    a = old.select(*keys, F.col(text).alias("papyra_t"), F.col(payload).alias("papyra_p"), F.lit(True).alias("papyra_old"))
    both = new.select(*keys, text, payload, F.lit(True).alias("papyra_new")).join(a, keys, "full")
    held = F.coalesce(F.col("papyra_old"), F.lit(False)) & ~(blank("papyra_t") & blank("papyra_p"))
    keep_old = held & (F.col("papyra_new").isNull() | blank(text) & blank(payload))
    out = both.where(F.col("papyra_new").isNotNull() | held)
    return out.select(*keys, F.when(keep_old, F.coalesce("papyra_t", F.lit(""))).otherwise(F.col(text)).alias(text), F.when(keep_old, F.col("papyra_p")).otherwise(F.col(payload)).alias(payload), F.coalesce(keep_old, F.lit(False)).alias("kept_old"))


def spine(sets: DataFrame, rows: DataFrame, key: str, number: str, last: int, value: str, placeholder: str) -> DataFrame:
    """Numbers 1 .. last of each set, with the first row's value or the placeholder; numbers beyond go."""
    numbers = sets.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(last))).alias(number)).withColumn(number, F.col(number).cast("long"))
    first = rows.groupBy(key, F.col(number).cast("long").alias(number)).agg(F.min(value).alias(value))
    out = numbers.join(first, [key, number], "left")
    return out.withColumn("placeholder", F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(placeholder)))


def associations(required: DataFrame, inventory: DataFrame, key: str, digest: str) -> DataFrame:
    """(finding, n): required files that the inventory lacks, files that nothing requires, and digests of a wrong length."""
    lone = lambda a, b, code: a.select(key).distinct().join(b.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("finding"), "n")
    bad = inventory.agg(F.count_if(F.length(F.coalesce(F.col(digest), F.lit(""))) != 64).alias("n")).select(F.lit("bad_digest").alias("finding"), "n")
    return lone(required, inventory, "missing").unionByName(lone(inventory, required, "unexpected")).unionByName(bad)
