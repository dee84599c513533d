"""Changes as new snapshots: edits, deletes with their closure, copies with new ids, merges of repair records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.relational import remapped


def text_changes(rows: DataFrame, key: str, column: str, after: Column, protected: DataFrame | None = None) -> DataFrame:
    """(key, before, after) of the rows that a repair changes, protected keys left out."""
    changed = rows.select(key, F.col(column).alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
    return changed if protected is None else changed.join(protected.select(key), key, "left_anti")


def with_rows(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Base with new rows; keys that base has are refused."""
    if base.join(new.select(key), key, "left_semi").limit(1).count():
        raise ValueError("a new row's key is taken")
    return base.unionByName(new)


def cascade(roots: DataFrame, key: str, tables: list[tuple[str, DataFrame, str, str, str]]) -> dict[str, DataFrame]:
    """The closure of roots: per (name, table, its key, parent's name, foreign key) its rows whose parent row is in the closure; the parent "" is roots."""
    held = {"": roots.select(F.col(key).alias("papyra_k")).distinct()}
    out = {}
    for name, df, own, parent, foreign in tables:
        rows = df.join(held[parent].withColumnRenamed("papyra_k", foreign), foreign, "left_semi")
        out[name] = rows.select(*df.columns)
        held[name] = rows.select(F.col(own).alias("papyra_k")).distinct()
    return out


def without_closure(roots: DataFrame, key: str, tables: list[tuple[str, DataFrame, str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the closure of roots, children first as foreign keys ask for; an anti join each on its foreign key."""
    held = {"": roots.select(F.col(key).alias("papyra_k")).distinct()}
    out = {}
    for name, df, own, parent, foreign in tables:
        gone = held[parent].withColumnRenamed("papyra_k", foreign)
        out[name] = df.join(gone, foreign, "left_anti").select(*df.columns)
        held[name] = df.join(gone, foreign, "left_semi").select(F.col(own).alias("papyra_k")).distinct()
    return out


def copied(rows: DataFrame, key: str, start: int, foreign: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows under new dense ids from start, foreign keys mapped by (old_id, new_id) tables; and the mapping of their own ids."""
    own = remapped(rows, key, start)
    out = rows
    for column, mapping in {key: own, **(foreign or {})}.items():
        out = out.join(mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("papyra_new")), column, "left").withColumn(column, F.col("papyra_new")).drop("papyra_new")
    return out.select(*rows.columns), own


def move_issues(wanted: DataFrame, source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """(key, issue) of a planned move: not_found in the source, or exists in the target; no rows, no objection."""
    lost = wanted.join(source.select(key), key, "left_anti").select(key, F.lit("not_found").alias("issue"))
    return lost.unionByName(wanted.join(target.select(key), key, "left_semi").select(key, F.lit("exists").alias("issue")))


def ensured(dims: DataFrame, wanted: DataFrame, code: str, name: str) -> DataFrame:
    """Dims with the wanted codes that they lack, and with the wanted names of those that they have (a null name changes nothing)."""
    one = wanted.groupBy(code).agg(F.min(name).alias("papyra_name"))
    both = dims.join(one, code, "full")
    return both.select(code, F.coalesce("papyra_name", name).alias(name))


def cloned(rows: DataFrame, passage: str, text: str, blanks: list[str]) -> DataFrame:
    """Templates of rows: the passage is written before the text, and the named columns are null."""
    shared = F.trim(F.coalesce(F.col(passage), F.lit("")))
    out = rows.withColumn(text, F.when(shared != "", F.concat_ws("\n\n", shared, F.col(text))).otherwise(F.col(text)))
    for c in blanks:
        out = out.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    return out


def merged_repairs(records: DataFrame, key: str, fields: list[str], notes: str, order: str, later_wins: bool = False) -> DataFrame:
    """One record a key: fields filled from those that have them, distinct notes joined in order, and the names of fields in conflict.

    With later_wins the last non-null value counts; else the first one, and a field with two values is in conflict.
    """
    pick = (lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order)))) if later_wins else (lambda f: F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))))
    conflict = F.array_join(F.array_compact(F.array(*[F.when(F.count_distinct(F.col(f)) > 1, f) for f in fields])), ",") if not later_wins else F.lit("")
    said = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, notes))), lambda x: x[notes])), "; ")
    return records.groupBy(key).agg(*[pick(f).alias(f) for f in fields], said.alias(notes), conflict.alias("conflict"))


def attached(rows: DataFrame, sources: DataFrame, keys: list[str], source: str, tags: str, more: str) -> DataFrame:
    """Rows with their source's id by natural key, and its tags joined behind their own, each once in order."""
    found = sources.groupBy(*keys).agg(F.min(F.struct(source, more)).alias("papyra_s"))
    both = F.concat(F.split(F.coalesce(F.col(tags), F.lit("")), ", "), F.split(F.coalesce(F.col("papyra_s")[more], F.lit("")), ", "))
    return rows.join(found, keys, "left").withColumn(source, F.col("papyra_s")[source]).withColumn(tags, F.array_join(F.filter(F.array_distinct(both), lambda t: t != ""), ", ")).drop("papyra_s")


def answer_rows(answers: DataFrame, key: str, number: str, answer: str, each: int = 5) -> DataFrame:
    """Answer key lines of `each` numbers: (key, line, text). A line collects `each` rows at most."""
    lined = answers.withColumn("line", F.floor((F.col(number) - 1) / each).cast("long"))
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, answer))), lambda x: F.concat_ws(".", x[number].cast("string"), x[answer].cast("string"))), " ")
    return lined.groupBy(key, "line").agg(shown.alias("text"))


def split_by_rule(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a rule that gives null rejects. Every row is in just one of them."""
    ok = F.coalesce(good, F.lit(False))
    return rows.where(ok), rows.where(~ok)
