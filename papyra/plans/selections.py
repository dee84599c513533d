"""Registered queries of selection: units, deduplication of groups, exclusion, exact-count samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import selection as S
from papyra.plans.registry import query


def _turns(conversations):
    """Turns as questions: a conversation of more than two turns is a group, the others are singles."""
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = conversations.join(sizes, "conv_id")
    group = F.when(F.col("n") > 2, F.col("conv_id"))
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), group.alias("group_id"), F.col("turn").cast("int").alias("group_order"), F.col("turn").cast("int").alias("number"), "text",
        F.lit(None).cast("array<string>").alias("choices"), F.lit(None).cast("string").alias("shared"),
    )


def _items(benchmark):
    i = F.col("item_id")
    none = F.lit(None)
    return benchmark.select(i.alias("id"), i.alias("idx"), none.cast("long").alias("group_id"), none.cast("int").alias("group_order"), i.cast("int").alias("number"), "text", none.cast("array<string>").alias("choices"), none.cast("string").alias("shared"))


@query("""
WITH s AS (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), u AS (SELECT CASE WHEN n > 2 THEN 'g:' || conv_id ELSE 'q:' || (conv_id * 1000 + turn) END AS unit, conv_id * 1000 + turn AS id FROM s)
SELECT unit, count(*) AS count, min(id) AS first_index, string_agg(id, ',' ORDER BY id) AS ids FROM u GROUP BY unit""")
def selection_units(conversations):
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return S.units(_turns(conversations)).select("unit", "count", "first_index", ids.alias("ids"))


@query(None)
def group_dedupe(conversations):
    return S.first_wins(S.units(_turns(conversations))).select("unit", "count", "first_index")


@query(None)
def fuzzy_dedupe(benchmark):
    return S.first_wins(S.units(_items(benchmark))).select(F.get("ids", F.lit(0)).alias("item_id"))


@query(None)
def fuzzy_exclusion(benchmark):
    # the selection whose contents the pool excludes: every seventh item, a parameter of the feature
    items = _items(benchmark)
    return S.excluded(S.units(items.where("id % 7 <> 0")), S.units(items.where("id % 7 = 0"))).select(F.get("ids", F.lit(0)).alias("item_id"))


@query("SELECT count(*) AS available FROM conversations")
def available_count(conversations):
    return S.available(S.units(_turns(conversations)))


@query("""
WITH d AS (SELECT doc_id, md5('q:' || doc_id || ':11') AS rank FROM documents) SELECT doc_id FROM d ORDER BY rank, 'q:' || doc_id LIMIT 30""")
def exact_count_units(documents):
    d = F.col("doc_id")
    found = documents.select(F.concat(F.lit("q:"), d.cast("string")).alias("unit"), F.lit(1).cast("long").alias("count"), d.alias("first_index"), d.alias("doc_id"))
    return S.exact_count(found, 30, 11).select("doc_id")


@query(None)
def exact_count_groups(conversations):
    return S.exact_count(S.units(_turns(conversations)), 25, 42).select("unit", "count", "first_index")


@query(None)
def mock_exam(conversations):
    turns = _turns(conversations)
    subjects = {k: turns.where(F.col("id") % 3 == i) for i, k in enumerate(("first", "second", "third"))}
    return S.mock_exam(subjects, ["first", "second"], 10, 42, F.length("text") > 0)


@query("""
WITH c AS (SELECT p_partkey, unnest([p_name, p_brand, p_type]) AS c, generate_subscripts([p_name, p_brand, p_type], 1) - 1 AS i FROM part)
SELECT p_partkey, string_agg(c, '|' ORDER BY md5(p_partkey || ':' || c || ':' || i || ':5')) AS choices FROM c GROUP BY p_partkey""")
def shuffled_choices(part):
    rows = part.select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("choices"))
    return S.shuffled_choices(rows, "p_partkey", "choices", 5).select("p_partkey", F.array_join("choices", "|").alias("choices"))


@query("""
WITH s AS (SELECT doc_id AS source_id, source AS provider, doc_id % 50 AS url, lang AS hash FROM documents WHERE doc_id % 2 = 0), a AS (SELECT provider, url, hash, min(source_id) AS id FROM s GROUP BY ALL), b AS (SELECT url, hash, min(source_id) AS id FROM s GROUP BY ALL),
c AS (SELECT doc_id, source AS provider, doc_id % 61 AS url, lang AS hash FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, coalesce(a.id, b.id) AS source_id FROM c LEFT JOIN a ON a.provider = c.provider AND a.url = c.url AND a.hash = c.hash LEFT JOIN b ON b.url = c.url AND b.hash = c.hash""")
def known_sources(documents):
    made = lambda m: documents.select("doc_id", F.col("source").alias("provider"), (F.col("doc_id") % m).alias("url"), F.col("lang").alias("hash"))
    sources = made(50).where("doc_id % 2 = 0").withColumnRenamed("doc_id", "source_id")
    return S.known_sources(made(61).where("doc_id % 2 = 1"), sources).select("doc_id", "source_id")
