"""Registered queries of rich-text payloads, which are made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import payloads as P
from papyra.plans.registry import query


def _region_payloads(region, nation):
    """A payload a region: the nations' names and keys as rows, the region's name as a cell."""
    rows = nation.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], F.when(x["n_nationkey"] % 5 != 0, x["n_nationkey"].cast("string")).otherwise(F.lit("")))).alias("rows"))
    cell = F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("r_name").alias("text"))
    made = F.to_json(F.struct(F.array(F.struct("rows", F.array(cell).alias("cells"))).alias("tables")))
    return region.join(rows, F.expr("r_regionkey = n_regionkey")).select("r_regionkey", "r_name", F.when(F.col("r_regionkey") == 2, "{broken").otherwise(made).alias("payload"))


@query("""
WITH x AS (SELECT n_regionkey AS k, n_nationkey * 10 AS o, n_name AS t FROM nation UNION ALL SELECT n_regionkey, n_nationkey * 10 + 1, CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT r_regionkey, 9999, r_name FROM region)
SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN '' ELSE (SELECT string_agg(t, chr(10) ORDER BY o) FROM x WHERE k = r_regionkey) END AS shown FROM region""")
def json_display(region, nation):
    return _region_payloads(region, nation).select("r_regionkey", P.display(F.col("payload")).alias("shown"))


@query("""
SELECT n_regionkey AS r_regionkey, 'p.tables[0].rows[' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '][' || c || ']' AS path, CASE c WHEN 0 THEN n_name ELSE CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END END AS text,
  CASE WHEN c = 1 AND n_nationkey % 5 = 0 THEN 'empty_table_cell' END AS code FROM nation CROSS JOIN (VALUES (0)) v(c) WHERE n_regionkey <> 2
UNION ALL SELECT n_regionkey, 'p.tables[0].rows[' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '][1]', CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END, CASE WHEN n_nationkey % 5 = 0 THEN 'empty_table_cell' END FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT r_regionkey, 'p.tables[0].cells[0].text', r_name, 'rows_cells_divergence' FROM region WHERE r_regionkey <> 2 UNION ALL SELECT r_regionkey, 'p', '{broken', 'invalid_format_json' FROM region WHERE r_regionkey = 2""")
def payload_surfaces(region, nation):
    return _region_payloads(region, nation).select("r_regionkey", F.explode(P.surfaces(F.col("payload"), "p")).alias("s")).select("r_regionkey", "s.path", "s.text", "s.code")


def _tables(part):
    """A table a part, with a mode, a score, flags, widths and an anchor of the part's numbers."""
    p, size = F.col("p_partkey"), F.col("p_size")
    payload = F.concat(
        F.lit('{"rows":[["a","b"],["c","d"]],"cells":[{"row":'), (size % 4).cast("string"), F.lit(',"col":0,"text":"x"}],"render_mode":"'), F.when(p % 5 == 0, "native").when(p % 7 == 0, "odd").otherwise("auto"), F.lit('","confidence":{"score":'), (size / 50).cast("string"),
        F.lit('},"complexity":{"has_formula":'), F.when(p % 3 == 0, "true").otherwise("false"), F.lit('},"column_widths":['), F.when(p % 2 == 0, F.concat(size.cast("string"), F.lit(",10"))).otherwise(F.lit("5")), F.lit('],"source":{"bbox":[0,0,'), size.cast("string"), F.lit(",20]}}"),
    )
    return part.select("p_partkey", "p_size", F.from_json(payload, P.TABLE).alias("t"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'native' WHEN p_partkey % 4 = 1 THEN 'image' WHEN p_size / 50 >= 0.9 AND p_partkey % 3 <> 0 THEN 'native' ELSE 'image' END AS mode,
  CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'auto' END AS width_mode, CASE WHEN p_partkey % 2 = 0 THEN round(p_size / (p_size + 10), 9) END AS first_width FROM part""")
def render_modes(part):
    document = F.when(F.expr("p_partkey % 4 = 1"), "image").otherwise("auto")
    t = F.col("t")
    return _tables(part).select("p_partkey", P.render_mode(t, document).alias("mode"), P.width_mode(t).alias("width_mode"), F.round(F.get(P.widths(t), F.lit(0)), 9).alias("first_width"))


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 30 OR p_size = 0 THEN 'bbox_out_of_page' END, CASE WHEN p_size % 4 + 1 > 2 THEN 'cell_out_of_bounds' END) AS codes FROM part""")
def table_codes(part):
    return _tables(part).select("p_partkey", F.array_join(P.table_codes(F.col("t"), F.lit("text"), 30, 40), ",").alias("codes"))


@query("SELECT p_partkey, 'table-1' AS id, CASE WHEN p_partkey % 5 = 0 THEN 'native' ELSE 'auto' END AS render_mode, round(least(1.0, p_size / 50), 9) AS score, 'left' AS alignment, CAST(1 AS BIGINT) AS row_span FROM part")
def normalized_tables(part):
    made = _tables(part).select("p_partkey", P.normalized(F.col("t"), F.lit(0)).alias("n"))
    cell = F.get(F.col("n.cells"), F.lit(0))
    return made.select("p_partkey", "n.id", "n.render_mode", F.round("n.score", 9).alias("score"), cell["horizontal_alignment"].alias("alignment"), cell["row_span"].cast("long").alias("row_span"))


@query("""
WITH d AS (SELECT doc_id, text, CAST(least(3 + doc_id % 40, length(text)) AS INT) AS o FROM documents), b AS (SELECT *, text[greatest(o - 2, 1):o] AS b FROM d)
SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN o WHEN b <> '' AND strpos(text, b) > 0 THEN strpos(text, b) - 1 + length(b) ELSE length(text) END AS BIGINT) AS place, doc_id % 2 <> 0 AS moved FROM b""")
def table_anchors(documents):
    d = documents.withColumn("o", F.expr("cast(least(3 + doc_id % 40, length(text)) as int)"))
    offset = F.when(F.expr("doc_id % 2 = 0"), F.col("o")).otherwise(F.lit(-1))
    first = F.greatest(F.col("o") - 2, F.lit(1))
    at = F.struct(offset.alias("offset"), F.substring("text", first, F.col("o") - first + 1).alias("before_context"), F.lit("").alias("after_context"))
    return d.select("doc_id", P.anchor(F.col("text"), at).alias("a")).select("doc_id", F.col("a.place").cast("long").alias("place"), "a.moved")


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{"spans":[{"start":0,"end":3}]}' WHEN 2 THEN NULL ELSE NULL END AS payload, event_id % 3 <> 1 AS fits FROM events""")
def payload_rows(events):
    k = F.col("event_id") % 4
    payload = F.when(k == 1, '{"spans":[{"start":0,"end":3}]}').when(k == 2, "[1]").when(k == 3, '{"schema_version":2}')
    spans = F.array(F.struct(F.lit(0).alias("start"), F.when(F.col("event_id") % 3 == 1, 99).otherwise(3).alias("end")))
    return events.select("event_id", P.serialized(payload).alias("payload"), P.spans_fit(spans, F.lit("text")).alias("fits"))
