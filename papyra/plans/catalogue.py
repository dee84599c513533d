"""The registered queries of the library's own operators on the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import ordered, quality, relational
from papyra.plans.registry import FOUND, query
from papyra.sources import tables as S

def _seconds(ts) -> F.Column:
    """Whole seconds of a timestamp without zone."""
    return F.unix_timestamp(ts.cast("timestamp_ltz"))


@query("""
SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND year(o_orderdate) BETWEEN 1994 AND 1996 AND o_orderstatus = 'F'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def search_star(orders, customer, nation, region):
    star = orders.where("o_orderdate >= timestamp_ntz '1994-01-01' and o_orderdate < timestamp_ntz '1997-01-01' and o_orderstatus = 'F'").join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey")).join(region.where("r_name = 'EUROPE'"), F.expr("n_regionkey = r_regionkey"))
    return star.select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""
SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE (strpos(lower(p_name), 'a') > 0 OR strpos(lower(p_brand), 'a') > 0 OR strpos(lower(p_type), 'a') > 0)
  AND (strpos(lower(p_name), 'brand#1') > 0 OR strpos(lower(p_brand), 'brand#1') > 0 OR strpos(lower(p_type), 'brand#1') > 0)""")
def search_text_multi(lineitem, part):
    surfaces = [F.col("p_name"), F.col("p_brand"), F.col("p_type")]
    return lineitem.join(part.where(X.search(surfaces, ["a", "brand#1"])), F.expr("l_partkey = p_partkey")).select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') OR source IN ('de', 'fr')")
def tag_match(documents):
    return documents.where(X.tagged(F.concat_ws(", ", "lang", "source"), "de fr")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE strpos(lower(text), '%%%') > 0 OR strpos(lower(text), '_') > 0")
def like_literal(documents):
    return documents.where(X.contains_literal(F.col("text"), "%%%") | X.contains_literal(F.col("text"), "_")).select("doc_id")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority FROM orders")
def filter_options(orders):
    return orders.select(F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority").distinct()


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def subject_options(customer, nation):
    return customer.groupBy("c_nationkey").agg(F.count("*").alias("n")).join(nation, F.expr("c_nationkey = n_nationkey")).groupBy("n_name").agg(F.sum("n").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY c_name, c_custkey LIMIT 1")
def first_with_rows(customer, orders):
    return customer.join(orders, F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(1)


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def stats_by_year(orders):
    return orders.groupBy(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""
SELECT 'benchmark' AS mount_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM benchmark
UNION ALL SELECT 'documents', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS BIGINT) FROM pages""")
def stats_mounts(benchmark, documents, pages):
    return S.federated(_mounts(benchmark, documents, pages), "key").groupBy("mount_id").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))


def _mounts(benchmark, documents, pages):
    return {"benchmark": benchmark.select(F.col("item_id").alias("key"), F.length("text").cast("long").alias("size")), "documents": documents.select(F.col("doc_id").alias("key"), F.length("text").cast("long").alias("size")), "pages": pages.select(F.col("page_id").alias("key"), F.length("html").cast("long").alias("size"))}


@query("""
SELECT mount_id || '::' || key AS id, mount_id, CAST(key AS VARCHAR) AS local_id, CAST(size AS BIGINT) AS size FROM (
  SELECT 'benchmark' AS mount_id, item_id AS key, length(text) AS size FROM benchmark UNION ALL SELECT 'documents', doc_id, length(text) FROM documents UNION ALL SELECT 'pages', page_id, length(html) FROM pages)
ORDER BY size DESC, mount_id, key LIMIT 50""")
def federated_topk(benchmark, documents, pages):
    return S.federated(_mounts(benchmark, documents, pages), "key").orderBy(F.desc("size"), "mount_id", "key").limit(50).select("id", "mount_id", "local_id", "size")


@query("""
SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS children
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_children(orders, lineitem):
    packed = relational.nested(orders.select(F.col("o_orderkey").alias("l_orderkey")), lineitem, "l_orderkey", ["l_linenumber", "l_partkey"], [])
    shown = F.transform("children", lambda c: F.concat_ws(":", c["l_linenumber"].cast("string"), c["l_partkey"].cast("string")))
    return packed.select(F.col("l_orderkey").alias("o_orderkey"), F.size("children").cast("long").alias("n"), F.array_join(shown, ",").alias("children"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(customer, orders):
    return customer.join(orders.where("o_totalprice > 200000"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_unreferenced(part, lineitem):
    return part.join(lineitem.where("l_quantity > 45"), F.expr("l_partkey = p_partkey"), "left_anti").select("p_partkey")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def anti_fill_default(documents, labels):
    missing = documents.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("quality"))
    return missing.union(documents.select("doc_id").join(labels.select("doc_id", "quality"), "doc_id"))


@query("""
SELECT p_partkey, round(coalesce(e.price, d.price), 4) AS price FROM part
LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_quantity > 48 GROUP BY 1) e ON e.l_partkey = p_partkey
LEFT JOIN (SELECT p_brand, max(p_retailprice) AS price FROM part GROUP BY 1) d USING (p_brand)""")
def fallback_lookup(part, lineitem):
    exact = lineitem.where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("price"))
    default = part.groupBy("p_brand").agg(F.max("p_retailprice").alias("price"))
    return relational.fallback(part, exact, default, "p_partkey", "p_brand", "price").select("p_partkey", F.round("price", 4).alias("price"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'middle' ELSE 'large' END AS band FROM part WHERE p_size BETWEEN 1 AND 45")
def range_band_join(part):
    return relational.banded(part, F.col("p_size"), [(1, 10, "small"), (11, 30, "middle"), (31, 45, "large")]).select("p_partkey", "band")


@query("""
WITH a AS (SELECT p_partkey AS id, p_partkey % 97 AS x0, p_size AS y0, p_partkey % 97 + 3 AS x1, p_size + 2 AS y1 FROM part),
b AS (SELECT s_suppkey AS id, s_suppkey % 89 AS x0, s_suppkey % 43 AS y0, s_suppkey % 89 + 4 AS x1, s_suppkey % 43 + 5 AS y1 FROM supplier)
SELECT a.id AS a_id, b.id AS b_id, CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE) AS area
FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def rect_overlap_join(part, supplier):
    box = lambda df, i, x, y, w, h: df.select(F.col(i).alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    a = box(part, "p_partkey", F.col("p_partkey") % 97, F.col("p_size"), 3, 2)
    b = box(supplier, "s_suppkey", F.col("s_suppkey") % 89, F.col("s_suppkey") % 43, 4, 5)
    return relational.overlap_pairs(a, b, 8)


@query("""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_totalprice AS old_value, b.price AS new_value,
  CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_totalprice IS DISTINCT FROM b.price THEN 'changed' ELSE 'same' END AS state
FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 4 <> 0) b ON a.o_orderkey = b.o_orderkey""")
def full_outer_diff(orders):
    new = orders.where("o_orderkey % 4 <> 0").withColumn("o_totalprice", F.when(F.expr("o_orderkey % 5 = 0"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return relational.compared(orders.where("o_orderkey % 3 <> 0"), new, "o_orderkey", "o_totalprice")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events""")
def asof_prev_event(events):
    return ordered.previous(events, "user_id", ["ts", "event_id"], "value", F.col("event_type") == "purchase").select("event_id", "previous")


@query("""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
w AS (SELECT event_id, s, last_value(CASE WHEN event_type = 'click' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN event_type = 'click' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, least(s - b, a - s) AS distance FROM w""")
def nearest_event(events):
    timed = events.withColumn("s", _seconds(F.col("ts")))
    return ordered.nearest(timed, "user_id", ["s", "event_id"], "s", F.col("event_type") == "click").select("event_id", "distance")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(lineitem):
    return lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete,
  CAST(max(l_linenumber) - count(DISTINCT l_linenumber) AS BIGINT) AS missing FROM lineitem GROUP BY l_orderkey""")
def structure_check(lineitem):
    return quality.contiguous(lineitem, "l_orderkey", "l_linenumber")


@query("""
SELECT conv_id, count(*) AS n, min(turn) = 1 AND max(turn) = count(*) AND count(DISTINCT turn) = count(*) AS complete,
  CAST(max(turn) - count(DISTINCT turn) AS BIGINT) AS missing FROM conversations GROUP BY conv_id""")
def completeness(conversations):
    return quality.contiguous(conversations, "conv_id", "turn")


@query("SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS correct, round(sum(quality) * 100.0 / count(*), 1) AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def grading_by_subject(documents, labels):
    graded = documents.select("doc_id", "lang").join(labels, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("correct"))
    return graded.withColumn("score", F.round(F.col("correct") * 100.0 / F.col("n"), 1))


@query("SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) WHERE turn <= 3")
def round_robin_sample(documents):
    return ordered.round_robin(documents.select("doc_id", "source"), "source", ["doc_id"], 3)


@query("SELECT doc_id, source, place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents) WHERE place % 10 = 0")
def systematic_sample(documents):
    return ordered.systematic(documents.select("doc_id", "source"), "source", ["doc_id"], 10)


@query(r"""
WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
s AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / (greatest(10, ceil(n * 0.05)) - 1), 0) AS BIGINT) AS i FROM (SELECT max(n) AS n FROM n), unnest(generate_series(0, CAST(greatest(10, ceil(n * 0.05)) AS BIGINT) - 1)) t(k)),
p AS (SELECT item_id AS doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS page FROM benchmark),
w AS (SELECT n.doc_id, n.lang, coalesce(CASE WHEN n.doc_id % 2 = 0 THEN n.text ELSE page END, '') AS page, list_filter(regexp_split_to_array(n.text[1:200], '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 4)[1:8] AS words FROM n JOIN s USING (i) LEFT JOIN p USING (doc_id))
SELECT count(*) AS checked, count(*) FILTER (page <> '') AS page_hits,
  count(*) FILTER (page <> '' AND len(words) > 0 AND len(list_filter(words, lambda x: contains(trim(regexp_replace(page, '\s+', ' ', 'g')), x))) >= least(3, len(words)) OR lang = 'es') AS evidence_hits FROM w""")
def spot_check_counts(documents, benchmark):
    pages = documents.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("page")).union(benchmark.where("item_id % 2 = 1").select("item_id", "text"))
    sample = ordered.evenly_spaced(documents.select("doc_id", "lang", F.substring("text", 1, 200).alias("excerpt")), ["doc_id"])
    return ordered.spot_checked(sample, pages, ["doc_id"], "page", "excerpt", F.col("lang") == "es")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE trim(event_type) <> '' GROUP BY user_id")
def latest_nonblank(events):
    return ordered.latest(events, "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def best_confidence(events):
    return ordered.first_by(events, ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "value")


@query("SELECT conv_id, turn, role, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS shown FROM conversations")
def print_once(conversations):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", (~F.col("role").eqNullSafe(F.lag("role").over(w))).alias("shown"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, n_chars DESC, doc_id) AS display_order FROM documents")
def display_order(documents):
    return documents.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("lang", F.desc("n_chars"), "doc_id")).cast("long").alias("display_order"))


@query("""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), m AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 86400 THEN 1 ELSE 0 END AS g FROM e)
SELECT event_id, CAST(sum(g) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS session FROM m""")
def gap_sessionize(events):
    return ordered.sessions(events.withColumn("s", _seconds(F.col("ts"))), "user_id", ["s", "event_id"], "s", 86400).select("event_id", "session")


@query("""
WITH m AS (SELECT *, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) > 5 THEN 1 ELSE 0 END AS g FROM part)
SELECT p_partkey, CAST(sum(g) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS session FROM m""")
def gap_cluster(part):
    return ordered.sessions(part, "p_brand", ["p_retailprice", "p_partkey"], "p_retailprice", 5).select("p_partkey", "session")


@query("""
WITH i AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 3600 * (1 + event_id % 24) AS b FROM events),
m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i),
g AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS run FROM m)
SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, run""")
def interval_merge(events):
    spans = events.select("user_id", _seconds(F.col("ts")).alias("a"), (_seconds(F.col("ts")) + 3600 * (1 + F.col("event_id") % 24)).alias("b"))
    return ordered.merged(spans, "user_id", "a", "b")


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def segment_lead(events):
    return events.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event"))


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM conversations")
def event_split(conversations):
    return ordered.segments(conversations, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "segment")


@query("""
WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN strpos(text, '!!') > 0 THEN 'shouting' END], lambda x: x IS NOT NULL)) AS code FROM documents)
SELECT code, count(*) AS n FROM f GROUP BY code""")
def error_explode(documents):
    rules = [("short", "error", F.length("text") < 200), ("foreign", "warning", F.col("lang") != "en"), ("shouting", "warning", F.instr("text", "!!") > 0)]
    return quality.findings(documents, "doc_id", rules).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY source")
def inventory_pivot(documents):
    return documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT CASE WHEN strpos(event_type, 'purchase') > 0 THEN 'sale' WHEN strpos(event_type, 'click') > 0 THEN 'use' ELSE 'other' END AS domain, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def domain_rollup(events):
    return events.groupBy(X.ladder(F.col("event_type"), [("purchase", "sale"), ("click", "use")], "other").alias("domain")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT doc_id, md5(doc_id || ':42') AS rank FROM documents ORDER BY rank LIMIT 25")
def exact_count_sample(documents):
    return ordered.exact_sample(documents.select("doc_id"), F.col("doc_id"), 25, 42)


@query("""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages)
SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS scheme, regexp_extract(u, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(u, '^[a-z]+://[^/]+(/.*)?$', 1) AS path,
  string_split(regexp_extract(u, '^[a-z]+://[^/]+(/.*)?$', 1), '/')[-1] AS base FROM p""")
def url_parts(pages):
    return S.url_parts(pages)


def _rules():
    text = F.col("text")
    return [
        ("empty_text", "error", F.trim(F.coalesce(text, F.lit(""))) == ""),
        ("short_text", "warning", F.length(text) < 200),
        ("unbalanced_delimiter", "warning", F.length(F.replace(text, F.lit("("), F.lit(""))) != F.length(F.replace(text, F.lit(")"), F.lit("")))),
        ("noise_text", "error", text.rlike(r"%%%|\$\$\$|!!")),
        ("length_mismatch", "error", F.length(text) != F.col("n_chars")),
    ]


_FINDINGS = r"""
f AS (SELECT doc_id, 'empty_text' AS code, 'error' AS severity FROM documents WHERE trim(coalesce(text, '')) = ''
  UNION ALL SELECT doc_id, 'short_text', 'warning' FROM documents WHERE length(text) < 200
  UNION ALL SELECT doc_id, 'unbalanced_delimiter', 'warning' FROM documents WHERE length(replace(text, '(', '')) <> length(replace(text, ')', ''))
  UNION ALL SELECT doc_id, 'noise_text', 'error' FROM documents WHERE regexp_matches(text, '%%%|\$\$\$|!!')
  UNION ALL SELECT doc_id, 'length_mismatch', 'error' FROM documents WHERE length(text) <> n_chars)"""


@query(f"WITH {_FINDINGS} SELECT * FROM f")
def quality_findings(documents):
    return quality.findings(documents, "doc_id", _rules())


@query(f"WITH {_FINDINGS} SELECT doc_id, count(*) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity FROM f GROUP BY doc_id")
def severity_rollup(documents):
    return quality.rolled_up(quality.findings(documents, "doc_id", _rules()), "doc_id")


@query("SELECT page_id, CASE WHEN regexp_matches(url, 'casino|bets') THEN 'gambling' WHEN regexp_matches(url, 'pills') THEN 'drugs' WHEN regexp_matches(url, '/en/') THEN 'english' ELSE 'other' END AS label FROM pages")
def classify_ladder(pages):
    return pages.select("page_id", X.ladder(F.col("url"), [("casino|bets", "gambling"), ("pills", "drugs"), ("/en/", "english")], "other").alias("label"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def hash_inventory(documents):
    return documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


@query("""
SELECT c_custkey, c_acctbal, 'kept' AS origin FROM customer WHERE c_custkey % 10 <> 0 UNION ALL
SELECT c_custkey, round(c_acctbal + 1, 2), 'updated' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 1000000000, round(c_acctbal + 1, 2), 'inserted' FROM customer WHERE c_custkey % 10 = 0""")
def upsert_merge(customer):
    base = customer.select("c_custkey", "c_acctbal")
    more = base.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    return relational.upserted(base, more.union(more.withColumn("c_custkey", F.col("c_custkey") + 1000000000)), "c_custkey")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN (SELECT min(c_mktsegment) FROM customer)")
def domain_split(orders, customer):
    first = customer.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    owners = customer.join(F.broadcast(first), "c_mktsegment", "left_semi")  # a single row
    return orders.join(owners, F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_mktsegment")


@query("SELECT o_orderkey AS old_id, CAST(row_number() OVER (ORDER BY o_orderkey) + 999 AS BIGINT) AS new_id FROM (SELECT DISTINCT o_orderkey FROM orders)")
def id_remap(orders):
    return relational.remapped(orders, "o_orderkey", 1000)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 50 = 0 AS applied FROM orders")
def cas_update(orders):
    wanted = orders.where("o_orderkey % 50 = 0").select("o_orderkey", F.col("o_orderstatus").alias("before"), F.lit("X").alias("after"))
    return relational.swapped(orders.select("o_orderkey", "o_orderstatus"), wanted, "o_orderkey", "o_orderstatus")


def _load() -> None:
    """The other catalogues register their queries when they are imported."""
    from papyra.plans import banks, corruption, joins, pages, payloads, reports, rules, selections, texts, upkeep  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
