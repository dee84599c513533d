"""Registered queries of searches, ordered rows, set operations and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import changes as C
from papyra.operators import ordered as O
from papyra.operators import search as Q
from papyra.plans.registry import query

#: Documents as questions: exam = source, subject = lang, and numbers made from the id.
BANK = "bank AS (SELECT doc_id AS id, source AS exam, lang AS subject, CAST(2000 + doc_id % 20 AS INT) AS year, CAST(1 + doc_id % 3 AS INT) AS session, CAST(1 + doc_id % 25 AS INT) AS number, text, '#' || lang || ', #' || source AS tags FROM documents)"


def bank(documents):
    d = F.col("doc_id")
    made = lambda e: F.expr(e).cast("int")
    tags = F.concat(F.lit("#"), F.col("lang"), F.lit(", #"), F.col("source"))
    return documents.select(d.alias("id"), F.col("source").alias("exam"), F.col("lang").alias("subject"), made("2000 + doc_id % 20").alias("year"), made("1 + doc_id % 3").alias("session"), made("1 + doc_id % 25").alias("number"), "text", tags.alias("tags"))


@query(f"""
WITH {BANK}, r AS (SELECT * FROM bank b WHERE year BETWEEN 2005 AND 2015 AND number IN (1, 2, 3, 5, 8) AND subject = 'en'
  AND (strpos(lower(text), 'the') > 0 OR EXISTS (SELECT 1 FROM conversations WHERE conv_id = id AND strpos(lower(text), 'the') > 0)) AND (strpos(lower(text), 'on') > 0 OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = id AND strpos(lower(c.text), 'on') > 0)))
SELECT id, exam, subject, year, session, number FROM r ORDER BY year DESC, session DESC, number, id LIMIT 50""")
def search_filtered(documents, conversations):
    choices = conversations.select(F.col("conv_id").alias("id"), F.col("text").alias("choice_text"))
    found = Q.search(bank(documents), choices, search_text="the ON", subject="en", year_from=2005, year_to=2015, numbers=[8, 1, 2, 3, 5, 1], limit=50)
    return found.select("id", "exam", "subject", "year", "session", "number")


@query(f"WITH {BANK} SELECT id, year, session, number FROM bank WHERE year = 2003 AND session = 2 AND (', ' || lower(tags) || ',' LIKE '%, #en,%' OR ', ' || lower(tags) || ',' LIKE '%, #fr,%')")
def search_year_overrides(documents):
    return Q.search(bank(documents), year=2003, year_from=2010, year_to=2012, session=2, tag_query="#EN, #fr").select("id", "year", "session", "number")


@query(f"WITH {BANK} SELECT id, exam, (SELECT count(*) FROM conversations WHERE conv_id = id) AS n, coalesce((SELECT string_agg(turn || ':' || role, ',' ORDER BY turn, role) FROM conversations WHERE conv_id = id), '') AS choices FROM bank WHERE id = 7")
def point_lookup(documents, conversations):
    choices = conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("number"), F.col("role").alias("symbol"))
    found = Q.point(bank(documents), choices, 7, ["number", "symbol"], [])
    shown = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["number"].cast("string"), c["symbol"])), ",")
    return found.select("id", "exam", F.size("children").cast("long").alias("n"), shown.alias("choices"))


@query("SELECT count(*) FILTER (trim(coalesce(CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 7 = 0 THEN NULL ELSE lang END, '')) = '') AS blank, count(*) AS n FROM documents")
def blank_tags(documents):
    rows = documents.withColumn("tags", F.when(F.expr("doc_id % 5 = 0"), "  ").when(F.expr("doc_id % 7 <> 0"), F.col("lang")))
    return rows.agg(F.count_if(Q.blank("tags")).alias("blank"), F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, TRY_CAST(CASE WHEN doc_id % 6 = 0 THEN 'n/a' ELSE CAST(1990 + doc_id % 30 AS VARCHAR) END AS INT) AS y FROM documents) WHERE y BETWEEN 1995 AND 2004")
def year_range(documents):
    rows = documents.withColumn("y", F.when(F.expr("doc_id % 6 = 0"), "n/a").otherwise(F.expr("cast(1990 + doc_id % 30 as string)")))
    return rows.where(Q.in_year_range("y", 1995, 2004)).select("doc_id")


@query("""
WITH u AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 10 END AS g, length(text) > 120 AS ok FROM documents)
SELECT doc_id FROM u WHERE (g IS NULL AND ok) OR g IN (SELECT g FROM u WHERE g IS NOT NULL GROUP BY g HAVING bool_and(ok))""")
def whole_groups(documents):
    rows = documents.select("doc_id", F.when(F.expr("doc_id % 3 <> 0"), F.expr("doc_id div 10")).alias("g"), (F.length("text") > 120).alias("ok"))
    return Q.whole_groups(rows, "g", "doc_id", F.col("ok")).select("doc_id")


@query("SELECT DISTINCT user_id FROM events WHERE event_type IN ('error', 'purchase')")
def status_filter(events):
    return Q.with_status(events, " error, purchase,", "user_id", "event_type")


@query("""
WITH f AS (SELECT user_id, event_type AS code FROM events WHERE value > 40) SELECT user_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f WHERE code IN ('error', 'click') GROUP BY user_id""")
def blocking_codes(events):
    return Q.blocking(events.where("value > 40").select("user_id", F.col("event_type").alias("code")), "user_id", ["error", "click"])


@query("SELECT 'documents' AS mount, lang, source, 'documents::' || lang AS code FROM (SELECT DISTINCT lang, source FROM documents)")
def pruned_options(documents, benchmark):
    mounts = {"documents": documents, "benchmark": benchmark.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))}
    return Q.namespaced(Q.pruned(mounts, "documents::en"), ["lang", "source"])


@query("SELECT user_id, coalesce(arg_max(t, event_id) FILTER (t <> ''), arg_min(t, event_id)) AS status FROM (SELECT user_id, event_id, CASE WHEN value < 40 THEN '' ELSE event_type END AS t FROM events) GROUP BY user_id")
def latest_or_first(events):
    rows = events.select("user_id", "event_id", F.when(F.col("value") < 40, "").otherwise(F.col("event_type")).alias("status"))
    return O.latest(rows, "user_id", ["event_id"], "status")


#: A walk along an order's rows that carries what has been kept.
_ROWS = "r AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem)"


@query(f"""
WITH RECURSIVE {_ROWS}, w AS (SELECT k, i, n, p, s, n AS last, true AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.k, r.i, r.n, r.p, r.s, CASE WHEN r.n > w.last AND r.n - w.last <= 2 THEN r.n ELSE w.last END, r.n > w.last AND r.n - w.last <= 2 FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1)
SELECT k AS l_orderkey, p AS l_partkey, s AS l_suppkey, n AS l_linenumber FROM w WHERE kept""")
def monotone_filter(lineitem):
    return O.monotone(lineitem, "l_orderkey", ["l_partkey", "l_suppkey"], "l_linenumber", 2)


@query(f"""
WITH RECURSIVE {_ROWS}, w AS (SELECT k, i, n, p, s, 1 AS c, 0 AS subject FROM r WHERE i = 1
  UNION ALL SELECT r.k, r.i, r.n, r.p, r.s, CASE WHEN (r.n = 1 AND w.n >= 4) OR w.c >= 3 THEN 1 ELSE w.c + 1 END, w.subject + CASE WHEN (r.n = 1 AND w.n >= 4) OR w.c >= 3 THEN 1 ELSE 0 END FROM w JOIN r ON r.k = w.k AND r.i = w.i + 1)
SELECT k AS l_orderkey, p AS l_partkey, s AS l_suppkey, n AS l_linenumber, CAST(subject AS BIGINT) AS subject FROM w""")
def subject_switches(lineitem):
    found = O.subject_switches(lineitem, "l_orderkey", ["l_partkey", "l_suppkey"], "l_linenumber", 3, 4)
    return found.withColumn("subject", F.col("subject").cast("long"))


@query("SELECT p_partkey, gap FROM (SELECT p_partkey, p_retailprice - lag(p_retailprice + 0.5) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS gap FROM part) WHERE gap >= 2")
def wide_gaps(part):
    rows = part.withColumn("end", F.col("p_retailprice") + 0.5)
    return O.wide_gaps(rows, "p_brand", ["p_retailprice", "p_partkey"], "p_retailprice", "end", 2).select("p_partkey", "gap")


@query("""
WITH m AS (SELECT *, CASE WHEN p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) > 1 THEN 1 ELSE 0 END AS g FROM part), s AS (SELECT *, sum(g) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS session FROM m)
SELECT p_brand, CAST(session AS BIGINT) AS session, avg(p_size) AS mean, count(*) AS n FROM s GROUP BY p_brand, session""")
def cluster_means(part):
    return O.cluster_means(part, "p_brand", ["p_size", "p_partkey"], "p_size", 1)


@query("""
WITH g AS (SELECT p_partkey, p_brand, p_retailprice, p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS gap FROM part), m AS (SELECT p_brand, coalesce(median(gap), 0) AS middle FROM g GROUP BY 1)
SELECT p_partkey, CAST(sum(CASE WHEN gap > greatest(middle * 1.55, 0.2) THEN 1 ELSE 0 END) OVER (PARTITION BY g.p_brand ORDER BY p_retailprice, p_partkey) AS BIGINT) AS run FROM g JOIN m USING (p_brand)""")
def split_by_median(part):
    return O.split_by_median(part, "p_brand", ["p_retailprice", "p_partkey"], "p_retailprice", 1.55, 0.2).select("p_partkey", "run")


@query("""
SELECT l_orderkey, n + 1 AS missing FROM (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS next FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) WHERE next = n + 2""")
def missing_between(lineitem):
    return O.missing_between(lineitem.select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("""
WITH a AS (SELECT user_id, event_id AS a_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id AS b_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click')
SELECT user_id, CAST(k AS BIGINT) AS k, a_id, b_id FROM a JOIN b USING (user_id, k)""")
def kth_pairs(events):
    side = lambda kind, name: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name))
    return O.kth_pairs(side("view", "a_id"), side("click", "b_id"), "user_id", ["a_id"], ["b_id"]).withColumn("k", F.col("k").cast("long"))


@query("SELECT event_id, ((r - 17 % n) % n + n) % n AS place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def rotated_candidates(events):
    return O.rotated(events, "user_id", ["event_id"], 17).select("event_id", "place")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS occurrence FROM orders")
def occurrence_numbers(orders):
    keyed = orders.withColumn("k", F.struct("o_custkey", F.year("o_orderdate")))
    return O.occurrences(keyed, "k", ["o_orderkey"]).select("o_orderkey", "occurrence")


@query("""
WITH g AS (SELECT *, max(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM part),
s AS (SELECT *, sum(CASE WHEN p_size - reach > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS session FROM g) SELECT p_partkey, p_brand FROM s WHERE session = 0""")
def first_band(part):
    rows = part.withColumn("high", F.col("p_size") + 1)
    return O.first_band(rows, "p_brand", ["p_size", "p_partkey"], "p_size", "high", 1).select("p_partkey", "p_brand")


@query("""
WITH p AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS page, CASE WHEN l_quantity > 30 THEN l_returnflag END AS meta, l_linenumber AS first FROM lineitem),
f AS (SELECT *, last_value(meta IGNORE NULLS) OVER (PARTITION BY d ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM p),
b AS (SELECT *, CASE WHEN page = 1 THEN 1 WHEN heading IS DISTINCT FROM lag(heading) OVER w OR (first = 1 AND lag(first) OVER w > 1) THEN 1 ELSE 0 END AS begins FROM f WINDOW w AS (PARTITION BY d ORDER BY page))
SELECT d, page, heading, CAST(sum(begins) OVER (PARTITION BY d ORDER BY page) AS BIGINT) AS set FROM b""")
def exam_sets(lineitem):
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")).cast("long")
    pages = lineitem.select(F.col("l_orderkey").alias("d"), page.alias("page"), F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).alias("meta"), F.col("l_linenumber").alias("first"))
    return O.exam_sets(pages, "d", "page", "meta", "first").select("d", "page", "heading", "set")


@query("""
WITH g AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS o, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS n FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN o IS NOT NULL THEN 0 WHEN n IS NOT NULL THEN 1 ELSE 2 END, coalesce(o, n, p_partkey), p_partkey) AS place FROM g""")
def child_order(part):
    rows = part.withColumn("group_order", F.when(F.col("p_size") % 3 != 0, F.col("p_size"))).withColumn("number", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")))
    return O.child_order(rows, "p_brand", "group_order", "number", "p_partkey").select("p_partkey", "place")


@query("""
WITH b AS (SELECT p_partkey, p_brand, p_size % 10 * 10 AS x0, p_size % 10 * 10 + CASE WHEN p_partkey % 11 = 0 THEN 80 ELSE 20 END AS x1, p_partkey % 37 AS y0 FROM part),
c AS (SELECT *, CASE WHEN x1 - x0 > 50 AND y0 = min(y0) OVER (PARTITION BY p_brand) THEN -1 WHEN x0 < 50 THEN 0 ELSE 1 END AS col FROM b)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY col, y0, x0, p_partkey) AS place FROM c QUALIFY count(*) OVER (PARTITION BY p_brand, col, y0, x0) = 1""")
def reading_order(part):
    x0 = F.col("p_size") % 10 * 10
    blocks = part.select("p_partkey", "p_brand", x0.alias("x0"), (x0 + F.when(F.expr("p_partkey % 11 = 0"), 80).otherwise(20)).alias("x1"), F.expr("p_partkey % 37").alias("y0"))
    placed = O.reading_order(blocks, "p_brand", "x0", "x1", "y0", 100, 50)
    # blocks at one and the same place have no order of their own
    return placed.withColumn("same", F.count("*").over(Window.partitionBy("p_brand", "column", "y0", "x0"))).where("same = 1").select("p_partkey", "place")


@query("SELECT n_name, n_nationkey FROM nation ORDER BY n_name, n_nationkey LIMIT 20")
def options_order(nation):
    return nation.select("n_name", "n_nationkey").orderBy("n_name", "n_nationkey").limit(20)


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49")
def distinct_union(orders, lineitem):
    return orders.where("o_totalprice > 400000").select(F.col("o_orderkey").alias("id")).union(lineitem.where("l_quantity > 49").select("l_orderkey")).distinct()


@query("SELECT l_orderkey, len(list_filter(list(DISTINCT l_linenumber), lambda x: x NOT IN (1, 2, 3, 4, 5))) = 0 AS inside FROM lineitem GROUP BY l_orderkey")
def subset_check(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.bool_and(F.col("l_linenumber").isin(1, 2, 3, 4, 5)).alias("inside"))


@query("SELECT p_partkey, array_to_string(list_concat([a, b], CASE WHEN c IN (a, b) THEN [] ELSE [c] END), ', ') AS tags FROM (SELECT p_partkey, p_brand AS a, p_type AS b, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_type ELSE p_name END AS c FROM part)")
def ordered_union(part):
    third = F.when(F.expr("p_partkey % 3 = 0"), F.col("p_brand")).when(F.expr("p_partkey % 3 = 1"), F.col("p_type")).otherwise(F.col("p_name"))
    return part.select("p_partkey", F.array_join(F.array_distinct(F.concat(F.array("p_brand", "p_type"), F.array(third))), ", ").alias("tags"))


@query("SELECT doc_id, md5(text) AS before, md5(trim(regexp_replace(replace(text, '%%%', ''), '[*]{3}', '', 'g'))) AS after FROM documents WHERE text <> trim(regexp_replace(replace(text, '%%%', ''), '[*]{3}', '', 'g')) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def text_changes(documents, labels):
    after = F.trim(F.regexp_replace(F.replace("text", F.lit("%%%"), F.lit("")), "[*]{3}", ""))
    return C.text_changes(documents, "doc_id", "text", after, labels.where("quality = 1")).select("doc_id", F.md5("before").alias("before"), F.md5("after").alias("after"))


_TABLES = lambda orders, lineitem: [("orders", orders, "o_orderkey", "", "o_custkey"), ("lineitem", lineitem, "l_orderkey", "orders", "l_orderkey")]


@query("""
SELECT 'orders' AS t, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL
SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))""")
def exam_closure(customer, orders, lineitem):
    held = C.cascade(customer.where("c_nationkey = 3"), "c_custkey", _TABLES(orders, lineitem))
    count = lambda name, key: held[name].agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("t"), "n", "ids")
    return count("orders", "o_orderkey").union(count("lineitem", "l_orderkey"))


@query("""
SELECT 'orders' AS t, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL
SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))""")
def exam_delete(customer, orders, lineitem):
    left = C.without_closure(customer.where("c_nationkey = 3"), "c_custkey", _TABLES(orders, lineitem))
    count = lambda name, key: left[name].agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("t"), "n", "ids")
    return count("orders", "o_orderkey").union(count("lineitem", "l_orderkey"))


@query("""
WITH m AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 4999 AS new FROM orders WHERE o_custkey < 500)
SELECT new AS l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN m ON l_orderkey = o_orderkey""")
def exam_copy(orders, lineitem):
    mine = orders.where("o_custkey < 500")
    _, ids = C.copied(mine, "o_orderkey", 5000)
    lines = lineitem.join(mine.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(ids.withColumnRenamed("old_id", "l_orderkey"), "l_orderkey").select(F.col("new_id").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("SELECT k, 'not_found' AS issue FROM (SELECT DISTINCT doc_id * 3 AS k FROM documents) WHERE k NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'exists' FROM labels WHERE doc_id IN (SELECT doc_id * 3 FROM documents)")
def move_issues(documents, labels):
    wanted = documents.select((F.col("doc_id") * 3).alias("k"))
    return C.move_issues(wanted, documents.select(F.col("doc_id").alias("k")), labels.select(F.col("doc_id").alias("k")), "k")


@query("SELECT coalesce(n.n_nationkey, s.k) AS n_nationkey, coalesce(s.name, n.n_name) AS n_name FROM nation n FULL JOIN (SELECT s_nationkey * 2 AS k, min(s_name) AS name FROM supplier GROUP BY 1) s ON n.n_nationkey = s.k")
def ensured_dims(nation, supplier):
    return C.ensured(nation.select("n_nationkey", "n_name"), supplier.select((F.col("s_nationkey") * 2).alias("n_nationkey"), F.col("s_name").alias("n_name")), "n_nationkey", "n_name")


@query("SELECT doc_id, md5(CASE WHEN trim(coalesce(b.text, '')) <> '' THEN trim(b.text) || chr(10) || chr(10) || d.text ELSE d.text END) AS text, CAST(NULL AS VARCHAR) AS source FROM documents d LEFT JOIN benchmark b ON item_id = doc_id % 50")
def cloned_templates(documents, benchmark):
    rows = documents.withColumn("item_id", F.expr("doc_id % 50")).join(benchmark.withColumnRenamed("text", "passage"), "item_id", "left")
    return C.cloned(rows, "passage", "text", ["source"]).select("doc_id", F.md5("text").alias("text"), "source")


@query("""
WITH r AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN event_type END AS f, CASE WHEN value < 5 THEN 'low' END AS g, CASE WHEN value > 45 THEN event_type END AS note FROM events),
n AS (SELECT user_id, note, min(event_id) AS first FROM r WHERE note IS NOT NULL GROUP BY ALL)
SELECT r.user_id, arg_min(f, event_id) FILTER (f IS NOT NULL) AS f, arg_min(g, event_id) FILTER (g IS NOT NULL) AS g, coalesce((SELECT string_agg(note, '; ' ORDER BY first) FROM n WHERE n.user_id = r.user_id), '') AS note,
  concat_ws(',', CASE WHEN count(DISTINCT f) > 1 THEN 'f' END, CASE WHEN count(DISTINCT g) > 1 THEN 'g' END) AS conflict FROM r GROUP BY r.user_id""")
def merged_repairs(events):
    v = F.col("value")
    rows = events.select("user_id", "event_id", F.when(v > 20, F.col("event_type")).alias("f"), F.when(v < 5, "low").alias("g"), F.when(v > 45, F.col("event_type")).alias("note"))
    return C.merged_repairs(rows, "user_id", ["f", "g"], "note", "event_id")


@query("""
WITH s AS (SELECT s_nationkey AS k, min(s_suppkey) AS source FROM supplier GROUP BY 1), m AS (SELECT s.*, (SELECT min(s_name) FROM supplier WHERE s_suppkey = source) AS more FROM s)
SELECT c_custkey, source, concat_ws(', ', c_mktsegment, CASE WHEN more <> c_mktsegment THEN more END) AS tags FROM customer LEFT JOIN m ON k = c_nationkey""")
def attached_sources(customer, supplier):
    rows = customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("tags"))
    return C.attached(rows, supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("source"), F.col("s_name").alias("more")), ["k"], "source", "tags", "more").select("c_custkey", "source", "tags")


@query("SELECT l_orderkey, CAST((n - 1) // 3 AS BIGINT) AS line, string_agg(n || '.' || a, ' ' ORDER BY n) AS text FROM (SELECT l_orderkey, l_linenumber AS n, min(l_suppkey) AS a FROM lineitem GROUP BY ALL) GROUP BY 1, 2")
def answer_rows(lineitem):
    answers = lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_suppkey").alias("a"))
    return C.answer_rows(answers, "l_orderkey", "n", "a", 3)


@query("SELECT 'accepted' AS state, count(*) AS n FROM events WHERE value > 5 AND event_type <> 'error' UNION ALL SELECT 'rejected', count(*) FROM events WHERE NOT (value > 5 AND event_type <> 'error')")
def quarantine_split(events):
    good, bad = C.split_by_rule(events, (F.col("value") > 5) & (F.col("event_type") != "error"))
    return good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("state"), "n").union(bad.agg(F.count("*").alias("n")).select(F.lit("rejected"), "n"))


@query("SELECT DISTINCT o_orderpriority AS exam, o_orderstatus AS subject, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS session FROM orders")
def existing_keys(orders):
    return orders.select(F.col("o_orderpriority").alias("exam"), F.col("o_orderstatus").alias("subject"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("session")).distinct()
