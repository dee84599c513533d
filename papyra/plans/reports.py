"""Registered queries of the reports: topics, percentiles, counts, samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import aggregates as G
from papyra.operators import analytics
from papyra.plans.registry import query

TOPIC_SQL = """
rows_ AS (SELECT o_orderpriority AS subject, year(o_orderdate) AS year, p_type AS l1, p_brand AS l2, string_split(p_name, ' ')[1] AS l3, l_discount AS confidence, l_tax AS risk, l_quantity > 45 AS review
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
valid AS (SELECT * FROM rows_ WHERE l1 <> 'PROMO'),
recent AS (SELECT DISTINCT year FROM rows_ ORDER BY year DESC LIMIT 3)"""


def _topics(lineitem, orders, part):
    """Classified rows: lineitems as questions; the topic PROMO stands for unknown."""
    rows = lineitem.join(orders, F.expr("l_orderkey = o_orderkey")).join(part, F.expr("l_partkey = p_partkey"))
    return rows.select(
        F.col("o_orderpriority").alias("subject"), F.year("o_orderdate").alias("year"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).otherwise("unknown").alias("l1"), F.col("p_brand").alias("l2"),
        F.element_at(F.split("p_name", " "), 1).alias("l3"), F.col("l_discount").alias("confidence"), F.col("l_tax").alias("risk"), (F.col("l_quantity") > 45).alias("review"),
    )


@query(f"""
WITH {TOPIC_SQL}
SELECT subject, l1, l2, l3, count(*) AS total_questions, floor((CAST(count(*) * 100.0 / (SELECT count(*) FROM valid) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS percent_all, string_agg(DISTINCT CAST(year AS VARCHAR), ';' ORDER BY CAST(year AS VARCHAR)) AS years_present,
  count(*) FILTER (year IN (SELECT year FROM recent)) AS recent_count, floor((CAST(count(*) FILTER (year IN (SELECT year FROM recent)) * 100.0 / count(*) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS recent_percent,
  floor((CAST(avg(confidence) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS avg_confidence, count(*) FILTER (review) AS needs_review, floor((CAST(avg(risk) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS avg_risk FROM valid GROUP BY subject, l1, l2, l3""")
def topic_distribution(lineitem, orders, part):
    return analytics.topic_distribution(_topics(lineitem, orders, part))


@query(f"""
WITH {TOPIC_SQL}
SELECT CAST(year AS BIGINT) AS year, subject, l1, l2, count(*) AS question_count, floor((CAST(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY year, subject) AS DOUBLE)) * 100 + 0.5 + 1e-9) / 100 AS percent_within, count(*) FILTER (review) AS needs_review
FROM valid GROUP BY year, subject, l1, l2""")
def topic_matrix(lineitem, orders, part):
    return analytics.topic_matrix(_topics(lineitem, orders, part))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS year FROM orders ORDER BY year DESC LIMIT 3")
def recent_years(orders):
    return analytics.recent_years(orders.select(F.year("o_orderdate").alias("year")), "year")


@query(f"""
WITH {TOPIC_SQL},
c AS (SELECT l1, l2, l3, count(*) AS total_count, count(*) FILTER (year IN (SELECT year FROM recent)) AS recent_count, avg(risk) AS risk FROM valid GROUP BY l1, l2, l3),
p AS (SELECT *, (count(*) OVER (ORDER BY total_count) - 1) / greatest(count(*) OVER () - 1, 1) AS f, (count(*) OVER (ORDER BY recent_count) - 1) / greatest(count(*) OVER () - 1, 1) AS r FROM c),
s AS (SELECT *, CAST(0.5 AS DOUBLE) * f + CAST(0.3 AS DOUBLE) * r + CAST(0.2 AS DOUBLE) * risk AS x FROM p)
SELECT l1, l2, l3, total_count, recent_count, floor((CAST(f AS DOUBLE)) * 10000 + 0.5 + 1e-9) / 10000 AS frequency_percentile, floor((CAST(r AS DOUBLE)) * 10000 + 0.5 + 1e-9) / 10000 AS recent_percentile, floor((CAST(risk AS DOUBLE)) * 10000 + 0.5 + 1e-9) / 10000 AS risk, floor((CAST(x AS DOUBLE)) * 10000 + 0.5 + 1e-9) / 10000 AS priority_score,
  CASE WHEN x >= 0.75 THEN 'first' WHEN x >= 0.55 THEN 'high' WHEN x >= 0.35 THEN 'middle' ELSE 'low' END AS priority FROM s""")
def topic_priority(lineitem, orders, part):
    return analytics.topic_priority(_topics(lineitem, orders, part))


@query("SELECT p_partkey, p_size, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (count(*) OVER (ORDER BY p_size) - 1) / (count(*) OVER () - 1) END AS percentile FROM part")
def percentile_map(part):
    return analytics.percentile_map(part, "p_partkey", "p_size")


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_brand LIMIT 10")
def most_common(part):
    return analytics.most_common(part, ["p_type", "p_brand"], 10)


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS total FROM orders),
w AS (SELECT CAST(greatest(10, ceil(count(*) * 0.05)) AS BIGINT) AS wanted, count(*) AS total FROM orders),
i AS (SELECT DISTINCT CAST(round_even(unnest(range(wanted)) * (total - 1) / greatest(wanted - 1, 1), 0) AS BIGINT) + 1 AS place FROM w)
SELECT o_orderkey, place FROM r, w WHERE w.total <= w.wanted OR place IN (SELECT place FROM i)""")
def spot_check(orders):
    return analytics.spot_check(orders.select("o_orderkey"), ["o_orderkey"])


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id, CAST(coalesce(sum(CASE WHEN o_totalprice < 0 THEN 1 END), 0) AS BIGINT) AS negatives FROM orders")
def next_sequence(orders):
    return G.next_number(orders, "o_orderkey").crossJoin(orders.agg(F.coalesce(F.sum(F.when(F.col("o_totalprice") < 0, 1)), F.lit(0)).alias("negatives")))


@query("""
SELECT c.c_custkey, count(o_orderkey) AS n FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c.c_custkey""")
def counts_with_zero(customer, orders):
    return G.counts_with_zero(customer, orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""
WITH e AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT c_mktsegment AS domain, c_custkey, c_name, coalesce(n, 0) AS n FROM customer LEFT JOIN e ON o_custkey = c_custkey)
SELECT domain, count(*) AS exam_count, CAST(sum(n) AS BIGINT) AS question_count, array_to_string(list(c_name ORDER BY c_custkey)[1:12], ',') AS examples FROM d GROUP BY domain""")
def domain_rollup_examples(customer, orders):
    counted = G.counts_with_zero(customer.select("c_custkey", "c_name", "c_mktsegment"), orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", keep=["c_name", "c_mktsegment"])
    return G.domain_rollup(counted, "c_mktsegment", "c_custkey", "c_name", "n").select(F.col("c_mktsegment").alias("domain"), "exam_count", "question_count", F.array_join("examples", ",").alias("examples"))


@query("SELECT n_nationkey, n_name FROM (SELECT n_nationkey, n_name, min(c_custkey) AS first FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) ORDER BY first LIMIT 1")
def first_group_by_id(customer, nation):
    firsts = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    return firsts.join(nation, F.expr("c_nationkey = n_nationkey")).orderBy("first").limit(1).select("n_nationkey", "n_name")


@query("SELECT o_orderpriority, min(o_orderkey) AS place FROM orders GROUP BY o_orderpriority")
def distinct_in_order(orders):
    return G.distinct_in_order(orders, "o_orderpriority", "o_orderkey").withColumnRenamed("first", "place")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, l_partkey, l_suppkey LIMIT 20")
def candidate_pairs(lineitem):
    return lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "l_partkey", "l_suppkey").limit(20)


@query("""
SELECT o_orderstatus AS mount, CAST(sum(exams) AS BIGINT) AS exam_count, CAST(sum(n) AS BIGINT) AS question_count, string_agg(year || ':' || n, ',' ORDER BY year) AS years FROM (
  SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_custkey) AS exams FROM orders GROUP BY ALL) GROUP BY 1""")
def merged_year_maps(orders):
    partial = orders.groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("exams"))
    return G.merged_stats(partial.withColumnRenamed("o_orderstatus", "mount"), "mount", "year", "n", "exams")


@query("""
SELECT l_shipmode AS k, CAST(0 AS BIGINT) AS n FROM (SELECT NULL AS l_shipmode) WHERE false
UNION ALL SELECT l_returnflag || '/' || l_linestatus, count(*) FROM lineitem GROUP BY 1 ORDER BY n DESC, k""")
def counters_desc(lineitem):
    return lineitem.groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k")


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_discount > 0.05) AS with_image, count(*) FILTER (l_tax > 0) AS with_answer, round(coalesce(avg(l_discount), 1.0), 4) AS confidence FROM lineitem GROUP BY 1""")
def parse_stats(lineitem):
    return G.counted_if(lineitem, ["l_returnflag"], {"with_image": F.col("l_discount") > 0.05, "with_answer": F.col("l_tax") > 0}).join(G.mean_or(lineitem, ["l_returnflag"], "l_discount", 1.0, 4, "confidence"), "l_returnflag")


@query("""
SELECT p_brand, median(p_retailprice) AS middle, count(*) FILTER (abs(p_retailprice - m) <= 0.1 * m) AS near FROM part JOIN (SELECT p_brand AS b, median(p_retailprice) AS m FROM part GROUP BY 1) ON b = p_brand GROUP BY p_brand""")
def median_tolerance(part):
    return G.near_median(part, ["p_brand"], "p_retailprice", 0.1)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY length(l_returnflag || l_partkey) DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def keep_longest(lineitem):
    return G.longest_first(lineitem, ["l_orderkey", "l_linenumber"], F.length(F.concat("l_returnflag", F.col("l_partkey").cast("string"))), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT p_brand, min(p_partkey % 100) AS x0, min(p_size) AS y0, max(p_partkey % 100 + 5) AS x1, max(p_size + 3) AS y1 FROM part GROUP BY 1")
def box_union(part):
    boxes = part.select("p_brand", (F.col("p_partkey") % 100).alias("x0"), F.col("p_size").alias("y0"), (F.col("p_partkey") % 100 + 5).alias("x1"), (F.col("p_size") + 3).alias("y1"))
    return G.box_union(boxes, "p_brand")


@query("""
SELECT count(*) AS n_orders, count(DISTINCT o_orderdate) AS groups, count(*) FILTER (o_orderstatus <> 'P') AS classified, count(*) FILTER (o_totalprice > 300000) AS review,
  (SELECT string_agg(o_orderpriority || ':' || n, ',' ORDER BY n DESC, o_orderpriority) FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_orderpriority LIMIT 3)) AS top FROM orders""")
def head_metrics(orders):
    top = analytics.most_common(orders, ["o_orderpriority"], 3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "o_orderpriority", "n"))), lambda x: F.concat_ws(":", x["o_orderpriority"], x["n"].cast("string"))), ",").alias("top"))
    head = orders.agg(F.count("*").alias("n_orders"), F.count_distinct("o_orderdate").alias("groups"), F.count_if(F.col("o_orderstatus") != "P").alias("classified"), F.count_if(F.col("o_totalprice") > 300000).alias("review"))
    return head.crossJoin(top)


@query(r"""
WITH c AS (SELECT unnest(regexp_extract_all(text, '(?s)(.)[0-9]', 1)) AS before FROM documents)
SELECT CASE WHEN before = chr(10) THEN 'line' WHEN regexp_matches(before, '[\s]') THEN 'space' WHEN regexp_matches(before, '\p{L}') THEN 'letter' WHEN regexp_matches(before, '[0-9]') THEN 'digit' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY 1""")
def preceding_classes(documents):
    before = documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(.)[0-9]"), F.lit(1))).alias("before"))
    return G.character_classes(before, "before")


@query("""
SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(*) > 0)""")
def exams_with_rows(nation, customer, orders):
    owners = customer.join(orders.select("o_custkey").distinct(), F.expr("o_custkey = c_custkey"), "left_semi").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return nation.join(owners, "n_nationkey", "left_semi").select("n_name")


@query("""
SELECT l_orderkey, count(*) AS n, count(*) <> 4 AS off, coalesce(string_agg(DISTINCT CASE WHEN c > 1 THEN CAST(l_linenumber AS VARCHAR) END, ',' ORDER BY CASE WHEN c > 1 THEN CAST(l_linenumber AS VARCHAR) END), '') AS doubles,
  count(*) FILTER (l_linenumber > 5) AS beyond FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem) GROUP BY l_orderkey""")
def extra_numbers(lineitem):
    return G.extra_numbers(lineitem, "l_orderkey", "l_linenumber", 4, 5)


@query("""
WITH t AS (SELECT 'customer' AS t, count(*) AS n, count(*) - count(DISTINCT c_custkey) AS doubles FROM customer UNION ALL SELECT 'orders', count(*), count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'part', count(*), count(*) - count(DISTINCT p_partkey) FROM part)
SELECT t AS name, n, doubles FROM t""")
def table_counts(customer, orders, part):
    return G.table_counts({"customer": (customer, "c_custkey"), "orders": (orders, "o_orderkey"), "part": (part, "p_partkey")})


@query("""
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_lines FROM customer""")
def closure_counts(customer, orders, lineitem):
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    per = orders.join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"))
    return customer.select("c_custkey").join(per, "c_custkey", "left").na.fill(0)


@query("""
SELECT event_type AS status, count(*) AS seen, count(*) FILTER (value > 10) AS saved, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS questions FROM events GROUP BY 1""")
def status_counters(events):
    return G.counted_if(events.withColumnRenamed("event_type", "status"), ["status"], {"saved": F.col("value") > 10}).withColumnRenamed("n", "seen").join(events.groupBy(F.col("event_type").alias("status")).agg(F.sum(F.floor("value")).alias("questions")), "status")


@query("""
WITH f AS (SELECT source, lang, count(*) AS n FROM documents WHERE length(text) < 400 GROUP BY ALL), a AS (SELECT DISTINCT source FROM documents WHERE n_chars > 5000)
SELECT f.source, f.lang, f.n, CASE WHEN a.source IS NULL THEN 'missing' ELSE 'available' END AS availability FROM f LEFT JOIN a USING (source)""")
def findings_by_source(documents):
    found = documents.where("length(text) < 400")
    return G.findings_by_source(found, ["source", "lang"], documents.where("n_chars > 5000").select("source").distinct(), "source")


@query("""
SELECT source AS mount, count(*) FILTER (length(text) < 200) AS blocked, count(*) FILTER (length(text) BETWEEN 200 AND 999) AS review, count(*) FILTER (length(text) >= 1000) AS changed, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def repair_report(documents):
    n = F.length("text")
    made = G.counted_if(documents.withColumnRenamed("source", "mount"), ["mount"], {"blocked": n < 200, "review": n.between(200, 999), "changed": n >= 1000}).drop("n")
    return made.join(documents.groupBy(F.col("source").alias("mount")).agg(F.sum(F.length("text")).alias("chars")), "mount")


@query("SELECT count(*) AS pages, count(*) FILTER (length(html) < 1000) AS needing, round(count(*) FILTER (strpos(url, '/en/') > 0) * 1.0 / count(*), 4) AS classified FROM pages")
def methodology_totals(pages):
    return pages.agg(F.count("*").alias("pages"), F.count_if(F.length("html") < 1000).alias("needing"), F.round(F.count_if(F.instr("url", "/en/") > 0) / F.count("*"), 4).alias("classified"))


@query("""
SELECT CASE WHEN n_chars = 0 THEN 'empty' WHEN n_chars < 300 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS class, lang, count(*) AS n FROM documents GROUP BY ALL""")
def surface_counts(documents):
    n = F.col("n_chars")
    return documents.groupBy(F.when(n == 0, "empty").when(n < 300, "short").when(n < 3000, "middle").otherwise("long").alias("class"), "lang").agg(F.count("*").alias("n"))


@query("""
SELECT lang, count(*) AS total, CAST(sum(quality) AS BIGINT) AS correct, round(sum(quality) * 100.0 / count(*), 1) AS score, (SELECT round(sum(quality) * 100.0 / count(*), 1) FROM labels) AS overall FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def quiz_results(documents, labels):
    return G.graded(documents.select("doc_id", "lang"), labels.select("doc_id", F.col("quality").alias("right")), "doc_id", "lang")
