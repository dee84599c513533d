"""Registered queries of joins with rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import matching as M
from papyra.operators import ordered
from papyra.plans.registry import query


@query("SELECT p_partkey FROM part WHERE strpos(p_name, 'red') > 0 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def exists_under_or(part, lineitem):
    return M.where_or_exists(part, F.instr("p_name", "red") > 0, lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", F.col("l_quantity") > 49).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))")
def nested_semi(customer, nation, region):
    nations = nation.join(region.where("r_name = 'ASIA'"), F.expr("n_regionkey = r_regionkey"), "left_semi")
    return customer.join(nations, F.expr("c_nationkey = n_nationkey"), "left_semi").select("c_custkey")


@query("SELECT r_name, display_order, label FROM region CROSS JOIN (VALUES (1, 'first'), (2, 'second'), (3, 'third')) v(display_order, label)")
def seed_orders(region):
    inline = F.inline(F.array(*[F.struct(F.lit(k).alias("display_order"), F.lit(x).alias("label")) for k, x in ((1, "first"), (2, "second"), (3, "third"))]))
    return region.select("r_name", inline)  # inline values are written out by a generator: no cross join


@query("""
WITH a AS (SELECT c_nationkey, c_mktsegment, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS e, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS l FROM customer),
q AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'NOSUCH' ELSE 'MACHINERY' END AS segment, s_suppkey % 5 + 1 AS number FROM supplier)
SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM a WHERE c_nationkey = s_nationkey AND c_mktsegment = segment) THEN (SELECT c_name FROM a WHERE c_nationkey = s_nationkey AND c_mktsegment = segment AND e = number)
  ELSE (SELECT c_name FROM a WHERE c_nationkey = s_nationkey AND l = number) END AS answer FROM q""")
def positional_fallback(supplier, customer):
    segment = F.when(F.expr("s_suppkey % 3 = 0"), "BUILDING").when(F.expr("s_suppkey % 3 = 1"), "NOSUCH").otherwise("MACHINERY")
    rows = supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), segment.alias("segment"), F.expr("cast(s_suppkey % 5 + 1 as int)").alias("number"))
    answers = customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "c_custkey", "c_name")
    return M.positional_answers(rows, answers, ["nation", "segment"], ["nation"], "number", "c_custkey", "c_name").select("s_suppkey", "answer")


@query("""
WITH b AS (SELECT n_name, n_nationkey * 2 AS low, n_nationkey * 2 + n_regionkey AS high FROM nation)
SELECT p_partkey, n_name FROM part JOIN b ON p_size BETWEEN low AND high""")
def range_table_join(part, nation):
    bands = nation.select("n_name", (F.col("n_nationkey") * 2).alias("low"), (F.col("n_nationkey") * 2 + F.col("n_regionkey")).alias("high"))
    return M.in_ranges(part, "p_size", bands, "low", "high").select("p_partkey", "n_name")


@query("""
WITH r AS (SELECT o_orderkey AS k, CAST(1 + o_orderkey % 2 AS BIGINT) AS low, CAST(3 + o_orderkey % 3 AS BIGINT) AS high FROM orders),
h AS (SELECT k, count(DISTINCT l_linenumber) AS held, count(l_linenumber) AS n FROM r LEFT JOIN lineitem ON l_orderkey = k AND l_linenumber BETWEEN low AND high GROUP BY k)
SELECT r.k, low, high, held = high - low + 1 AS complete, n - held AS repeats FROM r JOIN h USING (k)""")
def range_members(orders, lineitem):
    ranges = orders.select(F.col("o_orderkey").alias("k"), F.expr("1 + o_orderkey % 2").alias("low"), F.expr("3 + o_orderkey % 3").alias("high"))
    return M.range_members(lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber"), "k", "l_linenumber", "low", "high", ranges).select("k", "low", "high", "complete", "repeats")


@query("""
WITH a AS (SELECT p_partkey AS id, (p_partkey % 97)::DOUBLE AS x0, p_size::DOUBLE AS y0, (p_partkey % 97 + 3)::DOUBLE AS x1, (p_size + 2)::DOUBLE AS y1 FROM part),
b AS (SELECT s_suppkey AS id, (s_suppkey % 89)::DOUBLE AS x0, (s_suppkey % 43)::DOUBLE AS y0, (s_suppkey % 89 + 4 + s_suppkey % 3)::DOUBLE AS x1, (s_suppkey % 43 + 5)::DOUBLE AS y1 FROM supplier),
m AS (SELECT a.id, b.id AS owner, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) AS share, (b.x1 - b.x0) * (b.y1 - b.y0) AS size
  FROM a JOIN b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
e AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY share DESC, size) AS r FROM m WHERE share >= 0.5),
t AS (SELECT id, count(*) AS n, min(owner) AS owner FROM e WHERE r = 1 GROUP BY id)
SELECT a.id, CASE WHEN n = 1 THEN owner END AS owner FROM a LEFT JOIN t USING (id)""")
def best_owner(part, supplier):
    box = lambda df, i, x, y, w, h: df.select(F.col(i).alias("id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    a = box(part, "p_partkey", F.col("p_partkey") % 97, F.col("p_size"), F.lit(3), F.lit(2))
    b = box(supplier, "s_suppkey", F.col("s_suppkey") % 89, F.col("s_suppkey") % 43, F.lit(4) + F.col("s_suppkey") % 3, F.lit(5))
    return M.best_owner(a, b, 8)


@query("""
SELECT event_id, CAST(CASE WHEN x < 20 THEN 0 WHEN x < 50 THEN 1 ELSE 2 END AS BIGINT) AS col, CAST(CASE WHEN y < 5 THEN 0 WHEN y < 25 THEN 1 ELSE 2 END AS BIGINT) AS row
FROM (SELECT event_id, user_id % 100 AS x, value AS y FROM events) WHERE x >= 0 AND x < 90 AND y >= 1 AND y < 40""")
def grid_cells(events):
    points = events.select("event_id", (F.col("user_id") % 100).cast("double").alias("x"), F.col("value").alias("y"))
    return M.in_cells(points, [0, 20, 50, 90], [1, 5, 25, 40]).select("event_id", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"))


@query("""
WITH r AS (SELECT DISTINCT p_brand AS prefix, length(p_brand) AS place FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#2')
SELECT p_partkey, (SELECT prefix FROM r WHERE starts_with(p_brand || '-' || p_type, prefix) ORDER BY place, prefix LIMIT 1) AS prefix FROM part""")
def first_prefix(part):
    rules = part.where("p_brand like 'Brand#1%' or p_brand = 'Brand#2'").select(F.col("p_brand").alias("prefix"), F.length("p_brand").alias("place")).distinct()
    rows = part.select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("name"))
    return M.first_prefix(rows, "name", rules, "prefix", "place").select("p_partkey", F.col("rule.prefix").alias("prefix"))


@query("""
WITH k AS (SELECT unnest([s_nationkey || '/' || s_suppkey % 50, 'x' || s_suppkey]) AS alias FROM supplier)
SELECT c_custkey FROM customer WHERE NOT list_has_any([c_nationkey || '/' || c_custkey % 50, 'x' || c_custkey], (SELECT list(alias) FROM k))""")
def alias_anti(customer, supplier):
    rows = customer.select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("number"))
    known = supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("number"))
    aliases = lambda df: F.array(F.concat_ws("/", df["nation"].cast("string"), (df["number"] % 50).cast("string")), F.concat(F.lit("x"), df["number"].cast("string")))
    return M.without_known(rows, known, "c_custkey", aliases).select("c_custkey")


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_quantity > 5),
b AS (SELECT l_orderkey, CASE WHEN l_partkey % 10 = 0 THEN 0 ELSE l_partkey END AS l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem WHERE l_quantity > 6)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, count(*) FILTER (a.place IS NULL OR b.place IS NULL OR a.l_partkey IS DISTINCT FROM b.l_partkey) AS differ, count(*) AS places FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.place = b.place GROUP BY 1""")
def positional_diff(lineitem):
    order = ["l_linenumber", "p", "l_suppkey"]
    rows = lineitem.withColumn("p", F.col("l_partkey"))
    new = rows.where("l_quantity > 6").withColumn("l_partkey", F.when(F.expr("l_partkey % 10 = 0"), 0).otherwise(F.col("l_partkey")))
    return M.positional_diff(rows.where("l_quantity > 5"), new, "l_orderkey", order, "l_partkey")


@query("""
SELECT p.p_partkey, CASE WHEN c.v BETWEEN 50000 AND 90000 THEN c.v ELSE p_retailprice END AS p_retailprice, coalesce(c.v BETWEEN 50000 AND 90000, false) AS replaced
FROM part p LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) c ON l_partkey = p_partkey""")
def replace_if_valid(part, lineitem):
    candidates = lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("p_retailprice"))
    return M.replaced_if_valid(part.select("p_partkey", "p_retailprice"), candidates, "p_partkey", "p_retailprice", F.col("candidate").between(50000, 90000))


@query("""
WITH w AS (SELECT DISTINCT p_brand, p_type FROM part UNION ALL SELECT 'Brand#0', 'NONE'), m AS (SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_size < 3 GROUP BY ALL)
SELECT w.p_brand, w.p_type, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM w LEFT JOIN m USING (p_brand, p_type)""")
def match_states(part):
    extra = part.sparkSession.range(1).select(F.lit("Brand#0").alias("p_brand"), F.lit("NONE").alias("p_type"))
    wanted = part.select("p_brand", "p_type").distinct().union(extra)
    return M.match_states(wanted, part.where("p_size < 3"), ["p_brand", "p_type"])


@query("""
WITH d AS (SELECT p_partkey AS id, p_brand, p_type, p_name FROM part), f AS (SELECT p_brand, p_type, min(id) AS id FROM d GROUP BY ALL HAVING count(*) = 1), g AS (SELECT p_name, p_brand, min(id) AS id FROM d GROUP BY ALL HAVING count(*) = 1)
SELECT p.p_partkey, coalesce(f.id, g.id) AS id FROM part p LEFT JOIN f ON f.p_brand = p.p_brand AND f.p_type = p.p_type LEFT JOIN g ON g.p_name = p.p_name AND g.p_brand = p.p_brand""")
def two_tier_resolve(part):
    return M.two_tier(part, part.withColumn("id", F.col("p_partkey")), ["p_brand", "p_type"], ["p_name", "p_brand"], "id").select("p_partkey", "id")


@query("""
WITH l AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase')
SELECT e.event_id, (SELECT 'p' || l.value FROM l WHERE l.user_id = e.user_id AND abs(l.value - e.value) <= 5 ORDER BY abs(l.value - e.value), l.value LIMIT 1) AS nearest FROM events e WHERE event_type = 'click'""")
def nearest_label(events):
    labels = events.where("event_type = 'purchase'").select("user_id", "value", F.concat(F.lit("p"), F.col("value").cast("string")).alias("label"))
    rows = events.where("event_type = 'click'").select("event_id", "user_id", "value")
    return M.nearest_label(rows, labels, "user_id", "value", "label", 5).select("event_id", "nearest")


@query("""
WITH w AS (SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM events)
SELECT event_id, coalesce(b, a, -1) AS asof FROM w""")
def asof_default(events):
    return ordered.asof(events, "user_id", ["ts", "event_id"], "event_id", F.col("event_type") == "error", -1).select("event_id", "asof")


@query("SELECT o_orderkey, (SELECT min(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax = (SELECT min(l_tax) FROM lineitem WHERE l_orderkey = o_orderkey)) AS l_suppkey FROM orders")
def preferred_file(orders, lineitem):
    return M.preferred(orders, lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_tax", "l_suppkey").select("o_orderkey", "l_suppkey")


@query("SELECT s_suppkey, n_nationkey AS dim FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def dim_resolve(supplier, nation):
    wanted = supplier.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return M.matched_once(wanted, nation.select("n_nationkey"), ["n_nationkey"]).select("s_suppkey", F.col("n_nationkey").alias("dim"))


@query("""
WITH p AS (SELECT l_orderkey AS k, count(*) AS n, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), i AS (SELECT o_orderkey AS k, o_orderkey % 100 AS s, 'A' AS f FROM orders)
SELECT i.k, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN i.s IS DISTINCT FROM p.s OR i.f IS DISTINCT FROM p.f THEN 'different:' || concat_ws(',', CASE WHEN i.s IS DISTINCT FROM p.s THEN 's' END, CASE WHEN i.f IS DISTINCT FROM p.f THEN 'f' END) ELSE 'equal' END AS state
FROM i LEFT JOIN p USING (k)""")
def provenance_states(orders, lineitem):
    inventory = orders.select(F.col("o_orderkey").alias("k"), F.expr("o_orderkey % 100").alias("s"), F.lit("A").alias("f"))
    return M.provenance_states(inventory, lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")), "k", ["s", "f"])


@query("""
WITH o AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS t, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS p FROM documents WHERE doc_id % 5 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE upper(lang) END AS t, CASE WHEN doc_id % 7 = 0 THEN source END AS p FROM documents WHERE doc_id % 6 <> 0),
j AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, n.doc_id IS NOT NULL AS has, n.t, n.p, o.t AS ot, o.p AS op, o.doc_id IS NOT NULL AND (trim(coalesce(o.t, '')) <> '' OR trim(coalesce(o.p, '')) <> '') AS held FROM n FULL JOIN o ON n.doc_id = o.doc_id),
k AS (SELECT *, held AND (NOT has OR (trim(coalesce(t, '')) = '' AND trim(coalesce(p, '')) = '')) AS kept_old FROM j WHERE has OR held)
SELECT doc_id, CASE WHEN kept_old THEN coalesce(ot, '') ELSE t END AS t, CASE WHEN kept_old THEN op ELSE p END AS p, kept_old FROM k""")
def merged_choices(documents):
    d = documents
    old = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.expr("doc_id % 4 = 0"), "").otherwise(F.col("lang")).alias("t"), F.when(F.expr("doc_id % 3 <> 0"), F.col("source")).alias("p"))
    new = d.where("doc_id % 6 <> 0").select("doc_id", F.when(F.expr("doc_id % 2 = 0"), "").otherwise(F.upper("lang")).alias("t"), F.when(F.expr("doc_id % 7 = 0"), F.col("source")).alias("p"))
    return M.merged_choices(old, new, ["doc_id"], "t", "p")


@query("""
WITH q AS (SELECT o_orderkey, n, min(l_partkey) AS v FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS n) LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = n GROUP BY ALL)
SELECT o_orderkey, n AS l_linenumber, coalesce(CAST(v AS VARCHAR), '[missing]') AS l_partkey, v IS NULL AS placeholder FROM q""")
def spine_join(orders, lineitem):
    return M.spine(orders, lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", 5, "l_partkey", "[missing]").select("o_orderkey", "l_linenumber", "l_partkey", "placeholder")


@query("""
SELECT 'missing' AS finding, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
SELECT 'unexpected', count(*) FROM (SELECT DISTINCT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) UNION ALL SELECT 'bad_digest', count(*) FROM labels WHERE quality = 0""")
def file_associations(documents, labels):
    inventory = labels.select("doc_id", F.when(F.col("quality") == 0, "short").otherwise(F.sha2(F.col("doc_id").cast("string"), 256)).alias("digest"))
    return M.associations(documents, inventory, "doc_id", "digest")


@query("""
SELECT o_orderkey, l_linenumber, c_name, n_name, p_name, coalesce(s_name, 'none') AS s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE o_orderstatus = 'P' ORDER BY o_orderkey, l_linenumber, p_name, c_name, s_name""")
def quiz_rows(lineitem, orders, customer, nation, part, supplier):
    star = lineitem.join(orders.where("o_orderstatus = 'P'"), F.expr("l_orderkey = o_orderkey")).join(customer, F.expr("o_custkey = c_custkey")).join(nation, F.expr("c_nationkey = n_nationkey")).join(part, F.expr("l_partkey = p_partkey"))
    out = star.join(supplier.where("s_acctbal > 0"), F.expr("l_suppkey = s_suppkey"), "left").select("o_orderkey", "l_linenumber", "c_name", "n_name", "p_name", F.coalesce("s_name", F.lit("none")).alias("s_name"))
    return out.orderBy("o_orderkey", "l_linenumber", "p_name", "c_name", "s_name")


@query("""
WITH f AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) AS prefix, strpos(url, '?') > 0 AS answer FROM pages)
SELECT q.page_id, min(a.page_id) AS answer_id FROM f q LEFT JOIN f a ON a.prefix = q.prefix AND a.answer AND q.prefix <> '' WHERE NOT q.answer GROUP BY q.page_id""")
def prefix_join(pages):
    from papyra.operators import relational

    files = pages.withColumn("prefix", F.regexp_extract("url", "^([a-z]+://[^?#]*/)", 1)).withColumn("answer", F.instr("url", "?") > 0)
    return relational.prefix_siblings(files, "page_id", "prefix", "answer").select("page_id", "answer_id")
