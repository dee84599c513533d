"""Registered queries of a bank's upkeep, of papers and of payload counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import geometry as G
from papyra.functions import payloads as P
from papyra.functions import repairs as R
from papyra.functions import text as X
from papyra.operators import bank as B
from papyra.operators import papers
from papyra.plans.payloads import _tables
from papyra.plans.registry import query


@query("""
WITH b AS (SELECT c_custkey AS id, c_name AS k, c_acctbal AS v, c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT c_name AS k, c_acctbal + 1 AS v, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS note FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)
SELECT coalesce(b.k, i.k) AS k, round(CASE WHEN i.k IS NULL THEN b.v ELSE i.v END, 2) AS v, CASE WHEN i.k IS NULL THEN b.note ELSE coalesce(i.note, b.note) END AS note, CASE WHEN b.id IS NOT NULL THEN b.id ELSE -1 END AS id FROM b FULL JOIN i ON b.k = i.k""")
def saved_rows(customer):
    base = customer.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("note"))
    new = customer.where("c_custkey % 2 = 0 or c_custkey % 3 = 0")
    made = lambda seq, more: new.select(F.col("c_name").alias("k"), (F.col("c_acctbal") + more).alias("v"), F.when(F.expr("c_custkey % 2 = 0"), "new").alias("note"), F.lit(seq).alias("seq"))
    out = B.saved(base, made(1, 9).union(made(2, 1)), ["k"], keep=["note"])
    top = base.agg(F.max("id").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("k", F.round("v", 2).alias("v"), "note", F.when(F.col("id") > F.col("top"), -1).otherwise(F.col("id")).alias("id"))  # a single row


@query("""
WITH q AS (SELECT *, turn // 4 AS section FROM conversations)
SELECT row_number() OVER w AS display_number, conv_id, turn, CASE WHEN role IS DISTINCT FROM lag(role) OVER w OR section IS DISTINCT FROM lag(section) OVER w THEN 'P' || role END AS printed FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY section, turn)""")
def exam_sheet(conversations):
    rows = conversations.withColumn("passage", F.concat(F.lit("P"), "role")).withColumn("section", F.expr("turn div 4"))
    return B.exam_sheet(rows, "conv_id", "section", ["turn"], "role", "passage").select("display_number", "conv_id", "turn", "printed")


@query("""
WITH f AS (SELECT p_name || p_partkey || '.PNG' AS path, sha256(p_brand) AS digest FROM part WHERE p_partkey % 2 = 0), w AS (SELECT DISTINCT p_name || p_partkey || '.PNG' AS path FROM part WHERE p_partkey % 3 = 0)
SELECT 'mapping' AS part, w.path, substr(digest, 1, 20) || '.png' AS stored_as FROM w JOIN f USING (path) UNION ALL SELECT 'missing', path, NULL FROM w WHERE path NOT IN (SELECT path FROM f)
UNION ALL SELECT 'contents', min(w.path), substr(digest, 1, 20) || '.png' FROM w JOIN f USING (path) GROUP BY digest""")
def package_manifest(part):
    path = F.concat("p_name", F.col("p_partkey").cast("string"), F.lit(".PNG"))
    files = part.where("p_partkey % 2 = 0").select(path.alias("path"), F.sha2("p_brand", 256).alias("digest"))
    made = B.package(part.where("p_partkey % 3 = 0").select(path.alias("ref")), files, "ref", "path", "digest")
    shown = lambda name, last: made[name].select(F.lit(name).alias("part"), "path", last.alias("stored_as"))
    return shown("mapping", F.col("stored_as")).union(shown("missing", F.lit(None).cast("string"))).union(shown("contents", F.col("stored_as")))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'data/' || s_suppkey ELSE 'old/' || s_suppkey END AS ref, CASE WHEN s_suppkey % 3 = 0 THEN '{"a":1,"image_path":"' ELSE '{"a": 1, "image_path" : "' END || CASE WHEN s_suppkey % 2 = 0 THEN 'data/' || s_suppkey ELSE 'old/' || s_suppkey END || '","b":{"image_path":"none"}}' AS payload FROM supplier""")
def portable_refs(supplier):
    old = F.concat(F.lit("old/"), F.col("s_suppkey").cast("string"))
    rows = supplier.select("s_suppkey", old.alias("ref"), F.concat(F.when(F.expr("s_suppkey % 3 = 0"), '{"a":1,"image_path":"').otherwise('{"a": 1, "image_path" : "'), old, F.lit('","b":{"image_path":"none"}}')).alias("payload"))
    mapping = supplier.where("s_suppkey % 2 = 0").select(old.alias("path"), F.concat(F.lit("data/"), F.col("s_suppkey").cast("string")).alias("to"))
    return B.portable_payloads(B.portable(rows, "ref", mapping, "path", "to"), "s_suppkey", "payload", mapping, "path", "to")


@query("""
WITH k AS (SELECT p_partkey AS q, p_type AS subject, CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE p_partkey % 4 + 1 END AS r FROM part), a AS (SELECT l_orderkey AS attempt, l_partkey AS q, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_suppkey % 4 + 1 END AS given FROM lineitem)
SELECT attempt, subject, count(*) AS total, count(given) AS answered, count(*) FILTER (given IS NOT NULL AND (given = r OR r = -1)) AS correct, round(count(*) FILTER (given IS NOT NULL AND (given = r OR r = -1)) * 100.0 / count(*), 1) AS score FROM a JOIN k USING (q) GROUP BY attempt, subject""")
def practice_attempts(lineitem, part):
    key = part.select(F.col("p_partkey").alias("q"), F.col("p_type").alias("subject"), F.when(F.expr("p_partkey % 10 = 0"), -1).otherwise(F.expr("p_partkey % 4 + 1")).alias("right"))
    answers = lineitem.select(F.col("l_orderkey").alias("attempt"), F.col("l_partkey").alias("q"), F.when(F.col("l_tax") <= 0.06, F.expr("l_suppkey % 4 + 1")).alias("given"))
    return B.attempts(answers, key, "attempt", "q", "subject")


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS snapshot FROM nation""")
def snapshots(nation):
    return B.snapshot(nation, "n_nationkey", ["n_nationkey", "n_name"])


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), e AS (SELECT c_custkey AS a, unnest([c_custkey * 2 % n, (c_custkey * 3 + 1) % n]) AS b FROM customer, n),
w(p, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT b, depth + 1 FROM w JOIN e ON a = p WHERE depth < 12), f AS (SELECT p, min(depth) AS depth FROM w GROUP BY p)
SELECT p AS page, CAST(depth AS BIGINT) AS depth FROM f ORDER BY depth, p LIMIT 40""")
def crawl(customer):
    n = customer.agg(F.count("*").alias("n"))
    links = customer.crossJoin(F.broadcast(n)).select(F.col("c_custkey").alias("page"), F.explode(F.array(F.expr("c_custkey * 2 % n"), F.expr("(c_custkey * 3 + 1) % n"))).alias("target"))  # a single row
    start = customer.where("c_custkey = 1").select(F.col("c_custkey").alias("page"))
    return B.crawled(start, links, "page", "target", 40).withColumn("depth", F.col("depth").cast("long"))


@query("SELECT host, number, arg_max(url, (place, url)) AS url FROM (SELECT page_id % 7 AS place, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INT) AS number, url FROM pages) WHERE number >= 1 GROUP BY ALL")
def pagination(pages):
    return B.paginated(pages.select(X.url_host(F.col("url")).alias("host"), "url", F.expr("page_id % 7").alias("place")), "host", "url", "[?&]page=([0-9]+)")


@query("""
WITH b AS (SELECT p_partkey, least(p_size - 10, 30)::DOUBLE AS x0, greatest(p_size - 10, 30)::DOUBLE AS x1, 0.0::DOUBLE AS y0, (p_partkey % 50)::DOUBLE AS y1 FROM part),
c AS (SELECT *, greatest(0, least(25, x0)) AS u0, greatest(0, least(25, x1)) AS u1, greatest(0, least(20, y1)) AS v1 FROM b)
SELECT p_partkey, (x1 - x0) * (y1 - y0) AS area, (u1 - u0) * v1 AS clamped, round(CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(least(x1, 20) - greatest(x0, 5), 0) * greatest(least(y1, 10) - 0, 0) / ((x1 - x0) * (y1 - y0)) ELSE 0 END, 9) AS share FROM c""")
def boxes(part):
    d = lambda c: c.cast("double")
    b = G.box(d(F.col("p_size") - 10), F.lit(0.0), F.lit(30.0), d(F.col("p_partkey") % 50))
    other = G.box(F.lit(5.0), F.lit(0.0), F.lit(20.0), F.lit(10.0))
    rows = part.select("p_partkey", b.alias("b"))
    return rows.select("p_partkey", G.area(F.col("b")).alias("area"), G.area(G.clamped(F.col("b"), 25, 20)).alias("clamped"), F.round(G.share(F.col("b"), other), 9).alias("share"))


@query("SELECT p_partkey, CAST(len(list_filter(string_split(p_name, ''), lambda c: c IN (' ', 'i', 'l', 'I'))) * 0.5 + len(list_filter(string_split(p_name, ''), lambda c: c NOT IN (' ', 'i', 'l', 'I'))) AS DOUBLE) AS units, lower(p_name) AS plain, regexp_replace(lower(p_name), '[ _-]+', '', 'g') AS label, translate(p_name, 'rw', 'RW') AS mapped, replace(regexp_replace(p_name, '(^|[^0-9A-Za-z])red($|[^0-9A-Za-z])', '\\1RED\\2'), 'ring', 'RING') AS repaired FROM part")
def text_repairs(part):
    name = F.col("p_name")
    return part.select("p_partkey", X.display_units(name).alias("units"), X.nfkc(name).alias("plain"), X.label(name).alias("label"), X.mapped(name, {"r": "R", "w": "W"}).alias("mapped"), R.repaired(name, {"red": "RED"}, {"ring": "RING"}).alias("repaired"))


@query("""
WITH e AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'invalid_correct_answer: x' WHEN 1 THEN 'Answer mismatch for question 3' WHEN 2 THEN 'choice_count: 3' WHEN 3 THEN 'numbers not contiguous' WHEN 4 THEN 'ambiguous range' WHEN 5 THEN 'missing image' WHEN 6 THEN 'timeout: 30 s' ELSE ' ' END AS error FROM documents)
SELECT CASE doc_id % 8 WHEN 0 THEN 'invalid_correct_answer' WHEN 1 THEN 'answer_key_count_mismatch' WHEN 2 THEN 'choice_count' WHEN 3 THEN 'question_numbers_not_contiguous' WHEN 4 THEN 'ambiguous_group_range' WHEN 5 THEN 'missing_question_image' WHEN 6 THEN 'timeout' ELSE '<blank>' END AS class, count(*) AS n FROM e GROUP BY 1""")
def error_classes(documents):
    kinds = ["invalid_correct_answer: x", "Answer mismatch for question 3", "choice_count: 3", "numbers not contiguous", "ambiguous range", "missing image", "timeout: 30 s", " "]
    error = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 8).cast("int"))
    return documents.groupBy(X.error_class(error).alias("class")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'notice' WHEN doc_id % 3 = 1 THEN 'answer' WHEN length(text) > 500 THEN 'question' ELSE 'unknown' END AS role,
  CASE WHEN doc_id % 5 = 0 THEN 'has_clean_text' WHEN doc_id % 5 = 1 THEN 'ocr_required' WHEN doc_id % 5 = 2 THEN 'empty_or_unreadable_pdf' WHEN length(text) >= 500 THEN 'text_non_exam_or_answer_only' ELSE 'unknown_no_text' END AS reason FROM documents""")
def document_roles(documents):
    k, n = F.col("doc_id"), F.length("text")
    path = F.when(k % 3 == 0, "2024/채용 시험 공고.pdf").when(k % 3 == 1, "정답/a.pdf").otherwise("x/b.pdf")
    marks = F.when(n > 500, 5).otherwise(0)
    raw = F.when((k % 5).isin(1, 2), 0).otherwise(n)
    return documents.select("doc_id", X.document_role(path, marks, marks, F.lit(0)).alias("role"), X.no_text_case(raw, F.when(k % 5 == 0, 1).otherwise(0), F.when(k % 5 == 1, 1).otherwise(0), F.lit(0), F.lit(0)).alias("reason"))


@query("""
SELECT CASE WHEN p_partkey % 5 = 0 THEN 'native' WHEN p_size / 50 >= 0.9 AND p_partkey % 3 <> 0 THEN 'native' ELSE 'image' END AS mode, count(*) AS tables, count(*) FILTER (p_size > 30 OR p_size = 0 OR p_size % 4 + 1 > 2) AS with_findings FROM part GROUP BY 1""")
def table_counters(part):
    made = _tables(part).select(P.render_mode(F.col("t"), F.lit("auto")).alias("mode"), (F.size(P.table_codes(F.col("t"), F.lit("text"), 30, 40)) > 0).alias("bad"))
    return made.groupBy("mode").agg(F.count("*").alias("tables"), F.count_if("bad").alias("with_findings"))


def _papers(orders, lineitem):
    """A paper an order: its lineitems of distinct numbers as questions of four choices, the answer filled or in the tail. Orders and lineitems are dealt once, before they are lines."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("p").isNull().alias("none"), "p")
    none = F.lit(None)
    lines = lineitem.select(F.col("l_orderkey").alias("doc"), "l_linenumber", F.col("l_partkey").alias("p"), none.cast("string").alias("said"), F.lit(False).alias("heads"))
    heads = orders.select(F.col("o_orderkey").alias("doc"), none.cast("int").alias("l_linenumber"), none.cast("long").alias("p"), F.col("o_orderpriority").alias("said"), F.lit(True).alias("heads"))
    tasks = max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * orders.sparkSession.sparkContext.defaultParallelism)
    dealt = heads.unionByName(lines).where("doc is not null").repartition(tasks, "doc")
    whole = dealt.groupBy("doc").agg(F.sort_array(F.collect_list(F.when(~F.col("heads"), item))).alias("items"), F.max("said").alias("said"), F.bool_or("heads").alias("heads"))
    whole = whole.withColumn("items", F.filter("items", lambda x, i: (i == 0) | ~x["n"].eqNullSafe(F.get("items", i - 1)["n"])))  # the first of a number has its smallest part

    doc, line = F.col("doc"), lambda place, text: F.struct(place.cast("int").alias("place"), text.alias("text"))
    answer = lambda x: (x["p"] % 4).cast("int")
    mark = lambda x, i: F.when((doc % 2 != 0) & (answer(x) == i), papers.FILLED[i]).otherwise(papers.OPEN[i])

    def asked(x):
        texts = [F.concat(x["n"].cast("string"), F.lit(". What is part "), x["p"].cast("string"), F.lit("?")), F.concat(F.lit("  "), mark(x, 0), F.lit(" one "), mark(x, 1), F.lit("  two")), F.concat(mark(x, 2), F.lit(" three")), F.lit("more"), F.concat(mark(x, 3), F.lit(" four"))]
        return F.array(*[line(x["n"] * 10 + k, text) for k, text in enumerate(texts)])

    joined = lambda of: F.array_join(F.transform("items", of), " ")
    tail = F.array(line(F.lit(9000), F.lit(papers.TAIL[0])), line(F.lit(9001), joined(lambda x: x["n"].cast("string"))), line(F.lit(9002), joined(lambda x: F.get(F.array(*[F.lit(m) for m in papers.OPEN]), answer(x)))))
    head = F.array(line(F.lit(1), F.concat(F.lit("1과목 : "), "said")), line(F.lit(2), F.lit("[문제 1~2] 다음 글을 읽고 물음에 답하시오.")))
    some = lambda lines, condition: F.when(condition, lines).otherwise(F.array())
    text = F.concat(some(head, F.col("heads")), F.flatten(F.transform("items", asked)), some(tail, (doc % 2 == 0) & (F.size("items") > 0)))
    return whole.select("doc", F.sort_array(text).alias("lines"))


@query("""
WITH q AS (SELECT l_orderkey AS doc, l_linenumber AS number, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT doc, number, o_orderpriority AS subject, 'What is part ' || p || '?' AS text, '1.one 2.two 3.three more 4.four' AS choices, CAST(p % 4 + 1 AS INT) AS answer, number <= 2 AS grouped FROM q JOIN orders ON o_orderkey = doc""")
def parsed_papers(orders, lineitem):
    found = papers.parsed_papers(_papers(orders, lineitem))["questions"]
    shown = F.array_join(F.transform("choices", lambda c: F.concat_ws(".", c["number"].cast("string"), c["text"])), " ")
    return found.select("doc", "number", "subject", "text", shown.alias("choices"), "answer", F.col("group").isNotNull().alias("grouped"))


@query(r"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS n, regexp_split_to_array(text, '[0-9]+') AS p FROM documents)
SELECT doc_id, i - 1 AS place, TRY_CAST(n[i] AS INT) AS number, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(p[i + 1], '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) AS segment FROM s, unnest(range(1, len(n) + 1)) t(i)""")
def page_segments(documents):
    found = papers.segments(documents.withColumn("page", F.lit(1)), "doc_id", "page", "text", r"([0-9]+)")
    return found.select("doc_id", "place", "number", F.md5("segment").alias("segment"))


@query("""
WITH q AS (SELECT l_orderkey AS exam, CAST(l_linenumber AS INT) AS number, bool_or(l_quantity > 20) AS keep FROM lineitem GROUP BY ALL), g AS (SELECT o_orderkey AS exam, 'g' || k AS grp, CASE k WHEN 1 THEN [1, 2] ELSE [5, 3, 4] END AS children FROM orders, unnest([1, 2]) t(k))
SELECT g.exam, grp AS "group", array_to_string(list_filter(children, lambda x: list_contains(held, x)), ',') AS children FROM g JOIN (SELECT exam, list(number) FILTER (keep) AS held FROM q GROUP BY exam) h ON h.exam = g.exam WHERE list_has_any(children, held)""")
def fragment_groups(orders, lineitem):
    q = lineitem.groupBy(F.col("l_orderkey").alias("exam"), F.col("l_linenumber").alias("number")).agg(F.bool_or(F.col("l_quantity") > 20).alias("keep"))
    questions = q.select("exam", "number", F.when(F.col("keep"), "t").otherwise(" ").alias("text"), F.expr("cast(array() as array<string>)").alias("choices"))
    groups = orders.select(F.col("o_orderkey").alias("exam"), F.explode(F.array(F.struct(F.lit("g1").alias("group"), F.array(F.lit(1), F.lit(2)).alias("children")), F.struct(F.lit("g2").alias("group"), F.array(F.lit(5), F.lit(3), F.lit(4)).alias("children")))).alias("g")).select("exam", "g.*")
    kept = B.without_fragments(questions, groups, "exam")[1]
    return kept.select("exam", "group", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query("SELECT p_partkey, 'source' AS column FROM (SELECT p_partkey FROM part WHERE p_size = 7) UNION ALL SELECT p_partkey, 'row' FROM part WHERE p_partkey % 97 = 0 AND p_size <> 7 UNION ALL SELECT p_partkey, 'row' FROM part WHERE p_partkey % 97 = 0 AND p_size = 7 EXCEPT SELECT p_partkey, 'source' FROM part WHERE p_partkey % 97 = 0")
def migration_diff(part):
    rows = part.select("p_partkey", "p_size", F.col("p_brand").alias("source"), F.col("p_name").alias("text"))
    change = lambda df: df.where("p_partkey % 97 <> 0").withColumn("text", F.upper("text")).withColumn("source", F.when(F.col("p_size") == 7, "other").otherwise(F.col("source")))
    return B.migrated(rows, "p_partkey", ["text"], change)[1]


@query(r"""
WITH h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2 0 1 8년 상 반기 제 2 회 순경' WHEN 1 THEN '2031 하반기 제3차 해양경찰' WHEN 2 THEN 'x' ELSE '2020년 하 발기 국민 xx 안전처 ' END || ' ' || lang AS t FROM documents)
SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 2018 WHEN 3 THEN 2020 END AS INT) AS year, CASE doc_id % 4 WHEN 0 THEN '상반기' WHEN 1 THEN '하반기' WHEN 2 THEN '' ELSE '하반기' END AS period, CASE doc_id % 4 WHEN 0 THEN '제2회' WHEN 1 THEN '제3차' ELSE '' END AS session,
  CASE doc_id % 4 WHEN 0 THEN '순경' WHEN 1 THEN '해양경찰 채용' WHEN 2 THEN '채용구분 미상' ELSE '국민안전처' END AS category FROM h""")
def page_heads(documents):
    heads = ["2 0 1 8년 상 반기 제 2 회 순경", "2031 하반기 제3차 해양경찰", "x", "2020년 하 발기 국민 xx 안전처 "]
    text = F.concat(F.get(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 4).cast("int")), F.lit(" "), "lang")
    return documents.select("doc_id", X.page_head(text).alias("h")).select("doc_id", "h.*")


@query("""
WITH r AS (SELECT p_partkey, [[p_name, p_brand], [p_type]] AS rows FROM part)
SELECT p_partkey, array_to_string([p_name, p_brand, p_type, ''], '|') AS full, array_to_string(['', '', p_name, p_brand, p_type], '|') AS inserted, p_type AS deleted, array_to_string([p_brand], '|') AS first_cut FROM part""")
def table_algebra(part):
    rows = F.array(F.array("p_name", "p_brand"), F.array("p_type"))
    shown = lambda r: F.array_join(F.flatten(r), "|")
    r = part.select("p_partkey", rows.alias("r"))
    return r.select("p_partkey", shown(P.rectangular(F.col("r"))).alias("full"), shown(P.with_row(F.col("r"), F.lit(0), F.lit(2))).alias("inserted"), shown(P.without_row(F.col("r"), F.lit(0))).alias("deleted"), shown(P.without_column(F.col("r"), F.lit(0))).alias("first_cut"))


@query("""SELECT p_partkey, '(가) ' || p_name || ' / (나) ' || p_brand AS text, '[["(가)","(나)"],["' || p_name || '","' || p_brand || '"]]' AS rows FROM part""")
def aligned_choices(part):
    made = P.aligned_choice(F.array(F.lit("(가)"), F.lit("(나)")), F.array("p_name", F.concat(F.lit(" "), "p_brand")))
    return part.select("p_partkey", made.alias("a")).select("p_partkey", "a.text", F.get_json_object("a.payload", "$.tables[0].rows").alias("rows"))


@query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]+)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="(/[^"]+)">([^<]*)</a>', 2) AS t FROM pages), l AS (SELECT page_id, i, h[i] AS href, t[i] AS text FROM a, unnest(range(1, len(h) + 1)) u(i))
SELECT regexp_extract(href, '^/(.)(.+)$', 1) AS board, regexp_extract(href, '^/(.)(.+)$', 2) AS document, arg_min(text, (page_id, i)) AS text FROM l WHERE regexp_matches(href, '^/(.)(.+)$') GROUP BY 1, 2""")
def board_documents(pages):
    from papyra.sources import tables as S

    return B.boards(S.links(pages), "page_id", "^/(.)(.+)$")
