"""Registered queries of validators and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import gates, quality
from papyra.operators import validators as V
from papyra.plans.registry import query

SYMBOLS = {1: ["A", "a", "1"], 2: ["B", "b", "2"], 3: ["R", "r", "3"], 4: ["N", "n", "4"]}
HINT = r"(?i)red|fig\."

#: Orders as questions whose choices are their lineitems; odd values are made from the keys.
_SQL = """
c AS (SELECT l_orderkey AS k, list({'number': l_linenumber, 'symbol': l_returnflag, 'text': CASE WHEN l_quantity < 3 THEN ' ' ELSE 'x' END, 'image': CASE WHEN l_tax > 0.07 THEN 'i.png' END} ORDER BY l_linenumber, l_partkey) AS choices FROM lineitem GROUP BY 1),
q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN '[OCR 누락] 3' WHEN o_orderkey % 19 = 0 THEN 'see fig. 2' ELSE o_orderpriority END AS text, CAST(o_orderkey % 103 AS INT) AS session, CAST(o_orderkey % 520 AS INT) AS number,
  CASE WHEN o_orderkey % 11 = 0 THEN 'descriptive' END AS type, CASE WHEN o_orderkey % 2 = 0 THEN 'm' END AS model_answer, coalesce(choices, []) AS choices, CAST(o_orderkey % 6 AS INT) AS correct, o_orderkey % 7 <> 0 AS answer_available, o_orderkey % 23 = 0 AS has_image,
  CASE WHEN o_orderkey % 46 = 0 THEN 'q.png' END AS image, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE '#5-LOW, # ' || o_orderstatus END AS tags, o_orderpriority AS exam_name, o_orderstatus AS subject_name FROM orders LEFT JOIN c ON k = o_orderkey),
n AS (SELECT *, list_transform(choices, lambda x: x.number) AS numbers, len(choices) AS size, coalesce(type = 'descriptive', false) AS des, trim(coalesce(image, '')) <> '' AS img, len(list_filter(choices, lambda x: trim(coalesce(x.image, '')) <> '')) > 0 AS cimg FROM q)"""


def _questions(orders, lineitem):
    k = F.col("o_orderkey")
    choice = F.struct(F.col("l_linenumber").alias("number"), F.col("l_returnflag").alias("symbol"), F.when(F.col("l_quantity") < 3, " ").otherwise("x").alias("text"), F.when(F.col("l_tax") > 0.07, "i.png").alias("image"))
    choices = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(choice)).alias("choices"))
    text = F.when(k % 13 == 0, "  ").when(k % 17 == 0, "[OCR 누락] 3").when(k % 19 == 0, "see fig. 2").otherwise(F.col("o_orderpriority"))
    return orders.join(choices, "o_orderkey", "left").select(
        k.alias("k"), text.alias("text"), (k % 103).cast("int").alias("session"), (k % 520).cast("int").alias("number"), F.when(k % 11 == 0, "descriptive").alias("type"), F.when(k % 2 == 0, "m").alias("model_answer"), "choices", (k % 6).cast("int").alias("correct"),
        (k % 7 != 0).alias("answer_available"), (k % 23 == 0).alias("has_image"), F.when(k % 46 == 0, "q.png").alias("image"), F.when(k % 29 != 0, F.concat(F.lit("#5-LOW, # "), F.col("o_orderstatus"))).alias("tags"), F.col("o_orderpriority").alias("exam_name"), F.col("o_orderstatus").alias("subject_name"),
    )


@query(f"""
WITH {_SQL}, f AS (SELECT k, unnest(list_filter([
  CASE WHEN trim(text) = '' THEN 'empty_question_text' END, CASE WHEN starts_with(text, '[OCR 누락]') THEN 'ocr_placeholder' END, CASE WHEN session NOT BETWEEN 1 AND 99 THEN 'invalid_session' END, CASE WHEN number NOT BETWEEN 1 AND 500 THEN 'invalid_question_number' END,
  CASE WHEN des AND model_answer IS NULL THEN 'missing_model_answer' END, CASE WHEN NOT des AND answer_available AND NOT list_contains(numbers, correct) THEN 'invalid_correct_answer' END, CASE WHEN NOT des AND NOT answer_available AND correct <> 0 THEN 'invalid_answer_state' END,
  CASE WHEN NOT des AND NOT (size BETWEEN 4 AND 10 AND list_sort(numbers) = range(1, size + 1)) THEN 'choice_count' END,
  CASE WHEN NOT des AND len(list_filter(choices, lambda x: x.number <= 4 AND NOT list_contains(CASE x.number WHEN 1 THEN ['A', 'a', '1'] WHEN 2 THEN ['B', 'b', '2'] WHEN 3 THEN ['R', 'r', '3'] ELSE ['N', 'n', '4'] END, x.symbol))) > 0 THEN 'invalid_choice_symbol' END,
  CASE WHEN NOT des AND NOT img AND len(list_filter(choices, lambda x: trim(x.text) = '' AND x.image IS NULL)) > 0 THEN 'empty_choice_text' END, CASE WHEN has_image AND NOT img AND NOT cimg THEN 'missing_image_path' END,
  CASE WHEN regexp_matches(text, '(?i)red|fig\\.') AND NOT img AND NOT cimg THEN 'missing_required_image' END, CASE WHEN tags IS NULL THEN 'empty_tags' END,
  CASE WHEN tags IS NOT NULL AND strpos(replace(tags, ' ', ''), '#' || replace(exam_name, ' ', '')) = 0 THEN 'missing_exam_tag' END, CASE WHEN tags IS NOT NULL AND strpos(replace(tags, ' ', ''), '#' || replace(subject_name, ' ', '')) = 0 THEN 'missing_subject_tag' END], lambda x: x IS NOT NULL)) AS code FROM n)
SELECT k, code, CASE WHEN code LIKE '%_tag' OR code = 'empty_tags' THEN 'warning' ELSE 'error' END AS severity FROM f""")
def question_findings(orders, lineitem):
    return quality.findings(_questions(orders, lineitem), "k", V.question_rules(SYMBOLS, HINT))


@query(f"""
WITH {_SQL}, f AS (SELECT k, unnest(list_filter([CASE WHEN trim(text) = '' THEN 'blank_question_text' END, CASE WHEN NOT (size IN (4, 5) AND list_sort(numbers) = range(1, size + 1)) THEN 'choice_count' END, CASE WHEN NOT list_contains(numbers, correct) THEN 'invalid_correct_answer' END,
  CASE WHEN len(list_filter(choices, lambda x: trim(x.text) = '')) > 0 THEN 'blank_choice_text' END, CASE WHEN (has_image OR regexp_matches(text, '(?i)red|fig\\.')) AND NOT img AND NOT cimg THEN 'missing_question_image' END], lambda x: x IS NOT NULL)) AS code FROM n)
SELECT k, count(*) AS n, string_agg(code, ',' ORDER BY code) AS codes, 'error' AS severity FROM f GROUP BY k""")
def web_gate(orders, lineitem):
    return quality.rolled_up(quality.findings(_questions(orders, lineitem), "k", V.web_rules(HINT)), "k")


@query("""
WITH g AS (SELECT o_custkey AS exam, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'g' || o_orderkey % 4 END AS grp, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 5 AS INT) END AS first, CAST(2 + o_orderkey % 4 AS INT) AS last FROM orders),
q AS (SELECT DISTINCT o_custkey AS exam, CAST(l_linenumber AS INT) AS number, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'g' || l_linenumber % 5 END AS grp, CAST(l_linenumber - 1 AS INT) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT *, range(1, 3) AS children FROM g WHERE grp <> ''), r AS (SELECT * FROM n WHERE first <= last),
h AS (SELECT r.exam, r.grp, r.first, r.last, number, q.grp AS assigned FROM r JOIN q ON q.exam = r.exam AND number BETWEEN r.first AND r.last),
a AS (SELECT exam, grp, list_sort(list(number)) AS held, bool_or(assigned IS DISTINCT FROM grp) AS strange FROM h GROUP BY ALL)
SELECT DISTINCT exam, grp AS "group", code FROM (
  SELECT exam, grp, 'group_missing_id' AS code FROM g WHERE grp = '' UNION ALL SELECT exam, grp, 'duplicate_group_id' FROM n GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT exam, grp, 'group_range_missing' FROM n WHERE first IS NULL
  UNION ALL SELECT exam, grp, 'group_range_order' FROM n WHERE first > last UNION ALL SELECT r.exam, r.grp, 'group_child_mismatch' FROM r LEFT JOIN a USING (exam, grp) WHERE [1, 2] IS DISTINCT FROM coalesce(held, [])
  UNION ALL SELECT exam, grp, 'group_assignment_mismatch' FROM a WHERE strange UNION ALL SELECT q.exam, q.grp, 'unknown_group_id' FROM q WHERE q.grp IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.exam = q.exam AND n.grp = q.grp)
  UNION ALL SELECT exam, grp, 'invalid_group_order' FROM q WHERE grp IS NOT NULL AND place < 1)""")
def group_findings(orders, lineitem):
    k = F.col("o_orderkey")
    groups = orders.select(
        F.col("o_custkey").alias("exam"), F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("g"), (k % 4).cast("string"))).alias("group"), F.when(k % 37 != 0, (1 + k % 5).cast("int")).alias("first"), (2 + k % 4).cast("int").alias("last"), F.array(F.lit(1), F.lit(2)).alias("children")
    )
    n = F.col("l_linenumber")
    questions = lineitem.join(orders, F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("exam"), n.alias("number"), F.when(n % 3 != 0, F.concat(F.lit("g"), (n % 5).cast("string"))).alias("group"), (n - 1).alias("place")).distinct()
    return V.group_findings(groups, questions, "exam")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber AS n, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT l_orderkey, array_to_string(list_filter(range(1, 6), lambda x: NOT list_contains(list(n), x)), ',') AS missing, coalesce(string_agg(CASE WHEN c > 1 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n), '') AS doubles,
  coalesce(string_agg(CASE WHEN n > 5 THEN CAST(n AS VARCHAR) END, ',' ORDER BY n), '') AS unexpected FROM p GROUP BY l_orderkey""")
def set_findings(lineitem):
    return V.set_findings(lineitem, "l_orderkey", "l_linenumber", 5)


@query("""
SELECT 'duplicate_key' AS finding, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
SELECT 'blank_tag', count(*) FILTER (l_quantity < 4) FROM lineitem UNION ALL SELECT 'blank_l_returnflag', count(*) FILTER (trim(l_returnflag) = '') FROM lineitem""")
def master_findings(lineitem):
    rows = lineitem.withColumn("key", F.struct("l_orderkey", "l_linenumber")).withColumn("tag", F.when(F.col("l_quantity") >= 4, "t").otherwise(" "))
    return V.master_findings(rows, "key", ["tag", "l_returnflag"])


@query("""
SELECT 'orphan' AS code, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000) UNION ALL SELECT 'placeholder', count(*) FROM part WHERE p_name LIKE 'zz%' UNION ALL
SELECT 'duplicate', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def staging_findings(lineitem, orders, part):
    orphan = lineitem.join(orders.where("o_totalprice > 1000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti")
    double = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("c")).where("c > 1")
    return V.staging_findings([("orphan", orphan), ("placeholder", part.where(F.col("p_name").startswith("zz"))), ("duplicate", double)])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_quantity < 5 THEN 'short' END, CASE WHEN l_tax > 0.06 THEN 'taxed' END, CASE WHEN l_discount < 0.07 THEN 'low_confidence' END) AS reasons, l_quantity >= 5 AND l_tax <= 0.06 AND l_discount >= 0.07 AS accepted FROM lineitem""")
def candidate_gate(lineitem):
    rows = lineitem.withColumn("confidence", F.col("l_discount") * 10)
    made = V.gate(rows, [("short", F.col("l_quantity") < 5), ("taxed", F.col("l_tax") > 0.06), ("short", F.col("l_quantity") < 2)], "confidence", 0.7 - 1e-9)
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", ",").alias("reasons"), "accepted")


@query("""
WITH w AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT -1, 'en', 'web'),
r AS (SELECT doc_id AS k, lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id % 30 = 0), n AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM r)
SELECT DISTINCT w.k, CASE WHEN coalesce(c, 0) <> 1 THEN 'row' ELSE 'lang' END AS field, CASE WHEN coalesce(c, 0) <> 1 THEN '1' ELSE w.lang END AS expected, CASE WHEN coalesce(c, 0) <> 1 THEN CAST(coalesce(c, 0) AS VARCHAR) ELSE n.lang END AS found
FROM w LEFT JOIN n USING (k) WHERE coalesce(c, 0) <> 1 OR w.lang IS DISTINCT FROM n.lang""")
def verified_repairs(documents):
    d = documents.select(F.col("doc_id").alias("k"), "lang", "source")
    lost = documents.sparkSession.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    repairs = d.where("k % 3 = 0").withColumn("lang", F.when(F.expr("k % 5 = 0"), "xx").otherwise(F.col("lang"))).union(lost)
    return V.verified_repairs(repairs, d.union(d.where("k % 30 = 0")), ["k"], ["lang", "source"])


_REVIEW = [("signs", r"%%%|\*\*\*|###"), ("entity", r"&[a-z]+;"), ("address", r"[A-Za-z0-9.]+@[A-Za-z0-9.]+"), ("digits", r"[0-9]{6,}"), ("capital", r"[A-Z]{5,}")]


@query(r"""
WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '%%%|\*\*\*|###') THEN 'signs' END, CASE WHEN regexp_matches(text, '&[a-z]+;') THEN 'entity' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') THEN 'address' END,
  CASE WHEN regexp_matches(text, '[0-9]{6,}') THEN 'digits' END, CASE WHEN regexp_matches(text, '[A-Z]{5,}') THEN 'capital' END], lambda x: x IS NOT NULL)) AS code FROM documents) SELECT doc_id, code, 'review' AS severity FROM f""")
def review_findings(documents):
    return quality.findings(documents, "doc_id", [(code, "review", F.col("text").rlike(p)) for code, p in _REVIEW])


#: What a candidate's fourth choice is, and why it is rejected then; the other three are words of a document.
_FOURTH = [
    ("own words", ""), ("  ", "empty_choice"), ("첨부 파일 참조", "placeholder_choice"), ("7. 다음 글", "contaminated_choice"), ("틀린 것은 ?", "question_text_in_choice"), ("㉦ mark", "damaged_marker_choice"), ("long words of a tail that goes on and on, entirely beyond all others", "choice_tail_contamination"), ("(open", "unbalanced_choice_delimiter"),
]
_FOURTH_CASES = " ".join(f"WHEN {k} THEN '{code}'" for k, (_, code) in enumerate(_FOURTH))


@query(rf"""
WITH w AS (SELECT doc_id, n_chars, list_transform(regexp_extract_all(text, '[a-zA-Z]+')[1:3], lambda x: lower(x)[1:15]) AS words, CASE doc_id % {len(_FOURTH)} {_FOURTH_CASES} END AS planted FROM documents),
r AS (SELECT doc_id, [CASE WHEN planted = 'unbalanced_choice_delimiter' THEN planted END, CASE WHEN len(words) < 3 THEN 'invalid_choice_count' END, CASE WHEN planted NOT IN ('', 'unbalanced_choice_delimiter', 'choice_tail_contamination') THEN CASE WHEN planted = 'empty_choice' OR planted = 'placeholder_choice' THEN planted END END,
  CASE WHEN len(list_distinct(words)) < len(words) THEN 'duplicate_choice' END, CASE WHEN planted IN ('contaminated_choice', 'question_text_in_choice', 'damaged_marker_choice') THEN planted END, CASE WHEN planted = 'choice_tail_contamination' AND len(words) = 3 THEN planted END,
  CASE WHEN n_chars % 10 < 7 THEN 'low_confidence' END, CASE WHEN n_chars % 11 = 0 THEN 'parser_diagnostic' END] AS a FROM w)
SELECT doc_id, array_to_string(list_filter(a, lambda x: x IS NOT NULL), ',') AS reasons FROM r""")
def candidate_reasons(documents):
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), 1, 3), lambda x: F.substring(F.lower(x), 1, 15))
    fourth = F.get(F.array(*[F.lit(t) for t, _ in _FOURTH]), (F.col("doc_id") % len(_FOURTH)).cast("int"))
    said = F.when(F.expr("n_chars % 11 = 0"), F.array(F.lit("odd"))).otherwise(F.array(F.lit("table_choice_recovery")))
    return documents.select("doc_id", F.array_join(gates.reasons(F.lit("which one"), F.concat(words, F.array(fourth)), F.expr("n_chars % 10") / 10.0, said), ",").alias("reasons"))


_REVIEWED = [("", ""), ("", "pua_remaining"), (" x¯ y", "hwp_overbar_marker_review"), ("\t", "linebreak_remaining"), (" 그림에서 에 알맞은", "dangling_blank_reference"), (" 3 4 [m]", "number_unit_order_suspect"), (" [ ] Ω", "blank_unit_suspect"), (" (가) ?", "paren_question_order_suspect"), (" 다읔", "ocr_noise_text"), (" 시간을 3 초과", "suspicious_text_artifact")]
_REVIEWED_CASES = " ".join(f"WHEN {k} THEN '{code}'" for k, (_, code) in enumerate(_REVIEWED))


@query(f"SELECT doc_id, 'text' AS path, CASE doc_id % 10 {_REVIEWED_CASES} END AS category, 'needs_source_review' AS severity FROM documents WHERE doc_id % 10 <> 0")
def source_reviews(documents):
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    behind = F.get(F.array(*[F.lit(t) for t, _ in _REVIEWED]), (F.col("doc_id") % len(_REVIEWED)).cast("int"))
    return gates.review_findings(documents.select("doc_id", F.concat(plain, behind).alias("text")), "doc_id", "text")


@query("""
SELECT [x FOR x IN [
  CASE WHEN EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) THEN 'duplicate_questions' END, 'invalid_question_structure',
  CASE WHEN EXISTS (SELECT 1 FROM orders o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, max(l_linenumber) AS high FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE coalesce(n, 0) <> 4 OR high <> 4) THEN 'missing_question_numbers' END,
  'missing_answers'] IF x IS NOT NULL] AS codes""")
def staged_bank(lineitem, orders):
    keyed = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    questions = lineitem.select(keyed.alias("id"), F.col("l_orderkey").alias("set"), F.col("l_linenumber").cast("int").alias("number"), F.lit("text").alias("text"), (F.col("l_suppkey") % 6).cast("int").alias("answer"), F.lit(1).alias("answered"), F.lit(1).alias("source"))
    # a question's choices are made where its distinct key lies
    choices = lineitem.select(keyed.alias("question")).distinct().select("question", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("number")).withColumn("text", F.col("number").cast("string"))
    return gates.staging_codes(questions, choices, expected=orders.select(F.col("o_orderkey").alias("set"), F.lit(4).alias("n"), F.lit(True).alias("answers_required")))
