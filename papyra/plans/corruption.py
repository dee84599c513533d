"""Registered queries of misread texts: detection by code, and repair by a table of words that the documents themselves give."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import repairs as R
from papyra.functions import text as X
from papyra.plans.registry import query

#: What is written behind a plain text, and the codes that it must give.
_PLANTED = [
    ("", ""), (" 선박Ⅳ형입니다", "ocr_noise"), (" 가1나 다라", "ocr_noise"), (" 제Ⅲ장의 규정", ""), (" 제3항과 12명", ""), (" S0011 and f0llow", "ocr_noise"), (" 오으 것", "ocr_noise"), (" 匁k", "ocr_noise"), (" 수상(水上)", ""), (" [0/해", "broken_unit,unbalanced_delimiter"),
    (" (open", "unbalanced_delimiter"), ("\n@ 가", "damaged_list_marker"), (" ③ ③", "ocr_noise"), (" 모두 몇 개인가 a: b: c: d:", "damaged_list_marker"), (" qzteh misread", "ocr_noise"), (" qzteher", ""), (" 다읔(", "ocr_noise,unbalanced_delimiter"),
]
_CASES = " ".join(f"WHEN {k} THEN '{codes}'" for k, (_, codes) in enumerate(_PLANTED))


@query(f"SELECT doc_id, CASE doc_id % {len(_PLANTED)} {_CASES} END AS codes FROM documents")
def planted_quality_codes(documents):
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " ")
    behind = F.get(F.array(*[F.lit(t) for t, _ in _PLANTED]), (F.col("doc_id") % len(_PLANTED)).cast("int"))
    return documents.select("doc_id", F.array_join(X.quality_codes(F.concat(plain, behind), words=["qzteh"]), ",").alias("codes"))


#: Entries of the table of repairs, which every task holds.
_ENTRIES = 2000


@query(rf"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '[oli]') AND length(word) > 3 GROUP BY word ORDER BY n DESC, word LIMIT {_ENTRIES}),
m AS (SELECT translate(word, 'oli', '011') AS old, min(word) AS new FROM c GROUP BY 1),
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'oli', '011'), '[0-9A-Za-z]+|[^0-9A-Za-z]+') AS tokens FROM documents), u AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM t),
r AS (SELECT doc_id, string_agg(coalesce(new, token), '' ORDER BY i) AS repaired, count(new) AS hits FROM u LEFT JOIN m ON token = old GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(repaired, '')) AS repaired, coalesce(hits, 0) > 0 AS known FROM documents d LEFT JOIN r USING (doc_id)""")
def repaired_words(documents):
    damaged = lambda c: F.translate(c, "oli", "011")
    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).where("word rlike '[oli]' and length(word) > 3")
    common = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(_ENTRIES)
    table = {r.old: r.new for r in common.groupBy(damaged(F.col("word")).alias("old")).agg(F.min("word").alias("new")).collect()}
    text = damaged(F.coalesce("text", F.lit("")))
    return documents.select("doc_id", F.md5(R.repaired(text, table)).alias("repaired"), R.known(text, table).alias("known"))
