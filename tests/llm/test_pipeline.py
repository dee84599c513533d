"""The pipeline's stages: what goes, what stays, and the columns."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as P
    from papyra.llm.common import table

    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            assert out.count() == out.select("doc_id").distinct().count() <= kept.count()
        if name == "secrets":
            assert out.count() == kept.count()
        kept = out
    assert P.STAGES[-1][1](spark, kept, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


DDL = "doc_id long, text string, lang string, source string, n_chars long"


def test_unlike_texts_of_one_id_stay(spark):
    import corpus_pipeline as P

    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, "quite another text of some words", "en", "s", 1), (2, b, "en", "t", 1), (None, a, "en", "s", 1), (None, None, "en", "s", 0), (None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, DDL).withColumn("papyra_row", F.lit("mine"))
    got = P.drop_near_duplicates(spark, df, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted([("1", a), ("1", b), ("2", "quite another text of some words"), ("None", "None"), ("None", "")])
    assert all(r.papyra_row == "mine" for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline as P

    odd = [(1, None, None, None, None), (1, "", "en", "s", 0), (3, "token=abcdef123456 and words", "en", "s", 5), (3, "token=abcdef123456 and words", "en", "s", 5), (None, "x " * 100_000, "en", "s", 5)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, DDL)
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            n = out.count()
            assert n == len(rows) if name in ("secrets", "toxicity") else n <= max(2 * len(rows), 1)
        assert P.STAGES[-1][1](spark, docs, SF).count() >= len(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxic_documents_go(spark):
    import corpus_pipeline as P
    from papyra.llm.common import table

    labels = table(spark, "/root/testdata/sf0.1", "labels")
    docs = table(spark, "/root/testdata/sf0.1", "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select(*[c.split()[0] for c in DDL.split(", ")])
    kept = P.drop_toxic(spark, docs, "/root/testdata/sf0.1").select("doc_id").join(labels, "doc_id")
    n = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    left = {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()}
    assert left.get(1, 0) < 0.15 * n[1] and left[0] > 0.99 * n[0]
