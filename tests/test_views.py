"""View blocks that leave a question's text and come back."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import views as V

CASES = [
    ("다음 중 옳은 것은? <보기> ㉠ 가 ㉡ 나", None, "다음 중 옳은 것은?", "<보기>\n㉠ 가 ㉡ 나", True),
    ("다음 <보기> 중 옳은 것은 2 《 보 기 》 ㉠ 가", None, "다음 <보기> 중 옳은 것은?", "《 보 기 》\n㉠ 가", True),
    ("배가 나아가는 것은? 보 기 ㉠ 가", None, "배가 나아가는 것은?", "<보기>\n㉠ 가", True),
    ("배가 나아가는 것은? <보기 ㉠ 가", None, "배가 나아가는 것은?", "<보기>\n㉠ 가", True),
    ("글에서 본 보기 좋은 것", None, "글에서 본 보기 좋은 것", None, False),
    ("다음 <보기>에서 고른 것은? ㉠ 가 ㉡ 나", None, "다음 <보기>에서 고른 것은?", "<보기>\n㉠ 가 ㉡ 나", True),
    ("다음 물음 <보기>", None, "다음 물음", "<보기>", True),
    ("다음", "<보기> 중 옳은 것은? 보 기 ㉠ 가", "다음 <보기> 중 옳은 것은?", "<보기>\n㉠ 가", True),
    ("다음 <보기>", "<보기>에서 옳은 것은 7 ㉠ 가", "다음 <보기>에서 옳은 것은?", "<보기>\n㉠ 가", True),
    ("다음", "<보기> 중 무엇인가요? 뒤에 온 글", "다음 <보기> 중 무엇인가요?", "<보기>\n뒤에 온 글", True),
    ("물음?", "<보기> ㉠ 가", "물음?", "<보기> ㉠ 가", False),
    ("물음?", "plain cell", "물음?", "plain cell", False),
    (None, None, "", None, False),
]


@pytest.mark.parametrize("text, cell, want, view, changed", CASES)
def test_views_are_promoted_and_mended(spark, text, cell, want, view, changed):
    df = spark.createDataFrame([(text, cell)], "t string, c string")
    row = df.select(V.promoted(F.col("t"), F.col("c")).alias("p"), V.misplaced(F.col("t"), F.col("c")).alias("m")).first()
    assert tuple(row.p) == (want, view, changed) and row.m == (changed and cell is not None)


def test_views_come_back(spark):
    df = spark.createDataFrame([("앞 글 뒤 글", "<보기>\n㉠ 가", 4), ("앞", "x", 1), ("", None, 0)], "t string, c string, at int")
    assert [r.r for r in df.select(V.restored(F.col("t"), F.col("c"), F.col("at")).alias("r")).collect()] == ["앞 글\n<보기>\n㉠ 가\n뒤 글", "앞\nx", ""]
