"""Papers of numbered questions, line by line."""

from papyra.operators import papers as P


def lines(spark, *papers):
    return spark.createDataFrame([(d, k, x) for d, text in enumerate(papers) for k, x in enumerate(text.split("\n"))], "doc long, place long, text string")


SET = """1과목 : 바람과 돛
[문제 1~2] 아래 표를 보고 고르시오.
북풍이 사흘째 분다.
1. 돛을 매다는 곳은?
   ① 용골
   ❷ 돛대
   ③ 갑판
   ④ 닻
2. 가장 센 바람은?
   ① One ② Two
   ③ Three
   more of three
   ❹
3. no group
   ① a ② b ③ c ④ d
2과목 : other
다음 글을 읽고 물음에 답하시오.
open passage
4. in the open group, S to ❶ then
   ① x ② y ③ z ④ w
전자문제집 CBT 홈페이지 : www
3 4
② ③
"""
BAD = """1. Which?
① a
❷ b
③ c
④ d
전자문제집 CBT 홈페이지 : www
1
③"""


def test_sets_with_groups_and_a_tail(spark):
    got = P.parsed(lines(spark, SET, BAD))
    q = {(r.doc, r.number): r for r in got["questions"].collect()}
    assert len(q) == 5
    a = q[0, 1]
    assert (a.subject, a.text, [tuple(c) for c in a.choices], a.answer, a.group_order) == ("바람과 돛", "돛을 매다는 곳은?", [(1, "용골"), (2, "돛대"), (3, "갑판"), (4, "닻")], 2, 1)
    b = q[0, 2]
    assert [c.text for c in b.choices] == ["One", "Two", "Three more of three", P.PICTURE] and b.answer == 4 and b.group == a.group and b.group_order == 2
    assert q[0, 3].group is None and q[0, 3].answer == 2
    d = q[0, 4]
    assert (d.subject, d.answer, d.text, d.group_order) == ("other", 3, "in the open group, S to ❶ then", 1) and d.group not in (None, a.group)
    assert [tuple(r) for r in got["errors"].collect()] == [(1, 1, "answer_mismatch")] and q[1, 1].answer is None
    c = {r.text: (r.kind, r.first, r.last, r.ambiguous) for r in got["contexts"].collect()}
    assert c["바람과 돛"][0] == "subject" and c["[문제 1~2] 아래 표를 보고 고르시오. 북풍이 사흘째 분다."] == ("passage", 1, 2, False)
    assert c["다음 글을 읽고 물음에 답하시오. open passage"] == ("passage", None, None, True)


def test_a_key_counts_only_whole(spark):
    paper = "1. a\n① x\n2. b\n① y\n전자문제집 CBT 앱\n{}"
    for tail, want in (("1 2\n① ②", {1: 1, 2: 2}), ("1 2\n①", {}), ("2 1\n① ②", {}), ("1 1\n① ②", {}), ("1 9\n① ②", {}), ("x\n1\n①\n2\n③\nend\n4", {1: 1, 2: 3}), ("①\n1\n②", {1: 2})):
        got = P.parsed(lines(spark, paper.format(tail)))["questions"].collect()
        assert {r.number: r.answer for r in got if r.answer} == want, tail


def test_numbers_over_25_and_empty_papers(spark):
    got = P.parsed(lines(spark, "30. Thirtieth?\n① A ② B ❸ C ④ D", "", "no question here"))["questions"].collect()
    assert [(r.number, r.answer, len(r.choices)) for r in got] == [(30, 3, 4)]


def test_ocr_words_and_grids(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 2, 30, 5, 10, 8, 90.0, "world"), (1, 1, 1, 1, 1, 10, 6, 15, 8, 80.0, "hello"), (1, 1, 1, 1, 3, 0, 0, 1, 1, -1.0, "x"), (1, 1, 1, 2, 1, 0, 0, 1, 1, 50.0, " ")], "page int, block int, par int, line int, word int, x int, y int, w int, h int, conf double, text string")
    assert [tuple(r) for r in P.words_to_lines(words).collect()] == [(1, 1, 1, 1, "hello world", 10, 5, 40, 14, 0.85)]
    rules = spark.createDataFrame([(1, "x", v) for v in (10.0, 11.0, 50.0, 90.5, 90.0)], "page int, axis string, at double")
    assert sorted((r.edge, r.at) for r in P.grid(rules, "page", "axis", "at", 2).collect()) == [(0, 10.5), (1, 50.0), (2, 90.25)]


def test_papers_are_dealt_once_and_not_stored(spark):
    got = P.parsed(lines(spark, SET, BAD))
    for name in ("questions", "contexts", "errors"):
        plan = got[name]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "FileScan" not in plan and "Window" not in plan and "Join" not in plan, name


def test_whole_papers_are_not_shuffled(spark):
    papers = spark.createDataFrame([(1, [(k, x) for k, x in enumerate(SET.split("\n"))]), (2, []), (3, None)], "doc long, lines array<struct<place: long, text: string>>")
    got = P.parsed_papers(papers)
    assert "Exchange" not in got["questions"]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc, r.number, r.answer) for r in got["questions"].collect()) == [(1, 1, 2), (1, 2, 4), (1, 3, 2), (1, 4, 3)]


def test_an_order_s_paper_takes_one_shuffle(spark):
    from papyra.plans.upkeep import parsed_papers

    orders = spark.createDataFrame([(2, "a"), (3, "b"), (5, "none")], "o_orderkey long, o_orderpriority string")
    items = spark.createDataFrame([(2, 1, 9), (2, 1, 6), (2, 3, 7), (3, 2, 8)], "l_orderkey long, l_linenumber int, l_partkey long")
    found = parsed_papers(orders, items)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.doc, r.number, r.subject, r.text, r.answer, r.grouped) for r in found.collect()) == [(2, 1, "a", "What is part 6?", 3, True), (2, 3, "a", "What is part 7?", 4, False), (3, 2, "b", "What is part 8?", 1, True)]


def test_a_question_s_choices_are_read_from_rows_and_a_long_key_takes_no_backtracking(spark):
    got = P.parsed(lines(spark, "1. a\n① x\n전자문제집 CBT 앱\n1\n②\n" + "1" * 90 + "x"))["questions"]
    above = got._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_extract_all(rest" in above
    assert [(r.number, r.answer, [tuple(c) for c in r.choices]) for r in got.collect()] == [(1, 2, [(1, "x")])]
