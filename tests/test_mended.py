"""Cases of results that were once wrong: spacing of JSON, repeated rows, path parts, markers, classes of failures, numbering without one task."""

import json
import time

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import bank, matching, ordered, selection
from papyra.streaming import ingest


@pytest.mark.parametrize("dumps", [json.dumps, lambda x: json.dumps(x, separators=(",", ":")), lambda x: json.dumps(x, indent=1)])
def test_payload_paths_are_mapped_in_any_spacing(spark, dumps):
    values = ["old/2", "old/3", 'quo"te', "back\\slash", "old/2", "é" * 20_000]
    payload = {"a": [{"image_path": v, "n": k} for k, v in enumerate(values)], "text": "image_path: old/2"}
    rows = spark.createDataFrame([(1, dumps(payload)), (2, None), (3, "{}")], "k int, payload string")
    mapping = spark.createDataFrame([("old/2", "new/2"), ('quo"te', 'a"b'), ("back\\slash", "c\\d")], "path string, to string")
    got = {r.k: r.payload for r in bank.portable_payloads(rows, "k", "payload", mapping, "path", "to").collect()}
    assert [x["image_path"] for x in json.loads(got[1])["a"]] == ["new/2", "old/3", 'a"b', "c\\d", "new/2", "é" * 20_000]
    assert json.loads(got[1])["text"] == "image_path: old/2" and got[2] is None and got[3] == "{}"


def test_first_prefix_keeps_repeated_rows_and_maps(spark):
    rows = spark.createDataFrame([("abc", {"x": 1}), ("abc", {"x": 1}), ("b", None), (None, None)], "t string, m map<string,int>")
    rules = spark.createDataFrame([("a", 2), ("ab", 1)], "prefix string, place int")
    got = sorted(((r.t, r.rule and r.rule.prefix) for r in matching.first_prefix(rows, "t", rules, "prefix", "place").collect()), key=str)
    assert got == sorted([("abc", "ab"), ("abc", "ab"), ("b", None), (None, None)], key=str)


def test_path_parts_and_markers(spark):
    names = ["a.b c//d", "__x", "", None, "가-1 ½", "x" * 99]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(X.safe_stem(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["a_b_c__d", "__x", "", "", "가-1_½", "x" * 80]
    df = spark.createDataFrame([(n, f) for n in ("1", "3", "5", "6", "x", None) for f in ("f", "")], "n string, f string")
    legacy = df.select(X.choice_marker(F.col("n"), None, F.col("f")).alias("m")).collect()
    assert [r.m for r in legacy] == ["㉮", "㉮", "㉴", "㉴", "⑤", "⑤", "f", "6", "f", "", "f", ""]
    circled = df.select(X.choice_marker(F.col("n"), "circled_number").alias("m")).collect()
    assert [r.m for r in circled][::2] == ["①", "③", "⑤", "⑥", "", ""]


def test_retry_classes(spark):
    rows = [
        (True, ["x"], "FAT 1", None, "parser_fixed_importable"),
        (False, ["choice_count: 3"], "전산세무 2급", None, "accounting_practical_non_mc"),
        (False, ["missing_question_image: 1", "missing_question_image: 2"], "", None, "missing_required_image"),
        (False, ["missing_question_image", "question_count: 0"], "", None, "no_questions_detected"),
        (False, ["invalid_correct_answer: 1"], "2020 수능", None, "answer_key_format_unsupported"),
        (False, ["invalid_correct_answer: 1", "choice_count"], "2020 수능", None, "choice_or_answer_parser_remaining"),
        (False, ["group_child_mismatch", "choice_count"], "", None, "group_parser_remaining"),
        (False, ["choice_count"], "", ["Multiple inline answers in one question: 4"], "inline_answer_parser_partially_fixed"),
        (False, ["ambiguous_group_range: a"], None, [], "ambiguous_set_question"),
        (False, ["else"], "", None, "quality_block_remaining"),
        (False, None, None, None, "quality_block_remaining"),
    ]
    df = spark.createDataFrame(rows, "ok boolean, errors array<string>, title string, old array<string>, expected string")
    assert all(r.c == r.expected for r in df.select("expected", ingest.retry_class(F.col("ok"), F.col("errors"), F.col("title"), F.col("old")).alias("c")).collect())
    raised = spark.createDataFrame([("Multiple inline answers in one question", True, "t"), ("Multiple inline answers in one question", False, "t"), (None, True, "TAT")], "m string, p boolean, t string")
    assert [r.c for r in raised.select(ingest.exception_class(F.col("m"), F.col("p"), F.col("t")).alias("c")).collect()] == ["inline_answer_marker_remaining", "parse_exception_remaining", "accounting_practical_non_mc"]


def test_the_last_link_of_a_number_wins(spark):
    links = spark.createDataFrame([("p", "?page=2", 1), ("p", "?page=2&a", 5), ("p", "?page=2&z", 3), ("p", "?page=0", 4), ("q", "?page=2", 9)], "page string, href string, place int")
    got = sorted(map(tuple, bank.paginated(links, "page", "href", "[?]page=([0-9]+)").collect()))
    assert got == [("p", 2, "?page=2&a"), ("q", 2, "?page=2")]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 25, 199, 230, 1000])
def test_evenly_spaced_samples(spark, n):
    size = max(10, -(-n // 20))
    expected = list(range(n)) if n <= size else sorted({round(k * (n - 1) / (size - 1)) for k in range(size)})
    got = ordered.evenly_spaced(spark.range(n).repartition(3), ["id"])
    assert sorted(r.id for r in got.collect()) == expected


def test_numbers_are_dense_without_one_task(spark):
    n = 200_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3 == 0).cast("int").alias("g")).repartition(5)
    began = time.time()
    got = ordered.numbered(rows, ["k"], "i").agg(F.count_if(F.col("i") == F.col("k") + 1).alias("n")).first().n
    assert got == n
    placed = ordered.placed(rows, "g", ["k"]).groupBy("g").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.count_distinct("place").alias("d")).collect()
    assert sorted((r.g, r.n, r.last, r.d) for r in placed) == [(0, 133_333, 133_332, 133_333), (1, 66_667, 66_666, 66_667)]
    assert time.time() - began < 60
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "g string, k int")
    assert sorted((r.g or "", r.k, r.place) for r in ordered.placed(nulls, "g", ["k"]).collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_saved_rows_of_null_keys_and_many_new_ones(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "id long, k string, v int")
    new = spark.createDataFrame([("a", 5, 1), (None, 7, 1), (None, 8, 2), ("c", 9, 1)], "k string, v int, seq int")
    got = sorted((r.id, r.k, r.v) for r in bank.saved(base, new, ["k"]).collect())
    assert got == [(1, "a", 5), (2, None, 1), (3, None, 8), (4, "c", 9)]


def test_walks_are_linear_in_a_long_partition(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("p").alias("p"), F.col("id").alias("i"), (F.col("id") % 1000 + F.floor(F.col("id") / 1000)).alias("n")).repartition(4)
    began = time.time()
    kept = [r.n for r in ordered.monotone(rows, "p", ["i"], "n", 8).orderBy("i").collect()]
    expected, last = [], None
    for k in range(n):
        x = k % 1000 + k // 1000
        if last is None or 0 < x - last <= 8:
            expected.append(x)
            last = x
    assert kept == expected
    assert ordered.subject_switches(rows, "p", ["i"], "n", 25, 20).agg(F.max("subject")).first()[0] == n // 25 - 1
    assert time.time() - began < 60


def test_exact_count_keeps_few_rows_of_each_task(spark):
    found = spark.range(100_000).select(F.col("id").cast("string").alias("unit"), (F.col("id") % 2 + 1).alias("count"), F.col("id").alias("first_index"), F.array("id").alias("ids"))
    plan = selection.Window.partitionBy("count").orderBy("unit")
    shown = found.withColumn("n", F.row_number().over(plan)).where("n <= 20")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in shown
    assert selection.exact_count(found, 20, 1).agg(F.sum("count")).first()[0] == 20


def test_excerpts_roles_and_skills(spark):
    df = spark.createDataFrame([("합격 코스\n 3/12 \n\n문제지 1\n" + "바다와 배에 관한 글이 서른 자를 넘도록 길게 이어지고 또 이어진다 그리고 끝난다 ① 가 ② 나",), ("짧은 글 ① 가",), (None,), ("x" * 300,)], "t string")
    got = [r.e for r in df.select(X.evidence(F.col("t")).alias("e")).collect()]
    assert got == ["바다와 배에 관한 글이 서른 자를 넘도록 길게 이어지고 또 이어진다 그리고 끝난다", "짧은 글 ① 가", "", "x" * 180]
    parts = ["정답(1)", "문제", "문제(가)", "문제집", "  자료 ", "해설 답", "", None]
    marks = spark.createDataFrame([(p,) for p in parts], "p string").select(X.role_marker(F.col("p")).alias("m")).collect()
    assert [r.m for r in marks] == ["정답", "문제", "문제", "", "자료", "해설", "", ""]
    paths = ["d/2023_2차 - 물리.pdf", "x/정답안/a.pdf", "x/확정_답안.pdf", "x/a.pdf"]
    made = spark.createDataFrame([(p,) for p in paths], "p string").select(X.document_role(F.col("p"), F.lit(0), F.lit(0), F.lit(0), F.lit("연간 시험 공고"), F.lit("question")).alias("r")).collect()
    assert [r.r for r in made] == ["question", "answer", "answer", "notice"]
    skill = spark.createDataFrame([("이 CASE 에서",), ("모두 몇 개",), ("빈칸에",), ("그냥",)], "t string").select(X.cognitive_skill(F.col("t"), F.lit(False)).alias("s")).collect()
    assert [r.s for r in skill] == ["case_application", "comparative_analysis", "conceptual_understanding", "recall"]


def test_units_take_a_key_of_the_caller(spark):
    rows = [(1, 0, None, None, 1, "One?", ["a", "b"], None), (2, 1, None, None, 2, "Two?", ["c", "d"], None), (3, 2, None, None, 3, "three", ["a"], None)]
    df = spark.createDataFrame(rows, "id int, idx int, group_id string, group_order int, number int, text string, choices array<string>, shared string")
    assert selection.first_wins(selection.units(df)).count() == 3
    same = selection.first_wins(selection.units(df, key=lambda: F.lit("one key")))
    assert [r.first_index for r in same.collect()] == [0]


def test_sections_of_an_export(spark):
    ddl = "id int, idx int, group_id string, group_order int, number int, text string, choices array<string>, shared string, year int, tags string"
    law = [(k, k, "g" if k in (4, 5) else None, None, k, f"law question number {k % 7} of a long text", ["a", str(k % 7)], "shared passage" if k in (4, 5) else None, 2000 + k if k else None, "#law, #sea" if k % 2 else "#law") for k in range(10)]
    nav = [(100 + k, k, None, None, k, f"law question number {k} of a long text", ["a", str(k)], None, 2005, "#nav") for k in range(12)]
    a, b = spark.createDataFrame(law, ddl), spark.createDataFrame(nav, ddl)
    ids = lambda df: [r.id for r in df.select(F.explode("ids").alias("id")).collect()]
    assert ids(selection.practice(a)) == [0, 1, 2, 3, 4, 5, 6]  # 7 to 9 repeat 0 to 2
    assert ids(selection.practice(a, years=(2002, 2004))) == [2, 3, 4] and ids(selection.practice(a, years=(None, 2002), tags="#sea")) == [1]
    assert len(ids(selection.practice(a, 3, 1))) == 3
    got = [tuple(r) for r in selection.sections([("law", a, {"years": (2001, 2003)}), ("nav", b, {"count": 5, "seed": 3})]).orderBy("display_order").collect()]
    assert [(s, i) for s, i, _ in got][:3] == [("law", 1), ("law", 2), ("law", 3)] and [d for *_, d in got] == list(range(1, 9))
    nav_ids = {i for s, i, _ in got if s == "nav"}
    assert len(nav_ids) == 5 and not nav_ids & {101, 102, 103}


def test_boxes_of_one_place_meet_others_once(spark):
    from papyra.operators import relational

    box = lambda ids, x: ids.select("id", *[F.lit(float(v)).alias(c) for c, v in (("x0", x), ("y0", 0), ("x1", x + 2), ("y1", 2))])
    a = box(spark.range(5000), 1).unionByName(box(spark.range(0, -3, -1), 9)).unionByName(box(spark.range(1).select(F.lit(None).cast("long").alias("id")), 1))
    b = box(spark.range(7), 2).unionByName(box(spark.range(2), 2))
    got = relational.overlap_pairs(a, b, 8)
    assert got.count() == 5001 * 9 and got.where("a_id is null").count() == 9 and got.select("a_id", "b_id").distinct().count() == 5001 * 7
    assert {r.area for r in got.select("area").distinct().collect()} == {2.0}
    # as many boxes as would be 40 billion candidates in their common cell, none of which overlap
    began = time.time()
    assert relational.overlap_pairs(box(spark.range(200000), 1), box(spark.range(200000), 4), 8).count() == 0 and time.time() - began < 60


def test_a_staged_bank_reads_its_questions_once(spark):
    from papyra.operators import gates

    kinds = "id int, set string, number int, text string, answer int, answered int, source int"
    rows = [(1, "s", 1, "t", 1, 1, 1), (2, "s", 2, "t", 4, 1, 1), (3, None, 1, "t", 2, 1, 1), (4, "other", 9, "t", -1, 1, None)]
    choices = spark.createDataFrame([(i, k, "x") for i in range(1, 5) for k in range(1, 5)], "question int, number int, text string")

    def codes(asked, rows=rows, choices=choices):
        expected = spark.createDataFrame(asked, "set string, n int, answers_required boolean")
        return gates.staging_codes(spark.createDataFrame(rows, kinds), choices, expected=expected).first().codes

    assert codes([("s", 2, True)]) == [] and codes([("s", 2, None)]) == ["missing_question_numbers"]
    assert codes([("s", 3, False)]) == ["missing_question_numbers"] == codes([("s", 1, True)]) and codes([("s", 3, True)]) == ["missing_question_numbers", "missing_answers"]
    assert codes([("s", 2, True), ("empty", 0, True)]) == [] and codes([("s", 2, True), (None, 1, False)]) == ["missing_question_numbers"]
    assert codes([("other", 9, False)]) == ["missing_question_numbers", "missing_provenance"]
    assert codes([("s", 2, True)], [*rows, (5, "s", 2, "t", 1, 1, 1)]) == ["duplicate_questions", "invalid_question_structure", "missing_answers"]
    twice = choices.where("question <> 1").unionByName(spark.createDataFrame([(1, k, "x") for k in (1, 2, 2, 4)], choices.schema))
    assert codes([("s", 2, True)], choices=twice) == ["invalid_question_structure"]
    plan = gates.staging_codes(spark.createDataFrame(rows, kinds), choices, expected=spark.createDataFrame([("s", 2, True)], "set string, n int, answers_required boolean"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_pages_are_dealt_once(spark, monkeypatch):
    from papyra.operators import layout

    words = spark.createDataFrame([(p, x + 300.0 * (k % 2), 100.0 + 20 * (k // 2), x + 300.0 * (k % 2) + 100, 110.0 + 20 * (k // 2), f"w{k}") for p in range(3) for k in range(8) for x in (40.0,)], "page int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(p, 640.0, 400.0) for p in (0, 1, 7, None)], "page int, width double, height double")
    monkeypatch.setattr(layout, "stored", lambda df: pytest.fail("a page's words are stored"))
    found, lines = layout.dividers(words, pages), layout.page_lines(words, pages)
    assert sorted(map(tuple, found.collect()), key=str) == [(0, 240.0), (1, 240.0), (7, None), (None, None)]
    assert sorted((r.page, r.column, r.line, r.text) for r in lines.collect()) == [(p, c, k, f"w{2 * k + c}") for p in (0, 1) for c in (0, 1) for k in range(4)]
    for df in (found, lines):
        assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_chains_leave_in_batches(spark, monkeypatch):
    import pyarrow as pa

    from papyra.operators import layout

    starts = spark.range(30000).select(F.expr("id div 3").alias("doc"), (F.col("id") % 3).alias("place"), F.when(F.col("id") % 3 == 2, 1).otherwise(F.col("id") % 3 + 1).cast("int").alias("n"))
    long = spark.range(25000).select(F.lit(-1).cast("long").alias("doc"), F.col("id").alias("place"), F.col("id").cast("int").alias("n"))  # over several batches
    found = layout.chained_starts(starts.unionByName(long), "doc", "place", "n")
    assert {(r.doc == -1, r.size) for r in found.groupBy("doc").agg(F.count("*").alias("size")).collect()} == {(False, 2), (True, 25000)} and found.select("doc").distinct().count() == 10001
    # short documents were a batch each
    kept = []
    monkeypatch.setattr(type(starts), "mapInArrow", lambda self, run, schema: kept.append(run) or self)
    layout.chained_starts(starts, "doc", "place", "n")
    batch = pa.record_batch({"doc": [k // 2 for k in range(1000)], "place": list(range(1000)), "n": [k % 2 for k in range(1000)]})
    made = list(kept[0](iter([batch, batch.slice(998)])))
    assert len(made) == 2 and sum(len(b) for b in made) == 1000


def test_repairs_go_over_texts_by_parts(spark):
    from papyra.functions import repairs

    assert repairs._AT_ONCE
    rows = spark.range(12, numPartitions=1).select("id", F.when(F.col("id") % 5 != 4, F.concat(F.lit("s0 "), F.repeat(F.lit("x"), 400000), F.col("id").cast("string"))).alias("t"))
    got = rows.select("id", repairs.repaired(F.col("t"), {"s0": "so"}).alias("r"), repairs.known(F.col("t"), {"s0": "so"}).alias("k")).select("id", F.left("r", F.lit(3)).alias("r"), F.length("r").alias("n"), "k").collect()
    assert [(r.r, r.k) for r in got] == [(None, False) if k % 5 == 4 else ("so ", True) for k in range(12)] and {r.n for r in got if r.n} == {400004, 400005}


def test_range_members_hold_words_not_numbers(spark):
    from papyra.operators import matching as M

    spans = [(1, 0, 199), (1, 0, 199), (1, 5, 7), (2, -70, 3), (2, 4, 3), (3, 1, 2), (4, None, 2), (None, 1, 2), (5, 63, 64)]
    rows = [(1, k) for k in range(0, 200)] + [(1, 6), (1, None), (2, -71), (2, 4), *[(2, k) for k in range(-70, 4)], (2, -70), (None, 1), (4, 2), (5, 63), (5, 63)]
    ranges = spark.createDataFrame([(*s, f"r{k}") for k, s in enumerate(spans)], "k long, low long, high long, name string")
    found = M.range_members(spark.createDataFrame(rows, "k long, n int"), "k", "n", "low", "high", ranges)
    got = {r["name"]: (r.complete, r.repeats) for r in found.collect()}
    # two equal ranges count a row twice, as a join by their key does
    assert got == {"r0": (True, 202), "r1": (True, 202), "r2": (True, 1), "r3": (True, 1), "r4": (True, 0), "r5": (False, 0), "r6": (None, 0), "r7": (False, 0), "r8": (False, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "HashAggregate(keys=[" in line]
    assert keys and not any(part.strip().startswith("n#") for k in keys for part in k.split(",")) and plan.count("REPARTITION_BY_NUM") >= 2
