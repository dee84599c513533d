"""Reasons to reject a candidate, categories for review and codes of a staged bank, case by case."""

import json

import pytest
from pyspark.sql import functions as F

from papyra.operators import gates as G

GOOD = ["alpha", "beta", "gamma", "delta"]
CASES = [
    ("stem", GOOD, 0.7, [], []),
    (" ", GOOD, 0.69, None, ["empty_stem", "low_confidence"]),
    ("stem", GOOD[:3], None, ["odd_diagnostic"], ["invalid_choice_count", "low_confidence", "parser_diagnostic"]),
    ("stem", [*GOOD[:3], " "], 1.0, ["table_choice_recovery"], ["empty_choice"]),
    ("stem", [*GOOD[:3], "첨부 그림 참조"], 1.0, [], ["placeholder_choice"]),
    ("stem", [*GOOD[:3], "AL pha"], 1.0, [], ["duplicate_choice"]),
    ("stem", [*GOOD[:3], "alpha"], 1.0, ["source_duplicate_choices"], []),
    ("stem", ["㉠ a", "㉡", "㉢ c", "㉣ d"], 1.0, [], ["proposition_choices"]),
    ("stem", ["㉠ a", "㉡", "㉢ c", "㉣ d"], 1.0, ["explicit_proposition_choices"], []),
    ("stem", ["㉠ a", "㉡", "㉣ c", "㉢ d"], 1.0, [], []),
    ("stem", [*GOOD[:3], "delta 5. 다음"], 1.0, [], ["contaminated_choice"]),
    ("stem", [*GOOD[:3], "정답 3"], 1.0, ["source_text_repair"], []),
    ("stem", [*GOOD[:3], "가장 옳은 것은?"], 1.0, [], ["question_text_in_choice"]),
    ("stem", ["㉨ a", *GOOD[1:]], 1.0, [], ["damaged_marker_choice"]),
    ("stem", ["a", "b", "c", "d" * 50], 1.0, [], ["choice_tail_contamination"]),
    ("stem", ["a", "b" * 40, "c" * 41, "d" * 81], 1.0, [], ["mixed_choice_layers"]),
    ("stem", ["a", "b", "c", "㉠ - x ㉡: y"], 1.0, [], ["mixed_choice_layers"]),
    ("stem", ["㉠ - x", "㉡ - y", "㉢ - z", "last"], 1.0, [], ["mixed_choice_layers"]),
    ("압력 [시 다읔", [*GOOD[:3], "(open"], 1.0, [], ["ocr_noise_stem", "broken_unit_stem", "unbalanced_stem_delimiter", "unbalanced_choice_delimiter"]),
    ("탑승한 3 모든", GOOD, 1.0, [], ["suspicious_stem"]),
    (None, None, None, None, ["empty_stem", "invalid_choice_count", "low_confidence"]),
]


def test_candidates_are_rejected_for_each_reason(spark):
    df = spark.createDataFrame([(k, s, c, f, d) for k, (s, c, f, d, _) in enumerate(CASES)], "k int, stem string, choices array<string>, confidence double, diagnostics array<string>")
    got = df.select("k", G.reasons(F.col("stem"), F.col("choices"), F.col("confidence"), F.col("diagnostics")).alias("r")).orderBy("k").collect()
    for r in got:
        assert r.r == CASES[r.k][4], CASES[r.k]


def test_payloads_of_candidates(spark):
    table = json.dumps({"tables": [{"rows": [["다읔", ""]]}]})
    df = spark.createDataFrame([("stem", GOOD, table, ["{x", None, None, None])], "s string, c array<string>, f string, fs array<string>")
    got = df.select(G.reasons(F.col("s"), F.col("c"), F.lit(1.0), F.array().cast("array<string>"), F.col("f"), F.col("fs")).alias("r")).first().r
    assert got == ["empty_table_cell_question_format", "ocr_noise_question_format", "invalid_format_json_choice_format"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("plain", []), ("ab", ["pua_remaining"]), ("x¯ y", ["hwp_overbar_marker_review"]), ("a\tb", ["linebreak_remaining"]), ("(단 는 값이다? ( , x", ["unbalanced_paren_or_bracket", "broken_variable_note_remaining"]), ("그림에서 에 각각 알맞은", ["dangling_blank_reference"]), ('"x" ( ) ?', ["quote_blank_order_suspect", "paren_question_order_suspect"]),
        ("길이 3 4 [m]", ["number_unit_order_suspect"]), ("저항 [ ] Ω", ["blank_unit_suspect"]), ("것은 (가) ?", ["paren_question_order_suspect"]), ("탑승한 3 모든 사람", ["suspicious_text_artifact"]), ("다읔", ["ocr_noise_text"]), (None, []),
    ],
)
def test_review_categories(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(G.review_categories(F.col("t")).alias("c")).first().c == want


def test_findings_of_payloads(spark):
    rows = spark.createDataFrame([(1, "a\tb", json.dumps({"tables": [{"rows": [["x\ty", "(가) ?", ""]]}]})), (2, "fine", "{x")], "id int, text string, payload string")
    got = sorted(map(tuple, G.review_findings(rows, "id", "text", "payload").collect()))
    assert got == [
        (1, "payload.tables[0].rows[0][1]", "paren_question_order_suspect", "needs_source_review"), (1, "payload.tables[0].rows[0][2]", "empty_table_cell", "blocked_quality"), (1, "text", "linebreak_remaining", "needs_source_review"), (2, "payload", "invalid_format_json", "blocked_quality"),
    ]


QUESTION = "id int, set string, number int, text string, answer int, answered int, source int, tags string"


def bank(spark, change=lambda q, c: (q, c)):
    q = [(k, "s", k, "text", 1, 1, 1, None) for k in range(1, 6)]
    c = [(k, n, f"choice {n}") for k in range(1, 6) for n in range(1, 5)]
    q, c = change(q, c)
    return spark.createDataFrame(q, QUESTION), spark.createDataFrame(c, "question int, number int, text string")


def test_a_staged_bank(spark):
    documents = spark.createDataFrame([("2024/q.pdf", "question", "h", 5, None), ("2024/a.pdf", "answer", "g", 0, None)], "path string, role string, hash string, parsed int, error string")
    sources = spark.createDataFrame([(1, "http://x/q.pdf", "h", "http://x/a.pdf", "a.pdf"), (2, "http://x/none.pdf", "h", None, None)], "id int, path string, hash string, answer_path string, answer_name string")
    rejected = spark.createDataFrame([(0,)], "n int")
    expected = spark.createDataFrame([("s", 5, True)], "set string, n int, answers_required boolean")
    codes = lambda change=lambda q, c: (q, c), d=documents, s=sources, r=rejected, e=expected: G.staging_codes(*bank(spark, change), d, s, r, e).first().codes
    assert codes() == []
    replace = lambda k, i, v: lambda q, c: ([x if x[0] != k else (*x[:i], v, *x[i + 1 :]) for x in q], c)
    assert codes(replace(2, 3, " ")) == ["invalid_question_structure"]
    assert codes(replace(2, 4, 9)) == ["invalid_question_structure", "missing_answers"]
    assert codes(replace(2, 4, -1)) == [] and codes(replace(2, 6, None)) == ["missing_provenance"] and codes(replace(2, 6, 2)) == ["provenance_mismatch"]
    unanswered = lambda tags: lambda q, c: ([x if x[0] != 2 else (*x[:4], 0, 0, 1, tags) for x in q], c)
    assert codes(unanswered("a, #answer_missing_in_source")) == [] and codes(unanswered("a")) == ["missing_answers"]
    assert codes(replace(2, 2, 3)) == ["duplicate_questions", "missing_question_numbers", "missing_answers"]
    assert codes(lambda q, c: (q, [*c[:-1], (5, 4, "원문 보기 참조")])) == ["placeholder_choices"]
    assert codes(lambda q, c: (q, c[:-2])) == ["invalid_question_structure"] and codes(lambda q, c: (q, [*c[:-1], (5, 5, "x")])) == ["invalid_question_structure"]
    assert codes(d=documents.withColumn("parsed", F.lit(0)), r=rejected.withColumn("n", F.lit(2))) == ["unparsed_question_documents", "rejected_candidates"]
    assert G.staging_codes(*bank(spark)).first().codes == []
