"""Tables of misreadings against one alternation of all entries; formulas and their spans; maps of places through chains of rewrites."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.functions import formulas, offsets, repairs
from papyra.functions import text as X


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, t {kind}").repartition(3)


def shown(df, made):
    return [r.x for r in df.select("k", made.alias("x")).orderBy("k").collect()]


def test_a_table_of_thousands_is_one_pass(spark):
    r = random.Random(4)
    made = lambda n: "".join(r.choice("ab01 é-") for _ in range(n))
    words = {made(r.randrange(1, 7)).strip() or "a": made(3) for _ in range(2000)}
    phrases = {made(r.randrange(2, 9)): made(4) for _ in range(2000)}
    texts = [None, "", *[made(r.randrange(200)) for _ in range(300)]]
    either = lambda table: "|".join(re.escape(x) for x in sorted(table, key=len, reverse=True))
    bounded, anywhere = re.compile(f"(?<![0-9A-Za-z])(?:{either(words)})(?![0-9A-Za-z])"), re.compile(either(phrases))
    plain = lambda t: anywhere.sub(lambda m: phrases[m.group()], bounded.sub(lambda m: words[m.group()], t))
    df = column(spark, texts)
    assert shown(df, repairs.repaired(F.col("t"), words, phrases)) == [None if t is None else plain(t) for t in texts]
    assert shown(df, repairs.known(F.col("t"), words)) == [bool(t) and bool(bounded.search(t)) for t in texts]
    assert shown(df, repairs.repaired(F.col("t"), {})) == texts


@pytest.mark.parametrize(
    "text, want",
    [
        ("선박Ⅳ형입니다", True), ("가1나 다라", True), ("제Ⅳ장의 규정", False), ("부속서 Ⅵ에서 정한", False), ("Ⅲ 급", False), ("가ⅲ", True), ("제3항과 12명", False), ("지진파의S파", False), ("A1해역에", False), ("물]}0 가", True), ("r해사안전법]", True), ("가)7b 나", True),
    ],
)
def test_signs_inside_words(spark, text, want):
    codes = column(spark, [text]).select(X.quality_codes(F.col("t")).alias("c")).first().c
    assert ("ocr_noise" in codes) == want


def test_disorder_looks_around_each_number(spark):
    texts = ["탑승한 3 모든 사람", "선원이 2 실행", "장음 회와 단음 회 신호를 2 1", "제5조제2항 선박이3 미터", "제5조제2항 " + "가" * 30 + " 선박이3 미터", "기관2 문제", "기관2 문제와 길이3 미터", "협약 SOLAS 사용", "a" * 3000]
    assert shown(column(spark, texts), X.disordered(F.col("t"))) == [True, True, True, False, True, False, True, True, False]


FORMULAS = [
    (r"값 \( x+1 \) 끝", "값 x+1 끝", ["x+1"]),
    ("a $ sqrt{2} $ b", r"a \sqrt{2} b", [r"\sqrt{2}"]),
    ("a $ $ b $c$", "a $ $ b c", ["c"]),
    ("$$x$", "$x", ["x"]),
    ("sqrt { a · b } 와 overline{ x + y }", r"\sqrt{a \cdot b} 와 \overline{x+y}", [r"\sqrt{a \cdot b}", r"\overline{x+y}"]),
    ("ROOT ( 3 ) and root(x)", r"\sqrt{3} and \sqrt{x}", [r"\sqrt{3}", r"\sqrt{x}"]),
    ("√(a + b) √{ c } √¯12 √35 √7 √xy_1", r"\sqrt{a+b} \sqrt{c} \sqrt{12} \sqrt{3}5 \sqrt{7} \sqrt{xy_1}", [r"\sqrt{a+b}", r"\sqrt{c}", r"\sqrt{12}", r"\sqrt{3}", r"\sqrt{7}", r"\sqrt{xy_1}"]),
    ("P = √3 × V · I cos θ 는", r"P=\sqrt{3} \times V \cdot I \cos\theta는", [r"P=\sqrt{3} \times V \cdot I \cos\theta"]),
    ("x = 3 + 4 이다", "x = 3 + 4 이다", []),
    ("x̅의 평균", r"\overline{x}의 평균", [r"\overline{x}"]),
    ("\ue05c\ue06d\ue035 \ue0f2", r"\sqrt{2} n", [r"\sqrt{2}"]),
    (None, "", []),
    ("", "", []),
    ("plain", "plain", []),
]


def test_formulas_and_their_spans(spark):
    got = shown(column(spark, [t for t, _, _ in FORMULAS]), formulas.normalized(F.col("t")))
    for (text, want, latex), r in zip(FORMULAS, got):
        assert r.text == want, text
        assert [s.latex for s in r.spans] == latex and [r.text[s.start : s.end] for s in r.spans] == latex, text
        assert not r.map or (r.map[0].raw == 0 and r.map[-1].out_end == len(want) and all(a.raw_end == b.raw and a.out_end == b.out for a, b in zip(r.map, r.map[1:])))


def test_spans_survive_chains_of_rewrites(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abxy12 .") for _ in range(r.randrange(60))) for _ in range(200)]
    df = column(spark, texts)
    first = offsets.rewritten(F.col("t"), "[0-9]+", lambda m: F.concat(F.lit("<"), m, m, F.lit(">")))
    step = df.select("k", "t", first.alias("one"))
    second = offsets.rewritten(F.col("one.text"), "x+|[.]", lambda m: F.when(m == ".", "").otherwise("XX"))
    step = step.select("*", second.alias("two"))
    spans = F.transform(F.sequence(F.lit(0), F.length("t")), lambda i: F.struct(i.alias("start"), F.least(i + 3, F.length("t")).alias("end")))
    for row in step.select("t", "one", "two", offsets.carried(spans, [F.col("one.map"), F.col("two.map")]).alias("s")).collect():
        one = re.sub("[0-9]+", lambda m: f"<{m[0]}{m[0]}>", row.t)
        assert row.one.text == one and row.two.text == re.sub("x+|[.]", lambda m: "" if m[0] == "." else "XX", one)
        for i, s in enumerate(row.s):
            raw = row.t[i : i + 3]
            assert 0 <= s.start <= s.end <= len(row.two.text)
            if re.fullmatch("[aby ]*", raw) and raw:  # what no rewrite touches is still under its span
                assert row.two.text[s.start : s.end] == raw


def test_running_sums(spark):
    lists = [[random.Random(n).randrange(9) for _ in range(n)] for n in (0, 1, 2, 3, 8, 100, 1025)]
    want = [[sum(x[: k + 1]) for k in range(len(x))] for x in lists]
    assert shown(column(spark, lists, "array<int>"), offsets.running(F.col("t"))) == want


def test_checks_compute_their_text_once(spark):
    from papyra.operators import gates

    made = F.regexp_replace("t", "zzz", "")
    for check in (X.quality_codes(made), X.disordered(made), X.evidence(made), gates.review_categories(made)):
        plan = column(spark, ["x"]).select(check.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("zzz") == 1 and plan.count("합격코스") <= 2


@pytest.mark.parametrize("text, want", [
    ("plain Oh words", ["ocr_noise"]), ("a (} 0 가)", ["ocr_noise"]), ("a卜b", ["ocr_noise"]), ("see r해양법]", ["ocr_noise"]), ("a¯b", ["ocr_noise"]), ("가12명a나", ["ocr_noise"]), ("room", []), ("Ohm and or", []), ("제Ⅲ장의", []), ("x 100", []),
])
def test_first_looks_lose_no_sign(spark, text, want):
    assert [c for c in column(spark, [text]).select(X.quality_codes(F.col("t")).alias("c")).first().c if c == "ocr_noise"] == want


@pytest.mark.parametrize("text, want", [("see ISM code 식별", True), ("a]12.b?", False), ("a]12.bc?", True), ("한쪽 →→", True), ("plain text", False), ("시간을 3 초과", True)])
def test_first_looks_lose_no_artifact(spark, text, want):
    assert column(spark, [text]).select(X.disordered(F.col("t")).alias("c")).first().c is want
