"""Layout of pages: fixtures of one, two and three columns, cuts and chains against brute force, ruled tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import layout as L

WORD = "page int, x0 double, y0 double, x1 double, y1 double, text string"


def pages(spark, *ids):
    return spark.createDataFrame([(p, 600.0, 800.0) for p in ids], "page int, width double, height double")


def two_columns(page, rows=6, shift=0.0):
    """Rows of two words on either side of x = 300; the right ones may stand between the left ones' rows."""
    out = []
    for k in range(rows):
        y = 100.0 + 20 * k
        out += [(page, 50.0, y, 120.0, y + 10, f"a{k}"), (page, 130.0, y + 2, 260.0, y + 11, f"b{k}")]
        out += [(page, 340.0, y + shift, 420.0, y + shift + 10, f"c{k}"), (page, 430.0, y + shift, 550.0, y + shift + 10, f"d{k}")]
    return out


def test_columns_of_pages(spark):
    one = [(2, 50.0, 100.0 + 20 * k, 550.0, 110.0 + 20 * k, f"w{k}") for k in range(6)]
    margin = [(1, 50.0, 5.0, 60.0, 15.0, "head"), (1, 400.0, 790.0, 410.0, 799.0, "7"), (1, 0.0, 0.0, 1.0, 1.0, " ")]
    single = two_columns(4, rows=1)
    words = spark.createDataFrame(two_columns(1) + margin + one + two_columns(3, shift=10.0) + single, WORD).repartition(3)
    got = {r.page: r.divider for r in L.dividers(words, pages(spark, 1, 2, 3, 4, 5)).collect()}
    assert got == {1: 300.0, 2: None, 3: 300.0, 4: None, 5: None}
    lines = [(r.page, r.column, r.line, r.text) for r in L.page_lines(words, pages(spark, 1, 2, 3, 4, 5)).orderBy("page", "column", "line").collect()]
    assert [x for x in lines if x[0] == 1] == [(1, 0, 0, "head")] + [(1, 0, k + 1, f"a{k} b{k}") for k in range(6)] + [(1, 1, k, f"c{k} d{k}") for k in range(6)] + [(1, 1, 6, "7")]
    assert [x[3] for x in lines if x[0] == 2] == [f"w{k}" for k in range(6)] and [x[3] for x in lines if x[0] == 4] == ["a0 b0 c0 d0"]
    box = L.page_lines(words, pages(spark, 1)).where("text = 'a0 b0'").first().box
    assert tuple(box) == (50 / 600, 100 / 800, 260 / 600, 111 / 800)


def test_rows_follow_their_mean_centre(spark):
    ys = [100, 104, 108, 112, 140, 143, 160]
    words = spark.createDataFrame([(1, 10.0 * k, float(y), 10.0 * k + 5, y + 10.0, "w") for k, y in enumerate(ys)], WORD)
    got = [r.row for r in L.word_rows(words, ["page"]).orderBy("x0").collect()]
    expected, row, members = [], -1, []
    for y in ys:
        if members and abs(y + 5 - sum(members) / len(members)) <= 4.5:
            members.append(y + 5)
        else:
            row, members = row + 1, [y + 5]
        expected.append(row)
    assert got == expected


def cut(boxes, axis=0, still=0, least=4):
    """Groups of boxes, by trying every place of a cut."""
    low, high = (0, 2) if axis == 0 else (1, 3)
    groups, rest = [], sorted(boxes, key=lambda b: b[low])
    while rest:
        ends = sorted({b[high] for b in rest})
        place = next((e for e in ends if all(b[high] <= e or b[low] >= e + least for b in rest) and any(b[low] >= e + least for b in rest)), None)
        first = rest if place is None else [b for b in rest if b[high] <= place]
        groups.append(first)
        rest = [b for b in rest if b not in first]
    if len(groups) == 1:
        return groups if still else cut(boxes, 1 - axis, 1, least)
    return [g for part in groups for g in cut(part, 1 - axis, 0, least)]


@pytest.mark.parametrize("seed", [1, 2])
def test_regions_equal_all_cuts(spark, seed):
    r = random.Random(seed)
    rows, expected = [], {}
    for page in range(25):
        boxes = list({(x, y, x + r.randrange(1, 25), y + r.randrange(1, 15)) for x, y in ((r.randrange(0, 100), r.randrange(0, 60)) for _ in range(r.randrange(1, 12)))})
        rows += [(page, *map(float, b)) for b in boxes]
        expected[page] = sorted(sorted(g) for g in cut(boxes))
    df = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double")
    got: dict = {}
    for x in L.cut_regions(df, "page", 4.0, 4.0, 12).collect():
        got.setdefault(x.page, {}).setdefault(x.region, []).append((x.x0, x.y0, x.x1, x.y1))
    assert {p: sorted(sorted(g) for g in of.values()) for p, of in got.items()} == expected


def test_three_columns_are_three_regions(spark):
    boxes = [(1, 10.0 + 100 * c, 10.0 + 12 * k, 90.0 + 100 * c, 20.0 + 12 * k) for c in range(3) for k in range(5)]
    assert L.cut_regions(spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double"), "page", 8.0, 5.0).select("region").distinct().count() == 3


def grid(page, first, xs, ys):
    lines = [(xs[0], y, xs[-1], y + 0.5) for y in ys] + [(x, ys[0], x + 0.5, ys[-1]) for x in xs]
    return [(page, first + k, *map(float, line)) for k, line in enumerate(lines)]


def test_ruled_tables_come_apart(spark):
    rule = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    one, two = grid(1, 0, [0, 50, 100], [0, 20, 40]), grid(1, 10, [200, 230, 260, 300], [100, 110, 130])
    broken = [x for x in grid(2, 0, [0, 50, 100], [0, 20, 40]) if x[1] != 1] + [(2, 1, 0.0, 20.0, 50.0, 20.0)]
    small = grid(3, 0, [0, 50], [0, 20, 40])
    words = [(1, 5.0, 5.0, 20.0, 10.0, "a", 0.5), (1, 22.0, 5.0, 40.0, 10.0, "b", 0.5), (1, 60.0, 25.0, 90.0, 35.0, "d", None), (1, 240.0, 115.0, 250.0, 120.0, "x", 1.0), (1, 500.0, 500.0, 510.0, 510.0, "out", 1.0), (1, 5.0, 12.0, 9.0, 16.0, "c", 0.6)]
    made = L.ruled_tables(spark.createDataFrame(one + two + broken + small, rule).repartition(3), spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, text string, confidence double"))
    got = sorted(made.collect(), key=lambda r: r.x0)
    assert [r.rows for r in got] == [[["a b c", ""], ["", "d"]], [["", "", ""], ["", "x", ""]]]
    assert [round(w, 2) for w in got[1].column_widths] == [0.3, 0.3, 0.4] and sum(got[0].row_heights) == pytest.approx(1)
    assert got[0].score == round(0.7 + 0.2 + 0.1 * (0.5 + 0.5 + 1 + 0.6) / 4, 4)


def test_crossing_lines_are_linked_page_by_page(spark, monkeypatch):
    monkeypatch.setattr(L, "_PAIRS", 5)
    r = random.Random(4)
    lines = [(p, k, r.choice("xy"), float(a := r.randrange(30)), float(a + r.randrange(12)), float(r.randrange(30))) for p in range(12) for k in r.sample(range(50), p * 2)]
    want = set()
    for p in range(12):
        own = [x for x in lines if x[0] == p]
        low = {x[1]: x[1] for x in own}
        met = [(a[1], b[1]) for a in own for b in own if a[2] == "y" and b[2] == "x" and a[3] - 1 <= b[5] <= a[4] + 1 and b[3] - 1 <= a[5] <= b[4] + 1]
        for _ in own:
            for a, b in met:
                low[a] = low[b] = min(low[a], low[b])
        want |= {(p, low[x[1]], *x[2:]) for x in own if any(x[1] in e for e in met)}
    odd = [(None, 1, "y", 0.0, 9.0, 1.0), (None, 2, "x", 0.0, 9.0, 1.0), (1, None, "y", 0.0, 99.0, 1.0)]
    df = spark.createDataFrame(lines + odd, "page int, id int, axis string, low double, high double, at double")
    assert {(x.page, x.table, *line) for x in L.crossed(df, "page", 1.0).collect() for line in x.lines} == want and len({w[1] for w in want}) > 10


def test_components_of_long_paths(spark):
    r = random.Random(3)
    ids = list(range(300))
    r.shuffle(ids)
    edges = [(ids[k], ids[k + 1]) for k in range(299) if k % 100 != 99]
    got = {x.id: x.component for x in L.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: min(ids[k // 100 * 100 : k // 100 * 100 + 100]) for k, x in enumerate(ids)}


def test_chains_equal_brute_force(spark):
    r = random.Random(9)
    data = {d: [r.randrange(1, 9) for _ in range(r.randrange(0, 9))] for d in range(60)}
    rows = [(d, k, n) for d, ns in data.items() for k, n in enumerate(ns)]
    got: dict = {}
    for x in L.chained_starts(spark.createDataFrame(rows + [(0, 99, None)], "doc int, place int, number int"), "doc", "place", "number", 3).collect():
        got.setdefault(x.doc, []).append((x.place, x.number))
    for d, ns in data.items():
        chains = [c for n in range(1, len(ns) + 1) for c in itertools.combinations(enumerate(ns), n) if all(0 < b[1] - a[1] <= 3 for a, b in zip(c, c[1:]))]
        score = lambda c: (len(c), -(c[-1][1] - c[0][1] - len(c) + 1))
        best = max(map(score, chains), default=None)
        own = tuple(sorted(got.get(d, [])))
        assert own in chains and score(own) == best if chains else not own


def test_segments_are_recovered_from_the_one_before(spark):
    body, more = "첫째 물음의 글이 여기서부터 물음의 글이 여기에 서른 자 이상 길게 이어진다 그리고 더 이어진다", "다음 중 옳은 것은 무엇인가 서른 자가 되도록 길게 쓴다 하나 둘 셋 넷"
    rows = [(1, 1, f"{body} 2. {more} 3 {more}"), (1, 5, f"{body} 6. short"), (2, 1, f"x 2. {more}"), (3, 2, body)]
    got = sorted(map(tuple, L.recovered_segments(spark.createDataFrame(rows, "doc int, number int, text string"), "doc", "number", "text", F.lit(6)).collect()))
    assert got == [(1, 1, body), (1, 2, more), (1, 3, more), (1, 5, f"{body} 6. short"), (2, 1, f"x 2. {more}"), (3, 2, body)]


def test_each_document_has_its_divider(spark):
    from papyra.plans.pages import column_dividers

    words = " ".join(["word"] * 24)
    documents = spark.createDataFrame([(1, words), (2, words), (3, words), (5, "few words"), (-7, words), (None, "a b"), (9, "12")], "doc_id long, text string")
    assert {r.page: r.divider for r in column_dividers(documents).collect()} == {1: 305.0, 2: 305.0, 3: None, 5: None, -7: 305.0, None: None}
    dealt = column_dividers(documents)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "w AS text" in dealt  # words' texts aren't shuffled
