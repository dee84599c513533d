"""Grids of spanning cells and their widths against plain Python on random tables."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from papyra.functions import grids as G

TABLE = "k int, rows array<array<string>>, cells array<struct<row:int,col:int,text:string,row_span:int,col_span:int,horizontal_alignment:string,vertical_alignment:string>>"


def tables(n=40, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        rows = [[f"{k}.{i}.{j}" for j in range(r.randrange(0, 4))] for i in range(r.randrange(0, 4))]
        cells = [(r.randrange(-1, 4), r.randrange(0, 4), r.choice(["x", "", None, "가나\nlong line"]), r.choice([None, 0, 1, 2]), r.choice([1, 1, 2, 3]), r.choice([None, "right"]), None) for _ in range(r.randrange(0, 5))]
        out.append((k, rows, cells))
    return [*out, (n, None, None), (n + 1, [None, ["a"]], [None])]


def plain(rows, cells):
    rows = [r or [] for r in rows or []]
    cells = [c for c in cells or [] if c and c[0] >= 0 and c[1] >= 0]
    n = max([1, len(rows)] + [c[0] + max(1, c[3] or 1) for c in cells])
    m = max([1] + [len(r) for r in rows] + [c[1] + max(1, c[4] or 1) for c in cells])
    said = lambda r, c: rows[r][c] if r < len(rows) and c < len(rows[r]) else ""
    taken, out = {}, []
    for c in [x for _, x in sorted(enumerate(cells), key=lambda y: (y[1][0], y[1][1], y[0]))]:
        h, w = max(1, c[3] or 1), max(1, c[4] or 1)
        area = [(i, j) for i in range(c[0], c[0] + h) for j in range(c[1], c[1] + w)]
        if not any(a in taken for a in area):
            taken.update(dict.fromkeys(area))
            out.append((c[0], c[1], h, w, said(c[0], c[1]) if c[2] is None else c[2]))
    out += [(i, j, 1, 1, said(i, j)) for i in range(n) for j in range(m) if (i, j) not in taken]
    return n, m, sorted(out)


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(tables(), TABLE)
    return df.select("k", G.grid(F.col("rows"), F.col("cells")).alias("g")).cache()


def tuples(g):
    return g.n_rows, g.n_columns, [(c.row, c.col, c.row_span, c.col_span, c.text) for c in g.cells]


def test_grids_are_tiled(made):
    got = {r.k: tuples(r.g) for r in made.collect()}
    assert got == {k: plain(rows, cells) for k, rows, cells in tables()}


def test_split_gives_a_merged_table_back(made):
    at = [F.lit(x) for x in (1, 0, 0, 1)]
    one = made.select("k", "g", G.merged(F.col("g"), *at).alias("m"))
    two = one.select("k", "g", "m", G.split(F.col("m.grid"), F.lit(0), F.lit(0)).alias("s"), G.rows_of(F.col("m.grid")).alias("rows")).collect()
    errors = set()
    for r in two:
        errors.add(r.m.error)
        if r.m.error is None:
            assert tuples(r.s.grid) == tuples(r.g) and r.s.error is None
            texts = {(c.row, c.col): c.text for c in r.g.cells}
            assert r.rows[0][0] == "\n".join(texts[p] for p in ((0, 0), (0, 1), (1, 0), (1, 1)) if texts[p]) and r.rows[1][1] == ""
        else:
            assert tuples(r.m.grid) == tuples(r.g)
            small, spans = r.g.n_rows < 2 or r.g.n_columns < 2, any((c.row_span > 1 or c.col_span > 1) and c.row < 2 and c.col < 2 for c in r.g.cells)
            assert r.m.error == ("invalid_selection" if small else "merged_region_conflict") and (small or spans)
    assert errors == {None, "invalid_selection", "merged_region_conflict"}
    row = made.select(G.merged(F.col("g"), *[F.lit(0)] * 4).error.alias("a"), G.split(F.col("g"), F.lit(9), F.lit(0)).error.alias("b"), G.merged(F.col("g"), F.lit(None).cast("int"), *[F.lit(0)] * 3).error.alias("c")).first()
    assert (row.a, row.b, row.c) == ("merge_requires_multiple_cells", "split_requires_merged_origin", "invalid_selection")


@pytest.mark.parametrize("axis", ["row", "col"])
def test_what_is_inserted_can_be_removed(made, axis):
    one = made.select("g", G.inserted(F.col("g"), axis, F.lit(1)).alias("i"))
    for r in one.select("g", "i", G.removed(F.col("i.grid"), axis, F.array(F.lit(1))).alias("r")).collect():
        if r.i.error is None:
            assert tuples(r.r.grid) == tuples(r.g) and r.r.error is None
            assert len(r.i.grid.cells) == len(r.g.cells) + (r.g.n_columns if axis == "row" else r.g.n_rows)
        else:
            assert r.i.error == "merged_region_conflict" and tuples(r.i.grid) == tuples(r.g)
    bad = made.where("k = 40").select(*[G.removed(F.col("g"), axis, F.array(*[F.lit(p) for p in ps]).cast("array<int>")).error.alias(f"e{i}") for i, ps in enumerate(([], [0], [5]))], G.inserted(F.col("g"), axis, F.lit(7)).error.alias("e3")).first()
    assert list(bad) == ["invalid_selection", "minimum_table_size", "invalid_selection", "invalid_selection"]


def units(line):
    return sum(0.5 if c in " \t.,:;!'\"|ilI" else 2.0 if unicodedata.east_asian_width(c) in "WFA" else 1.0 for c in line)


def plain_layout(g, widths, mode, wide):
    n = g.n_columns
    given = [w / sum(widths) for w in widths] if widths and len(widths) == n and all(w > 0 for w in widths) else []
    scores = [1.0] * n
    for c in g.cells:
        need = max(1.0, max(map(units, c.text.splitlines()), default=0.0))
        for k in range(c.col, c.col + c.col_span):
            share = 1.0 if c.col_span == 1 else given[k] / sum(given[c.col : c.col + c.col_span]) if given else 1 / c.col_span
            scores[k] = max(scores[k], need * share)
    use = mode in ("manual", "source") and given
    ratios = given if use else [s / sum(scores) for s in scores]

    def allocate(total):
        if n * 12 > total:
            return [total / n] * n
        over = [max(0.0, r * total - 12) for r in ratios]
        over = over if sum(over) > 0 else ratios
        w = [12 + (total - n * 12) * v / sum(over) for v in over]
        for _ in range(n if n > 1 else 0):
            large = [k for k in range(n) if w[k] > 0.75 * total + 1e-9]
            if not large:
                break
            rest = sum(w[k] for k in range(n) if k not in large)
            w = [0.75 * total if k in large else w[k] * (total - 0.75 * total * len(large)) / rest for k in range(n)]
        w[-1] += total - sum(w)
        return w

    def lines(w):
        return max([1] + [sum(max(1, math.ceil(units(x) * 1.6 / sum(w[c.col : c.col + c.col_span]))) for x in c.text.splitlines() or [""]) for c in g.cells])

    wide = bool(wide) or n >= 5 or n * 12 > 82 or (n > 1 and lines(allocate(82.0)) > 3)
    w = allocate(180.0 if wide else 82.0)
    return w, 180.0 if wide else 82.0, mode if use else "auto", wide, lines(w)


def test_widths_fill_the_page(spark, made):
    r = random.Random(2)
    text = lambda: r.choice(["a", "가나다라마바사", "word " * 20, "x\ny\n" * 3, "", "il" * 40])
    rows = [(k, [[text() for _ in range(1 + k % 8)] for _ in range(2)], [(0, 0, text(), 1, min(2, 1 + k % 8), None, None)] if k % 3 else None) for k in range(60)]
    extra = [(k, [r.choice([0.0, 1.0, 5.0, 60.0]) for _ in range(1 + k % 8)] if k % 2 else None, r.choice(["manual", "source", "auto", None]), r.choice([True, False, None])) for k in range(60)]
    df = spark.createDataFrame(rows, TABLE).join(spark.createDataFrame(extra, "k int, w array<double>, mode string, wide boolean"), "k")
    grid = df.select("*", G.grid(F.col("rows"), F.col("cells")).alias("g"))
    for x in grid.select("g", "w", "mode", "wide", G.layout(F.col("g"), F.col("w"), F.col("mode"), F.col("wide")).alias("l")).collect():
        w, total, mode, wide, lines = plain_layout(x.g, x.w, x.mode, x.wide)
        assert x.l.widths_mm == pytest.approx(w) and sum(x.l.widths_mm) == pytest.approx(total) and (x.l.total_mm, x.l.mode, x.l.wide, x.l.lines) == (total, mode, wide, lines)
