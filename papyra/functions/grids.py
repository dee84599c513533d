"""Tables with spanning cells, as column functions: a grid that its cells tile, merging and splitting, and column widths on paper.

A grid is struct<n_rows, n_columns, cells>, its cells in order of row and column, each place under one cell. Changes that a grid refuses
give it back unchanged with an error's code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.offsets import let

CELL = "struct<row:int,col:int,row_span:int,col_span:int,text:string,horizontal_alignment:string,vertical_alignment:string,backup:array<struct<row:int,col:int,text:string>>>"
GRID = f"struct<n_rows:int,n_columns:int,cells:array<{CELL}>>"
# Millimetres of narrow and wide tables, of the narrowest column and of a display unit; the largest share of a column; lines that a narrow table may wrap to; columns of a wide table.
NARROW, WIDE, LEAST, UNIT, MOST_SHARE, MOST_LINES, WIDE_COLUMNS = 82.0, 180.0, 12.0, 1.6, 0.75, 3, 5

_NO_CELLS = f"cast(array() as array<{CELL}>)"


def _cell(row, col, text, row_span=None, col_span=None, horizontal=None, vertical=None, backup=None) -> Column:
    one = F.lit(1)
    return F.struct(
        row.alias("row"), col.alias("col"), (one if row_span is None else row_span).alias("row_span"), (one if col_span is None else col_span).alias("col_span"), text.alias("text"),
        F.coalesce(horizontal if horizontal is not None else F.lit(None), F.lit("left")).alias("horizontal_alignment"), F.coalesce(vertical if vertical is not None else F.lit(None), F.lit("center")).alias("vertical_alignment"),
        (backup if backup is not None else F.lit(None)).cast("array<struct<row:int,col:int,text:string>>").alias("backup"),
    ).cast(CELL)


def _meet(a: Column, b: Column) -> Column:
    """Whether two cells share a place."""
    return (a["row"] < b["row"] + b["row_span"]) & (b["row"] < a["row"] + a["row_span"]) & (a["col"] < b["col"] + b["col_span"]) & (b["col"] < a["col"] + a["col_span"])


def _ordered(cells: Column) -> Column:
    return F.array_sort(cells, lambda a, b: F.when(a["row"] != b["row"], a["row"] - b["row"]).otherwise(a["col"] - b["col"]).cast("int"))


def _span(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(1)), F.lit(1))


def grid(rows: Column, cells: Column) -> Column:
    """The grid of rows of texts and of cells (struct with row, col, text, row_span, col_span, alignments; null ones go).

    Of cells that overlap the first by row, column and place counts; spans end with the grid; places without a cell get one of their row's text.
    """
    rows = F.coalesce(rows, F.expr("cast(array() as array<array<string>>)"))
    inside = F.filter(F.coalesce(cells, F.expr("cast(array() as array<struct<row:int,col:int,text:string,row_span:int,col_span:int,horizontal_alignment:string,vertical_alignment:string>>)")), lambda c: c.isNotNull() & (F.coalesce(c["row"], F.lit(0)) >= 0) & (F.coalesce(c["col"], F.lit(0)) >= 0))

    def sized(x):
        ends = lambda at, span: F.coalesce(F.array_max(F.transform(x["c"], lambda c: F.coalesce(c[at], F.lit(0)) + _span(c[span]))), F.lit(0))
        n_rows = F.greatest(F.lit(1), F.size(x["r"]), ends("row", "row_span"))
        n_columns = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(x["r"], lambda r: F.greatest(F.size(r), F.lit(0)))), F.lit(0)), ends("col", "col_span"))
        return F.struct(x["r"].alias("r"), x["c"].alias("c"), n_rows.cast("int").alias("n"), n_columns.cast("int").alias("m"))

    def tiled(x):
        said = lambda r, c: F.coalesce(F.get(F.get(x["r"], r), c), F.lit(""))

        def full(c, i):
            row, col = F.coalesce(c["row"], F.lit(0)), F.coalesce(c["col"], F.lit(0))
            made = _cell(row, col, F.coalesce(c["text"], said(row, col)), F.least(_span(c["row_span"]), x["n"] - row), F.least(_span(c["col_span"]), x["m"] - col), F.nullif(c["horizontal_alignment"], F.lit("")), F.nullif(c["vertical_alignment"], F.lit("")))
            return F.struct(row.alias("a"), col.alias("b"), i.alias("i"), made.alias("cell"))

        order = F.transform(F.array_sort(F.transform(x["c"], full)), lambda y: y["cell"])
        kept = F.aggregate(order, F.expr(_NO_CELLS), lambda acc, c: F.when(F.exists(acc, lambda k: _meet(k, c)), acc).otherwise(F.concat(acc, F.array(c))))
        places = F.flatten(F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda r: F.transform(F.sequence(F.lit(0), x["m"] - 1), lambda c: _cell(r, c, said(r, c)))))
        whole = let(kept, lambda k: _ordered(F.concat(k, F.filter(places, lambda p: ~F.exists(k, lambda c: _meet(c, p))))))
        return F.struct(x["n"].alias("n_rows"), x["m"].alias("n_columns"), whole.alias("cells"))

    return let(let(F.struct(rows.alias("r"), inside.alias("c")), sized), tiled)


def rows_of(g: Column) -> Column:
    """The grid's rows of texts: a cell's text stands at its first place, and its other places are empty."""
    at = lambda r, c: F.coalesce(F.get(F.filter(g["cells"], lambda x: (x["row"] == r) & (x["col"] == c)), F.lit(0))["text"], F.lit(""))
    return F.transform(F.sequence(F.lit(0), g["n_rows"] - 1), lambda r: F.transform(F.sequence(F.lit(0), g["n_columns"] - 1), lambda c: at(r, c)))


def _result(g: Column, new: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), new).otherwise(g).alias("grid"), error.alias("error"))


def _with(g: Column, cells: Column, rows: Column | None = None, columns: Column | None = None) -> Column:
    return F.struct((g["n_rows"] if rows is None else rows).cast("int").alias("n_rows"), (g["n_columns"] if columns is None else columns).cast("int").alias("n_columns"), _ordered(cells).alias("cells"))


def merged(g: Column, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """struct<grid, error>: the rectangle's cells as one, their texts in lines, with a backup of each.

    invalid_selection: it isn't in the grid; merge_requires_multiple_cells: it is one place; merged_region_conflict: it meets a spanning cell.
    """

    def made(x):
        area = F.struct(F.least(x["a"], x["c"]).alias("row"), F.least(x["b"], x["d"]).alias("col"), (F.abs(x["c"] - x["a"]) + 1).alias("row_span"), (F.abs(x["d"] - x["b"]) + 1).alias("col_span"))

        def of(s):
            held = F.filter(x["g"]["cells"], lambda c: _meet(c, s))
            outside = F.coalesce((s["row"] < 0) | (s["col"] < 0) | (s["row"] + s["row_span"] > x["g"]["n_rows"]) | (s["col"] + s["col_span"] > x["g"]["n_columns"]), F.lit(True))
            conflict = F.exists(held, lambda c: (c["row_span"] > 1) | (c["col_span"] > 1))
            error = F.when(outside, "invalid_selection").when((s["row_span"] == 1) & (s["col_span"] == 1), "merge_requires_multiple_cells").when(conflict, "merged_region_conflict")
            text = F.array_join(F.filter(F.transform(held, lambda c: c["text"]), lambda t: t != ""), "\n")
            first = F.get(held, F.lit(0))
            one = _cell(s["row"], s["col"], text, s["row_span"], s["col_span"], first["horizontal_alignment"], first["vertical_alignment"], F.transform(held, lambda c: F.struct(c["row"], c["col"], c["text"])))
            return _result(x["g"], _with(x["g"], F.concat(F.filter(x["g"]["cells"], lambda c: ~_meet(c, s)), F.array(one))), error)

        return let(area, of)

    return let(F.struct(g.alias("g"), top.alias("a"), left.alias("b"), bottom.alias("c"), right.alias("d")), made)


def split(g: Column, row: Column, col: Column) -> Column:
    """struct<grid, error>: a spanning cell as single ones, with the texts of its backup, else its own text at the first place. split_requires_merged_origin: no such cell begins there."""

    def made(x):
        own = F.get(F.filter(x["g"]["cells"], lambda c: (c["row"] == x["r"]) & (c["col"] == x["c"]) & ((c["row_span"] > 1) | (c["col_span"] > 1))), F.lit(0))

        def of(o):
            known = lambda r, c: F.get(F.filter(o["backup"], lambda b: (b["row"] == r) & (b["col"] == c)), F.lit(0))["text"]
            origin = lambda r, c: (r == o["row"]) & (c == o["col"])
            text = lambda r, c: F.when(F.size(o["backup"]) > 0, F.coalesce(known(r, c), F.lit(""))).when(origin(r, c), o["text"]).otherwise("")
            side = lambda r, c, name: F.when(origin(r, c), o[name])
            single = lambda r, c: _cell(r, c, text(r, c), horizontal=side(r, c, "horizontal_alignment"), vertical=side(r, c, "vertical_alignment"))
            cells = F.flatten(F.transform(F.sequence(o["row"], o["row"] + o["row_span"] - 1), lambda r: F.transform(F.sequence(o["col"], o["col"] + o["col_span"] - 1), lambda c: single(r, c))))
            rest = F.filter(x["g"]["cells"], lambda c: ~((c["row"] == o["row"]) & (c["col"] == o["col"])))
            return _result(x["g"], _with(x["g"], F.concat(rest, cells)), F.when(o.isNull(), "split_requires_merged_origin"))

        return let(own, of)

    return let(F.struct(g.alias("g"), row.alias("r"), col.alias("c")), made)


def _moved_cells(cells: Column, axis: str, shift) -> Column:
    moved = {a: (lambda c, a=a: c[a] + shift(c) if a == axis else c[a]) for a in ("row", "col")}
    return F.transform(cells, lambda c: _cell(moved["row"](c), moved["col"](c), c["text"], c["row_span"], c["col_span"], c["horizontal_alignment"], c["vertical_alignment"], c["backup"]))


def inserted(g: Column, axis: str, at: Column) -> Column:
    """struct<grid, error>: an empty row or column (axis: row, col) before a place. invalid_selection: no such place; merged_region_conflict: a spanning cell lies across it."""
    span, size, other = f"{axis}_span", "n_rows" if axis == "row" else "n_columns", "n_columns" if axis == "row" else "n_rows"

    def made(x):
        h, k = x["g"], x["k"]
        error = F.when(~F.coalesce(k.between(0, h[size]), F.lit(False)), "invalid_selection").when(F.exists(h["cells"], lambda c: (c[axis] < k) & (k < c[axis] + c[span])), "merged_region_conflict")
        cells = _moved_cells(h["cells"], axis, lambda c: F.when(c[axis] >= k, 1).otherwise(0))
        new = F.transform(F.sequence(F.lit(0), h[other] - 1), lambda i: _cell(k if axis == "row" else i, i if axis == "row" else k, F.lit("")))
        grown = {"rows": h["n_rows"] + 1} if axis == "row" else {"columns": h["n_columns"] + 1}
        return _result(h, _with(h, F.concat(cells, new), **grown), error)

    return let(F.struct(g.alias("g"), at.cast("int").alias("k")), made)


def removed(g: Column, axis: str, places: Column) -> Column:
    """struct<grid, error>: the grid without rows or columns. invalid_selection: none, or not in the grid; minimum_table_size: all; merged_region_conflict: a spanning cell lies on one."""
    span, size = f"{axis}_span", "n_rows" if axis == "row" else "n_columns"

    def made(x):
        h, gone = x["g"], x["p"]
        outside = (F.size(gone) < 1) | F.exists(gone, lambda p: ~p.between(0, h[size] - 1))
        on = lambda c: F.exists(gone, lambda p: (c[axis] <= p) & (p < c[axis] + c[span]))
        error = F.when(F.coalesce(outside, F.lit(True)), "invalid_selection").when(F.size(gone) >= h[size], "minimum_table_size").when(F.exists(h["cells"], lambda c: on(c) & ((c["row_span"] > 1) | (c["col_span"] > 1))), "merged_region_conflict")
        kept = F.filter(h["cells"], lambda c: ~F.array_contains(gone, c[axis]))
        cells = _moved_cells(kept, axis, lambda c: -F.size(F.filter(gone, lambda p: p < c[axis])))
        less = {"rows": h["n_rows"] - F.size(gone)} if axis == "row" else {"columns": h["n_columns"] - F.size(gone)}
        return _result(h, _with(h, cells, **less), error)

    return let(F.struct(g.alias("g"), F.array_distinct(places).alias("p")), made)


# ---- column widths ----------------------------------------------------------------------------------------------


def line_units(texts: Column) -> Column:
    """array<array<double>>: the display units of each line of each text; a text without lines has one of none. Character widths are Python's tables."""

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata
        from functools import lru_cache

        @lru_cache(1 << 16)
        def units(c: str) -> float:
            return 0.5 if c in " \t.,:;!'\"|ilI" else 2.0 if unicodedata.east_asian_width(c) in "WFA" else 1.0

        for batch in batches:
            yield pd.Series([None if row is None else [[float(sum(map(units, line))) for line in (t or "").splitlines() or [""]] for t in row] for row in batch], dtype=object)

    return run(texts)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def allocated(ratios: Column, total: float) -> Column:
    """Widths of the given shares that fill `total`: LEAST for each column, the rest by what a share is over it; no column over MOST_SHARE of the whole, whose excess the others take in proportion."""
    n = F.size(ratios)

    def dealt(x):
        over = F.transform(x, lambda r: F.greatest(r * total - LEAST, F.lit(0.0)))
        weights = let(over, lambda o: F.when(_sum(o) > 0, o).otherwise(x))
        return let(weights, lambda w: let(_sum(w), lambda s: F.transform(w, lambda v: LEAST + (total - F.size(w) * LEAST) * v / s)))

    cap = total * MOST_SHARE

    def capped(acc):
        large = lambda w: w > cap + 1e-9
        kept = F.filter(acc, lambda w: ~large(w))
        target = total - cap * (F.size(acc) - F.size(kept))
        return F.when(F.exists(acc, large), let(F.struct(target.alias("t"), _sum(kept).alias("s"), F.size(kept).alias("n")), lambda k: F.transform(acc, lambda w: F.when(large(w), F.lit(cap)).when(k["s"] <= 0, k["t"] / k["n"]).otherwise(w * k["t"] / k["s"])))).otherwise(acc)

    def bounded(widths):
        rounds = F.aggregate(F.sequence(F.lit(1), F.size(widths)), widths, lambda acc, _: let(acc, capped))
        return F.when(F.size(widths) > 1, rounds).otherwise(widths)

    corrected = lambda w: let(total - _sum(w), lambda rest: F.transform(w, lambda v, i: F.when(i == F.size(w) - 1, v + rest).otherwise(v)))
    return F.when(n * LEAST > total, F.transform(ratios, lambda r: total / n)).otherwise(let(let(let(ratios, dealt), bounded), corrected))


def layout(g: Column, widths: Column, mode: Column, wide: Column) -> Column:
    """struct<widths_mm, total_mm, mode, wide, lines> of a grid on paper.

    Given widths (one over 0 for each column) count in the modes manual and source, else the widest line of each column (a spanning cell's is shared by its columns). A table is wide if it is asked
    for, from WIDE_COLUMNS on, if its columns would be too narrow, or if one of several columns would wrap to more than MOST_LINES lines.
    """
    good = F.coalesce((F.size(widths) == g["n_columns"]) & F.forall(widths, lambda w: w > 0), F.lit(False))
    given = F.when(good, F.transform(widths, lambda w: w / _sum(widths))).otherwise(F.expr("cast(array() as array<double>)"))
    x = F.struct(g.alias("g"), given.alias("given"), line_units(F.transform(g["cells"], lambda c: c["text"])).alias("u"), F.coalesce(mode, F.lit("auto")).alias("mode"), F.coalesce(wide, F.lit(False)).alias("wide"))

    def scored(x):
        h = x["g"]
        need = lambda i: F.greatest(F.lit(1.0), F.array_max(F.get(x["u"], i)))
        own = lambda c: F.slice(x["given"], c["col"] + 1, c["col_span"])
        share = lambda c, k: F.when(F.size(x["given"]) > 0, F.get(x["given"], k) / _sum(own(c))).otherwise(1.0 / c["col_span"])
        at = lambda c, i, k: F.when((c["col"] <= k) & (k < c["col"] + c["col_span"]), F.when(c["col_span"] == 1, need(i)).otherwise(need(i) * share(c, k)))
        scores = F.transform(F.sequence(F.lit(0), h["n_columns"] - 1), lambda k: F.greatest(F.lit(1.0), F.array_max(F.transform(h["cells"], lambda c, i: at(c, i, k)))))
        use = x["mode"].isin("manual", "source") & (F.size(x["given"]) > 0)
        ratios = F.when(use, x["given"]).otherwise(let(scores, lambda s: let(_sum(s), lambda t: F.transform(s, lambda v: v / t))))
        return F.struct(h.alias("g"), x["u"].alias("u"), F.when(use, x["mode"]).otherwise("auto").alias("mode"), x["wide"].alias("wide"), ratios.alias("r"))

    def lines(x, widths):
        def of(c, i):
            room = _sum(F.slice(widths, c["col"] + 1, c["col_span"]))
            return let(room, lambda r: F.aggregate(F.get(x["u"], i), F.lit(0).cast("long"), lambda a, u: a + F.greatest(F.lit(1).cast("long"), F.ceil(u * UNIT / r))))

        return F.greatest(F.lit(1).cast("long"), F.array_max(F.transform(x["g"]["cells"], of)))

    def placed(x):
        n = x["g"]["n_columns"]
        narrow = let(allocated(x["r"], NARROW), lambda w: lines(x, w))
        wide = x["wide"] | (n >= WIDE_COLUMNS) | (n * LEAST > NARROW) | ((n > 1) & (narrow > MOST_LINES))
        made = lambda w, total, is_wide: F.struct(w.alias("widths_mm"), F.lit(total).alias("total_mm"), x["mode"].alias("mode"), F.lit(is_wide).alias("wide"), lines(x, w).cast("int").alias("lines"))
        return F.when(wide, let(allocated(x["r"], WIDE), lambda w: made(w, WIDE, True))).otherwise(let(allocated(x["r"], NARROW), lambda w: made(w, NARROW, False)))

    return let(let(x, scored), placed)
