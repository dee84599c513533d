"""Rich-text payloads: JSON documents with tables of rows and cells, read by column functions alone.

A payload is parsed twice: as variant, which tells what each part is, and as text of its parts. Invalid JSON counts as no payload.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 2
# The score from which a table may be drawn natively, and the modes of drawing and of widths.
AUTO_SCORE = 0.90
RENDER_MODES, WIDTH_MODES = ("auto", "image", "native"), ("auto", "manual", "source")
FLAGS = ("has_formula", "has_embedded_image", "has_rotated_text", "has_complex_merge", "has_duplicate_text_risk")
#: A table as far as the rules read it; unknown keys stay in the payload's own text.
TABLE = (
    "struct<id:string,rows:array<array<string>>,cells:array<struct<row:int,col:int,text:string,row_span:int,col_span:int,horizontal_alignment:string,vertical_alignment:string>>,"
    "column_widths:array<double>,layout:struct<width_mode:string,wide:boolean>,anchor:struct<offset:int,before_context:string,after_context:string>,"
    "source:struct<bbox:array<double>,image_path:string,sha256:string>,confidence:struct<score:double>,complexity:map<string,boolean>,render_mode:string>"
)
PAYLOAD = f"struct<tables:array<{TABLE}>,spans:array<struct<start:int,end:int,style:string>>>"


def parsed(payload: Column) -> Column:
    """The payload's tables and spans; null for null, invalid and blank payloads."""
    return F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE"})


def display(payload: Column) -> Column:
    """The non-empty texts of all tables' rows, then cells, table by table, one a line; empty if the payload is invalid."""
    tables = F.coalesce(parsed(payload)["tables"], F.from_json(F.lit("[]"), f"array<{TABLE}>"))
    none = F.expr("cast(array() as array<string>)")
    shown = lambda t: F.concat(F.coalesce(F.flatten(F.filter(F.coalesce(t["rows"], F.array(none)), lambda r: r.isNotNull())), none), F.transform(F.coalesce(t["cells"], F.from_json(F.lit("[]"), "array<struct<row:int,col:int,text:string,row_span:int,col_span:int,horizontal_alignment:string,vertical_alignment:string>>")), lambda c: c["text"]))
    return F.array_join(F.filter(F.flatten(F.transform(F.filter(tables, lambda t: t.isNotNull()), shown)), lambda x: x.isNotNull() & (x != "")), "\n")


def is_payload(payload: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def serialized(payload: Column) -> Column:
    """The payload as text, null where it says nothing (no object, no tables and no spans)."""
    p = parsed(payload)
    empty = ~is_payload(payload) | (F.coalesce(F.size(p["tables"]), F.lit(0)) <= 0) & (F.coalesce(F.size(p["spans"]), F.lit(0)) <= 0)
    return F.when(~empty, payload)


def with_spans(payload: Column, spans: Column) -> Column:
    """The payload's tables with the given spans in place of its own; null where neither is left."""
    p = parsed(payload)
    made = F.struct(F.lit(VERSION).alias("schema_version"), p["tables"].alias("tables"), F.when(F.size(spans) > 0, spans).alias("spans"))
    nothing = (F.coalesce(F.size(p["tables"]), F.lit(0)) <= 0) & (F.size(spans) <= 0)
    return F.when(~nothing, F.to_json(made))


def render_mode(table: Column, document: Column) -> Column:
    """A table's own mode, else the document's, else native from a score of AUTO_SCORE with structure and without a complexity flag, else image."""
    own, whole = F.lower(F.coalesce(table["render_mode"], F.lit("auto"))), F.lower(F.coalesce(document, F.lit("auto")))
    complex_ = F.exists(F.array(*[F.coalesce(table["complexity"][f], F.lit(False)) for f in FLAGS]), lambda x: x)
    structure = (F.coalesce(F.size(table["rows"]), F.lit(0)) > 0) | (F.coalesce(F.size(table["cells"]), F.lit(0)) > 0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(table["confidence"]["score"], F.lit(0.0))))
    automatic = F.when((score >= AUTO_SCORE) & structure & ~complex_, "native").otherwise("image")
    return F.when(own.isin("image", "native"), own).when(whole.isin("image", "native"), whole).otherwise(automatic)


def widths(table: Column) -> Column:
    """Column widths as shares of their sum, if there is a positive one for each column of the rows; else empty."""
    none = F.expr("cast(array() as array<double>)")
    columns = F.array_max(F.transform(F.coalesce(table["rows"], F.expr("cast(array() as array<array<string>>)")), F.size))
    given = F.coalesce(table["column_widths"], none)
    good = (F.size(given) == columns) & (columns > 0) & F.forall(given, lambda w: w > 0)
    total = F.aggregate(given, F.lit(0.0), lambda a, w: a + w)
    return F.when(F.coalesce(good, F.lit(False)), F.transform(given, lambda w: w / total)).otherwise(none)


def width_mode(table: Column) -> Column:
    """The table's width mode; source where it is unknown and widths are given, auto where widths are missing."""
    has = F.size(widths(table)) > 0
    given = F.lower(F.coalesce(table["layout"]["width_mode"], F.lit("")))
    mode = F.when(given.isin(*WIDTH_MODES), given).when(has, "source").otherwise("auto")
    return F.when(mode.isin("manual", "source") & ~has, "auto").otherwise(mode)


def anchor(text: Column, at: Column) -> Column:
    """struct<place, moved>: the stored offset if its contexts stand around it, else the place that contexts give, else the end."""
    offset, before, after = at["offset"], F.coalesce(at["before_context"], F.lit("")), F.coalesce(at["after_context"], F.lit(""))
    made = lambda place, moved: F.struct(place.cast("int").alias("place"), F.lit(moved).alias("moved"))
    size = F.length(text)
    fits = offset.between(0, size) & F.substring(text, F.lit(1), offset).endswith(before) & F.substring(text, offset + 1, size).startswith(after)
    first = F.call_function("instr", text, before)
    behind = first - 1 + F.length(before)
    later = F.call_function("locate", after, text, behind + 1)
    alone = F.call_function("instr", text, after)
    both = (before != "") & (after != "") & (first > 0) & (later > 0)
    return (
        F.when(fits, made(offset, False)).when(both, made(later - 1, True)).when((before != "") & (first > 0), made(behind, True)).when((after != "") & (alone > 0), made(alone - 1, True)).otherwise(made(size, True))
    )


def table_codes(table: Column, text: Column, width: float, height: float) -> Column:
    """Codes of what is wrong with a table: a box off the page, cells off the rows, an anchor that can't be found, a low score without a source."""
    box = table["source"]["bbox"]
    good_box = (F.size(box) == 4) & (box[0] >= 0) & (box[1] >= 0) & (box[2] > box[0]) & (box[3] > box[1]) & (box[2] <= width) & (box[3] <= height)
    rows = F.coalesce(table["rows"], F.expr("cast(array() as array<array<string>>)"))
    n, m = F.size(rows), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    span = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    place = lambda c: F.coalesce(c, F.lit(0))
    off = F.coalesce(F.exists(table["cells"], lambda c: (place(c["row"]) < 0) | (place(c["col"]) < 0) | (place(c["row"]) + span(c["row_span"]) > n) | (place(c["col"]) + span(c["col_span"]) > m)), F.lit(False))
    a = table["anchor"]
    offset = F.coalesce(a["offset"], F.lit(0))
    context = lambda c: (F.coalesce(a[c], F.lit("")) != "") & (F.call_function("instr", text, F.coalesce(a[c], F.lit(""))) > 0)
    lost = (text != "") & ~offset.between(0, F.length(text)) & ~(context("before_context") | context("after_context"))
    low = (F.coalesce(table["confidence"]["score"], F.lit(0.0)) < AUTO_SCORE) & table["source"]["image_path"].isNull() & (n == 0)
    return F.array_compact(
        F.array(F.when(box.isNotNull() & ~F.coalesce(good_box, F.lit(False)), "bbox_out_of_page"), F.when(off, "cell_out_of_bounds"), F.when(lost, "anchor_unresolved"), F.when(low, "low_confidence_without_source"))
    )


def surfaces(payload: Column, path: str) -> Column:
    """array<struct<path, text, code>> of a payload's row and cell texts with their structural findings; a null code is a sound text."""
    item = "struct<path:string,text:string,code:string>"
    invalid = F.array(F.struct(F.lit(path).alias("path"), payload.alias("text"), F.lit("invalid_format_json").alias("code")))
    none = F.expr(f"cast(array() as array<{item}>)")
    tables = parsed(payload)["tables"]

    def of_table(t, i):
        base = F.concat(F.lit(f"{path}.tables["), i.cast("string"), F.lit("]"))
        blank = lambda x: F.when(F.trim(x) == "", "empty_table_cell")
        rows = F.flatten(F.transform(F.coalesce(t["rows"], F.expr("cast(array() as array<array<string>>)")), lambda r, k: F.transform(r, lambda x, j: F.struct(F.concat(base, F.lit(".rows["), k.cast("string"), F.lit("]["), j.cast("string"), F.lit("]")).alias("path"), x.alias("text"), blank(x).alias("code")))))
        known = lambda c: F.get(F.get(t["rows"], c["row"]), c["col"])
        code = lambda c: F.coalesce(blank(c["text"]), F.when(c["row"].isNull() | c["col"].isNull(), "invalid_table_cell_coordinate").when(known(c) != c["text"], "rows_cells_divergence"))
        cells = F.transform(t["cells"], lambda c, j: F.struct(F.concat(base, F.lit(".cells["), j.cast("string"), F.lit("].text")).alias("path"), c["text"].alias("text"), code(c).alias("code")))
        return F.concat(rows, F.coalesce(cells, none))

    held = F.when(tables.isNotNull(), F.flatten(F.transform(tables, of_table))).otherwise(none)
    return F.when(payload.isNull() | (payload == ""), none).when(~is_payload(payload), invalid).otherwise(held)


def spans_fit(spans: Column, text: Column) -> Column:
    """Whether all spans lie within a text, so that they can be kept."""
    return F.coalesce(F.forall(spans, lambda s: (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length(text))), F.lit(True))


def normalized(table: Column, index: Column) -> Column:
    """A table with its defaults: an id by place, texts for nulls, spans of one at least, left and center alignments, clamped score, known modes."""
    empty = F.expr("cast(array() as array<array<string>>)")
    rows = F.transform(F.filter(F.coalesce(table["rows"], empty), lambda r: r.isNotNull()), lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(""))))
    least = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))

    def cell(c):
        return F.struct(
            F.coalesce(c["row"], F.lit(0)).alias("row"), F.coalesce(c["col"], F.lit(0)).alias("col"), F.coalesce(c["text"], F.lit("")).alias("text"), least(c["row_span"]).alias("row_span"), least(c["col_span"]).alias("col_span"),
            F.coalesce(F.nullif(c["horizontal_alignment"], F.lit("")), F.lit("left")).alias("horizontal_alignment"), F.coalesce(F.nullif(c["vertical_alignment"], F.lit("")), F.lit("center")).alias("vertical_alignment"),
        )

    none = F.from_json(F.lit("[]"), "array<struct<row:int,col:int,text:string,row_span:int,col_span:int,horizontal_alignment:string,vertical_alignment:string>>")
    mode = F.lower(F.coalesce(table["render_mode"], F.lit("auto")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(table["confidence"]["score"], F.lit(0.0))))
    return F.struct(
        F.coalesce(F.nullif(table["id"], F.lit("")), F.concat(F.lit("table-"), (index + 1).cast("string"))).alias("id"), rows.alias("rows"), F.transform(F.coalesce(table["cells"], none), cell).alias("cells"),
        widths(table).alias("column_widths"), width_mode(table).alias("width_mode"), score.alias("score"), F.when(mode.isin(*RENDER_MODES), mode).otherwise("auto").alias("render_mode"),
    )


def with_row(rows: Column, at: Column, columns: Column) -> Column:
    """Rows with an empty row of `columns` cells before the place `at` (0 is the first)."""
    return F.concat(F.slice(rows, F.lit(1), at), F.array(F.array_repeat(F.lit(""), columns)), F.slice(rows, at + 1, F.size(rows)))


def without_row(rows: Column, at: Column) -> Column:
    """Rows without the one at a place; the last row stays."""
    return F.when(F.size(rows) > 1, F.filter(rows, lambda r, i: i != at)).otherwise(rows)


def with_column(rows: Column, at: Column) -> Column:
    """Rows with an empty cell before the place `at` of each."""
    return F.transform(rows, lambda r: F.concat(F.slice(r, F.lit(1), at), F.array(F.lit("")), F.slice(r, at + 1, F.size(r))))


def without_column(rows: Column, at: Column) -> Column:
    """Rows without their cell at a place; a last column stays."""
    return F.when(F.array_max(F.transform(rows, F.size)) > 1, F.transform(rows, lambda r: F.filter(r, lambda c, i: i != at))).otherwise(rows)


def rectangular(rows: Column) -> Column:
    """Rows padded with empty cells to the widest; null cells and rows are empty; one cell at least."""
    width = F.greatest(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), F.lit(1))
    full = F.transform(rows, lambda r: F.concat(F.transform(F.coalesce(r, F.expr("cast(array() as array<string>)")), lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))))
    return F.when(F.size(rows) > 0, full).otherwise(F.array(F.array(F.lit(""))))


def aligned_choice(headers: Column, values: Column) -> Column:
    """struct<text, payload> of one choice of a (가)/(나) matrix: its searchable text and a table of two rows; null if headers or values don't fit."""
    named = F.slice(F.array(*[F.lit(f"({x})") for x in "가나다라"]), F.lit(1), F.size(headers))
    good = F.size(headers).between(2, 4) & (headers == named) & (F.size(values) == F.size(headers)) & F.forall(values, lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    plain = F.transform(values, lambda v: F.trim(v))
    cell = lambda row: lambda t, i: F.struct(F.lit(row).alias("row"), i.alias("col"), t.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"))
    table = F.struct(F.array(headers, plain).alias("rows"), F.concat(F.transform(headers, cell(0)), F.transform(plain, cell(1))).alias("cells"))
    made = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.array(table).alias("tables")))
    return F.when(good, F.struct(F.array_join(F.zip_with(headers, plain, lambda h, v: F.concat_ws(" ", h, v)), " / ").alias("text"), made.alias("payload")))
