"""Page layout: words with boxes to rows, columns, lines and ruled tables, and question starts to their longest chain.

All work is by window, join or a walk over sorted rows, with a page as the key; a page's words are held together for its dividers and lines. Boxes are columns x0, y0, x1, y1; pages have width and height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from papyra.functions.offsets import let
from papyra.operators.ordered import walked
from papyra.sources.scratch import stored

# Shares of a page's width and height that tell columns from gaps and the body from margins, and of a word's height that tell rows.
GUTTER, MIDDLE, BODY, ROW, LEAST_ROW = 0.08, (0.30, 0.70), (0.08, 0.90), 0.45, 2.0
# Parts of a table's score.
SCORE = (0.70, 0.20, 0.10, 0.99)


def _centre(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


def word_rows(words: DataFrame, keys: list[str]) -> DataFrame:
    """words with a column row: numbers from 0 downwards. A word joins the row above it whose mean centre lies within ROW of the page's median height (LEAST_ROW at least).

    keys: what makes a page (or a column of one). Words without text go.
    """
    good = words.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    reach = good.groupBy(*keys).agg(F.greatest(F.lit(LEAST_ROW), F.median(height) * ROW).alias("papyra_reach"))
    page = F.struct(*keys)
    own = good.join(reach, keys).withColumn("papyra_y", _centre("y0", "y1")).withColumn("papyra_page", page).withColumn("papyra_at", F.struct("papyra_y", "papyra_reach"))

    def step(carry, at):
        row, total, n = carry
        y, reach = at["papyra_y"], at["papyra_reach"]
        carry = (row, total + y, n + 1) if n and abs(y - total / n) <= reach else (row + 1, y, 1)
        return carry, carry[0]

    out = walked(own, "papyra_page", ["papyra_y", "x0", "text"], "papyra_at", step, (-1, 0.0, 0), "row", "int")
    return out.drop("papyra_page", "papyra_at", "papyra_y", "papyra_reach")


def _by_page(words: DataFrame, pages: DataFrame, page: str, each, schema: str) -> DataFrame:
    """The rows that each(sizes, boxes, texts) gives for a page, as columns behind its key: sizes (width, height) of the page's rows in pages; boxes x0, y0, x1, y1 and texts in order of x0, y0 and text.

    Words and sizes are dealt by page together, sizes first; a page is held at a time.
    """
    good = words.where(F.col(page).isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    corner = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    none = F.lit(None).cast("double")
    sizes = pages.select(page, F.lit(True).alias("papyra_size"), F.col("width").cast("double").alias("x0"), F.col("height").cast("double").alias("y0"), none.alias("x1"), none.alias("y1"), F.lit(None).cast("string").alias("text"))
    every = sizes.unionByName(good.select(page, F.lit(False).alias("papyra_size"), *corner, "text"))
    kind = pages.select(page).schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def told():
            """The rows of the held page, None if it has no size."""
            whole = pa.Table.from_batches(held)
            n = pc.sum(whole.column(1)).as_py()
            if not n:
                return
            boxes = np.stack([whole.column(k).to_numpy() for k in range(2, 6)], axis=1)
            columns = each(boxes[:n, :2], boxes[n:], whole.column(6).slice(n).to_pylist())
            keys.extend([whole.column(0)[0].as_py()] * len(columns[0]))
            for out, more in zip(outs, columns):
                out.extend(more)

        def flushed():
            arrays = [pa.array(v, t) for v, t in zip((keys, *outs), kinds)]
            keys.clear(), [o.clear() for o in outs]
            return pa.RecordBatch.from_arrays(arrays, names=[page, *(f.name for f in fields)])

        held, keys, outs, kinds = [], [], [[] for _ in fields], None
        for batch in batches:
            key = batch.column(0)
            kinds = kinds or [key.type, *arrow_kinds]
            same = pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
            same |= pc.and_(pc.is_null(key[1:]), pc.is_null(key[:-1])).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), len(key)]
            for at, end in zip(cuts, cuts[1:]):
                if held and held[0].column(0)[0].as_py() != key[at].as_py():
                    told()
                    held = []
                held.append(batch.slice(at, end - at))
                if len(keys) >= 4096:
                    yield flushed()
        if held:
            told()
        if keys:
            yield flushed()

    fields = T.StructType.fromDDL(schema).fields
    arrow_kinds = [to_arrow_type(f.dataType) for f in fields]
    dealt = every.repartition(page).sortWithinPartitions(page, F.desc("papyra_size"), "x0", "y0", "text")
    return dealt.mapInArrow(run, f"`{page}` {kind}, {schema}")


def _rows_of(boxes):
    """The numbers of the rows of a page's boxes, from 0 downwards: as word_rows(). Words of one height join one row, so the walk goes over different heights."""
    import numpy as np

    reach = max(LEAST_ROW, float(np.median(np.maximum(boxes[:, 3] - boxes[:, 1], 1.0))) * ROW)
    ys, place, many = np.unique((boxes[:, 1] + boxes[:, 3]) / 2, return_inverse=True, return_counts=True)
    out, row, total, n = [], -1, 0.0, 0
    for y, k in zip(ys.tolist(), many.tolist()):
        if not n or abs(y - total / n) > reach:
            row, total, n = row + 1, 0.0, 0
        for _ in range(k):  # one by one, as the walk over words rounds
            total += y
        n += k
        out.append(row)
    return np.array(out)[place]


def _divider(width: float, height: float, boxes) -> float | None:
    """The x that parts the columns of a page's boxes (in order of x0, y0 and text), None if nothing shows two."""
    import numpy as np

    if not len(boxes):
        return None
    row = _rows_of(boxes)
    n = np.bincount(row)
    y = np.bincount(row, (boxes[:, 1] + boxes[:, 3]) / 2) / n
    within = ((y >= height * BODY[0]) & (y <= height * BODY[1]))[row]
    boxes, row = boxes[within], row[within]
    if not len(boxes):
        return None
    inner = lambda x: (x >= width * MIDDLE[0]) & (x <= width * MIDDLE[1])
    x0, x1 = boxes[:, 0], boxes[:, 2]
    # gutters: gaps between neighbours of a row
    by_row = np.argsort(row, kind="stable")
    a, b = by_row[:-1], by_row[1:]
    wide = (row[a] == row[b]) & (x0[b] - x1[a] >= width * GUTTER)
    gaps = np.bincount(row[b[wide]], minlength=len(n))
    lone = wide & (gaps[row[b]] == 1)
    middles = ((x0[b] + x1[a]) / 2)[lone]
    middles = middles[inner(middles)]
    if len(middles):
        split = float(np.median(middles))
    else:
        sweep = np.lexsort((x1, x0))
        covered = np.maximum.accumulate(x1[sweep])[:-1]
        band, at = x0[sweep][1:] - covered, (x0[sweep][1:] + covered) / 2
        free = (band >= width * GUTTER) & inner(at)
        if not free.any():
            return None
        split = float(at[free][np.lexsort((at[free], -band[free]))[0]])
    left = (x0 + x1) / 2 < split
    l, r = np.bincount(row[left], minlength=len(n)), np.bincount(row[~left], minlength=len(n))
    begin, end = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    np.minimum.at(begin, row[~left], x0[~left])
    np.maximum.at(end, row[left], x1[left])
    both = ((l > 0) & (r > 0) & (gaps <= 1) & (begin - end >= width * GUTTER)).sum()
    shown = both >= 2 or ((r == 0) & (l > 0)).sum() >= 2 and ((l == 0) & (r > 0)).sum() >= 2
    return split if shown and l.sum() >= 2 and r.sum() >= 2 else None


def dividers(words: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """(page, divider) of each page: the x that parts two columns, null if nothing shows two.

    The divider is the median of the middles of gutters that are their rows' only ones, else the middle of the widest band that no word covers, found by a sweep over the
    boxes' ends. It counts if two rows lie on both sides of it with a gutter between, or two rows on either side alone. Margins above and below are left out.
    """

    def each(sizes, boxes, texts):
        return ([_divider(width, height, boxes) for width, height in sizes.tolist()],)

    return _by_page(words, pages, page, each, "divider double")


def page_lines(words: DataFrame, pages: DataFrame, page: str = "page") -> DataFrame:
    """(page, column, line, text, box): the lines of a page, column by column, each from left to right; boxes are shares of the page."""

    def each(sizes, boxes, texts):
        import numpy as np

        columns, lines, said, shares = [], [], [], []
        width, height = sizes[0].tolist()
        divider = _divider(width, height, boxes)
        right = np.zeros(len(boxes), bool) if divider is None else (boxes[:, 0] + boxes[:, 2]) / 2 >= divider
        for column, its in enumerate((np.flatnonzero(~right), np.flatnonzero(right))):
            if not len(its):
                continue
            row = _rows_of(boxes[its])
            its = its[np.argsort(row, kind="stable")]
            begins = np.cumsum([0, *np.bincount(row)])
            low, high = np.minimum.reduceat(boxes[its], begins[:-1]), np.maximum.reduceat(boxes[its], begins[:-1])
            box = np.clip(np.column_stack([low[:, 0] / width, low[:, 1] / height, high[:, 2] / width, high[:, 3] / height]), 0.0, 1.0)
            order = its.tolist()
            columns += [column] * len(box)
            lines += range(len(box))
            said += [" ".join([texts[k] for k in order[i:j]]) for i, j in zip(begins, begins[1:])]
            shares += [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in box.tolist()]
        return columns, lines, said, shares

    return _by_page(words, pages, page, each, "column int, line int, text string, box struct<x0:double,y0:double,x1:double,y1:double>")


def cut_regions(boxes: DataFrame, page: str, least_x: float, least_y: float, most_depth: int = 8) -> DataFrame:
    """boxes with a column region: pages cut at all empty bands of least_x or wider, the parts at those of least_y or higher, and so on while a cut parts anything.

    Each cut is one sweep over the boxes' ends; a region's name is the row of its cuts.
    """
    out, parts = stored(boxes.withColumn("region", F.lit(""))), -1
    for depth in range(most_depth):
        low, high, least = ("x0", "x1", least_x) if depth % 2 == 0 else ("y0", "y1", least_y)
        # boxes that begin at one place are one step of the sweep: they see the same reach, and open a part once
        ends = out.groupBy(page, "region", low).agg(F.max(high).alias("papyra_end"))
        w = Window.partitionBy(page, "region").orderBy(low)
        reach = F.max("papyra_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        at = ends.withColumn("papyra_new", F.coalesce((F.col(low) - reach >= least).cast("int"), F.lit(0))).withColumn("papyra_at", F.sum("papyra_new").over(w)).drop("papyra_new", "papyra_end")
        out = stored(out.join(at, [page, "region", low]).withColumn("region", F.concat("region", F.lit("xy"[depth % 2]), F.col("papyra_at").cast("string"))).select(*out.columns))
        n = out.select(page, "region").distinct().count()
        if depth > 1 and n == parts:  # neither axis has parted anything
            break
        parts = n if depth % 2 else parts
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that each id of the edges is linked with, by rounds of smallest neighbours and of jumps to their own smallest."""
    links = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))).distinct())
    low = stored(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"))
    while True:
        near = links.join(low.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = low.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("component", "near").alias("next"), "component")
        jump = low.select(F.col("id").alias("next"), F.col("component").alias("far"))
        new = stored(step.join(jump, "next").select("id", F.least("next", "far").alias("now"), "component"))
        if not new.where("now <> component").limit(1).count():
            return new.select("id", "component")
        low = new.select("id", F.col("now").alias("component"))


#: Pairs of lines that crossed() looks at together.
_PAIRS = 1 << 21


def crossed(lines: DataFrame, page: str, tolerance: float) -> DataFrame:
    """(page, table, lines): the lines (page, id, axis x or y, low, high, at) of each page that cross, lines linked by crossings together; table is their smallest id.

    A page's lines meet in one row, and the pages of a batch are linked side by side: each line takes the smallest number it is linked with until nothing changes.
    """
    known = lines.where(F.col(page).isNotNull() & F.col("id").isNotNull())
    held = known.groupBy(page).agg(F.collect_list(F.struct("id", "axis", "low", "high", "at")).alias("papyra_lines"))
    kind = lines.schema

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            flat = column.flatten()
            ids, axis, low, high, at = (flat.field(k) for k in range(5))
            of = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            codes = pd.factorize(ids.to_pandas(), sort=True)[0]
            names, first, node = np.unique(of * (codes.max(initial=0) + 1) + codes, return_index=True, return_inverse=True)
            y = axis.to_numpy(zero_copy_only=False) == "y"
            low_, high_, at_ = (c.to_numpy(zero_copy_only=False) for c in (low, high, at))
            h, v = np.flatnonzero(y), np.flatnonzero(~y)
            per = np.bincount(of[v], minlength=len(column))
            begin, many = (np.cumsum(per) - per)[of[h]], per[of[h]]
            upto, found, i = np.cumsum(many), [], 0
            while i < len(h):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + _PAIRS, "right")))
                n = many[i:j]
                a = np.repeat(h[i:j], n)
                b = v[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i:j], n)]
                met = (at_[b] >= low_[a] - tolerance) & (at_[b] <= high_[a] + tolerance) & (at_[a] >= low_[b] - tolerance) & (at_[a] <= high_[b] + tolerance)
                found.append((node[a[met]], node[b[met]]))
                i = j
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            label = np.arange(len(names))
            while len(a):
                new = label.copy()
                least = np.minimum(label[a], label[b])
                for ends in (label[a], label[b], a, b):
                    np.minimum.at(new, ends, least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            linked = np.zeros(len(names), bool)
            linked[a] = linked[b] = True
            kept = np.flatnonzero(linked[node])
            kept = kept[np.argsort(label[node[kept]], kind="stable")]
            tables, begins = np.unique(label[node[kept]], return_index=True)
            head = pa.array(first[tables])
            own = flat.take(pa.array(kept))
            parts = pa.StructArray.from_arrays([own.field(k) for k in range(1, 5)], names=["axis", "low", "high", "at"])
            lists = pa.ListArray.from_arrays(pa.array([*begins.tolist(), len(kept)], pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first[tables]])), ids.take(head), lists], names=[page, "table", "lines"])

    names = {f.name: f.dataType.simpleString() for f in kind}
    return held.mapInArrow(run, f"`{page}` {names[page]}, table {names['id']}, lines array<struct<axis:string,low:double,high:double,at:double>>")


def ruled_tables(rules: DataFrame, words: DataFrame, page: str = "page", tolerance: float = 3.0) -> DataFrame:
    """(page, table, rows, x0, y0, x1, y1, column_widths, row_heights, score) of the grids that rule lines close.

    rules: (page, id, x0, y0, x1, y1), words: boxes with text and confidence. Lines that cross belong to one grid; its edges are its lines' places within `tolerance` of one another.
    A grid counts from two cells each way, if as many lines run right across it as it has edges. Words fill the cell that holds their centre, from the top and from the left.
    """
    flat = F.abs(F.col("y1") - F.col("y0")) <= tolerance
    upright = F.abs(F.col("x1") - F.col("x0")) <= tolerance
    h = rules.where(flat).select(page, "id", F.lit("y").alias("axis"), F.least("x0", "x1").alias("low"), F.greatest("x0", "x1").alias("high"), _centre("y0", "y1").alias("at"))
    v = rules.where(upright).select(page, "id", F.lit("x").alias("axis"), F.least("y0", "y1").alias("low"), F.greatest("y0", "y1").alias("high"), _centre("x0", "x1").alias("at"))
    lines = crossed(h.unionByName(v), page, tolerance)

    def places(axis: str) -> Column:
        """The means of runs of places within the tolerance of one another."""
        sorted_ = F.array_sort(F.transform(F.filter("lines", lambda x: x["axis"] == axis), lambda x: x["at"]))
        begins = lambda s: F.filter(s, lambda x, i: (i == 0) | (x - F.get(s, i - 1) > tolerance))
        mean = lambda r: F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x) / F.size(r)
        run = lambda s, b, low, k: let(F.filter(s, lambda x: (x >= low) & ((x < F.get(b, k + 1)) | F.get(b, k + 1).isNull())), mean)
        return let(sorted_, lambda s: let(begins(s), lambda b: F.transform(b, lambda low, k: run(s, b, low, k))))

    edges = lines.select(page, "table", "lines", places("x").alias("xs"), places("y").alias("ys"))
    edges = edges.where((F.size("xs") >= 3) & (F.size("ys") >= 3)).withColumns({"x0": F.get("xs", F.lit(0)), "x1": F.element_at("xs", -1), "y0": F.get("ys", F.lit(0)), "y1": F.element_at("ys", -1)})
    right = lambda axis, low, high: F.size(F.filter("lines", lambda x: (x["axis"] == axis) & (x["low"] <= F.col(low) + tolerance) & (x["high"] >= F.col(high) - tolerance)))
    grids = stored(edges.where((right("y", "x0", "x1") >= F.size("ys")) & (right("x", "y0", "y1") >= F.size("xs"))).drop("lines"))
    good = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(page, F.col("y0").alias("wy"), F.col("x0").alias("wx"), "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), _centre("x0", "x1").alias("cx"), _centre("y0", "y1").alias("cy"))
    held = good.join(grids, page).where(F.col("cx").between(F.col("x0"), F.col("x1")) & F.col("cy").between(F.col("y0"), F.col("y1")))
    # a word on an edge belongs to the cell before it
    cell = lambda at, edges: F.greatest(F.size(F.filter(edges, lambda e: e < F.col(at))) - 1, F.lit(0))
    cells = held.groupBy(page, "table", cell("cy", "ys").alias("row"), cell("cx", "xs").alias("col")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("wy", "wx", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n"), F.sum("confidence").alias("c"))
    per = cells.groupBy(page, "table").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "text"))).alias("said"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = grids.join(per, [page, "table"], "left")
    at = lambda r, c: F.coalesce(F.try_element_at("said", F.struct(r.alias("row"), c.alias("col"))), F.lit(""))
    rows = F.transform(F.sequence(F.lit(0), F.size("ys") - 2), lambda r: F.transform(F.sequence(F.lit(0), F.size("xs") - 2), lambda c: at(r, c)))
    widths = lambda e, low, high: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: (F.get(e, k) - F.get(e, k - 1)) / (F.col(high) - F.col(low)))
    score = F.least(F.lit(SCORE[3]), F.lit(SCORE[0]) + F.when(F.col("n") > 0, F.lit(SCORE[1]) + SCORE[2] * F.col("c") / F.col("n")).otherwise(0.0))
    return out.select(page, "table", rows.alias("rows"), "x0", "y0", "x1", "y1", widths("xs", "x0", "x1").alias("column_widths"), widths("ys", "y0", "y1").alias("row_heights"), F.round(score, 4).alias("score"))


def chained_starts(starts: DataFrame, doc: str, place: str, number: str, gap: int = 8) -> DataFrame:
    """The question starts of each document that form its longest chain: numbers grow by 1 to `gap` as places grow.

    Of equally long chains the one with the fewest missing numbers counts, then the one of the earliest starts from the end on. A candidate looks only at the best chain that ends in each of the `gap`
    numbers before its own, so a document costs its candidates times `gap`. Documents follow one another in sorted partitions; a batch's and one document's candidates are held at a time.
    """
    schema = starts.schema
    place_of = [starts.columns.index(c) for c in (doc, number)]

    def longest(numbers: list) -> list[int]:
        """Which of a document's candidates, in order of place, are the chain's."""
        best: dict[int, tuple] = {}  # number: (length, -missing, row) of the best chain that ends in it
        back, top = [], None
        for i, n in enumerate(numbers):
            before = max(((*best[m][:2], -best[m][2], m) for m in range(n - gap, n) if m in best), default=None)
            prior = best[before[3]] if before else None
            own = (prior[0] + 1, prior[1] - (n - before[3] - 1), i) if prior else (1, 0, i)
            back.append(prior[2] if prior else None)
            if n not in best or own[:2] > best[n][:2]:
                best[n] = own
            if top is None or own[:2] > top[:2]:
                top = own
        kept, at = [], top[2] if top else None
        while at is not None:
            kept.append(at)
            at = back[at]
        return kept[::-1]

    def run(batches):
        import pyarrow as pa

        def chained(rows):
            """The rows of whole documents that are their chains'."""
            keys, numbers, kept, at = rows.column(place_of[0]).to_pylist(), rows.column(place_of[1]).to_pylist(), [], 0
            for end in range(1, len(keys) + 1):
                if end == len(keys) or keys[end] != keys[at]:
                    kept += [at] if end == at + 1 else [at + k for k in longest([int(n) for n in numbers[at:end]])]
                    at = end
            return rows.take(pa.array(kept, pa.int64())).combine_chunks().to_batches()

        held = []
        for batch in batches:
            # what lies before the batch's last document is whole
            keys = batch.column(place_of[0])
            last, at = keys[-1].as_py(), len(keys) - 1
            while at and keys[at - 1].as_py() == last:
                at -= 1
            if at or held and held[-1].column(place_of[0])[-1].as_py() != last:
                yield from chained(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            held.append(batch.slice(at))
        if held:
            yield from chained(pa.Table.from_batches(held))

    return starts.where(F.col(number).isNotNull()).repartition(doc).sortWithinPartitions(doc, place, number).mapInArrow(run, schema)


def recovered_segments(segments: DataFrame, doc: str, number: str, text: str, last: Column | int, least_before: int = 40, least_after: int = 30) -> DataFrame:
    """Segments (doc, number, text) with those whose number is missing recovered from the end of the segment of the largest number before.

    The missing number stands there with a point or a bullet, or before words that open a question; `least_before` signs must precede it and `least_after` follow. Numbers are tried upwards to
    `last`, and what is recovered may hold the next one. A document's segments are one group.
    """
    import re

    schema = segments.select(doc, number, text).schema
    own = segments.select(doc, number, text).withColumn("papyra_last", last if isinstance(last, Column) else F.lit(last))

    def recover(key, frame):
        import pandas as pd

        found = {int(n): t for n, t in zip(frame[number], frame[text])}
        for missing in range(1, int(frame["papyra_last"].max()) + 1):
            before = max((n for n in found if n < missing), default=None)
            if missing in found or before is None:
                continue
            said = found[before]
            hit = re.search(rf"(?<!\d){missing}\s*[.•ㆍ·]\s*(?=\S)", said) or re.search(rf"(?<!\d){missing}\s+(?=다음|[「<〈])", said)
            if hit and hit.start() >= least_before and len(" ".join(said[hit.end() :].split())) >= least_after:
                found[before], found[missing] = said[: hit.start()].strip(), said[hit.end() :].strip()
        return pd.DataFrame({doc: [key[0]] * len(found), number: list(found), text: list(found.values())})

    return own.groupBy(doc).applyInPandas(recover, schema)
