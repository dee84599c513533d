"""A bank's upkeep, text quality, and payloads, on literal cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.functions import payloads as P
from papyra.functions import text as X
from papyra.operators import bank as B
from papyra.sources import tables


def test_saving_keeps_and_numbers(spark):
    base = spark.createDataFrame([(5, "a", 1, "x"), (7, "b", 2, "y")], "id long, k string, v long, note string")
    new = spark.createDataFrame([("a", 9, None, 1), ("c", 3, "z", 2), ("c", 4, "w", 3), ("d", 1, None, 4)], "k string, v long, note string, seq long")
    got = {r.k: (r.id, r.v, r.note) for r in B.saved(base, new, ["k"], keep=["note"]).collect()}
    assert got["a"] == (5, 9, "x") and got["b"] == (7, 2, "y") and got["c"][1:] == (4, "w") and sorted(v[0] for v in got.values()) == [5, 7, 8, 9]
    dims = B.registered(spark.createDataFrame([("c1", "Law")], "code string, name string"), spark.createDataFrame([("Law",), ("항해 2",), (None,)], "name string"), "name", "code")
    assert {r.name: r.code.rsplit("_", 1)[0] for r in dims.collect()} == {"Law": "c1", "항해 2": "auto_항해_2"}


def test_bundles_are_read_in_page_order(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("p10.txt", "ten")
        z.writestr("p2.txt", "two")
        z.writestr("manifest.json", json.dumps({"pages": [{"page_number": 2, "image": "x.png"}]}))
    (tmp_path / "a.zip").write_bytes(out.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = sorted((r.path[-5:], r.page, r.text, r.images) for r in B.bundled_pages(files).collect())
    assert got[:2] == [("a.zip", 2, "two", True), ("a.zip", 10, "ten", False)] and got[2][1] is None


def test_manifests_are_rewritten_whole(spark, tmp_path):
    path = str(tmp_path / "m.json")
    B.manifest_with(path, [{"id": "a", "label": "A", "enabled": True}])
    B.renamed_mount(path, "a", "B")
    assert tables.manifest(spark, path).first().label == "B"
    with pytest.raises(ValueError):
        B.manifest_with(path, [{"id": "a"}, {"id": "a"}])
    with pytest.raises(ValueError):
        B.renamed_mount(path, "z", "B")


def test_attached_tables_meet_in_sql(spark):
    B.attached(spark, "src", {"q": spark.createDataFrame([(1,)], "id long")})
    B.attached(spark, "tgt", {"q": spark.createDataFrame([(1,), (2,)], "id long")})
    assert spark.sql("select t.id from tgt_q t left anti join src_q s on s.id = t.id").first().id == 2


def test_repairs_of_all_mounts_or_none(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    fix = spark.createDataFrame([(1, "a", "x")], "id long, before string, after string")
    assert sorted(tuple(r) for r in B.repaired_mounts({"m": (rows, fix)}, "id", "v")["m"].collect()) == [(1, "x"), (2, "b")]
    with pytest.raises(ValueError):
        B.repaired_mounts({"m": (rows, fix), "n": (rows, fix.withColumn("before", F.lit("z")))}, "id", "v")


def test_crawl_stops_at_its_cap_and_at_its_end(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("x", "y")], "page string, target string")
    start = spark.createDataFrame([("a",)], "page string")
    assert sorted(tuple(r) for r in B.crawled(start, links, "page", "target", 3).collect()) == [("a", 0), ("b", 1), ("c", 1)]
    assert sorted(tuple(r) for r in B.crawled(start, links, "page", "target", 99, lambda p: p != "d").collect()) == [("a", 0), ("b", 1), ("c", 1)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []), ("plain words", []), ("다읔 중 옳은 것", ["ocr_noise"]), ("the c0de of w0rds", ["ocr_noise"]), ("x1 = (a+b1c)/2", []), ("수상(水上)에서 甲은", []), ("글匁자", ["ocr_noise"]), ("① ① two", ["ocr_noise"]),
        ("압력 [시 단위", ["broken_unit", "unbalanced_delimiter"]), ("a\n @ 가나", ["damaged_list_marker"]), ("모두 몇 개인가? a: b: c: d:", ["damaged_list_marker"]), ("모두 몇 개인가? ㄱ. a: ㄴ. b: ㄷ. c: d:", []), ("a) one 1) two (ok)", []), ("one ) two", ["unbalanced_delimiter"]), (")(", ["unbalanced_delimiter"]),
    ],
)
def test_text_quality_codes(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.quality_codes(F.col("t")).alias("c")).first().c == want


def test_display_width_and_normal_forms(spark):
    row = spark.createDataFrame([("가나 il\nabc", "Ｆｉｇ．①")], "a string, b string").select(X.display_units(F.col("a")).alias("w"), X.nfkc(F.col("b")).alias("n")).first()
    assert row.w == 5.5 and row.n == "fig.1"


def test_payloads_of_odd_kinds(spark):
    rows = [(None,), ("",), ("{x",), ("[1]",), ('{"tables":[]}',), ('{"tables":[{"rows":[["a",""],["b"]],"cells":[{"row":0,"col":0,"text":"z"},{"text":"q"}]}]}',), ('{"tables":null,"spans":[{"start":1,"end":2}]}',)]
    df = spark.createDataFrame(rows, "p string")
    got = df.select(P.display(F.col("p")).alias("d"), P.serialized(F.col("p")).alias("s"), P.surfaces(F.col("p"), "f").alias("x")).collect()
    assert [r.d for r in got] == ["", "", "", "", "", "a\nb\nz\nq", ""]
    assert [r.s is not None for r in got] == [False, False, False, False, False, True, True]
    assert [[s.code for s in r.x if s.code] for r in got] == [[], [], ["invalid_format_json"], ["invalid_format_json"], [], ["empty_table_cell", "rows_cells_divergence", "invalid_table_cell_coordinate"], []]
    kept = df.select(P.with_spans(F.col("p"), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("u").alias("style")))).alias("k")).collect()
    assert json.loads(kept[5].k)["tables"][0]["rows"] == [["a", ""], ["b"]] and json.loads(kept[0].k)["spans"] == [{"start": 0, "end": 2, "style": "u"}]


def test_anchors_are_found_by_context(spark):
    at = lambda o, b, a: F.struct(F.lit(o).alias("offset"), F.lit(b).alias("before_context"), F.lit(a).alias("after_context"))
    for anchor, want in ((at(5, "hello", " wor"), (5, False)), (at(2, "hello", ""), (5, True)), (at(99, "", "world"), (6, True)), (at(-1, "he", "ld"), (9, True)), (at(99, "zz", "yy"), (11, True)), (at(3, "", ""), (3, False))):
        row = spark.createDataFrame([("hello world",)], "t string").select(P.anchor(F.col("t"), anchor).alias("a")).first().a
        assert (row.place, row.moved) == want


def test_covers_and_disorder(spark):
    df = spark.createDataFrame([("2019년 정기 시험 제 2 회 3급 항해사 국내한정 상선",), ("년 정기 제 회 2020 4 급 기관사 5",), ("소형선박조종사",), ("no cover",)], "t string")
    got = [r.c and tuple(r.c) for r in df.select(X.cover(F.col("t")).alias("c")).collect()]
    assert got == [(2019, 2, "3급항해사(국내 상선)"), (2020, 4, "5급기관사"), None, None]
    texts = ["길이가12 미터인 배", "제3조제2항 기준", "법 제3조 제2항12 이상", "시간을 24 초과하여", "plain", None, "기관1 문제"]
    flags = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.disordered(F.col("t")).alias("d")).collect()]
    assert flags == [True, False, False, True, False, False, False]


def test_ingest_without_growing_state(spark, tmp_path):
    from papyra.streaming import ingest

    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    df.write.parquet(source)
    ingest.ingest_new(spark, source, df.schema, mark, sink, "id")
    spark.createDataFrame([(2, "b"), (3, "c")], df.schema).write.mode("append").parquet(source)
    ingest.ingest_new(spark, source, df.schema, mark, sink, "id")
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path, monkeypatch):
    import sqlite3

    from papyra.sources import sqlite

    path = str(tmp_path / "bank.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "q s" (id INTEGER PRIMARY KEY, text TEXT, score REAL, raw BLOB, odd INT)')
        con.executemany('INSERT INTO "q s" VALUES (?, ?, ?, ?, ?)', [(i, f"t{i}" if i % 3 else None, i / 2, b"x", "no number" if i == 5 else i) for i in range(1, 26)])
        con.execute("CREATE TABLE none (a TEXT)")
        con.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, b INT) WITHOUT ROWID")
        con.execute("INSERT INTO keyed VALUES ('k', 1)")
    monkeypatch.setattr(sqlite.SqliteReader, "ROWS", 10)
    df = sqlite.table(spark, path, "q s")
    assert df.dtypes == [("id", "bigint"), ("text", "string"), ("score", "double"), ("raw", "binary"), ("odd", "bigint")]
    got = {r.id: r for r in df.collect()}
    assert len(got) == 25 and got[3].text is None and got[4].score == 2.0 and got[5].odd is None and got[6].odd == 6
    assert sqlite.table(spark, path, "none").count() == 0 and sqlite.table(spark, path, "keyed").first().b == 1
    assert sqlite.tables(path) == ["keyed", "none", "q s"]


def test_changes_go_to_their_mount():
    mounts = [{"id": "a", "domain": "law", "read_only": True}, {"id": "b", "domain": "user"}, {"id": "c", "domain": "law"}]
    assert B.route(mounts, "a") == "a" and B.route(mounts) == "b" and B.route(mounts, domain="law") == "c" and B.route([*mounts, {"id": "user_workspace"}]) == "user_workspace"
    with pytest.raises(ValueError):
        B.route(mounts, "z")
    with pytest.raises(ValueError):
        B.route([mounts[0]])
