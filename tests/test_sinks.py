"""Sinks, file scans and changes on small folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from papyra.operators import changes, matching, ordered, search, validators
from papyra.sources import scratch, sinks, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_report_has_just_its_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "x")], "id long, name string, extra string")
    sinks.csv_report(df, str(tmp_path / "r"), ["name", "missing", "id"])
    back = tables.csv_rows(spark, str(tmp_path / "r"))
    assert back.columns == ["name", "missing", "id"] and rows(back) == [("a,b", None, "1")]


def test_csv_skips_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfid,name\n1,caf\xe9\n")
    got = tables.csv_rows(spark, str(tmp_path / "b.csv"))
    assert got.columns == ["id", "name"] and got.first().name.startswith("caf")


def test_json_lines_skip_blank_and_broken_ones(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert rows(tables.json_lines(spark, str(tmp_path / "l.jsonl"), "a long")) == [(1,), (2,)]


def test_append_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a long")
    for _ in range(2):
        sinks.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.json_report(df, str(tmp_path / "x" / "r.json"))
    assert json.loads((tmp_path / "x" / "r.json").read_text()) == {"a": 1} and os.listdir(tmp_path / "x") == ["r.json"]
    with pytest.raises(ValueError):
        sinks.json_report(df.union(df), str(tmp_path / "r.json"))


def test_listing_hashes_files_in_order(spark, tmp_path):
    root = tmp_path / "bank"
    (root / "b").mkdir(parents=True)
    (root / "b" / "1.pdf").write_bytes(b"one")
    (root / "a.pdf").write_bytes(b"two")
    (root / "c.txt").write_bytes(b"no")
    got = [(r.path, r.role, r.size, len(r.sha256)) for r in tables.listing(spark, str(root), ".pdf").collect()]
    assert got == [("a.pdf", "", 3, 64), ("b/1.pdf", "b", 3, 64)]


def test_split_writes_a_folder_a_value(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, domain string")
    assert rows(sinks.split(df, str(tmp_path / "s"), "domain")) == [("x", 2), ("y", 1)]
    assert {d for d in os.listdir(tmp_path / "s") if d.startswith("domain")} == {"domain=x", "domain=y"}


def test_replace_keeps_the_old_table_if_the_new_one_is_bad(spark, tmp_path):
    path = str(tmp_path / "t")
    good = lambda df: df.count() > 0
    old, new = spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([(2,)], "a long")
    assert sinks.replaced(old, path, good) is None
    backup = sinks.replaced(new, path, good)
    assert rows(spark.read.parquet(path)) == [(2,)] and rows(spark.read.parquet(backup)) == [(1,)]
    with pytest.raises(ValueError):
        sinks.replaced(new.where("false"), path, good)
    assert rows(spark.read.parquet(path)) == [(2,)]
    with pytest.raises(ValueError):
        sinks.replaced_all({path: old, str(tmp_path / "u"): new.where("false")}, good)
    assert rows(spark.read.parquet(path)) == [(2,)] and not os.path.exists(tmp_path / "u")
    assert sinks.export(new, str(tmp_path / "e"))[0] == 1


def test_a_match_must_be_just_one(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    dims = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, v long")
    with pytest.raises(ValueError):
        matching.matched_once(wanted, dims, ["k"])
    assert rows(matching.matched_once(wanted.where("k = 'a'"), dims, ["k"])) == [("a", 1)]


def test_edits_and_deletes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    with pytest.raises(ValueError):
        changes.with_rows(base, base.where("id = 1"), "id")
    assert changes.with_rows(base, base.where("id = 1").withColumn("id", F.lit(3).cast("long")), "id").count() == 3


def test_repairs_in_conflict_are_named(spark):
    df = spark.createDataFrame([("k", 1, None, "x", "n1"), ("k", 2, "v", "y", "n2"), ("k", 3, "v", None, "n1")], "key string, seq long, f string, g string, note string")
    assert rows(changes.merged_repairs(df, "key", ["f", "g"], "note", "seq")) == [("k", "v", "x", "n1; n2", "g")]
    assert rows(changes.merged_repairs(df, "key", ["f", "g"], "note", "seq", later_wins=True)) == [("k", "v", "y", "n1; n2", "")]


def test_conflicting_mounts_give_no_rows(spark):
    mounts = {"x": 1, "y": 2}
    assert search.pruned(mounts, "x::a", "y::b") == {} and search.pruned(mounts, "x::a") == {"x": 1} and search.pruned(mounts, None) == mounts


def test_schema_findings_read_nothing(spark):
    t = {"q": spark.createDataFrame([], "id long")}
    assert validators.schema_findings(t, {"q": ["id", "text"], "c": ["id"]}) == [("c", "table"), ("q", "text")]


def test_monotone_numbers_carry_the_last_kept_one(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 2, 5, 30, 6, 6, 14])], "p long, i long, n long")
    assert [r.n for r in ordered.monotone(df, "p", ["i"], "n", 8).orderBy("i").collect()] == [3, 5, 6, 14]


def test_scratch_tables_are_removed(spark):
    held = scratch.stored(spark.range(3))
    assert held.count() == 3
    scratch.release(spark)
    assert not os.path.exists(held.inputFiles()[0].removeprefix("file://")) if held.inputFiles() else True
