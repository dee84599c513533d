"""Batches of several tables: all or nothing, once; and comparisons that SQLite answers."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from papyra.sources import batches, sqlite


def rows(spark, n, start=0):
    return spark.range(start, start + n, numPartitions=3).select("id", F.concat(F.lit('"é\n'), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, F.col("id") / 4).alias("share"))


def shown(df):
    return sorted(map(tuple, df.collect()))


def test_a_batch_appears_whole_and_once(spark, tmp_path):
    folder = str(tmp_path / "bank")
    assert batches.read(spark, folder) == {} and batches.committed(folder) == []
    assert batches.commit(spark, folder, "one", {"a": rows(spark, 5), "b": rows(spark, 0).select("id")})
    assert shown(batches.read(spark, folder)["a"]) == shown(rows(spark, 5)) and batches.read(spark, folder)["b"].count() == 0
    assert not batches.commit(spark, folder, "one", {"a": rows(spark, 9)})  # a rerun
    assert batches.commit(spark, "file://" + folder, "two", {"a": rows(spark, 2, 5), "c": rows(spark, 1)}, append=True)
    got = batches.read(spark, folder)
    assert shown(got["a"]) == shown(rows(spark, 7)) and sorted(got) == ["a", "b", "c"] and batches.committed(folder) == ["one", "two"]
    assert batches.commit(spark, folder, "three", {"a": rows(spark, 1)})
    assert batches.read(spark, folder)["a"].count() == 1 and got["a"].count() == 7  # a reader's tables stay


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "bank")
    batches.commit(spark, folder, "one", {"a": rows(spark, 5), "b": rows(spark, 3)})
    before = {k: shown(v) for k, v in batches.read(spark, folder).items()}
    parts = set(os.listdir(f"{folder}/parts"))
    bad = rows(spark, 50).withColumn("text", F.when(F.col("id") == 40, F.raise_error(F.lit("torn"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="torn"):
        batches.commit(spark, folder, "bad", {"b": rows(spark, 8), "a": bad})
    assert {k: shown(v) for k, v in batches.read(spark, folder).items()} == before and batches.committed(folder) == ["one"]
    batches.swept(folder)
    assert set(os.listdir(f"{folder}/parts")) == parts
    # what a killed task would leave is not read, and goes
    open(f"{folder}/parts/left-0.json", "w").write('{"id": 1}\n')
    assert {k: shown(v) for k, v in batches.read(spark, folder).items()} == before and batches.swept(folder) == 1
    with pytest.raises(ValueError, match="share"):
        batches.commit(spark, "hdfs://x/y", "z", {})


def test_writers_that_meet_build_on_each_other(tmp_path):
    folder = str(tmp_path)
    schema = {"type": "struct", "fields": []}
    for batch in ("x", "y", "x"):
        writer = batches.BatchWriter(folder, batch, {batch: schema}, False)
        writer.commit([writer.write(iter([(batch, "{}")])), None])
    newest = batches._newest(folder)
    assert newest["version"] == 2 and newest["batches"] == ["x", "y"] and sorted(newest["tables"]) == ["x", "y"]
    assert batches.swept(folder) == 0 and len(os.listdir(f"{folder}/parts")) == 2  # the repeated batch took its part back


def test_repairs_of_all_tables_or_of_none(spark, tmp_path):
    folder = str(tmp_path / "bank")
    batches.commit(spark, folder, "one", {"a": rows(spark, 3), "b": rows(spark, 3)})
    fix = lambda *r: spark.createDataFrame(list(r), "id long, before string, after string")
    good, other = fix((1, '"é\n1', "mended")), fix((2, '"é\n2', None))
    for wrong in (fix((1, "else", "x")), fix((9, '"é\n1', "x")), fix((1, '"é\n1', "x"), (1, '"é\n1', "y"))):
        with pytest.raises(ValueError, match="b: a repair"):
            batches.prepared(spark, folder, "two", {"a": good, "b": wrong}, "id", "text")
    with pytest.raises(ValueError, match="b: not valid"):
        batches.prepared(spark, folder, "two", {"a": good, "b": other}, "id", "text", lambda name, df: name == "a" or not df.where("text is null").count())
    with pytest.raises(ValueError, match="c: no such table"):
        batches.prepared(spark, folder, "two", {"c": good}, "id", "text")
    assert batches.committed(folder) == ["one"]
    assert batches.prepared(spark, folder, "two", {"a": good, "b": other}, "id", "text") and not batches.prepared(spark, folder, "two", {"a": good}, "id", "text")
    got = {k: {r.id: r.text for r in v.collect()} for k, v in batches.read(spark, folder).items()}
    assert got["a"][1] == "mended" and got["a"][0] == '"é\n0' and got["b"][2] is None and len(got["b"]) == 3


@pytest.fixture(scope="module")
def bank(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bank") / "bank.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "q t" (id INTEGER PRIMARY KEY, year INT, name TEXT COLLATE NOCASE, score REAL, raw BLOB, "a""b" TEXT)')
        con.executemany('INSERT INTO "q t" VALUES (?, ?, ?, ?, ?, ?)', [(k, 2000 + k % 20 if k % 7 else None, f"{'Ab' if k % 2 else 'aB'}{k % 10}", k / 4, b"x", "y") for k in range(1, 1001)])
        con.executemany('INSERT INTO "q t" (id, year, name, score) VALUES (?, ?, ?, ?)', [(2001, 2005.5, 7, "text"), (2002, "no year", None, 3), (2003, "2005", b"bytes", None)])
    return path


@pytest.mark.parametrize("condition", ["year = 2005", "year > 2010 and id <= 500", "name = 'Ab5'", "name >= 'a'", "year in (2001, 2003, 2005)", "score < 3.5", "name like 'Ab%'", "year is not null", "year is null", "year <=> 2005", "id = 7 or year = 2001", "not (year = 2001)", "`a\"b` = 'y'", "score = 2.5"])
def test_comparisons_give_what_spark_gives(spark, bank, condition):
    pushed = sqlite.table(spark, bank, "q t").where(condition).collect()
    whole = sqlite.table(spark, bank, "q t")
    plain = spark.createDataFrame(whole.collect(), whole.schema).where(condition).collect()
    assert sorted(pushed, key=str) == sorted(plain, key=str) and plain


def test_the_sql_holds_the_comparison(bank):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = sqlite.SqliteReader(bank, "q t", [("id", "long"), ("year", "long")])
    filters = [EqualTo(("year",), 2005), GreaterThan(("id",), 500), IsNotNull(("year",)), In(("year",), (1, 2)), EqualTo(("none",), 1), EqualTo(("year",), "x")]
    assert list(reader.pushFilters(filters)) == filters
    sql, values = reader.statement(sqlite.Rows(1, 900))
    assert "year" in sql and sql.count("?") == 4 and values == [2005, 500, 1, 2] and sql.startswith('SELECT "id", "year" FROM "q t" WHERE rowid BETWEEN 1 AND 900')
    few = sqlite.SqliteReader(bank, "q t", [("id", "long"), ("year", "long")])
    list(few.pushFilters(filters[:2]))
    assert len(list(few.read(sqlite.Rows(1, 1000)))) == sum(1 for k in range(501, 1001) if k % 7 and k % 20 == 5)


def test_some_columns_alone_are_read(spark, bank):
    df = sqlite.table(spark, bank, "q t", ["score", "id"])
    assert df.columns == ["score", "id"] and df.where("id = 4").first().score == 1.0
    with pytest.raises(Exception, match="no column"):
        sqlite.table(spark, bank, "q t", ["none"])
