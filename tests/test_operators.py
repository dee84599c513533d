"""Literal fixtures for operators whose corner cases the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as X
from papyra.operators import dedupe, ordered, quality, relational
from papyra.sources import tables
from papyra.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fuzzy_keeps_the_first_and_the_opposite(spark):
    df = spark.createDataFrame([(1, "Which valve is fitted to the boiler drum?"), (2, "Which valve is fitted to the boilers drum"), (3, "Which valve is not fitted to the boiler drum?"), (4, "Which valve is fitted to the boiler drum 7?"), (5, "short"), (6, "Short."), (7, None), (8, "")], "id long, text string")
    assert rows(dedupe.fuzzy(df, "id", "text")) == [(1,), (3,), (4,), (5,), (7,)]


def test_exact_dedupe_counts_copies(spark):
    df = spark.createDataFrame([(3, "A b"), (1, "a  B!"), (2, "c")], "id long, text string")
    assert rows(dedupe.exact(df, "id", "text").select("id", "copies")) == [(1, 2), (2, 1)]


def test_compare_and_set_is_all_or_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    good = spark.createDataFrame([(1, "a", "x")], "id long, before string, after string")
    bad = spark.createDataFrame([(1, "a", "x"), (2, "z", "y")], "id long, before string, after string")
    assert rows(relational.swapped(base, good, "id", "v").select("id", "v")) == [(1, "x"), (2, "b")]
    assert rows(relational.swapped(base, bad, "id", "v").select("id", "v")) == [(1, "a"), (2, "b")]


def test_overlaps_are_counted_once(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 20.0, 20.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([(7, 5.0, 5.0, 19.0, 30.0), (8, 20.0, 0.0, 25.0, 5.0)], a.schema)
    assert rows(relational.overlapping(a, b, 4)) == [(1, 7, 210.0)]


def test_structure(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 2)], "k long, n int")
    assert rows(quality.contiguous(df, "k", "n")) == [(1, 2, True, 0), (2, 2, False, 1), (3, 1, False, 1)]


def test_search_takes_wildcards_as_text(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), (None,)], "t string")
    assert rows(df.where(X.search([F.col("t")], ["50%", "OFF"]))) == [("50% off",)]


def test_tags_match_by_any_token(spark):
    df = spark.createDataFrame([("a, b",), ("c",)], "t string")
    assert rows(df.where(X.tagged(F.col("t"), "B x"))) == [("a, b",)]


def test_intervals_merge_when_they_touch(spark):
    df = spark.createDataFrame([("u", 1, 3), ("u", 3, 5), ("u", 7, 9), ("u", 2, 4)], "k string, a long, b long")
    assert rows(ordered.merged(df, "k", "a", "b")) == [("u", 1, 5, 3), ("u", 7, 9, 1)]


def test_manifest_refuses_repeated_ids(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"version": 1, "mounts": [{"id": "a", "enabled": true}, {"id": "a", "enabled": false}]}')
    with pytest.raises(ValueError):
        tables.manifest(spark, str(path))


def test_federation_names_rows(spark):
    parts = {"x": spark.createDataFrame([(1,)], "k long"), "y": spark.createDataFrame([(1,)], "k long")}
    assert sorted(r.id for r in tables.federated(parts, "k").collect()) == ["x::1", "y::1"]


def test_ingest_is_idempotent(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    df.write.parquet(source)
    ingest.ingest(spark, source, df.schema, mark, sink, "id")
    spark.createDataFrame([(2, "b"), (3, "c")], df.schema).write.mode("append").parquet(source)
    ingest.ingest(spark, source, df.schema, mark, sink, "id")
    assert rows(spark.read.parquet(sink)) == [(1, "a"), (2, "b"), (3, "c")]
    log = spark.createDataFrame([(1, True), (2, False)], "id long, final boolean")
    assert rows(ingest.pending(spark.read.parquet(sink).select("id"), log, "id")) == [(2,), (3,)]


def test_fuzzy_dedupe_of_long_prompts(spark):
    from papyra.operators import dedupe

    words = "apple bridge candle dragon engine forest garden harbor island jungle kitten ladder".split()
    long = " ".join(words[(i * i + i // 5) % 12] for i in range(150))
    rows = [(1, long), (2, long.replace("dragon", "wagon", 1)), (3, " ".join(words[(7 * i + i // 3) % 12] for i in range(150)))]
    got = dedupe.fuzzy(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_rare_trigrams_miss_no_pair_of_the_ratio():
    import random

    from papyra.operators import selection

    r = random.Random(4)
    for _ in range(2000):
        a = "".join(r.choice("abc ") for _ in range(r.randint(18, 60)))
        b = "".join(c for c in a if r.random() > 0.05)
        for with_choices, least in ((True, 0.9), (False, 0.97)):
            if len(b) >= 18 and selection.similarity(a, b) >= least:
                both = set(selection.signs(a, with_choices)) & set(selection.signs(b, with_choices))
                for x in (a, b):
                    # of all but the prefix at least one less can be shared, so the prefixes meet
                    assert len(both) > len(x) - 2 - selection.prefix_size(len(x), with_choices)


def test_owners_of_one_place_meet_its_boxes_once(spark, monkeypatch):
    from papyra.operators import matching, relational

    sizes, plain = [], relational.overlapping
    monkeypatch.setattr(relational, "overlapping", lambda a, b, cell: sizes.append((a.count(), b.count())) or plain(a, b, cell))
    ddl = "id int, x0 double, y0 double, x1 double, y1 double"
    boxes = spark.createDataFrame([(k, 10.0 * (k % 4), 0.0, 10.0 * (k % 4) + 4, 4.0) for k in range(400)] + [(400, None, 0.0, 1.0, 1.0)], ddl)
    # the first place has an owner, the second 100 that are equal, the third one smaller than the others, the fourth none that holds half of it
    owners = [(1, 0.0, 0.0, 4.0, 4.0)] + [(k, 10.0, 0.0, 14.0, 4.0) for k in range(2, 102)] + [(k, 20.0, -9.0, 24.0, 4.0) for k in range(200, 300)] + [(150, 20.0, 0.0, 24.0, 9.0), (301, 33.0, 0.0, 34.0, 4.0), (None, 0.0, 0.0, 4.0, 4.0)]
    got = {r.id: r.owner for r in matching.best_owner(boxes, spark.createDataFrame(owners, ddl), 8).collect()}
    assert got == {**{k: {0: 1, 2: 150}.get(k % 4) for k in range(400)}, 400: None} and sizes == [(5, 5)]
