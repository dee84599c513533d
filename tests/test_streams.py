"""Streams: observed counts of each batch, state that follows a lifetime, restarts that lose nothing."""

import json

from pyspark.sql import functions as F

from papyra.streaming import ingest

SCHEMA = "id long, at timestamp, v string"


def files(spark, folder, n, each=100, start=0):
    """One file a batch: a new quarter of an hour with its own keys, and the last ten keys of the one before."""
    for k in range(start, start + n):
        ids = [*range(k * each, (k + 1) * each), *range(max(0, k * each - 10), k * each)]
        rows = spark.createDataFrame([(i, f"b{k}") for i in ids], "id long, v string").coalesce(1)
        rows.select("id", F.timestamp_seconds(F.lit(1_700_000_000 + 900 * k)).alias("at"), "v").write.mode("append").parquet(folder)


def test_state_stays_with_the_lifetime(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    progress = ingest.Progress()
    spark.streams.addListener(progress)
    try:
        for start, n in ((0, 6), (6, 4), (10, 0)):  # a restart with new files, and one without
            files(spark, source, n, start=start)
            ingest.ingest_within(spark, source, SCHEMA, mark, sink, "id", "at", "20 minutes", F.col("id") % 2 == 0)
        rows = sorted((r.batch, json.loads(r.counts), r.state_rows) for r in progress.table(spark).collect())
    finally:
        spark.streams.removeListener(progress)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(1000))
    with_rows = [(c["seen"], c["good"]) for _, c, _ in rows if int(c["seen"])]
    assert [(int(a), int(b)) for a, b in with_rows] == [(100, 50)] + [(110, 55)] * 9
    assert max(state for _, _, state in rows) <= 400 < 1000
