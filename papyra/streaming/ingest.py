"""Resumable incremental ingest with Structured Streaming: new files once, repeated keys dropped, counts upserted per batch."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from papyra.sources.scratch import working_folder


def ingest(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, key: str) -> None:
    """Reads every file of a folder that no earlier run has read, drops repeated keys, and appends to a Parquet sink.

    The checkpoint makes reruns idempotent. As in any unbounded deduplication the state grows with the keys.
    """
    stream = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()


def pending(inventory: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """The inventory's rows that the log doesn't hold as final."""
    return inventory.join(log.where(F.col("final")).select(key).distinct(), key, "left_anti")


def streamed_counts(spark: SparkSession, source: str, key: str = "event_id", group: str = "event_type", value: str = "value") -> DataFrame:
    """Rows and summed values by group of what a stream over the source's files has written; a second run over the same files adds nothing."""
    folder = working_folder(spark)
    schema = spark.read.parquet(source).schema
    source = source.removesuffix("/") + "*"  # a pattern finds a file and a folder alike
    for _ in range(2):  # the second run finds no new file
        ingest(spark, source, schema, f"{folder}/mark", f"{folder}/sink", key)
    return spark.read.schema(schema).parquet(f"{folder}/sink").groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def statuses(candidates: DataFrame, known: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """Candidates (key, ok) with the status that an import gives: blocked_quality, skipped_duplicate (known, or a repeated key behind its first row), dry_run or imported."""
    from pyspark.sql import Window

    marked = candidates.join(known.select(key).distinct().withColumn("papyra_known", F.lit(True)), key, "left")
    again = F.row_number().over(Window.partitionBy(key, "ok").orderBy(*[c for c in candidates.columns if c not in (key, "ok")])) > 1
    status = F.when(~F.col("ok"), "blocked_quality").when(F.col("papyra_known") | again, "skipped_duplicate").otherwise("dry_run" if dry_run else "imported")
    return marked.withColumn("status", status).drop("papyra_known")


# Parts of titles of practical accounting papers, the message and the title part that tell parsers' failures apart.
ACCOUNTING = ("FAT", "TAT", "전산회계", "전산세무")
INLINE_ANSWERS, ADMISSION = "Multiple inline answers in one question", "수능"


def _accounting(title) -> F.Column:
    return reduce(lambda a, b: a | b, [title.contains(t) for t in ACCOUNTING])


def retry_class(importable, errors, title, old_errors) -> F.Column:
    """What has become of a failed import on a new try. errors, old_errors: arrays of messages, whose codes stand before the first colon; null counts as none."""
    heads = lambda messages: F.transform(F.coalesce(messages, F.array().cast("array<string>")), lambda m: F.substring_index(m, ":", 1))
    codes, before, title = F.array_distinct(heads(errors)), heads(old_errors), F.coalesce(title, F.lit(""))
    has = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(n) for n in names]))
    broken = has("choice_count", "invalid_correct_answer")
    return (
        F.when(importable, "parser_fixed_importable")
        .when(_accounting(title), "accounting_practical_non_mc")
        .when((F.size(codes) == 1) & has("missing_question_image"), "missing_required_image")
        .when(has("question_count"), "no_questions_detected")
        .when(has("invalid_correct_answer") & ~has("choice_count") & title.contains(ADMISSION), "answer_key_format_unsupported")
        .when(has("invalid_group_range", "group_assignment_mismatch", "group_child_mismatch"), "group_parser_remaining")
        .when(broken & F.array_contains(before, INLINE_ANSWERS), "inline_answer_parser_partially_fixed")
        .when(broken, "choice_or_answer_parser_remaining")
        .when(has("ambiguous_group_range"), "ambiguous_set_question")
        .otherwise("quality_block_remaining")
    )


def exception_class(message, parse_error, title) -> F.Column:
    """The class of a new try that ended in an exception; parse_error: whether the parser raised it."""
    inline = F.coalesce(parse_error & message.contains(INLINE_ANSWERS), F.lit(False))
    return F.when(_accounting(F.coalesce(title, F.lit(""))), "accounting_practical_non_mc").when(inline, "inline_answer_marker_remaining").otherwise("parse_exception_remaining")


def ingest_new(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, key: str) -> None:
    """Like ingest(), with the keys that the sink holds read anew before each batch; the state that a stream keeps doesn't grow."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.schema(schema).parquet(sink).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as missing:  # the sink's first batch
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        fresh.write.mode("append").parquet(sink)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Progress(StreamingQueryListener):
    """What each batch of the session's queries has seen: its observed counts and the rows of its state. Add it with spark.streams.addListener."""

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        for name, metrics in p.observedMetrics.items():
            self.rows.append((str(p.id), name, int(p.batchId), json.dumps(metrics.asDict(), default=str), int(state)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, name, batch, counts, state_rows) of the batches so far; counts is JSON."""
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        return spark.createDataFrame(self.rows, "query string, name string, batch long, counts string, state_rows long")


def ingest_within(spark: SparkSession, source: str, schema, checkpoint: str, sink: str, key: str, at: str, lifetime: str, good: F.Column | None = None, files: int = 1) -> None:
    """Like ingest(), with keys that are forgotten when the rows' time has passed by the lifetime: the state follows the rows of a lifetime, not all rows.

    A key that repeats within the lifetime is dropped; one that comes again later is new; rows whose own time is behind the newest by more than the lifetime are late and left out. Each batch takes `files` new files and observes, as "ingest", the rows it has seen, and those that are good.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    seen = stream.observe("ingest", F.count(F.lit(1)).alias("seen"), F.count_if(F.lit(True) if good is None else good).alias("good"))
    fresh = seen.withWatermark(at, lifetime).dropDuplicatesWithinWatermark([key])
    query = fresh.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_counts(spark: SparkSession, source: str, lifetime: str = "1 hour", key: str = "event_id", at: str = "ts") -> DataFrame:
    """(seen, good, written) over all batches of a stream of the source's files, restarted once: observed counts beside the rows in the sink."""
    folder, progress = working_folder(spark), Progress()
    schema = spark.read.parquet(source).withColumn(at, F.col(at).cast("timestamp_ltz")).schema
    spark.streams.addListener(progress)
    try:
        for _ in range(2):
            ingest_within(spark, source.removesuffix("/") + "*", schema, f"{folder}/mark", f"{folder}/sink", key, at, lifetime, F.col(key) % 2 == 0)
        counts = progress.table(spark)
    finally:
        spark.streams.removeListener(progress)
    number = lambda name: F.coalesce(F.sum(F.get_json_object("counts", f"$.{name}").cast("long")), F.lit(0)).alias(name)
    written = spark.read.schema(schema).parquet(f"{folder}/sink").agg(F.count("*").alias("written"))
    return counts.where("name = 'ingest'").agg(number("seen"), number("good")).crossJoin(written)  # single rows
