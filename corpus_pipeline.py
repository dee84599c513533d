"""A training-data pipeline: toxic documents go, near duplicates go, secrets are masked, sources are mixed, and the mix is packed.

Part of the llm subpackage. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it back, as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import minhash, mixing, packing, secrets, toxicity
from papyra.llm.common import fresh, stored, table
from papyra.llm.queries import rank_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the model scores 0.5 or more; it learns from the labelled rows of docs.

    Null and empty texts stay, whatever the model's bias; equal texts fare alike, also under one id. Without labels nothing is learnt and all stay.
    """
    model = stored(toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels"))))
    score = fresh(docs, "papyra_score")
    if not model.where("coordinate >= 0").limit(1).count():
        return docs
    silent = F.col("text").isNull() | (F.col("text") == "")
    return toxicity.scored(docs, model, name=score).where((F.col(score) < 0.5) | silent).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near duplicates (five words, similarity 0.8): that of the smallest id.

    Each row is a document of its own: rows of equal or null id with unlike texts all stay, and of equal rows one stays (null ids
    count as the largest). Null texts and texts without words are like no other and stay.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if not repeated.limit(1).count():
        gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
    row = fresh(docs, "papyra_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = minhash.near_duplicates(numbered, key=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    ids = numbered.select(row, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row")).alias("at"))
    first = stored(found.join(ids, row).groupBy("group").agg(F.min("at").alias("at")).select(F.col("at.row").alias(row)))
    return numbered.join(first, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret span of their texts replaced by [secret]; no document goes. Null texts stay null, empty ones empty."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as its source's target wants it; a document at a source's boundary is whole or absent.

    Null sources are a source; documents without words follow their source's whole epochs; rows of equal id, source and number of words are taken alike.
    """
    return mixing.mixed(docs, mixing.quality_weights(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of token sequences. Each row is a document, repeated ones and null ids too; a null or empty text is its end token."""
    return packing.pieces(docs, rank_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the learnt model nor the greedy packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else stored(docs)
    return docs
