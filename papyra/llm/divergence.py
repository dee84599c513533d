"""Audit of how sources of one language differ in their words, by deduplicated count columns.

Each task counts the terms of its texts by language and source; summed, every kept term has one sparse vector of counts by
source. Terms of one vector differ from each other in nothing that a pair of sources can see, so each pair is evaluated
once for each distinct vector and multiplied by the number of its terms. Single terms are then ranked under their own names.

All arithmetic is on integers: shares are billionths, rounded down, plus one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Terms stay that so many documents of their language hold; PAD is added to each count; SCALE is the unit of shares.
LEAST_DOCS, PAD, SCALE = 30, 5, 1_000_000_000
#: Terms reported for each source.
TOP = 50
#: Entries that a task's counters hold before they are handed on, and texts of more bytes are split into words part by part.
HELD, PART_BYTES = 300_000, 1 << 20
#: Distinct vectors and first sources of pairs that one evaluation has.
VECTORS, SIDE = 2_000, 512

#: Letters A-Z in lower case, a-z and all bytes of other characters stay; the rest parts words.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes, table: bytes = _TERMS):
    """Lists of a text's words, in order; a long text comes in several lists, cut between words."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PART_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term as far as single tasks have counted.

    Each (lang, source) has a row of the empty term too. Null text, lang and source are empty.
    """

    def emptied(held):
        import pyarrow as pa

        columns = ([], [], [], [], [])

        def batch():
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "docs"])

        for (lang, source), (n, docs) in held.items():
            for c, x in zip(columns, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [b"", *n], [0, *n.values()], [0, *map(docs.__getitem__, n)])):
                c += x
            if len(columns[0]) >= 50_000:
                yield batch()
                columns = ([], [], [], [], [])
        if columns[0]:
            yield batch()
        held.clear()

    def run(batches):
        held, seen = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                own = set()
                for words in words_of(text):
                    n.update(words)
                    own.update(words)
                docs.update(own)
                seen += len(text)
                if seen > 8 * PART_BYTES:
                    seen = 0
                    if sum(len(n) for n, _ in held.values()) > HELD:
                        yield from emptied(held)
        yield from emptied(held)

    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*plain, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(C.frugal(run), "lang string, source string, term string, n long, docs long")


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, vec): the kept terms with (source, n) by source; under the empty term the sources of the language."""
    # dealt once, by language and term; the two sums need no further exchange
    by = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return vectors.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "vec")


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / size) of 64-bit integers, n <= size < 2 ** 53, by long division in base 1000, so no product overflows."""
    whole, rest = np.divmod(n, size)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + step
    return whole + 1


def _distances(vectors: DataFrame, dims: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of a language's sources; vectors has (lang, vec) of each kept term."""
    distinct = C.stored(vectors.groupBy("lang", "vec").agg(F.count("*").alias("m")))
    langs = dims.groupBy("lang").agg(F.count("*").alias("sources")).join(distinct.groupBy("lang").agg(F.count("*").alias("k")), "lang", "left")
    parts = langs.select("lang", F.expr(f"1 + coalesce(k, 0) div {VECTORS}").alias("parts"), F.expr(f"(sources - 1) div {SIDE}").alias("last"))
    tiles = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("tile")
    left = distinct.join(parts, "lang").select("lang", F.pmod(F.xxhash64("vec"), F.col("parts")).alias("part"), F.col("vec.source").alias("at"), F.col("vec.n").alias("n"), "m", "last")
    left = left.select("lang", "part", "at", "n", "m", tiles)
    right = dims.join(parts, "lang").select("lang", "source", "size", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = right.select("lang", "part", "source", "size", tiles)

    def pairs(key, left, right):
        import pandas as pd

        right = right.sort_values("source")
        names, size = right["source"].to_numpy(), right["size"].to_numpy(np.int64)
        first = int(key[1]) * SIDE
        own = range(first, min(first + SIDE, len(names)))
        total = np.zeros((len(own), len(names)), np.int64)
        places = {x: k for k, x in enumerate(names)}
        step = max(1, 2_000_000 // max(1, len(names)))
        for i in range(0, len(left), step):
            some = left.iloc[i : i + step]
            row = np.repeat(np.arange(len(some)), [len(x) for x in some["at"]])
            count = np.zeros((len(some), len(names)), np.int64)
            count[row, [places[x] for at in some["at"] for x in at]] = np.concatenate(some["n"].to_numpy())
            p = shares(count + PAD, size)
            m = some["m"].to_numpy(np.int64)[:, None]
            for k, a in enumerate(own):
                total[k] += (np.abs(p - p[:, a : a + 1]) * m).sum(0)
        a, b = (x.ravel() for x in np.meshgrid(np.arange(len(own)) + first, np.arange(len(names)), indexing="ij"))
        apart = a != b
        return pd.DataFrame({"lang": key[0], "source": names[a[apart]], "item": names[b[apart]], "value": total.ravel()[apart]})

    keys = ("lang", "tile", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pairs, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: str, size: str) -> F.Column:
    return F.expr(f"1 + (cast({n} + {PAD} as decimal(20, 0)) * {SCALE}) div cast({size} as decimal(20, 0))")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's words are from those of its language's other sources.

    Part `pair`: the summed distance of the two sources' shares over all kept terms, for every other source. Part `term`: the
    `top` terms of which the source has a larger share than its language. Null text, lang and source are empty; a source
    without words has the smoothed share of every kept term; a language without kept terms has pairs of value 0 and no terms.
    Ties go to the smaller item by bytes. Repeated rows count as often as they occur; an empty table gives no rows; other
    columns are not read. Counts of a language stay below 2 ** 53.
    """
    found = C.stored(term_vectors(docs, least_docs))
    kept = found.where("term <> ''")
    # an exploded row for each term and source that has it
    hits = kept.select("lang", "term", F.expr("aggregate(vec, 0L, (s, x) -> s + x.n)").alias("total"), F.explode("vec").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.expr("aggregate(vec, 0L, (s, x) -> s + x.n)")).alias("lang_words"))
    words = hits.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = found.where("term = ''").select("lang", F.explode("vec.source").alias("source"))
    dims = groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left")
    size = [(F.coalesce(n, F.lit(0)) + PAD * F.coalesce("v", F.lit(0))).alias(name) for n, name in (("words", "size"), ("lang_words", "lang_size"))]
    dims = C.stored(dims.select("lang", "source", *size))

    own = C.looked_up(hits, dims, ["lang", "source"])
    above = own.select("lang", "source", F.col("term").alias("item"), (_share("n", "size") - _share("total", "lang_size")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = _distances(kept.select("lang", "vec"), dims).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return columns(pairs, "pair").unionByName(columns(terms, "term"))
