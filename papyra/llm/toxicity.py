"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, their first `STEM` bytes, adjacent pairs and pairs one word apart (A-Z
lower-cased, punctuation taken as white space) in 2 ** 20 coordinates. Training is sequential by nature, so it takes a bounded sample of labelled rows
(`SAMPLE`, by a hash of the id) in one task; per-coordinate rates and L1 leave a few thousand weights, which are broadcast (at most
4 MB, the dense table). Scoring is one Arrow pass over all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE_BITS = 20
#: Labelled rows that training takes at most, a documented bound: those of the least hash of their id.
SAMPLE = 12_000
EPOCHS = 3
#: Times that a toxic row is learnt each time it comes: there are few of them.
REPEAT = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 6.0, 1.0
STEM = 4
#: Features that a row carries to the training task, at most: Arrow batches count rows, so this bounds their bytes.
A_ROW = 256
_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[list(_PUNCTUATION)] = 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of every feature occurrence, with the number of the text that it belongs to."""
    words, first, stems = C.word_hashes(_BLANK[data[int(offsets[0]) : int(offsets[-1])]], offsets - offsets[0], STEM)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shift = np.uint64(64 - SPACE_BITS)
    parts, owners = [words >> shift, stems >> shift], [doc, doc]
    for gap, salt in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        if len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = C.mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(salt))
            parts.append(pair[same] >> shift)
            owners.append(doc[gap:][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights are derived lazily from z and n."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return -self.bias_z / ((BETA + self.bias_n**0.5) / ALPHA)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / ALPHA * b
        self.bias_n += g * g


def train(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(coordinate, weight) of the model, the bias at coordinate -1; from at most `sample` rows of (key, text, label 0/1).

    Rows with a null label are left out. Empty input: just the bias 0. Rows are learnt in the order of a hash of the key and the text,
    so reruns agree, whatever the partitions.
    """
    rank = F.xxhash64(F.lit("toxicity"), F.col(key).cast("string"), F.col(text))
    picked = labelled.where(F.col(label).isNotNull()).select(rank.alias("rank"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")).orderBy("rank").limit(sample)

    def hashed(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 32  # tells equal texts of one id apart
        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for i, j in C.passes(offsets):
                at, doc = features(data, offsets[i : j + 1])
                pairs = np.unique(doc << SPACE_BITS | at)
                cuts = np.searchsorted(pairs, np.arange(j - i + 1) << SPACE_BITS)
                n = np.maximum(1, -(-np.diff(cuts) // A_ROW))
                owner = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                starts = np.append(cuts[owner] + piece * A_ROW, cuts[-1]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array((pairs & ((1 << SPACE_BITS) - 1)).astype(np.int32)))
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(own), pa.array(row + owner), pa.array(piece), lists, batch.column(2).slice(i, j - i).take(own)], names=["rank", "row", "piece", "at", "label"])
                row += j - i

    def run(batches):
        import pyarrow as pa

        # features stay in the few large arrays that they come in; a text's rows are views of them
        columns, chunks, at = [], [], 0
        for batch in batches:
            if len(batch):
                flat, cuts = batch.column(3).flatten().to_numpy().copy(), batch.column(3).offsets.to_numpy().astype(np.int64)
                cuts = cuts - cuts[0] + at
                columns.append(np.stack([*(batch.column(k).to_numpy().astype(np.int64) for k in (0, 4, 1, 2)), cuts[:-1], cuts[1:], np.full(len(batch), len(chunks))]))
                chunks.append((at, flat))
                at += len(flat)
        rows = []
        if chunks:
            rank, label_, row, piece, start, stop, chunk = np.concatenate(columns, axis=1)
            order = np.lexsort((piece, row, label_, rank))
            begins = np.flatnonzero(piece[order] == 0)
            for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(order)]):
                own = order[x:y]
                first, flat = chunks[chunk[own[0]]]
                if (chunk[own] == chunk[own[0]]).all() and (start[own[1:]] == stop[own[:-1]]).all():
                    text_at = flat[start[own[0]] - first : stop[own[-1]] - first]
                else:  # its rows came in two batches
                    text_at = np.concatenate([chunks[chunk[k]][1][start[k] - chunks[chunk[k]][0] : stop[k] - chunks[chunk[k]][0]] for k in own])
                rows.append((text_at, int(label_[own[0]])))
        model = Ftrl(1 << SPACE_BITS)
        if rows:
            for _ in range(EPOCHS):
                for at, y in rows:
                    for _ in range(REPEAT if y else 1):
                        model.learn(at, y)
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], model.bias()))], names=["coordinate", "weight"])

    # features are hashed on all executors; the few rows then meet in one task, as training is sequential
    dealt = picked.repartition(64).mapInArrow(C.frugal(hashed), "rank long, row long, piece long, at array<int>, label int")
    return dealt.repartition(1).mapInArrow(C.frugal(run), "coordinate long, weight double")


def scored(docs: DataFrame, model: DataFrame, text: str = "text", name: str = "papyra_score") -> DataFrame:
    """docs with a column of the given name, the score: 0 to 1, higher the likelier toxic. Null texts count as empty, whose score is the bias's."""
    size = 1 << SPACE_BITS
    table = np.zeros(size, np.float32)
    bias = 0.0
    for at, w in model.collect():  # at most 2 ** 20 coordinates, whatever the input
        if at < 0:
            bias = w
        else:
            table[at] = w
    shared = docs.sparkSession.sparkContext.broadcast(table)
    place = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        weights = shared.value
        live = weights != 0
        for batch in batches:
            data, offsets = C.utf8(batch.column(place))
            total = np.full(len(batch), bias)
            for i, j in C.passes(offsets):
                at, doc = features(data, offsets[i : j + 1])
                hit = live[at]
                pairs = np.unique(doc[hit] << SPACE_BITS | at[hit])
                total[i:j] += np.bincount(pairs >> SPACE_BITS, weights[pairs & (size - 1)], j - i)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    schema = C.extended(docs.schema, f"{name} double")
    return docs.mapInArrow(C.frugal(run), schema)


def held_out(key) -> F.Column:
    """Whether an id is out of training: crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the labelled documents that training may see; of repeated labels the highest counts."""
    marks = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label")).where("label is not null")
    rank = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    few = marks.orderBy(rank, "doc_id").limit(SAMPLE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. Rows without text are scored as empty ones; rows of equal text score alike."""
    model = C.stored(train(labelled_rows(docs, labels)))
    out = scored(docs.select("doc_id", "text"), model).withColumnRenamed("papyra_score", "score")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
