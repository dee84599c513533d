"""Quartile bucket digests: hashed byte triplets counted in buckets, each bucket's quartile in two bits, and a length code.

The digest is hexadecimal text: two digits for a logarithmic length code, then 2 bits a bucket. Two digests differ by the sum
of their buckets' quartile differences (a jump of 3 counts 6) and of their length codes, which is bounded; likeness is one less the
difference's share of the bound.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 512
#: Costs of quartile differences, and of a length code's step, up to a bound.
_COST = np.array([0, 1, 2, 6])
_LENGTH_COST, _LENGTH_MOST = 4, 64
#: Byte places of a triplet within a window of five bytes.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_TABLE = [C.mix(np.arange(256 * (k + 1), 256 * (k + 2), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16) & np.uint16(BUCKETS - 1) for k in range(3 * len(_TRIPLETS))]


def codes(data: np.ndarray) -> np.ndarray:
    """A length code and BUCKETS quartile codes of a byte string."""
    out = np.zeros(BUCKETS + 1, np.uint8)
    out[0] = min(255, int(round(8 * np.log2(1 + len(data)))))
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(len(data) - 2, 0), C.PASS_BYTES):
        part = data[start : start + C.PASS_BYTES + 4]
        for k, (a, b, c) in enumerate(_TRIPLETS):
            n = min(len(part) - c, C.PASS_BYTES)
            if n > 0:
                x = _TABLE[3 * k][part[a : a + n]]
                x ^= _TABLE[3 * k + 1][part[b : b + n]]
                x ^= _TABLE[3 * k + 2][part[c : c + n]]
                counts += np.bincount(x, minlength=BUCKETS)
    ordered = np.sort(counts)
    for q in (1, 2, 3):
        out[1:] += counts > ordered[q * BUCKETS // 4 - 1]
    return out


def packed(code: np.ndarray) -> bytes:
    quads = code[1:].reshape(-1, 4)
    return bytes(code[:1]) + (quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]).astype(np.uint8).tobytes()


def encoded(code: np.ndarray) -> str:
    return packed(code).hex()


def decoded(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.concatenate((raw[:1], np.stack([raw[1:] >> 6, raw[1:] >> 4 & 3, raw[1:] >> 2 & 3, raw[1:] & 3], 1).ravel()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests down to 0 for those that differ everywhere."""
    differ = int(_COST[np.abs(a[1:].astype(np.int16) - b[1:])].sum())
    length = min(_LENGTH_MOST, _LENGTH_COST * abs(int(a[0]) - int(b[0])))
    return 1 - (differ + length) / (6 * BUCKETS + _LENGTH_MOST)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "papyra_fingerprint") -> DataFrame:
    """docs with a column of the given name; null texts count as empty, whose buckets are all 0; equal texts have equal digests."""
    place = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = C.utf8(batch.column(place))
            made = [encoded(codes(data[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(C.frugal(run), C.extended(docs.schema, f"{name} string"))


#: Code points of a range part, about.
PART_CHARS = 1 << 26
_RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
#: Hashes and digests are bytes until the result is shown, which halves what is stored.
_BYTES = ("edited_sha256", "fingerprint", "edited_fingerprint")
_DDL = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _pair(doc: int | None, text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    """The result row of a document and its next one."""
    import hashlib

    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    edited_code = codes(np.frombuffer(edited, np.uint8))
    return doc, len(text), hashlib.sha256(edited).digest(), packed(code), packed(edited_code), likeness(code, edited_code), likeness(code, next_code)


def _of(text: str) -> np.ndarray:
    return codes(np.frombuffer(text.encode(), np.uint8))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id, after the last the first; rows of equal id follow one another by a hash of the text, then as read; null
    ids come last. A sole document is its own next one. Null texts count as empty. An empty table gives an empty result.

    Rows are dealt to sorted ranges of id, hash and place in the table, so that not even one repeated row fills a range. Each range is compared in one pass;
    its first and last documents are stored, and each last one meets the next range's first in a join of range numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_CHARS + 1)
    keyed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("place")]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held, first = TaskContext.get().partitionId(), None, None
        fields = [*_RESULT, "part", "first", "last"]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string())

        def batched(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)], names=fields)

        for batch in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                now = (doc, text, _of(text))
                if held:
                    out.append((*_pair(*held, text, now[2]), None, None, None))
                first = text if first is None else first
                held = now
            yield batched(out)
        if held:
            yield batched([(held[0], *[None] * 6, part, first, held[1])])

    made = C.stored(ranged.mapInArrow(C.frugal(run), f"{_DDL}, part long, first string, last string"))
    # one row a range, of numbers alone, in one window; the texts meet in a join
    numbers = made.where("part is not null").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    after = numbers.select("part", following.alias("next"))
    ends = made.where("part is not null").select("doc_id", "part", "last").join(after, "part")
    edges = ends.join(made.where("part is not null").select(F.col("part").alias("next"), "first"), "next").select("doc_id", "last", "first")

    def close(batches):
        import pyarrow as pa

        for batch in batches:
            for doc, last, first in zip(*(c.to_pylist() for c in batch.columns)):
                row = _pair(doc, last, _of(last), first, _of(first))
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=list(_RESULT))

    out = made.where("part is null").select(*_RESULT).union(edges.mapInArrow(C.frugal(close), _DDL))
    return out.select(*[F.lower(F.hex(c)).alias(c) if c in _BYTES else F.col(c) for c in _RESULT])
