"""Helpers the training-data operators share: shared-folder tables and word hashing over Arrow buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every contract: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass works on; a longer text is one pass of its own.
PASS_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a new local one, which is then set, if driver and executors are one process; else an error.

    Executors of a cluster would write to their own disks, and what they wrote could not be read back whole.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="papyra-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The folder of this driver process's tables, so that release() spares those of other jobs.
_RUN = uuid.uuid4().hex


def stored(df: DataFrame) -> DataFrame:
    """df, computed once, as a Parquet table in the shared folder: it cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/papyra-tables/{_RUN}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes what stored() has written in this driver process; call it once no result is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/papyra-tables/{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df, in any case of letters, doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with one row in so many is joined by broadcast; there are at most so many such keys.
HOT = 256


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with lookup (at most a row a key), null keys never meeting; rows should be stored, as they are read several times.

    Keys that hold a HOTth of all rows or more, HOT of them at most, meet their lookup rows by broadcast, so no task gets a hot key's rows.
    """
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    full = rows.where(known)
    order = [*rows.columns, *[c for c in lookup.columns if c not in keys]]
    none = rows.where(~known).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lookup.schema if f.name not in keys]).select(*order)
    total = full.count()
    hot = stored(full.groupBy(*keys).agg(F.count("*").alias("papyra_c")).where(F.col("papyra_c") >= max(HOT, total / HOT)).drop("papyra_c"))
    if not hot.limit(1).count():
        return full.join(lookup, keys, "left").select(*order).unionByName(none)
    found = stored(hot.join(lookup, keys, "left"))  # HOT rows at most
    cold = full.join(F.broadcast(hot), keys, "left_anti").join(lookup, keys, "left").select(*order)
    return full.join(F.broadcast(found), keys).select(*order).unionByName(cold).unionByName(none)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frugal(run):
    """An Arrow function that hands freed memory back to the system when its task ends: workers are reused, and what they keep counts while other stages run."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def extended(schema: T.StructType, more: str) -> T.StructType:
    """The schema with the fields of a DDL text behind its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields])


def n_words(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- vectorised hashing of words -------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_30, _27, _31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), in place on the array it gets."""
    x ^= x >> _30
    x *= _M1
    x ^= x >> _27
    x *= _M2
    x ^= x >> _31
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def passes(offsets: np.ndarray, most: int = PASS_BYTES):
    """Ranges of texts of about `most` bytes, each with one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word (A-Z lower-cased) of texts that lie one after the other, and where each text's words begin.

    stem: a third array has hashes of the words' first `stem` bytes (8 at most).

    Eight bytes at a time go through a bijective mixer, so words of up to eight bytes never collide.
    """
    base = int(offsets[0])
    size = int(offsets[-1]) - base
    low = np.zeros(size + 8, np.uint8)
    np.take(_LOWER, data[base : base + size], out=low[:size])
    begins = (offsets - base).astype(np.int64)
    if not size:
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, none[0]) if stem else none
    space = _SPACE[low[:size]]
    gap = np.empty(size, bool)  # a word can't go on from the byte before
    gap[0] = True
    gap[1:] = space[:-1]
    inner = begins[:-1]
    gap[inner[inner < size]] = True
    starts = np.flatnonzero(gap & ~space)
    stop = np.empty(size, bool)
    stop[-1] = True
    stop[:-1] = space[1:]
    stop[inner[(inner > 0) & (inner < size + 1)] - 1] = True
    lengths = np.flatnonzero(stop & ~space) + 1 - starts
    eight = np.ndarray((size + 1,), "<u8", low, 0, (1,))
    h = mix(lengths.astype(np.uint64) * _GOLD)
    h ^= eight[starts] & _MASK[np.minimum(lengths, 8)]
    mix(h)
    live, at = np.flatnonzero(lengths > 8), 8
    while len(live):
        part = h[live] ^ (eight[starts[live] + at] & _MASK[np.minimum(lengths[live] - at, 8)])
        part += _GOLD
        h[live] = mix(part)
        at += 8
        live = live[lengths[live] > at]
    first = np.searchsorted(starts, begins)
    return (h, first, mix((eight[starts] & _MASK[np.minimum(lengths, stem)]) + _GOLD)) if stem else (h, first)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `width`-word shingles; shorter texts: of their whole word sequence; no words: empty."""
    words, first = word_hashes(data, offsets)
    folded = words.copy()
    out = []
    for j in range(1, width):
        folded[: len(words) - j] = mix(folded[: len(words) - j] * _GOLD + words[j:]) if len(words) > j else folded[: len(words) - j]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(folded[a : b - width + 1]))
        elif b > a:
            h = words[a : a + 1].copy()
            for j in range(1, b - a):
                h = mix(h * _GOLD + words[a + j : a + j + 1])
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
