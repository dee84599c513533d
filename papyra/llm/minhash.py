"""MinHash near-duplicate detection with b-bit signatures.

One Arrow pass per document gives the exact set digest, `BANDS * ROWS` minima, their low `BITS` bits packed into longs,
and one key per band. Exact copies of a set meet on its digest. In each band bucket every member is compared with
the bucket's smallest id (a number of pairs linear in the members); buckets whose members still lie in more than
one component are then compared in full, block by block. The collision-corrected b-bit estimate prunes; in the blocks a parity bitmap of each
set prunes too, as the bits in which two bitmaps differ are a lower bound of the elements in which the sets do. Pairs
that pass are few, and every link is confirmed on full shingle sets.

At the default 32 bands of 4 rows a pair of similarity 0.8 shares a bucket but for 5e-8; the estimate prunes
5.5 standard deviations below the threshold, so it drops 2e-8 of such pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BANDS, ROWS, BITS = 32, 4, 2
#: Members of a bucket that one task compares with one another; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024
#: Hashed ids of the bitmap that spares texts a shuffle: 64 places a candidate at least, within these bounds.
LEAST_ID_BITS, MOST_ID_BITS = 1 << 20, 1 << 27
_LANES = 64 // BITS
_WORDS = BANDS * ROWS // _LANES
SIGNATURE = [f"s{i}" for i in range(_WORDS)]
_LOW = 0x5555555555555555


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    values = C.mix(seed)
    return values[: BANDS * ROWS] | np.uint64(1), values[BANDS * ROWS :]


def _described(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Digest halves, packed signatures and band keys of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    flat = np.concatenate(sets)
    d1 = np.add.reduceat(C.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), first)
    d2 = np.add.reduceat(C.mix(flat + np.uint64(0x14057B7EF767814F)), first)
    a, b = _coefficients()
    minima = np.empty((len(sets), BANDS * ROWS), np.uint64)
    at = 0
    while at < len(sets):  # pieces that stay in the cache
        end = max(at + 1, int(np.searchsorted(first, first[at] + 32768, "right")) - 1)
        end = len(sets) if first[-1] < first[at] + 32768 else end
        part = flat[first[at] : first[end] if end < len(sets) else len(flat)]
        starts, scratch = first[at:end] - first[at], np.empty(len(part), np.uint64)
        for i in range(BANDS * ROWS):
            np.multiply(part, a[i], out=scratch)
            np.add(scratch, b[i], out=scratch)
            minima[at:end, i] = np.minimum.reduceat(scratch, starts)
        at = end
    low = (C.mix(minima.copy()) & np.uint64((1 << BITS) - 1)).reshape(len(sets), _WORDS, _LANES)
    packed = np.bitwise_or.reduce(low << (np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    keys = np.zeros((len(sets), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    grouped = minima.reshape(len(sets), BANDS, ROWS)
    for r in range(ROWS):
        keys = C.mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return d1, d2, packed, keys


def bitmap(members: np.ndarray) -> bytes:
    """The parity of the members in each of 2 ** k buckets, about eight buckets a member, 512 to 65,536 of them."""
    width = min(1 << 16, max(512, 1 << int(8 * len(members) - 1).bit_length()))
    return np.packbits((np.bincount((members >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n (set size), digest d1 d2, packed signature s0.., band keys, parity bitmap. Null texts and texts without words: n 0, no keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for i, j in C.passes(offsets):
                sets = C.shingle_sets(data, offsets[i : j + 1], width)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                packed, keys = np.zeros((j - i, _WORDS), np.uint64), np.zeros((len(full), BANDS), np.uint64)
                if len(full):
                    d1[full], d2[full], packed[full], keys = _described([sets[k] for k in full])
                counts = np.zeros(j - i, np.int32)
                counts[full] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                maps = pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())
                signed = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (d1, d2, *packed.T)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *signed, lists, maps], names=["id", "n", "d1", "d2", *SIGNATURE, "keys", "bits"])

    schema = "id long, n long, d1 long, d2 long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", keys array<long>, bits binary"
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(C.frugal(run), schema)


def sets_of(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and its full shingle set as sorted hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = C.utf8(batch.column(1))
            for i, j in C.passes(offsets):
                sets = C.shingle_sets(data, offsets[i : j + 1], width)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "members"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(C.frugal(run), "id long, members array<long>")


def least_estimate(threshold: float) -> float:
    """The b-bit estimate below which a pair of the threshold's similarity falls with probability 2e-8."""
    by_chance = 0.5**BITS
    match = by_chance + (1 - by_chance) * threshold
    return threshold - 5.5 * math.sqrt(match * (1 - match) / (BANDS * ROWS)) / (1 - by_chance)


def estimate(left: str, right: str) -> F.Column:
    """Collision-corrected similarity of two packed signatures, by bit counts."""
    differ = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW)))
    matched = 1 - differ / F.lit(float(BANDS * ROWS))
    return (matched - 0.5**BITS) / (1 - 0.5**BITS)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): its smallest reachable id, by alternating large and small stars.

    Each round is two keyed aggregations and joins whose result is written to the shared folder; a hub's edges are
    pre-aggregated and its join can be split. Edges whose ends are equal or null don't count. Empty input: empty result.
    """
    now = C.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if at == mark or not at[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        mark = at
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower.select("u", F.col("m").alias("v")))
        now = C.stored(small.where("u <> v").distinct())


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without most of those whose id is not in ids, and with every one whose id is, before the rows' texts are shuffled.

    A bitmap of hashed ids is broadcast, 64 places an id or more and MOST_ID_BITS at most: 2 ** 21 rows of 64 places, whatever the input. With more than
    that bound's two million candidates it fills up and lets more rows by; then the texts of about all candidates and of that share of the others are shuffled.
    """
    n = ids.count()
    size = min(MOST_ID_BITS, max(LEAST_ID_BITS, 1 << (64 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(size))
    marked = ids.withColumn("place", place).selectExpr("place div 64 as word", "shiftleft(1L, cast(place % 64 as int)) as bit")
    bitmap = F.broadcast(marked.groupBy("word").agg(F.bit_or("bit").alias("held")))
    dealt = rows.withColumn("place", place).withColumn("word", F.expr("place div 64"))
    return dealt.join(bitmap, "word").where("(held & shiftleft(1L, cast(place % 64 as int))) <> 0").select(*rows.columns)


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, width: int, key: str, text: str) -> DataFrame:
    """Those of pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""
    ids = C.stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    # ids are distinct; a semi-join would be pushed below the bitmap's join, and all texts shuffled
    full = C.stored(sets_of(_likely(slim, ids).join(ids, "id"), width, "id", "text"))
    joined = pairs.join(full.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(full.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return C.stored(joined.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct())


def _open(members: DataFrame) -> DataFrame:
    """Those of members (key, id, component) whose bucket holds several components: with main (the component with most members), c (members) and others (those outside main).

    A bucket of two was compared with its hub.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = per.groupBy("key").agg(F.sum("n").alias("c"), F.max(F.struct("n", "component")).alias("m")).where("c > 2 and m.n < c")
    return members.join(sizes.select("key", "c", F.col("m.component").alias("main"), (F.col("c") - F.col("m.n")).alias("others")), "key")


def _narrowed(members: DataFrame, bands: DataFrame) -> DataFrame:
    """Open buckets of members; those with more than a block of members outside their main component are parted by a second band: pairs then meet only where they share two.

    That keeps buckets of one loose template from being compared all with all: of documents of similarity 0.6 an eighth share a band and a sixtieth two.
    A pair of similarity 0.8 shares fewer than two of the 32 bands with probability 1.1e-6.
    """
    held = C.stored(_open(members))
    large = held.where(F.col("others") > BLOCK)
    if not large.limit(1).count():
        return held
    second = large.join(bands.select("id", F.col("key").alias("other")), "id").where("other > key")
    parted = second.select(F.xxhash64("key", "other").alias("key"), "id", "component")
    return held.where(F.col("others") <= BLOCK).unionByName(_open(parted))


def _across(members: DataFrame, signed: DataFrame, bands: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) of buckets, of different components and near by estimate and bitmap: each bucket whole, in blocks that bound a task.

    Members of the main component stay in their block; only the others go to all blocks of the bucket, so a large group of copies with a few strangers
    is not compared with itself. Widths of bitmaps aside, a pair passes only if its sets may meet the threshold; rejected pairs never leave their task.
    Of signed (id, n, signature, bits) only the rows of open buckets' members are shuffled.
    """
    held = C.stored(_narrowed(members, bands).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")))
    open_ = held.join(_likely(signed, held.select("id").distinct()), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    to = F.when(F.col("component") == F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = open_.withColumn("home", block).withColumn("block", F.explode(to)).withColumn("at_home", F.col("home") == F.col("block"))

    def run(frame):
        import pandas as pd

        frame = frame.drop_duplicates(["id", "n", *SIGNATURE]).sort_values(["n", "id"])  # an id may have several texts
        ids, comp, n, home = (frame[c].to_numpy() for c in ("id", "component", "n", "at_home"))
        sign, bits = frame[SIGNATURE].to_numpy().view(np.uint64), [np.frombuffer(b, np.uint64) for b in frame["bits"]]
        one, found = np.uint64(1), []
        widths = np.array([len(b) for b in bits])
        for width in np.unique(widths):  # a partner has at most a quarter more members, so the same width or twice as much
            rows = np.flatnonzero((widths == width) | (widths == 2 * width))
            maps = np.stack([bits[r] if widths[r] == width else bits[r][:width] ^ bits[r][width:] for r in rows])
            for k in np.flatnonzero(widths[rows] == width):
                a = rows[k]
                end = int(np.searchsorted(n[rows], n[a] * 100 // percent, "right"))
                some = np.arange(k + 1, end)
                some = some[(comp[rows[some]] != comp[a]) & (home[a] | home[rows[some]])]
                x = sign[rows[some]] ^ sign[a]
                x = (x | x >> one) & np.uint64(_LOW)
                some = some[((1 - np.bitwise_count(x).sum(axis=1) / (BANDS * ROWS)) - 0.5**BITS) / (1 - 0.5**BITS) >= least]
                both = n[a] + n[rows[some]]
                shared = (both - np.bitwise_count(maps[some] ^ maps[k]).sum(axis=1, dtype=np.int64)) // 2  # at most
                other = ids[rows[some[100 * shared >= percent * (both - shared)]]]
                if len(other):
                    found.append(np.stack([np.minimum(other, ids[a]), np.maximum(other, ids[a])], 1))
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(ids) >= BLOCK:
            C.give_back()
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.drop("home", "c", "others", "main", "blocks").groupBy("key", "block").applyInPandas(run, "a long, b long").distinct()


def _with_hubs(bands: DataFrame, hubs: DataFrame) -> DataFrame:
    """(key, id, hub) of the bands (id, key) that several ids share. Keys that hold a HOTth of those rows or more, HOT of them at most, meet their hub by broadcast."""
    total = hubs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]  # one number
    hot = hubs.where(F.col("c") >= max(C.HOT, total / C.HOT)).select("key", "hub")
    if not hot.limit(1).count():
        return bands.join(hubs.drop("c"), "key").select("key", "id", "hub")
    cold = bands.join(F.broadcast(hot.select("key")), "key", "left_anti").join(hubs.drop("c"), "key")
    return cold.select("key", "id", "hub").union(bands.join(F.broadcast(hot), "key").select("key", "id", "hub"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest linked id, itself included), kept (it is that id).

    Links: documents whose sets of distinct `width`-word shingles (A-Z lower-cased; shorter texts: the whole sequence)
    meet 100 * intersection >= percent * union. Null, empty and blank texts have no shingles and no links. Rows of equal id are
    one node and each comes back; rows whose id is null are kept, with a null component. An empty table gives an empty result. Other columns are ignored.
    """
    sig = C.stored(signatures(docs, width, key, text))
    live = sig.where("n > 0 and id is not null")
    exact = live.groupBy("d1", "d2", "n").agg(F.min("id").alias("id"))
    reps = C.stored(live.drop("d1", "d2", "bits").join(exact.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "n", *SIGNATURE]))
    bands = reps.select("id", F.explode("keys").alias("key"))
    hubs = C.stored(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1"))
    members = C.stored(_with_hubs(bands, hubs).distinct())
    least = least_estimate(percent / 100)
    slim = reps.drop("keys")
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().alias("p")
    near = pairs.join(slim.alias("l"), F.expr("p.a = l.id")).join(slim.alias("r"), F.expr("p.b = r.id"))
    near = near.where((100 * F.least("l.n", "r.n") >= percent * F.greatest("l.n", "r.n")) & (estimate("l", "r") >= least))
    first = _confirmed(docs, C.stored(near.select("p.a", "p.b").distinct()), percent, width, key, text)
    label = C.stored(components(first))
    labelled = C.stored(members.join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    second = C.stored(_across(labelled, live.select("id", "n", *SIGNATURE, "bits"), bands, least, percent))
    if second.limit(1).count():
        links = _confirmed(docs, second, percent, width, key, text)
        if links.limit(1).count():
            first = C.stored(first.union(links))
            label = C.stored(components(first))
    # rows of one digest have the same set: the smallest id of each digest stands for them
    digests = sig.select("id", "n", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("d1")).alias("d1"), "d2")
    to_rep = exact.withColumnRenamed("id", "rep")
    repeated = live.groupBy("id").agg(F.min(F.struct("d1", "d2", "n")).alias("low"), F.max(F.struct("d1", "d2", "n")).alias("high")).where("low <> high")
    if repeated.limit(1).count():  # rows of one id with different sets are one node
        same = C.looked_up(digests, to_rep, ["d1", "d2", "n"]).where("rep is not null").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
        label = C.stored(components(first.union(same)))
        named = digests.join(label, "id", "left").select("id", "n", "component")
    else:
        to_rep = to_rep.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
        named = C.looked_up(digests, to_rep, ["d1", "d2", "n"])
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
