"""Collocations of two to five words: candidates from the upper bounds of a sketch, counted exactly by automata.

1. Every task counts the hashed phrases of its texts, of one to five words; the counts are added up by blocks of cells. A
   cell's sum bounds the frequency of each of its phrases from above. The number of cells follows the size of the texts.
2. The cells that reach the threshold are a bitmap; the tasks name the phrases in such cells, which are the candidates.
3. Candidates go to shards of bounded size by their first word. Each shard is compiled into an Aho-Corasick automaton in
   which a word is three signs; texts are spelt in these signs, with delimiters for the ends of pieces and for words that no phrase
   has, so that a match is always whole words of one piece. It scans all texts for overlapping matches; the summed counts are exact.
4. Thresholds, cuts and ranks are joins and windows over the counted phrases, which hold all parts of each of them.

Bitmaps and shards are broadcast and bounded (BITMAP_BITS, SHARD_BYTES); more cells or candidates take more passes over the texts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Words of the longest phrase, least occurrences of a phrase, rows reported for each language.
WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of text for each cell of the sketch (about six phrases, so few cells reach the threshold by chance), cells of a block (2 to this power).
CELL_BYTES, BLOCK_BITS = 8, 16
#: Cells of one bitmap (2 to this power: 32 MB), bytes of the phrases of one automaton (about 10 bytes of memory each), its distinct words.
BITMAP_BITS, SHARD_BYTES, SHARD_WORDS = 28, 16_000_000, 1_000_000
#: Phrases whose counts are one row of a task's result.
COUNT_BLOCK = 4096
#: Entries that a task holds before it hands them on.
HELD = 4_000_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z in lower case, the ends of pieces as line feeds, tabs as spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _BREAKS else 32 if b == 9 else b for b in range(256))
_LUT = np.frombuffer(_PLAIN, np.uint8)


def _read(docs: DataFrame) -> DataFrame:
    """(lang, text): null languages are `und`, null texts empty."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _passes(column):
    """(plain bytes, begins, rows) of about PASS_BYTES each: begins parts texts, or pieces of a very long one; rows has their places in the column."""
    data, offsets = C.utf8(column)
    for i, j in C.passes(offsets, C.PASS_BYTES):
        low = _LUT[data[int(offsets[i]) : int(offsets[j])]]
        begins, rows = (offsets[i : j + 1] - offsets[i]).astype(np.int64), np.arange(i, j)
        if len(low) <= 2 * C.PASS_BYTES:
            yield low, begins, rows
            continue
        ends, at = np.flatnonzero(low == 10), 0  # one long text: it is cut where pieces end
        while at < len(low):
            k = int(np.searchsorted(ends, at + C.PASS_BYTES))
            end = int(ends[k]) + 1 if k < len(ends) else len(low)
            yield low[at:end], np.array([0, end - at]), rows
            at = end


class Grams:
    """Words of a pass and hashes of the phrases that begin at each of them. salts: a number for each text of the pass."""

    def __init__(self, low: np.ndarray, begins: np.ndarray, salts: np.ndarray):
        self.low = low
        h, first = C.word_hashes(low, begins)
        apart = np.concatenate(([True], (low == 32) | (low == 10), [True]))
        apart_before, apart_after = apart[:-2].copy(), apart[2:].copy()
        inner = begins[1:-1]
        apart_before[inner[inner < len(low)]] = True
        apart_after[inner[(inner > 0)] - 1] = True
        self.starts, self.ends = np.flatnonzero(apart_before & ~apart[1:-1]), np.flatnonzero(apart_after & ~apart[1:-1]) + 1
        self.doc = np.repeat(np.arange(len(begins) - 1), np.diff(first))
        piece = np.searchsorted(np.flatnonzero(low == 10), self.starts) + self.doc
        self.hashes, self.at = [], []
        own = C.mix(h ^ salts[self.doc])
        folded, live = own.copy(), np.arange(len(own))
        for k in range(WORDS):
            if k:
                live = live[live + k < len(own)]
                live = live[piece[live] == piece[live + k]]
                folded[live] = C.mix(folded[live] * C._GOLD + own[live + k])
            self.hashes.append(folded[live])
            self.at.append(live)

    def text(self, k: int, i: int) -> bytes:
        found = self.low[self.starts[i] : self.ends[i + k - 1]].tobytes()
        return b" ".join(found.split()) if k > 1 else found


def _salts(langs: list) -> np.ndarray:
    import zlib

    return C.mix(np.array([zlib.crc32(x.encode()) + len(x) * (1 << 32) for x in langs], np.uint64))


def _summed(cells: list, counts: list, most: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their counts, `most` at most."""
    cells, counts = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    return cells[new], np.minimum(np.add.reduceat(counts, new, dtype=np.int64), most).astype(kind)


def heavy_cells(docs: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """(block, bits): the cells of a sketch of 2 ** bits cells whose phrases occur `least` times or more together, as bitmaps by block."""
    kind, place = np.min_scalar_type(least), np.uint32 if bits <= 32 else np.uint64

    def run(batches):
        import pyarrow as pa

        def emptied():
            at, n = _summed(cells, counts, least, kind)
            cells.clear(), counts.clear()
            blocks = (at >> place(BLOCK_BITS)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))), len(at))
            low = (at & place((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            for i in range(0, len(cuts) - 1, 256):
                some = list(zip(cuts[i : i + 257].tolist(), cuts[i + 1 : i + 257].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[[a for a, _ in some]]), pa.array([low[a:b].tobytes() for a, b in some], pa.binary()), pa.array([n[a:b].tobytes() for a, b in some], pa.binary())], names=["block", "cells", "counts"])

        cells, counts = [], []
        for batch in batches:
            salts = _salts(batch.column(0).to_pylist())
            for low, begins, rows in _passes(batch.column(1)):
                found = (np.concatenate(Grams(low, begins, salts[rows]).hashes) >> np.uint64(64 - bits)).astype(place)
                if len(found):
                    at, n = np.unique(found, return_counts=True)
                    cells.append(at)
                    counts.append(np.minimum(n, least).astype(kind))
                if sum(map(len, cells)) > HELD:
                    yield from emptied()
        if cells:
            yield from emptied()

    def summed(key, frame):
        import pandas as pd

        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for at, n in zip(frame["cells"], frame["counts"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)  # cells of a row are distinct
        hot = total >= least
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(hot, bitorder="little").tobytes()]}).iloc[: int(hot.any())]

    sketched = _read(docs).mapInArrow(C.frugal(run), "block long, cells binary, counts binary")
    return sketched.groupBy("block").applyInPandas(summed, "block long, bits binary")


def candidates(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase) of all phrases of one to five words that may occur `least` times, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(BLOCK_BITS, (size // CELL_BYTES).bit_length())
    hot = C.stored(heavy_cells(docs, bits, least))
    wave_bits = min(bits, BITMAP_BITS)
    parts = []
    for wave in range(1 << (bits - wave_bits)):
        low_block, n_blocks = wave << (wave_bits - BLOCK_BITS), 1 << (wave_bits - BLOCK_BITS)
        bitmap = np.zeros((n_blocks, 1 << (BLOCK_BITS - 3)), np.uint8)
        for block, own in hot.where((F.col("block") >= low_block) & (F.col("block") < low_block + n_blocks)).toLocalIterator():
            bitmap[block - low_block] = np.frombuffer(own, np.uint8)
        parts.append(C.stored(_named(docs, spark.sparkContext.broadcast(bitmap.ravel()), bits, wave_bits, wave)))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    words = found.where("block < 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return found.where("block >= 0").select("lang", F.explode(F.split(F.col("phrases").cast("string"), "\n")).alias("phrase")), words


def _named(docs: DataFrame, shared, bits: int, wave_bits: int, wave: int) -> DataFrame:
    """(lang, block, phrases, n): the distinct phrases in the bitmap's cells, by block of cells and parted by line feeds; with the first wave, block -1 has the number n of a language's words."""

    def run(batches):
        import pyarrow as pa

        def emptied():
            keys = list(named)
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in keys], pa.string()), pa.array([block for _, block in keys], pa.int64()), pa.array([b"\n".join(named[k]) for k in keys], pa.binary()), pa.nulls(len(keys), pa.int64())], names=["lang", "block", "phrases", "n"])
            named.clear()

        bitmap, seen, named, words, held = shared.value, np.zeros(0, np.uint64), {}, {}, 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            salts = _salts(langs)
            for low, begins, rows in _passes(batch.column(1)):
                grams = Grams(low, begins, salts[rows])
                for row, n in zip(rows.tolist(), np.bincount(grams.doc, minlength=len(rows)).tolist()):
                    words[langs[row]] = words.get(langs[row], 0) + n
                for k, (h, at) in enumerate(zip(grams.hashes, grams.at), 1):
                    cell = h >> np.uint64(64 - bits)
                    own = (cell >> np.uint64(wave_bits)) == wave
                    cell = (cell & np.uint64((1 << wave_bits) - 1)).astype(np.int64)
                    hit = np.flatnonzero(own & (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool))
                    new, first = np.unique(h[hit], return_index=True)
                    place = np.searchsorted(seen, new)
                    fresh = seen[np.minimum(place, len(seen) - 1)] != new if len(seen) else np.ones(len(new), bool)
                    for i, block in zip(at[hit[first[fresh]]].tolist(), (cell[hit[first[fresh]]] >> BLOCK_BITS).tolist()):
                        named.setdefault((langs[rows[grams.doc[i]]], block), []).append(grams.text(k, i))
                    held += int(fresh.sum())
                    seen = np.insert(seen, place[fresh], new[fresh]) if len(seen) < HELD else new
                if held > HELD // 4:
                    held = 0
                    yield from emptied()
        yield from emptied()
        if wave == 0:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array([-1] * len(words), pa.int64()), pa.nulls(len(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "block", "phrases", "n"])

    def joined(key, frame):
        import pandas as pd

        if key[1] < 0:
            return pd.DataFrame({"lang": [key[0]], "block": [-1], "phrases": [None], "n": [int(frame["n"].sum())]})
        found = sorted({p for own in frame["phrases"] for p in own.split(b"\n")})
        return pd.DataFrame({"lang": [key[0]], "block": [key[1]], "phrases": [b"\n".join(found)], "n": [0]})

    return _read(docs).mapInArrow(C.frugal(run), "lang string, block long, phrases binary, n long").groupBy("lang", "block").applyInPandas(joined, "lang string, block long, phrases binary, n long")


#: Signs of the ends of pieces and of words that no phrase of the automaton has.
_END, _OTHER = "\n", "\x01"
#: The automaton of a Python worker, kept from task to task of one scan.
_BUILT: dict = {}


def _sign(k: int) -> str:
    """Three signs of the k-th word, of a hundred each, from alphabets of their own, so that no match begins inside a word."""
    return chr(0x100 + k // 10_000) + chr(0x200 + k // 100 % 100) + chr(0x300 + k % 100)


def compiled(phrases: list) -> tuple[dict, object]:
    """The signs of each word, and the automaton of the phrases (bytes), whose values are their places.

    An automaton looks through a node's branches one by one, in the order in which they were added: a hundred of them at most, and common words first.
    """
    import ahocorasick

    signs = {w: _sign(k) for k, (w, _) in enumerate(Counter(w for p in phrases for w in p.split(b" ")).most_common())}
    keys = ["".join([signs[w] for w in p.split(b" ")]) for p in phrases]
    built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k in sorted(range(len(keys)), key=keys.__getitem__):
        built.add_word(keys[k], k)
    built.make_automaton()
    return signs | {b"": "", b"\n": _END}, built


def spelt(text: bytes, signs: dict) -> str:
    """The text's words as signs, with delimiters."""
    known = signs.get
    return "".join([known(w, _OTHER) for w in text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")])


def _scanned(docs: DataFrame, phrases: list, least: int) -> DataFrame:
    """(lang, phrase, a): the phrases (bytes, of one shard) that all texts of a language together hold `least` times or more."""
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        import pyarrow as pa

        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = compiled(shared.value)
        signs, automaton = _BUILT[key]
        totals: dict = {}
        second = itemgetter(1)

        def emptied():
            for lang, total in totals.items():
                blocks = [k for k in range(0, len(total), COUNT_BLOCK) if total[k : k + COUNT_BLOCK].any()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blocks), pa.string()), pa.array(blocks, pa.int64()), pa.array([total[k : k + COUNT_BLOCK].tobytes() for k in blocks], pa.binary())], names=["lang", "block", "counts"])
            totals.clear()

        def scan(lang, texts):
            if lang not in totals:
                totals[lang] = np.zeros(len(automaton), np.int64)
            np.add.at(totals[lang], np.fromiter(map(second, automaton.iter(spelt(b"\n".join(texts), signs))), np.int64), 1)

        for batch in batches:
            by: dict = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                texts = by.setdefault(lang, [0])
                texts[0] += len(text)
                texts.append(text)
                if texts[0] > C.PASS_BYTES:
                    scan(lang, by.pop(lang)[1:])
            for lang, texts in by.items():
                scan(lang, texts[1:])
                if len(totals) > 8:
                    yield from emptied()
        yield from emptied()

    def summed(key, frame):
        import pandas as pd

        total = sum(np.frombuffer(x, np.int64) for x in frame["counts"])
        kept = np.flatnonzero(total >= least)
        return pd.DataFrame({"lang": key[0], "phrase": np.array([shared.value[key[1] + k].decode() for k in kept.tolist()], object), "a": total[kept]})

    read = _read(docs).select("lang", F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(C.frugal(run), "lang string, block long, counts binary").groupBy("lang", "block").applyInPandas(summed, "lang string, phrase string, a long")


def _bounded(phrases: list):
    """The phrases in lists of at most SHARD_WORDS distinct words."""
    if len(phrases) > 1 and len({w for p in phrases for w in p.split(b" ")}) > SHARD_WORDS:
        half = len(phrases) // 2
        yield from _bounded(phrases[:half])
        yield from _bounded(phrases[half:])
    elif phrases:
        yield phrases


def counted(docs: DataFrame, names: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, a): all phrases of names with their exact occurrences, where these are `least` or more."""
    size = names.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    shards = 1 + size // SHARD_BYTES
    dealt = C.stored(names.select("phrase").distinct().withColumn("shard", F.pmod(F.xxhash64(F.substring_index("phrase", " ", 1)), F.lit(shards))))
    parts = []
    for shard, own in sorted(dealt.groupBy("shard").agg(F.sum(F.octet_length("phrase") + 2)).collect()):
        pieces = 1 + own * 2 // (3 * SHARD_BYTES)  # a frequent first word's phrases part further
        for piece in range(pieces):
            rows = dealt.where((F.col("shard") == shard) & (F.pmod(F.xxhash64("phrase"), F.lit(pieces)) == piece)).select(F.col("phrase").cast("binary"))
            for phrases in _bounded(sorted(bytes(r[0]) for r in rows.toLocalIterator())):
                parts.append(C.stored(_scanned(docs, phrases, least)))
    if not parts:
        return names.select("lang", "phrase", F.lit(0).alias("words"), F.lit(0).cast("long").alias("a")).where(F.lit(False))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to five words that no longer one holds everywhere.

    a, l and r are the occurrences of the phrase and of the parts of its worst cut, n the language's words; score is
    floor(1000 a n / (l r)). Null languages are `und`, null and empty texts have no words; rows that are repeated count each
    time; ties go to the more frequent phrase and then to the smaller by bytes. An empty table gives no rows; other columns
    are not read. Two phrases of one 64-bit hash in one task could hide a candidate (odds below 1e-6 for a million candidates).
    """
    names, words = candidates(docs, least)
    found = C.stored(counted(docs, C.stored(names), least))
    known = found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    long = found.where("words >= 2")
    # a longer phrase holds a shorter one everywhere only if one that is longer by a word does
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substr(phrase, length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase")
    held = found.where("words >= 3").select("lang", "a", inner).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    own = long.join(held, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a")
    cuts = own.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, words - 1), k -> substring_index(phrase, ' ', k))")).alias("k", "head"))
    cuts = cuts.withColumn("tail", F.expr("substr(phrase, length(head) + 2)"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = C.looked_up(C.stored(cuts.select("lang", "phrase", "a", "k", "l", "r")), words, ["lang"])
    # products of up to 37 digits
    score = F.expr("cast((cast(a as decimal(18,0)) * cast(n as decimal(16,0)) * 1000) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    rows = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
