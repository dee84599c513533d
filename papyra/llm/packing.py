"""Lexical retrieval packing: documents that share terms fill a training window together.

Documents are tokenised once into a stored table. They are dealt into shards of about equal tokens by content: a document's keys are the first of its
token ids in two fixed random orders that favour rare ids (weighted MinHash), documents of equal or neighbouring keys share a shard. Each shard
builds a BM25 inverted index over token ids with corpus-wide document frequencies (one number per vocabulary entry, whatever
the input). A seed, queried by all its terms, document opens a window; its best unused neighbours fill it; the one that is cut goes on
in the next window and is its seed. All windows but a shard's last are full; the last tokens are laid out in sequences of powers of two,
so that nothing is padded.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 2048
#: Tokens of a shard, about: what one task indexes. A row counts as so many tokens more.
SHARD_TOKENS, ROW_TOKENS = 1 << 20, 256
#: Shards of a partition, at most about: they are packed one after another.
SHARDS_A_PART = 64
#: Bins that documents are dealt to at most, beyond one a vocabulary entry: a bound of what is collected and broadcast (twelve bytes a bin).
MOST_BINS = 1 << 22
#: BM25's constants.
K1, B = 1.2, 0.75
END = 1
#: White space in a row that the tokenizer's pattern may recurse on too deeply; longer runs are cut where the pattern cuts them.
LONG_RUN = 100_000


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids as uint16 bytes, for a byte-level BPE rank file; a worker's tasks share it.

    Strings of special tokens in a text are ordinary text.
    """
    import array
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("papyra", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids must fit 16 bits")

    piece = tiktoken.Encoding("papyra-piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    run = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_RUN)

    def encode(text: str) -> bytes:
        parts, at = [], 0
        for found in run.finditer(text) if len(text) >= LONG_RUN else ():
            # a run is one piece, but for its last character where a word follows
            end = found.end() - (found.end() < len(text))
            parts += coder.encode_ordinary(text[at : found.start()]) + piece.encode_ordinary(text[found.start() : end])
            at = end
        return array.array("H", parts + coder.encode_ordinary(text[at:])).tobytes()

    return encode


def tokenized(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, place): ids as little-endian 16-bit numbers with END behind; a null text is empty."""

    def run(batches):
        import pyarrow as pa

        encode, end = encoder(path), np.array([END], "<u2").tobytes()
        place = 0
        for batch in batches:
            made = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 2 for x in made], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(n), pa.array(np.arange(place, place + len(n)))], names=["doc_id", "ids", "n_tokens", "place"])
            place += len(n)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(C.frugal(run), "doc_id long, ids binary, n_tokens long, place long")


def frequencies(ids: DataFrame) -> DataFrame:
    """(token, df): in how many documents each id occurs; partial sums are made on the executors."""

    def run(batches):
        import pyarrow as pa

        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(x, "<u2"))] += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["token", "df"])

    return ids.select("ids").mapInArrow(C.frugal(run), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Shard:
    """An inverted index of a shard's documents with BM25 impacts."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, tfs, owners = [], [], []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t.astype(np.int64))
            tfs.append(c)
            owners.append(np.full(len(t), i, np.int32))
        sizes = np.array([len(d) for d in docs], float)
        term, tf, owner = np.concatenate(terms), np.concatenate(tfs), np.concatenate(owners)
        impact = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / mean))).astype(np.float32)
        self.first = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
        self.term = term
        by_term = np.argsort(term, kind="stable")
        self.owner, self.held = owner[by_term], impact[by_term]
        self.bounds = np.searchsorted(term[by_term], np.arange((1 << 16) + 1))
        self.n = len(docs)
        # terms of an eighth of the documents or more: a row of a matrix each, at most eight numbers a posting
        common = np.flatnonzero(np.diff(self.bounds) * 8 >= self.n) if self.n >= 64 else np.zeros(0, int)
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        at = self.row[term]
        self.rows[at[at >= 0], owner[at >= 0]] = impact[at >= 0]

    def scores(self, seed: int) -> np.ndarray:
        term = self.term[self.first[seed] : self.first[seed + 1]]
        at = self.row[term]
        rare = term[at < 0]
        low, n = self.bounds[rare], self.bounds[rare + 1] - self.bounds[rare]
        posting = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[posting], self.held[posting], self.n) + np.add.reduce(self.rows[at[at >= 0]], axis=0)


class Deal:
    """Which shard a document goes to, by content; a few numbers per vocabulary entry and bin, whatever the input.

    Shards are runs of bins in key order. A bin is a first key; one too full for a shard is cut by the second key, and what that leaves too full
    (large groups of copies, and at most MOST_BINS bins of many shards each) by a hash.
    """

    def __init__(self, idf: np.ndarray):
        late = -np.log(1 - np.random.default_rng(7).random((2, 1 << 16))) / np.maximum(idf, 1e-9) ** 2
        self.ranks = np.argsort(np.argsort(late, axis=1), axis=1).astype(np.uint16)

    def keys(self, ids: list[np.ndarray]) -> np.ndarray:
        """Two rows of keys; no document is without an id."""
        first = np.cumsum([0] + [len(x) for x in ids[:-1]])
        return np.minimum.reduceat(self.ranks[:, np.concatenate(ids)], first, axis=1)

    def cut(self, load: np.ndarray) -> None:
        """Bins, from the tokens under each key (two rows)."""
        parts = -(-load[0] // SHARD_TOKENS) * 4.0 * (load[0] > SHARD_TOKENS)
        self.parts = np.maximum(1, parts * min(1, MOST_BINS / max(parts.sum(), 1))).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.parts)))
        self.share = (np.cumsum(load[1]) - load[1]) / max(load[1].sum(), 1)

    def bins(self, keys: np.ndarray) -> np.ndarray:
        return self.first[keys[0]] + (self.share[keys[1]] * self.parts[keys[0]]).astype(np.int64)

    def fill(self, load: np.ndarray) -> int:
        """Shards, from the tokens in each bin; their number."""
        self.at, self.ways = np.zeros(len(load), np.int64), np.maximum(1, -(-load // SHARD_TOKENS)).astype(np.int32)
        shard, held = 0, 0
        for i in np.flatnonzero(load).tolist():
            if held and held + load[i] > SHARD_TOKENS:
                shard, held = shard + 1, 0
            self.at[i], held = shard, held + load[i]
            if self.ways[i] > 1:
                shard, held = shard + int(self.ways[i]), 0
        return shard + int(held > 0)

    def shards(self, ids: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        b = self.bins(self.keys(ids))
        return self.at[b] + hashes % self.ways[b]


def dealt_by_content(ids: DataFrame, idf: np.ndarray) -> tuple[DataFrame, int]:
    """ids with a column shard, and the number of shards."""
    context, deal = ids.sparkSession.sparkContext, Deal(idf)
    keyed_by = context.broadcast(deal)

    def keys(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                k = keyed_by.value.keys([np.frombuffer(x, "<u2") for x in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(k[0].astype(np.int32)), pa.array(k[1].astype(np.int32)), batch.column(1)], names=["k0", "k1", "load"])

    keyed = C.stored(ids.select("ids", F.col("n_tokens") + ROW_TOKENS).mapInArrow(C.frugal(keys), "k0 int, k1 int, load long"))

    def summed(rows: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size, np.int64)
        found = rows.groupBy("bin").agg(F.sum("load").alias("load")).toArrow()  # a row a vocabulary entry or bin at most
        out[found["bin"].to_numpy()] = found["load"].to_numpy()
        return out

    deal.cut(np.stack([summed(keyed.select(F.col(k).cast("long").alias("bin"), "load"), 1 << 16) for k in ("k0", "k1")]))
    binned_by = context.broadcast(deal)

    def bins(batches):
        import pyarrow as pa

        load = np.zeros(binned_by.value.first[-1], np.int64)
        for batch in batches:
            k0, k1, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(load, binned_by.value.bins(np.stack([k0, k1])), n)
        seen = np.flatnonzero(load)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(load[seen])], names=["bin", "load"])

    shards = max(1, deal.fill(summed(keyed.mapInArrow(C.frugal(bins), "bin long, load long"), int(deal.first[-1]))))
    filled_by = context.broadcast(deal)

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                found = filled_by.value.shards([np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()], batch.column(4).to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found.astype(np.int32))], names=["doc_id", "ids", "n_tokens", "place", "shard"])

    hashed = ids.select("doc_id", "ids", "n_tokens", "place", F.xxhash64("doc_id", "n_tokens", "place").alias("hash"))
    return hashed.mapInArrow(C.frugal(dealt), "doc_id long, ids binary, n_tokens long, place long, shard int"), shards


def windows(docs: list[np.ndarray], idf: np.ndarray, mean: float):
    """Pieces (document, start, length, sequence, offset) of a shard."""
    index = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    upcoming, room, sequence = 0, WINDOW, 0
    left = sum(len(d) for d in docs)
    size = WINDOW
    score, seed = None, None
    while left:
        # the next document: the seed's best unused neighbour, else the first unused one
        doc = None
        if seed is not None:
            if score is None:
                score = np.where(unused, index.scores(seed), 0)
            best = int(score.argmax())
            if score[best] > 0:
                doc, score[best] = best, 0
        if doc is None:
            while not unused[upcoming]:
                upcoming += 1
            doc = upcoming
        unused[doc] = False
        if seed is None:
            seed, score = doc, None
        start, n = 0, len(docs[doc])
        while start < n:
            if room == size and left < WINDOW:  # the last tokens: powers of two
                size = room = 1 << (left.bit_length() - 1)
            length = min(room, n - start)
            yield doc, start, length, sequence, size - room
            start, room, left = start + length, room - length, left - length
            if not room:
                sequence, room, size = sequence + 1, WINDOW, WINDOW
                seed, score = (doc, None) if start < n else (None, None)


def packed(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids (little-endian 32-bit, binary), doc_tokens, sequence_id, offset.

    Every id of every document, and its END, is in exactly one piece; null and empty texts are their END alone. Rows of equal or null
    id, and repeated rows, are documents of their own; ties of a seed's neighbours go to the first of the shard in id order. Other columns are ignored. An empty table gives no pieces. `path` names a byte-level BPE rank file on every executor.
    """
    ids = C.stored(tokenized(docs, path, key, text))
    total = ids.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n, tokens = max(int(total[0]), 1), int(total[1])
    df = np.zeros(1 << 16)
    for r in frequencies(ids).collect():  # one row a vocabulary entry at most
        df[r.token] = r.df
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    mean = max(tokens / n, 1.0)
    dealt, shards = dealt_by_content(ids, idf)
    parts = max(-(-shards // SHARDS_A_PART), min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    share = -(-shards // parts)
    dealt = dealt.repartitionById(parts, F.floor(F.col("shard") / share).cast("int")).sortWithinPartitions("shard", "doc_id", "n_tokens", "place")

    def run(batches):
        """Packs shard after shard; the documents of one are held at a time."""
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())

        def packed_shard(shard, names, held):
            rows: list[tuple] = []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

            for doc, start, length, sequence, offset in windows(held, shared.value, mean):
                rows.append((names[doc], start, length, held[doc][start : start + length].astype("<u4").tobytes(), len(held[doc]), shard << 32 | sequence, offset))
                if len(rows) == 2000:
                    yield out()
                    rows = []
            if rows:
                yield out()

        names, held, now = [], [], None
        for batch in batches:
            shard = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and int(shard[a]) != now:
                    yield from packed_shard(now, names, held)
                    names, held = [], []
                now = int(shard[a])
                names += batch.column(0).slice(a, b - a).to_pylist()
                held += [np.frombuffer(x, "<u2") for x in batch.column(1).slice(a, b - a).to_pylist()]
        if held:
            yield from packed_shard(now, names, held)

    return dealt.mapInArrow(C.frugal(run), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """packed(), with each piece's CRC-32 in place of its ids."""
    return packed(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
