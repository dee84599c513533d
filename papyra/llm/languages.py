"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary and, as any text must have a segmentation, for
each single byte. A forward algorithm sums the probabilities of all ways to cut a word into pieces; a text's score is the
product over its words. The probabilities are learnt by expectation maximisation over the counted words of each language:
the forward and the backward sums of a word give the expected count of each piece.

A word is a run of letters in lower case behind a word mark. Other than letters, ASCII only parts words; all of UTF-8's
other bytes count as letters. Words over WORD_BYTES are cut there, so the sums stay within a double's range.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .divergence import words_of

#: Bytes of the longest piece (a piece is then one 64-bit number) and of the longest word.
PIECE_BYTES, WORD_BYTES = 8, 48
#: Rounds of expectation maximisation, and the pseudo-count of each piece.
ROUNDS, SMOOTH = 3, 0.1
#: Factor of each byte's probability, which keeps sums over WORD_BYTES bytes within 1e-290 and 1e200.
SCALE = 300.0
#: Distinct words that a task holds before it hands them on or forgets them.
HELD = 300_000
#: Numbers of one array of partial sums.
CELLS = 4_000_000

_MASK = C._MASK


def vocabulary(pieces) -> list[bytes]:
    """The single bytes and the given pieces of 2 to PIECE_BYTES bytes, in lower case, whose word mark (a blank) is at their start or absent."""
    plain = {p.replace("▁", " ").lower() for p in pieces}
    kept = {p.encode() for p in plain if " " not in p[1:] and p.strip() and all(c.isalpha() for c in p.lstrip(" "))}
    return [bytes([b]) for b in range(256)] + sorted(p for p in kept if 2 <= len(p) <= PIECE_BYTES)


class Lattice:
    """All pieces in given words: at[k][i] is the piece of k + 1 bytes at byte i of each word, or the number of pieces where there is none."""

    def __init__(self, words: list, vocabulary: list):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.width = int(self.lengths.max(initial=0))
        flat = np.frombuffer(b"".join(words), np.uint8)
        grid = np.zeros((len(words), self.width + PIECE_BYTES), np.uint8)
        inside = np.zeros(grid.shape, bool)
        inside[:, : self.width] = np.arange(self.width) < self.lengths[:, None]
        grid[inside] = flat
        self.at = []
        for k in range(1, PIECE_BYTES + 1):
            own = np.array([int.from_bytes(p, "little") for p in vocabulary if len(p) == k], np.uint64)
            ids = np.array([i for i, p in enumerate(vocabulary) if len(p) == k], np.int64)
            found = np.full((self.width, len(words)), len(vocabulary), np.int32)
            order = np.argsort(own)
            own, ids = own[order], ids[order]
            if len(own):
                for i in range(self.width):
                    live = np.flatnonzero(self.lengths >= i + k)
                    if len(live):
                        value = np.ascontiguousarray(grid[live, i : i + 8]).view("<u8")[:, 0] & _MASK[k]
                        place = np.minimum(np.searchsorted(own, value), len(own) - 1)
                        found[i, live] = np.where(own[place] == value, ids[place], len(vocabulary))
            self.at.append(found)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """sums[i, w, language]: of all segmentations of the first i bytes of a word. p: (pieces + 1, languages), scaled, 0 in the last row."""
        sums = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        sums[0] = 1
        for i in range(1, self.width + 1):
            for k in range(1, min(i, PIECE_BYTES) + 1):
                sums[i] += sums[i - k] * p[self.at[k - 1][i - k]]
        return sums

    def backward(self, p: np.ndarray) -> np.ndarray:
        """sums[i, w]: of all segmentations of a word from its byte i on, for one language. p: (pieces + 1,)."""
        sums = np.zeros((self.width + 1, len(self.lengths)))
        for i in range(self.width, -1, -1):
            sums[i, self.lengths == i] = 1
            for k in range(1, min(self.width - i, PIECE_BYTES) + 1):
                sums[i] += sums[i + k] * p[self.at[k - 1][i]]
        return sums


def scaled(p: np.ndarray, vocabulary: list) -> np.ndarray:
    """The probabilities times SCALE for each byte of a piece, and a last row of zeros for no piece."""
    factor = SCALE ** np.array([len(x) for x in vocabulary], float)
    return np.concatenate((p * factor[:, None], np.zeros((1, p.shape[1]))))


def log_sums(words: list, vocabulary: list, p: np.ndarray) -> np.ndarray:
    """(words, languages): logarithm of the summed probability of each word's segmentations; p as scaled() gives it."""
    out = np.empty((len(words), p.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    step = max(1, CELLS // ((WORD_BYTES + 1) * p.shape[1]))
    for i in range(0, len(order), step):
        some = order[i : i + step]
        lattice = Lattice([words[k] for k in some], vocabulary)
        out[some] = np.log(lattice.forward(p)[lattice.lengths, np.arange(len(some))]) - lattice.lengths[:, None] * np.log(SCALE)
    return out


def expected(words: list, counts: np.ndarray, vocabulary: list, p: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in one language's counted words, under its probabilities p (scaled, one column)."""
    total = np.zeros(len(vocabulary) + 1)
    order = np.argsort([len(w) for w in words], kind="stable")
    step = max(1, CELLS // (WORD_BYTES + 1) // 4)
    for i in range(0, len(order), step):
        some = order[i : i + step]
        lattice = Lattice([words[k] for k in some], vocabulary)
        before, after = lattice.forward(p)[:, :, 0], lattice.backward(p[:, 0])
        weight = counts[some] / after[0]
        for k in range(1, min(PIECE_BYTES, lattice.width) + 1):
            for at in range(lattice.width - k + 1):
                ids = lattice.at[k - 1][at]
                total += np.bincount(ids, before[at] * p[ids, 0] * after[at + k] * weight, len(total))
    return total[:-1]


def marked_words(text: str):
    """Lists of a text's words as bytes, in order, each with its mark; words of over WORD_BYTES in parts."""
    for words in words_of(text.lower().encode()):
        words = [b" " + w for w in words]
        if max(map(len, words), default=0) > WORD_BYTES:
            words = [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
        yield words


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words of each language's texts, as bytes. Null languages and texts are left out."""

    def run(batches):
        import pyarrow as pa

        def emptied():
            for lang, found in held.items():
                words, counts = list(found), list(found.values())
                for i in range(0, len(words), 50_000):
                    some = words[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(counts[i : i + 50_000], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        held: dict = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = held.setdefault(lang, Counter())
                for words in marked_words(text):
                    own.update(words)
                    if len(own) > HELD:
                        yield from emptied()
                        own = held.setdefault(lang, Counter())
        yield from emptied()

    read = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    return read.mapInArrow(C.frugal(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learned(words: DataFrame, vocabulary: list, rounds: int = ROUNDS) -> tuple[list, np.ndarray]:
    """The languages in order and the probability of each piece in each of them; words: (lang, word, n), stored.

    The model is a number for each piece and language: a fixed vocabulary times the number of languages.
    """
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    p = np.full((len(vocabulary), len(langs)), 1 / len(vocabulary))
    column = {lang: k for k, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        shared = words.sparkSession.sparkContext.broadcast(p)

        def run(batches, shared=shared):
            import pyarrow as pa

            p = scaled(shared.value, vocabulary)
            totals: dict = {}
            for batch in batches:
                lang = np.array([column[x] for x in batch.column(0).to_pylist()])
                word, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k in np.unique(lang).tolist():
                    own = np.flatnonzero(lang == k)
                    totals[k] = totals.get(k, 0) + expected([word[i] for i in own], n[own].astype(float), vocabulary, p[:, [k]])
            for k, total in totals.items():
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k, np.int32)), pa.array(hit.astype(np.int32)), pa.array(np.round(total[hit] * 1e6).astype(np.int64))], names=["lang", "piece", "n"])

        # in millionths, so that the sums don't depend on the order of tasks
        counts = words.mapInArrow(C.frugal(run), "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
        total = np.full(p.shape, SMOOTH)
        for k, piece, n in counts.toLocalIterator():
            total[piece, k] += float(n) / 1e6
        p = total / total.sum(0)
    return langs, p


def identified(docs: DataFrame, langs: list, p: np.ndarray, vocabulary: list, text: str = "text", names=("lang_pred", "score")) -> DataFrame:
    """docs with the likeliest language of each text and its probability among the learnt ones, all being as likely beforehand.

    Null texts, texts without a letter and, if nothing was learnt, all texts are `und` with score 0; ties go to the first language.
    """
    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        import pyarrow as pa

        p = scaled(shared.value, vocabulary)

        class Places(dict):
            def __missing__(self, word):
                self[word] = at = len(self)
                return at

        places, logs = Places(), np.zeros((0, len(langs)))
        for batch in batches:
            texts = batch.column(place).to_pylist()
            predicted, score = ["und"] * len(texts), np.zeros(len(texts))
            todo = [k for k, t in enumerate(texts) if langs and t and has_letter(t)]
            at = 0
            while at < len(todo):
                if len(places) > HELD:
                    places, logs = Places(), np.zeros((0, len(langs)))
                begin, size, found = at, 0, []
                while at < len(todo) and size < C.PASS_BYTES:
                    found.append(np.concatenate([np.fromiter(map(places.__getitem__, words), np.int64, len(words)) for words in marked_words(texts[todo[at]])]))
                    size += len(texts[todo[at]])
                    at += 1
                if len(places) > len(logs):
                    logs = np.concatenate((logs, log_sums(list(places)[len(logs) :], vocabulary, p)))
                for k, own in zip(todo[begin:at], found):
                    total = sum(logs[own[i : i + CELLS // 8]].sum(0) for i in range(0, len(own), CELLS // 8))
                    best = int(np.argmax(total))
                    predicted[k], score[k] = langs[best], 1 / np.exp(total - total[best]).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(score)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(C.frugal(run), C.extended(docs.schema, f"{names[0]} string, {names[1]} double"))


def held_out(key) -> F.Column:
    """Whether an id is out of learning: crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def pieces_of(path: str) -> list:
    """The normal pieces of a public SentencePiece vocabulary."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return [own.id_to_piece(k) for k in range(own.get_piece_size()) if not (own.is_control(k) or own.is_unknown(k) or own.is_byte(k))]


def languages(docs: DataFrame, pieces) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score; learnt from the rows that aren't held out and have a language.

    Null texts and texts without letters are `und`, of score 0, as are all if no row can be learnt from. Rows of equal text
    fare alike, also under one id; words count as often as they occur, whatever their case. Other columns are not read.
    """
    known = vocabulary(pieces)
    words = C.stored(word_counts(docs.where(~held_out(F.col("doc_id"))).select("lang", "text")))
    langs, p = learned(words, known)
    out = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), langs, p, known)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
