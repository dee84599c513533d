"""op11 to op13 against SQL on a small fixture, brute force, and held-out accuracy; odd inputs of each."""

import collections
import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyra.llm import common, divergence, languages, phrases, queries

DDL = "doc_id long, text string, lang string, source string, n_chars long, term string, n string, part string, phrase string, vec string, block string, word string"
CLASH = ("t", "n", "p", "ph", "v", "b", "w")


def fixture(n=400, seed=5):
    r = random.Random(seed)
    words = ["the", "The", "OF", "sea", "é", "Été", "x1y", "a_b", "ship", "deep", "zz", "of"]
    out = []
    for i in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", ", ", ".\n", "\t", "; "]) for _ in range(r.randrange(0, 30)))
        out.append((i, text, r.choice(["en", "fr", None, ""]), r.choice(["s0", "s0", "s1", "s2", None, "é"]), 0))
    odd = [(None, None, "en", "s9", 0), (7, "", "en", None, 0), (7, "sea of sea", "en", "s0", 0), (7, "sea of sea", "en", "s0", 0), (8, "12 34 !!", "xx", "only", 0), (8, None, "xx", "other", 0), (9, None, None, None, None), (10, "the sea, of " * 40_000, "en", "s1", 0)]
    return [(*row, *CLASH) for row in out + odd]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_sql(name):
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(fixture(), columns=[x.split()[0] for x in DDL.split(", ")]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    return connection.sql(queries.oracle_sql()[name]).df()


def rows(df, columns):
    return sorted(df[columns].itertuples(index=False, name=None))


# ---- op11 --------------------------------------------------------------------------------------------------------


def test_divergence_equals_sql_on_odd_rows(docs, monkeypatch):
    expected = by_sql("op11_divergence")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    assert rows(divergence.divergence(docs).toPandas(), columns) == rows(expected, columns)
    assert {"xx", ""} <= set(expected.lang) and (expected.part == "term").sum() > 20
    # small bounds: many hand-overs of counters, many parts of vectors, several tiles of sources
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PART_BYTES", 64)
    monkeypatch.setattr(divergence, "VECTORS", 2)
    monkeypatch.setattr(divergence, "SIDE", 2)
    assert rows(divergence.divergence(docs).toPandas(), columns) == rows(expected, columns)


def test_divergence_without_kept_terms_and_rows(spark, empty):
    assert divergence.divergence(empty).collect() == []
    few = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "c", "de", "s")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergence(few).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact_beyond_64_bits():
    n = np.array([5, 10**13 + 7, 2**52, 12_345_678_901_234])
    for size in (2**52, 2**53 - 1, 12_345_678_901_234 * 3):
        own = n[n <= size]
        assert divergence.shares(own, np.full(len(own), size)).tolist() == [1 + 10**9 * int(x) // size for x in own]


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 5)
    text = "Ab cdefghijk l ÉÉ\x00m_n"
    assert [w for ws in divergence.words_of(text.encode()) for w in ws] == [x.encode() for x in ("ab", "cdefghijk", "l", "ÉÉ", "m", "n")]


# ---- op12 --------------------------------------------------------------------------------------------------------


def test_collocations_equal_sql_on_odd_rows(docs):
    expected = by_sql("op12_collocations")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows(phrases.collocations(docs).toPandas(), columns) == rows(expected, columns)
    assert "en" in set(expected.lang) and len(expected) > 2


def plain_collocations(data, least, top):
    """By counting everything, candidate by candidate."""
    f, n = collections.Counter(), collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for row in data:
        lang = "und" if row[2] is None else row[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (row[1] or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(x[0] == lang and len(x[1]) > len(p) and 100 * b >= 100 * a and inside(p, x[1]) for x, b in candidates.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, own in found.items() for k, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


@pytest.mark.parametrize("least, top", [(3, 10_000), (20, 7), (300, 5)])
def test_collocations_equal_brute_force_over_waves_and_shards(spark, monkeypatch, least, top):
    data = [x for x in fixture(250, least) if len(x[1] or "") < 1000]
    # eight bitmaps, a dozen automata, tasks that hand on and forget what they hold
    monkeypatch.setattr(phrases, "CELL_BYTES", 1)
    monkeypatch.setattr(phrases, "BLOCK_BITS", 10)
    monkeypatch.setattr(phrases, "BITMAP_BITS", 11)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 500)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 9)
    monkeypatch.setattr(phrases, "COUNT_BLOCK", 2)
    monkeypatch.setattr(phrases, "HELD", 50)
    made = phrases.collocations(spark.createDataFrame(data, DDL).repartition(3), least, top).collect()
    assert sorted(map(tuple, made)) == plain_collocations(data, least, top)


def test_sketch_bounds_every_phrase(spark):
    data = fixture(200)
    df = spark.createDataFrame(data, DDL)
    names, words = phrases.candidates(df, 12)
    got = {(r.lang, r.phrase) for r in names.collect()}
    f = collections.Counter()
    for row in data:
        for line in re.split(r"[.,;:!?\x0a-\x0d]", (row[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))):
            w = re.findall(r"[^ \t]+", line)
            f.update((row[2] if row[2] is not None else "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert {x for x, a in f.items() if a >= 12} <= got
    assert sum(r.n for r in words.collect()) == sum(a for (_, p), a in f.items() if " " not in p)


def test_texts_are_spelt_in_words():
    signs, automaton = phrases.compiled([b"a", b"a b", b"b", "é a".encode()])
    assert phrases.spelt("A  b,x a\té a".encode(), signs) == "".join([signs[b"a"], signs[b"b"], "\n\x01", signs[b"a"], signs["é".encode()], signs[b"a"]])
    assert [v for _, v in automaton.iter(phrases.spelt(b"a b a", signs))] == [0, 1, 2, 0]
    assert len({phrases._sign(k) for k in range(phrases.SHARD_WORDS)}) == phrases.SHARD_WORDS and [ord(c) >> 8 for c in phrases._sign(999_999)] == [1, 2, 3]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "PASS_BYTES", 10)
    text = "one two three. four five, six seven eight nine ten eleven\ntwelve"
    parts = [low.tobytes() for low, _, _ in phrases._passes(pa.array(["a b", text, "c"]))]
    assert b"".join(parts) == ("a b" + text + "c").replace(".", "\n").replace(",", "\n").encode() and len(parts) > 3
    assert all(p.endswith(b"\n") or p in (b"a b", b"c", b"twelve") for p in parts)


def test_collocations_of_empty_tables_and_repeats(spark, empty):
    assert phrases.collocations(empty).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, "en"), (2, "...", "en")], "doc_id long, text string, lang string")).collect() == []
    once = spark.createDataFrame([(1, "a a a a", "en")] * 40, "doc_id long, text string, lang string")
    assert sorted((r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(once).collect()) == [("a a", 120, 160, 160, 160, 750)]


# ---- op13 --------------------------------------------------------------------------------------------------------


def all_segmentations(word, known):
    if not word:
        yield ()
    for k in range(1, min(len(word), languages.PIECE_BYTES) + 1):
        if word[:k] in known:
            for rest in all_segmentations(word[k:], known):
                yield (word[:k], *rest)


def test_sums_equal_all_segmentations():
    r = np.random.default_rng(1)
    known = languages.vocabulary(["▁a", "ab", "▁", "abc", "bc", "cab", "b▁c", "éa", "1x", "toolongpiece", "▁AB", "b", "▁abcabca", "a-b"])
    assert known[256:] == sorted([b" a", b" ab", b" abcabca", b"ab", b"abc", b"bc", b"cab", "éa".encode()])
    p = r.dirichlet(np.ones(len(known)), 3).T
    words = [b" abcab", b" a", b" cab", " éab".encode(), b"a", b" aaaaaaaaaa", b" abcabc"]
    place = {x: k for k, x in enumerate(known)}
    sums = lambda w, q: sum(np.prod([q[place[x]] for x in s]) for s in all_segmentations(w, place))
    expected = np.log([[sums(w, p[:, k]) for k in range(3)] for w in words])
    assert np.allclose(languages.log_sums(words, known, languages.scaled(p, known)), expected)
    counts, total = np.array([3.0, 1, 2, 5, 1, 2, 4]), np.zeros(len(known))
    for w, c in zip(words, counts):
        for s in all_segmentations(w, place):
            for x in s:
                total[place[x]] += c * np.prod([p[place[y], 1] for y in s]) / sums(w, p[:, 1])
    assert np.allclose(languages.expected(words, counts, known, languages.scaled(p[:, [1]], known)), total)


def test_sums_of_the_longest_words_stay_in_range():
    known = languages.vocabulary([])
    p = np.full((256, 2), 1e-7)
    p[97, 0] = 0.9
    got = languages.log_sums([b"a" * languages.WORD_BYTES, bytes([250]) * languages.WORD_BYTES], known, languages.scaled(p, known))
    assert np.allclose(got, languages.WORD_BYTES * np.log([[0.9, 1e-7], [1e-7, 1e-7]]))


def test_learning_raises_the_likelihood(spark):
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the ship of the deep sea", "en"), ("le bateau de la mer", "fr"), ("the the ships", "en")] * 5)], "doc_id long, text string, lang string")
    known = languages.vocabulary(languages.pieces_of(queries.piece_file()))
    words = common.stored(languages.word_counts(docs))
    own = [(r.lang, bytes(r.word), r.n) for r in words.collect()]
    assert sum(n for lang, _, n in own if lang == "en") == 45
    last = -np.inf
    for rounds in range(4):
        langs, p = languages.learned(words, known, rounds)
        assert langs == ["en", "fr"] and np.allclose(p.sum(0), 1)
        q = languages.scaled(p, known)
        total = sum(n * languages.log_sums([w], known, q)[0, langs.index(lang)] for lang, w, n in own)
        assert total > last
        last = total


def test_predictions_learn_from_text_alone_and_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = common.table(spark, sf, "documents")
    pieces = languages.pieces_of(queries.piece_file())
    made = languages.languages(docs, pieces).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(made) == docs.count() and made.score.between(0, 1).all()
    own = made[made.held_out]
    assert 0.25 < len(own) / len(made) < 0.42 and (own.lang_pred == own.lang).mean() > 0.98
    # other labels, sources and ids of held-out rows change nothing
    turned = docs.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    again = languages.languages(turned, pieces).toPandas()
    assert again.sort_values("doc_id").lang_pred.tolist() == made.sort_values("doc_id").lang_pred.tolist()


def test_languages_of_odd_rows(spark, docs, empty):
    pieces = languages.pieces_of(queries.piece_file())
    assert languages.languages(empty, pieces).collect() == []
    made = languages.languages(docs, pieces)
    assert made.count() == len(fixture())
    texts = [None, "", " 12 .,", "——", "né", "THE ship", "the SHIP", "日本語", "the " * 100_000, "x" * 100_000]
    rows = spark.createDataFrame([(3 * k, t, None) for k, t in enumerate(texts)] + [(k, t, lang) for k in range(200, 240) for t, lang in (("the ship", "en"), ("né près", "fr"))], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languages.languages(rows, pieces).where("doc_id < 100").collect()}
    assert [got[3 * k].lang_pred == "und" for k in range(len(texts))] == [True] * 4 + [False] * 6
    assert got[12].lang_pred == "fr" and got[15].lang_pred == "en" and got[15].score == got[18].score and all(0 <= r.score <= 1 for r in got.values())
    unlearnt = languages.languages(rows.withColumn("lang", F.lit(None).cast("string")), pieces)
    assert {(r.lang_pred, r.score) for r in unlearnt.collect()} == {("und", 0.0)}


def test_long_words_are_cut_whole(monkeypatch):
    word = "abcdefghij" * 30
    parts = list(itertools.chain(*languages.marked_words(f"x {word} 1 y")))
    assert b"".join(parts).decode() == f" x {word} y" and max(map(len, parts)) == languages.WORD_BYTES
