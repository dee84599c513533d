"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, digest, divergence, html, languages, licences, minhash, mixing, packing, phrases, pii, secrets, toxicity
from .common import table


def rank_file() -> str:
    """The byte-level BPE ranks of byte_bpe_50k.json; PAPYRA_BPE names another file."""
    import public_tokenizers

    return os.environ.get("PAPYRA_BPE") or public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_file() -> str:
    """The pieces of piece_bpe_32k.model; PAPYRA_PIECES names another file."""
    import public_tokenizers

    return os.environ.get("PAPYRA_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the session's secret; without one, a key for test tables only, as it can be read here
    key = spark.conf.get("spark.papyra.pii.key", None) or "no secret: test tables only"
    return pii.pii(table(spark, sf_dir, "documents"), key)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=80, width=2)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), rank_file())


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compared(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_digests(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(table(spark, sf_dir, "documents"), languages.pieces_of(piece_file()))


def queries() -> dict:
    import corpus_pipeline

    own = (op1_mix, op2_pii, op3_minhash, op4_licences, op5_toxicity, op6_packing, op7_fingerprints, op8_secrets, op9_html, op10_audio, op11_divergence, op12_collocations, op13_languages)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
weights AS (SELECT doc_id, CASE WHEN max(quality) = 0 THEN 0.5 ELSE 1.0 END AS weight FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
keyed AS (
  SELECT s.*, 1 - pow((CAST('0x' || substr(md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || ':7'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0, 1 / coalesce(CAST(w.weight AS DOUBLE), 1.0)) AS k
  FROM sized s LEFT JOIN weights w ON s.doc_id = w.doc_id),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST(CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM sized GROUP BY source),
capped AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, 2 * source_size / w AS full_at FROM per),
levels AS (
  SELECT *, row_number() OVER o AS n,
    ((SELECT sum(source_size) FROM per) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY full_at, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped WINDOW o AS (ORDER BY full_at, source IS NULL, encode(source))),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels WHERE level <= full_at ORDER BY n LIMIT 1) * w, cap)) AS target FROM levels),
budgets AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS copies FROM targets),
ordered AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.copies,
    CAST(round(b.target) AS BIGINT) - b.copies * b.source_size
      - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM keyed d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(least(size, room), 0) AS BIGINT) AS taken FROM ordered
"""

MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least_ AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.low, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(l.low, s.doc_id) AS kept
FROM sets s LEFT JOIN least_ l ON s.doc_id = l.doc_id
"""

DIVERGENCE_SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM read),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM read),
langs AS (SELECT g.lang, CAST(count(k.term) AS HUGEINT) AS v, CAST(coalesce(sum(k.total), 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
counts AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM groups g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
    1 + (1000000000 * (k.total + 5)) // (l.n + 5 * l.v) AS q
  FROM sizes s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 100),
inner_ AS (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM candidates),
held AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM inner_) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.a, unnest(range(1, c.k)) AS j, c.w, c.k
  FROM candidates c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.most IS NULL OR 100 * h.most < 100 * c.a),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, n.n, (1000 * c.a * n.n) // (x.a * y.a) AS score
  FROM cuts c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1 : c.k], ' ')),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": MIX_SQL, "op3_minhash": MINHASH_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_collocations": COLLOCATIONS_SQL}
