"""Scans: tables of a data folder, mounted folders behind a manifest, HTML links and titles, and a streaming file source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import spaced


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An immutable Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The enabled mounts of a JSON manifest (id, label, domain, path, read_only); repeated ids are refused."""
    mounts = spark.read.json(path, multiLine=True).select(F.explode("mounts").alias("m")).select("m.*")
    if mounts.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("the manifest repeats a mount id")
    return mounts.where(F.coalesce("enabled", F.lit(True)))


def federated(parts: dict[str, DataFrame], key: str, separator: str = "::") -> DataFrame:
    """The union of the mounts' rows, each with its mount_id, its own key as local_id and a namespaced id."""
    named = [df.withColumn("mount_id", F.lit(m)).withColumn("local_id", F.col(key).cast("string")).withColumn("id", F.concat_ws(separator, F.lit(m), F.col(key).cast("string"))) for m, df in sorted(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


#: An anchor element with an href in any quoting and case, up to its end tag.
_ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)[^>]*>.*?</a\s*>"""
_HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def _plain(html) -> F.Column:
    """Markup's text: tags dropped, character references decoded, white space single."""
    return spaced(F.regexp_replace(html, "<[^>]*>", ""))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, href, text) of each anchor of a page, in order; unclosed anchors don't count."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))).alias("place", "tag"))
    href = F.regexp_replace(F.regexp_extract("tag", _HREF, 1), r"""^["']|["']$""", "")
    return found.select(key, F.col("place").cast("long").alias("place"), _plain(href).alias("href"), _plain(F.regexp_replace("tag", "^<[^>]*>", "")).alias("text"))


def titles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Each page's og:title, else its title; empty if there is none."""
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']og:title["'][^>]*>""", 0)
    og = F.regexp_extract(meta, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*')""", 1)
    named = _plain(F.regexp_replace(og, r"""^["']|["']$""", ""))
    return pages.select(key, F.coalesce(F.nullif(named, F.lit("")), _plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1))).alias("title"))


def url_parts(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Scheme, host, path and last path step of each url; the query and the fragment go."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    path = F.regexp_extract(plain, r"^[a-z]+://[^/]+(/.*)?$", 1)
    return pages.select(key, F.regexp_extract(plain, r"^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(plain, r"^[a-z]+://([^/]+)", 1).alias("host"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("base"))


def json_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of JSON lines or of a folder of JSON files; blank lines and malformed records are dropped."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte order mark is skipped and bad bytes are replaced."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(path, role, sha256, size) of the files below a folder, sorted by path; the role is the first folder below the root.

    Unreadable files are skipped. Contents are read on the executors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(root)
    below = F.regexp_extract("path", "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/(.*)$", 1)
    role = F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).otherwise("")
    return files.select(below.alias("path"), role.alias("role"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).orderBy("path")


def latest_by(log: DataFrame, key: str, order: str, status: str, statuses: list[str]) -> DataFrame:
    """The last row of each key, if its status is one of those asked for (the last one is taken first)."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last"))
    return last.select(key, *[f"last.{c}" for c in rest]).where(F.col(status).isin(*statuses))


def surfaces(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(owner, id, path, text) of the non-blank texts of several (owner, table, key, column)."""
    made = [df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").select(F.lit(owner).alias("owner"), F.col(key).cast("string").alias("id"), F.lit(column).alias("path"), F.col(column).alias("text")) for owner, df, key, column in parts if column in df.columns]
    return reduce(lambda a, b: a.unionByName(b), made)
