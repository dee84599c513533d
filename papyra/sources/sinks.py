"""Sinks: report files, append logs, partitioned splits, and exports that are checked before they replace what is there."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV folder with a header and just these columns in this order; missing ones are empty, others left out."""
    have = set(rows.columns)
    rows.select(*[F.col(f"`{c}`") if c in have else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def append_json(rows: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def json_report(report: DataFrame, path: str) -> None:
    """The one row of a report as a JSON file on the driver, written whole or not at all."""
    found = report.limit(2).toJSON().collect()
    if len(found) != 1:
        raise ValueError("a report is one row")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as out:
        json.dump(json.loads(found[0]), out, ensure_ascii=False, indent=2)
    os.replace(part, path)


def split(rows: DataFrame, path: str, column: str) -> DataFrame:
    """Rows written by the column's values, one folder each; the manifest (column, rows) as read back."""
    rows.write.mode("overwrite").partitionBy(column).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(column).agg(F.count("*").alias("rows"))


def checksum(rows: DataFrame) -> tuple[int, int]:
    """Rows and a sum of row hashes, whatever their order."""
    got = rows.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("decimal(38,0)"))).first()
    return int(got[0]), int(got[1] or 0)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def export(rows: DataFrame, path: str) -> tuple[int, int]:
    """Rows written to a new folder and read back; an error, and no folder, if they differ."""
    spark, want = rows.sparkSession, checksum(rows)
    rows.write.mode("errorifexists").parquet(path)
    if checksum(spark.read.parquet(path)) != want:
        fs, at = _files(spark, path)
        fs.delete(at, True)
        raise ValueError("the export differs from its source")
    return want


def replaced(rows: DataFrame, path: str, valid) -> str | None:
    """Rows take the place of the table at path if valid(table) holds before and after; returns where the former one is kept, None if there was none.

    A new table is written and checked beside the old one, folders are renamed, and the old one comes back if the new one fails there.
    """
    spark = rows.sparkSession
    fresh, backup = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    fs, at = _files(spark, path)
    _, new = _files(spark, fresh)
    _, old = _files(spark, backup)
    if not valid(spark.read.parquet(fresh)):
        fs.delete(new, True)
        raise ValueError("the new table is not valid")
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot move {path}")
    fs.rename(new, at)
    if not valid(spark.read.parquet(path)):
        fs.delete(at, True)
        if had:
            fs.rename(old, at)
        raise ValueError("the new table is not valid in its place")
    return backup if had else None


def replaced_all(tables: dict[str, DataFrame], valid) -> None:
    """Several tables replaced, or none: all are written and checked before the first one is moved, and moved ones go back if a later one fails."""
    spark = next(iter(tables.values())).sparkSession
    for path, rows in tables.items():
        if not valid(rows):
            raise ValueError(f"{path}: not valid")
    done: list[tuple[str, str | None]] = []
    try:
        for path, rows in tables.items():
            done.append((path, replaced(rows, path, valid)))
    except Exception:
        for path, backup in reversed(done):
            fs, at = _files(spark, path)
            fs.delete(at, True)
            if backup:
                fs.rename(_files(spark, backup)[1], at)
        raise
