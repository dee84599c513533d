"""Batches of several tables that appear together or not at all, by a data source with task messages, commit and abort.

A folder holds parts and numbered manifests. A batch's tasks write parts under names of their own and report them; the commit lists the
reported parts, beside those of the tables that the batch doesn't touch, in the next manifest, which appears in one step. Readers
take the newest manifest alone, so what a failed or killed task has left is never seen, and `swept` removes it. A batch that is
committed already is not written again. Parts are JSON lines, and driver and executors must see the folder as files.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_MANIFESTS, _PARTS = "manifests", "parts"


def _local(folder: str) -> str:
    path = folder.removeprefix("file://")
    if "://" in path:
        raise ValueError("the folder of batches must be one of files that driver and executors share")
    return path


def _newest(folder: str) -> dict:
    """The newest manifest: version, batches (all committed ones) and tables (name: schema and parts)."""
    names = [n for n in os.listdir(f"{folder}/{_MANIFESTS}") if n.endswith(".json")] if os.path.isdir(f"{folder}/{_MANIFESTS}") else []
    if not names:
        return {"version": 0, "batches": [], "tables": {}}
    with open(f"{folder}/{_MANIFESTS}/{max(names)}", encoding="utf-8") as text:
        return json.load(text)


@dataclass
class Written(WriterCommitMessage):
    """The parts that a task has written, as (table, name, rows)."""

    parts: list


class BatchWriter(DataSourceWriter):
    """Rows of (table, row): the table's name and the row as JSON."""

    def __init__(self, folder: str, batch: str, schemas: dict, append: bool):
        self.folder, self.batch, self.schemas, self.append = folder, batch, schemas, append

    def write(self, iterator):
        task, open_, rows = uuid.uuid4().hex, {}, {}
        os.makedirs(f"{self.folder}/{_PARTS}", exist_ok=True)
        try:
            for table, row in iterator:
                if table not in self.schemas:
                    raise ValueError(f"the batch has no table {table}")
                if table not in open_:
                    open_[table] = open(f"{self.folder}/{_PARTS}/{task}-{len(open_)}.json", "w", encoding="utf-8")
                open_[table].write(row + "\n")
                rows[table] = rows.get(table, 0) + 1
        except BaseException:
            for file in open_.values():
                file.close()
                os.remove(file.name)
            raise
        for file in open_.values():
            file.flush()
            os.fsync(file.fileno())
            file.close()
        return Written([(table, os.path.basename(file.name), rows[table]) for table, file in open_.items()])

    def commit(self, messages):
        """The next manifest, made beside and linked in one step; another batch that came first is built upon."""
        os.makedirs(f"{self.folder}/{_MANIFESTS}", exist_ok=True)
        while True:
            old = _newest(self.folder)
            if self.batch in old["batches"]:
                self.abort(messages)
                return
            tables = {**old["tables"]}
            for table, schema in self.schemas.items():
                new = [[name, n] for m in messages if m for t, name, n in m.parts if t == table]
                tables[table] = {"schema": schema, "parts": [*(tables.get(table, {}).get("parts", []) if self.append else []), *new]}
            made = {"version": old["version"] + 1, "batches": [*old["batches"], self.batch], "tables": tables}
            beside = f"{self.folder}/{_MANIFESTS}/{uuid.uuid4().hex}.part"
            with open(beside, "w", encoding="utf-8") as out:
                json.dump(made, out, ensure_ascii=False)
            try:
                os.link(beside, f"{self.folder}/{_MANIFESTS}/{made['version']:012d}.json")  # fails if it is there
                return
            except FileExistsError:
                continue
            finally:
                os.remove(beside)

    def abort(self, messages):
        for m in messages:
            for _, name, _ in m.parts if m else []:
                if os.path.exists(f"{self.folder}/{_PARTS}/{name}"):
                    os.remove(f"{self.folder}/{_PARTS}/{name}")


class BatchSource(DataSource):
    @classmethod
    def name(cls):
        return "papyra_batch"

    def writer(self, schema, overwrite):
        o = self.options
        return BatchWriter(o["folder"], o["batch"], json.loads(o["schemas"]), o["mode"] == "append")


def committed(folder: str) -> list[str]:
    """The ids of the batches that a folder holds, in order."""
    return _newest(_local(folder))["batches"]


def commit(spark: SparkSession, folder: str, batch: str, tables: dict[str, DataFrame], append: bool = False) -> bool:
    """Writes all tables of a batch in one job, in place of the folder's tables of these names or behind their rows; False if the batch is there already.

    An error leaves the folder's tables as they were. Null values are left out of the JSON and read back as nulls.
    """
    path = _local(folder)
    if batch in _newest(path)["batches"]:
        return False
    spark.dataSource.register(BatchSource)
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("row")) for name, df in tables.items()])
    schemas = json.dumps({name: df.schema.jsonValue() for name, df in tables.items()})
    rows.write.format("papyra_batch").option("folder", path).option("batch", batch).option("schemas", schemas).option("mode", "append" if append else "replace").mode("append").save()
    return True


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest manifest."""
    path = _local(folder)
    out = {}
    for name, table in _newest(path)["tables"].items():
        schema = T.StructType.fromJson(table["schema"])
        files = [f"file://{path}/{_PARTS}/{part}" for part, _ in table["parts"]]
        out[name] = spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
    return out


def prepared(spark: SparkSession, folder: str, batch: str, repairs: dict[str, DataFrame], key: str, column: str, valid=None) -> bool:
    """Repairs (key, before, after) of several of a folder's tables as one batch.

    Every repair must find its row with the value before, once, and every repaired table must be valid(name, table); else an error names the table and nothing changes. False if the batch is there already.
    """
    if batch in committed(folder):
        return False
    tables, made = read(spark, folder), {}
    for name, wanted in repairs.items():
        if name not in tables:
            raise ValueError(f"{name}: no such table")
        rows = tables[name]
        asked = wanted.select(F.col(key), "before", "after")
        met = rows.join(asked, key).where(F.col(column).eqNullSafe(F.col("before")))
        counts = asked.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
        if met.count() != counts.n or counts.d != counts.n:
            raise ValueError(f"{name}: a repair does not fit")
        marked = rows.join(asked.withColumn("papyra_hit", F.lit(True)), key, "left")
        made[name] = marked.withColumn(column, F.when(F.col("papyra_hit"), F.col("after")).otherwise(F.col(column))).select(*rows.columns)
        if valid is not None and not valid(name, made[name]):
            raise ValueError(f"{name}: not valid after its repairs")
    return commit(spark, folder, batch, made)


def swept(folder: str) -> int:
    """Removes parts that no manifest lists, while no batch is being written; the number of them."""
    path, n = _local(folder), 0
    kept = set()
    for name in os.listdir(f"{path}/{_MANIFESTS}") if os.path.isdir(f"{path}/{_MANIFESTS}") else []:
        with open(f"{path}/{_MANIFESTS}/{name}", encoding="utf-8") as text:
            kept |= {part for table in json.load(text)["tables"].values() for part, _ in table["parts"]}
    for part in os.listdir(f"{path}/{_PARTS}") if os.path.isdir(f"{path}/{_PARTS}") else []:
        if part not in kept:
            os.remove(f"{path}/{_PARTS}/{part}")
            n += 1
    return n
