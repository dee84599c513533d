"""SQLite files as a Spark data source, read-only, in ranges of row ids.

spark.dataSource.register(SqliteSource); spark.read.format("papyra_sqlite").option("path", file).option("table", name).load()

Every executor must see the file. Columns are long, double, string or binary by their declared affinity; values that don't fit their column are null.
Comparisons with a constant go into the SQL that each task sends (spark.sql.python.filterPushdown.enabled, which table() sets), and with the option
columns (a JSON list) only these are read. A value of another kind than its column's always comes through, as Spark reads it in its own way and tests every row again.
"""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=30)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    """A column's Spark type by SQLite's affinity rules."""
    d = declared.upper()
    if "INT" in d:
        return "long"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return "string"
    if not d or "BLOB" in d:
        return "binary" if "BLOB" in d else "string"
    return "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Row-id ranges of about ROWS rows each; a table without row ids is one range."""

    ROWS = 100_000

    def __init__(self, path: str, table: str, columns: list[tuple[str, str]]):
        self.path, self.table, self.columns, self.pushed = path, table, columns, []

    #: What SQLite calls the values that are as their column says.
    NATURAL = {"long": ("integer",), "double": ("real", "integer"), "string": ("text",)}
    SIGNS = {EqualTo: "=", EqualNullSafe: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def pushFilters(self, filters):
        """Keeps what the SQL can say; all filters are tested by Spark, too."""
        for f in filters:
            if (made := self._sql(f)) is not None:
                self.pushed.append(made)
            yield f

    def _sql(self, f) -> tuple[str, list] | None:
        """A condition that holds for every row that the filter keeps, and its values."""
        kinds = dict(self.columns)
        if len(getattr(f, "attribute", ())) != 1 or kinds.get(f.attribute[0]) not in self.NATURAL:
            return None
        name, kind = _quoted(f.attribute[0]), kinds[f.attribute[0]]
        fits = lambda v: isinstance(v, {"long": int, "double": (int, float), "string": str}[kind]) and not isinstance(v, bool) and (not isinstance(v, int) or abs(v) < 1 << 63)
        odd = f"typeof({name}) NOT IN ({', '.join(repr(k) for k in (*self.NATURAL[kind], 'null'))})"
        if isinstance(f, IsNotNull):
            return f"{name} IS NOT NULL", []
        if type(f) in self.SIGNS and fits(f.value):
            return f"({name} COLLATE BINARY {self.SIGNS[type(f)]} ? OR {odd})", [f.value]
        if isinstance(f, In) and len(f.value) <= 500 and all(map(fits, f.value)):
            return f"({name} COLLATE BINARY IN ({', '.join('?' * len(f.value))}) OR {odd})", list(f.value)
        if isinstance(f, StringStartsWith) and kind == "string":
            return f"(substr({name}, 1, ?) COLLATE BINARY = ? OR {odd})", [len(f.value), f.value]
        return None

    def statement(self, partition) -> tuple[str, list]:
        """The SQL of a range of rows, and its values."""
        names = ", ".join(_quoted(c) for c, _ in self.columns) or "NULL"
        own = [(f"rowid BETWEEN {partition.low} AND {partition.high}", [])] if partition.high >= partition.low else []
        where = [*own, *self.pushed]
        return f"SELECT {names} FROM {_quoted(self.table)}" + (" WHERE " + " AND ".join(c for c, _ in where) if where else ""), [v for _, vs in where for v in vs]

    def partitions(self):
        with _opened(self.path) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Rows(0, -1)]
        return [Rows(0, -1)] if low is None else [Rows(a, min(a + self.ROWS - 1, high)) for a in range(low, high + 1, self.ROWS)]

    def read(self, partition):
        cast = {"long": int, "double": float, "string": str, "binary": bytes}
        sql, values = self.statement(partition)
        with _opened(self.path) as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in con.execute(sql, values):
                out = []
                for v, (_, kind) in zip(row, self.columns):
                    try:
                        out.append(None if v is None else cast[kind](v))
                    except (TypeError, ValueError):
                        out.append(None)
                yield tuple(out)


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "papyra_sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        with _opened(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        every = {r[1]: _kind(r[2] or "") for r in found}
        wanted = json.loads(self.options["columns"]) if self.options.get("columns") else list(every)
        if unknown := [c for c in wanted if c not in every]:
            raise ValueError(f"no column {unknown[0]} in {self.options['table']}")
        return [(c, every[c]) for c in wanted]

    def schema(self):
        return ", ".join(f"`{c}` {k}" for c, k in self._columns())

    def reader(self, schema):
        return SqliteReader(self.options["path"], self.options["table"], self._columns())


def table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table of a SQLite file, or some of its columns; comparisons with constants are left to SQLite."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("papyra_sqlite").option("path", path).option("table", name)
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def tables(path: str) -> list[str]:
    """The names of a file's tables."""
    with _opened(path) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
