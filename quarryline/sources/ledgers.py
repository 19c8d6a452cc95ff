"""SQLite ledgers as a source of Spark, read by ranges of rowids or newest first.

    ledgers.reader(spark, file, "jobs").load()

Options: partitions (ranges of rowids, 8 at first); newest (a column) and limit: only so many rows, the greatest
first, by one ordered query that SQLite ends early. Filters on columns are handed to SQLite, for which
reader() lets the session push them (spark.sql.python.filterPushdown.enabled). The file is opened for reading only, by a path that
all executors have.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Comparisons that mean the same to SQLite.
COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(Path(path.removeprefix("file://")).resolve().as_uri() + "?mode=ro", uri=True)


def _name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name} is no name of a table or column")
    return name


class LedgerSource(D.DataSource):
    """A table of a SQLite file; INTEGER columns are longs, REAL ones doubles, all others strings."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> StructType:
        kinds = {"INTEGER": LongType(), "INT": LongType(), "REAL": DoubleType()}
        with _opened(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return StructType([StructField(_name(c[1]), kinds.get(c[2].upper(), StringType())) for c in found])

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(dict(self.options), schema)


class Rows(D.InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class LedgerReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        """Takes what SQLite judges alike; the others are Spark's. With a limit none is taken, since they would
        change which rows are the newest."""
        names = {f.name for f in self.schema}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in names else None
            if column is None or "newest" in self.options:
                yield f
            elif type(f) in COMPARED and f.value is not None:
                self.where.append(f"{_name(column)} {COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, D.In) and f.value and None not in f.value:
                self.where.append(f"{_name(column)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (D.IsNull, D.IsNotNull)):
                self.where.append(f"{_name(column)} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL")
            else:
                yield f

    def partitions(self) -> list[Rows]:
        with _opened(self.options["path"]) as db:
            first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.options['table'])}").fetchone()
        if first is None:
            return [Rows(0, -1)]
        n = 1 if "newest" in self.options else max(1, int(self.options.get("partitions", "8")))
        size = -(-(last - first + 1) // n)
        return [Rows(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]

    def statement(self, part: Rows) -> tuple[str, list]:
        columns = ", ".join(_name(f.name) for f in self.schema)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        sql, values = f"SELECT {columns} FROM {_name(self.options['table'])} WHERE {where}", [part.first, part.last, *self.values]
        if "newest" in self.options:
            sql, values = f"{sql} ORDER BY {_name(self.options['newest'])} DESC, rowid DESC LIMIT ?", [*values, int(self.options.get("limit", "100"))]
        return sql, values

    def read(self, partition: Rows) -> Iterator[tuple]:
        as_text = [isinstance(f.dataType, StringType) for f in self.schema]
        as_real = [isinstance(f.dataType, DoubleType) for f in self.schema]
        db = _opened(self.options["path"])
        try:
            for row in db.execute(*self.statement(partition)):
                yield tuple(None if v is None else str(v) if t else float(v) if r else v for v, t, r in zip(row, as_text, as_real, strict=True))
        finally:
            db.close()


def reader(spark: SparkSession, path: str, table: str):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
    return spark.read.format("ledger").option("path", path).option("table", table)


def ledger(spark: SparkSession, path: str, table: str = "jobs", partitions: int = 8) -> DataFrame:
    return reader(spark, path, table).option("partitions", str(partitions)).load()


def newest(spark: SparkSession, path: str, column: str = "created", limit: int = 100, table: str = "jobs") -> DataFrame:
    """The rows with the greatest values of a column; a report of that many rows, read in one ordered query."""
    return reader(spark, path, table).option("newest", column).option("limit", str(limit)).load()
