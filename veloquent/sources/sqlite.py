"""SQLite tables as a Spark data source: partitions by ranges of row ids, filters pushed into the reader's query."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import StructType

#: Operators that mean the same to both engines.
COMPARISONS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows fetched at once.
BATCH = 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The Spark type of a declared column type, by the words that decide SQLite's own affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return "bigint"
    if any(w in kind for w in ("REAL", "FLOA", "DOUB")):
        return "double"
    return "binary" if "BLOB" in kind else "string"


def clause(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL with parameters; None if it stays with Spark."""
    if len(f.attribute) != 1:
        return None
    column = quoted(f.attribute[0])
    plain = (int, float, str)
    if type(f) in COMPARISONS and isinstance(f.value, plain):
        return f"{column} {COMPARISONS[type(f)]} ?", [f.value]
    if isinstance(f, In) and all(isinstance(v, plain) for v in f.value) and len(f.value) <= 500:
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{column} IS NOT NULL", []
    if isinstance(f, StringStartsWith):
        return f"substr({column}, 1, ?) = ?", [len(f.value), f.value]
    if isinstance(f, StringContains):
        return f"instr({column}, ?) > 0", [f.value]
    return None


@dataclass
class Range(InputPartition):
    """Row ids from ``first`` to before ``after``."""

    first: int
    after: int


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], partitions: int):
        self.path, self.table, self.columns, self.count = path, table, columns, partitions
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = clause(f)
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[Range]:
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.count)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def query(self) -> str:
        told = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        return f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.table)} WHERE {told}"

    def read(self, partition: Range) -> Iterator[tuple]:
        with _opened(self.path) as db:
            rows = db.execute(self.query(), [partition.first, partition.after, *self.values])
            while some := rows.fetchmany(BATCH):
                yield from some


class _opened:
    """A read-only connection, closed at the end."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def __enter__(self) -> sqlite3.Connection:
        return self.db

    def __exit__(self, *_: object) -> None:
        self.db.close()


class SqliteSource(DataSource):
    """Options: ``path`` of a file that driver and executors share, ``table``, and ``partitions`` (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        with _opened(self.options["path"]) as db:
            found = [(r[1], r[2]) for r in db.execute(f"PRAGMA table_info({quoted(self.options['table'])})")]
        if not found:
            raise ValueError(f"no such table: {self.options['table']}")
        return found

    def schema(self) -> str:
        return ", ".join(f"`{name}` {spark_type(kind)}" for name, kind in self._columns())

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema.fieldNames(), max(1, int(self.options.get("partitions", 8))))


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A SQLite table with an integer row id. Filters on single columns reach SQLite; the order of rows is not kept.

    Spark hands filters to Python sources only with ``spark.sql.python.filterPushdown.enabled``, which is set here.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions).load()
