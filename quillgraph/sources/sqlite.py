"""SQLite files as a Spark data source: read in parallel by ranges of row ids, filters evaluated in the files."""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Row ids a partition covers unless the option ``rowids`` says otherwise, ranges from which it covers more, rows a batch holds.
ROWIDS = 500_000
MOST_RANGES = 10_000
BATCH = 8_192
#: Spark type: SQLite type that values are cast to, Arrow type, Python types of literals that filters may hold.
TYPES = {
    "bigint": ("INTEGER", pa.int64(), (int,)),
    "double": ("REAL", pa.float64(), (float, int)),
    "string": ("TEXT", pa.string(), (str,)),
}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local_path(path: str) -> str:
    """The path as the file system sees it; SQLite files are opened by path, so driver and executors must all mount it."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"SQLite files are opened in a mounted folder, not at {path}")
    return bare


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Range(InputPartition):
    """Rows of one file with row ids from ``first`` to ``last``; all of them where ``first`` is None."""

    file: str
    first: int | None
    last: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        path = local_path(options["path"])
        self.files = sorted(glob.glob(os.path.join(glob.escape(path), "*.sqlite"))) if os.path.isdir(path) else [path]
        self.table = options["table"]
        self.step = int(options.get("rowids", ROWIDS))
        self.types = {f.name: f.dataType.simpleString() for f in schema.fields}
        unknown = sorted(set(self.types.values()) - set(TYPES))
        if unknown:
            raise ValueError(f"SQLite columns are read as {', '.join(TYPES)}, not {', '.join(unknown)}")
        self.conditions: list[str] = []
        self.values: list = []

    def _value(self, column: str) -> str:
        """A column cast as it is read, so that a filter sees what Spark would see; text compares by bytes."""
        cast = f"CAST({_name(column)} AS {TYPES[self.types[column]][0]})"
        return f"{cast} COLLATE BINARY" if self.types[column] == "string" else cast

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            literals = f.value if isinstance(f, In) else (f.value,) if type(f) in COMPARED else ()
            fit = column in self.types and all(type(v) in TYPES[self.types[column]][2] and v == v for v in literals)
            if fit and type(f) in COMPARED:
                self.conditions.append(f"{self._value(column)} {COMPARED[type(f)]} ?")
            elif fit and isinstance(f, In) and 0 < len(literals) <= 500:
                self.conditions.append(f"{self._value(column)} IN ({', '.join('?' * len(literals))})")
            elif fit and isinstance(f, IsNull | IsNotNull):
                self.conditions.append(f"{_name(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f
                continue
            self.values += literals

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in self.files:
            db = _open(file)
            try:
                first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                first = last = None
            finally:
                db.close()
            if first is None:
                # Views, empty tables and those without row ids; a missing table fails when it is read.
                out.append(Range(file, None, None))
            else:
                step = max(self.step, -(-(last - first + 1) // MOST_RANGES))
                out += [Range(file, at, min(at + step - 1, last)) for at in range(first, last + 1, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # What Spark makes of a folder without files.
            return
        where, values = list(self.conditions), list(self.values)
        if partition.first is not None:
            where, values = [*where, "rowid BETWEEN ? AND ?"], [*values, partition.first, partition.last]
        columns = ", ".join(f"CAST({_name(c)} AS {TYPES[t][0]})" for c, t in self.types.items())
        schema = pa.schema([(c, TYPES[t][1]) for c, t in self.types.items()])
        db = _open(partition.file)
        try:
            rows = db.execute(f"SELECT {columns} FROM {_name(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while batch := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*batch, strict=True), schema, strict=True)], schema=schema)
        finally:
            db.close()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rowids: int = ROWIDS) -> DataFrame:
    """Columns of a table of one SQLite file, or of all ``*.sqlite`` files of a folder, opened read-only.

    Values are cast to the types of ``schema`` (bigint, double, string) by SQLite's rules. Files are cut into ranges of
    ``rowids`` row ids; tables without row ids and views are read in one task a file. An empty table gives no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").schema(schema).option("table", table).option("rowids", rowids).load(path)


def write_sqlite(df: DataFrame, path: str, table: str) -> DataFrame:
    """Writes each partition as one SQLite file ``<partition>.sqlite`` into a mounted folder, and returns (file, rows).

    A file appears under its name when it is whole, so a task that runs again replaces it by the same rows."""
    folder, names = local_path(path), list(df.columns)
    kinds = {c: TYPES[t][0] for c, t in df.dtypes}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        whole = os.path.join(folder, f"{task.partitionId():05d}.sqlite")
        part = f"{whole}.{task.taskAttemptId()}"
        db, n = sqlite3.connect(part), 0
        try:
            db.execute(f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(c)} {k}' for c, k in kinds.items())})")
            for b in batches:
                db.executemany(f"INSERT INTO {_name(table)} VALUES ({', '.join('?' * len(names))})", zip(*[c.to_pylist() for c in b.columns], strict=True))
                n += b.num_rows
            db.commit()
        finally:
            db.close()
        os.replace(part, whole)
        yield pa.RecordBatch.from_pydict({"file": [whole], "rows": pa.array([n], pa.int64())})

    return df.mapInArrow(write, "file string, rows long")
