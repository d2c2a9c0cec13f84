"""SQLite files and NumPy archives as Spark formats: ``spark.read.format("sqlite_files")`` and ``"npz"``.

Both read a folder (or one file) that driver and executors reach under one path, in partitions of a file's rows. Filters are pushed
into SQLite where it can hold them (``spark.sql.python.filterPushdown.enabled``). A file that cannot be read gives one
row whose ``_error`` says why and whose other columns are null; rows of good files have a null there.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from dataclasses import dataclass
from glob import glob

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of one partition of a file.
SPLIT_ROWS = 100_000


def _files(path: str, ending: str) -> list[str]:
    """A file, or the files of a folder, in order."""
    local = path.removeprefix("file://")
    if "://" in local:
        raise ValueError(f"{path}: only mounted paths can be read")
    return sorted(glob(f"{local}/*{ending}")) if os.path.isdir(local) else [local]


def _error_row(schema: StructType, path: str, error: Exception) -> tuple:
    return tuple(f"{os.path.basename(path)}: {error}" if f.name == "_error" else None for f in schema.fields)


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    last: int


# ------------------------------------------------------------------ SQLite

_KINDS = {"INT": LongType(), "CHAR": StringType(), "TEXT": StringType(), "CLOB": StringType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType(), "BLOB": BinaryType()}
_SIGNS = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteFiles(DataSource):
    """Options: ``path``, ``table``, and ``split`` (rows of a partition). Files of a folder end in .db and have the table; the first readable one gives the columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def schema(self) -> StructType:
        for path in _files(self.options["path"], ".db"):
            try:
                with _open(path) as db:
                    columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
            except sqlite3.Error:
                continue
            if columns:
                kind = lambda declared: next((t for part, t in _KINDS.items() if part in declared.upper()), StringType())
                return StructType([*[StructField(c[1], kind(c[2] or "")) for c in columns], StructField("_error", StringType())])
        raise ValueError(f"no file of {self.options['path']} has a table {self.options['table']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.table, self.split, self.schema = options["path"], options["table"], int(options.get("split", SPLIT_ROWS)), schema
        self.where, self.values = [], []

    def pushFilters(self, filters):
        """Comparisons of a whole column go to SQLite; the others stay with Spark."""
        for f in filters:
            column = _quoted(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 and f.attribute[0] != "_error" else None
            if column and type(f) in _SIGNS and isinstance(f.value, (int, float, str)):
                self.where.append(f"{column} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{column} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
            else:
                yield f
                continue
            # Rows of unreadable files have null columns: Spark filters again, so that they go where the filter says so.
            yield f

    def partitions(self):
        out = []
        for path in _files(self.path, ".db"):
            try:
                with _open(path) as db:
                    first, last = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.Error:
                first, last = 0, 0  # the task finds the error again and reports it
            if first is not None:
                out += [Stretch(path, k, min(k + self.split - 1, last)) for k in range(first, last + 1, self.split)]
        return out or [Stretch("", 0, -1)]

    def read(self, part: Stretch):
        if part.last < part.first:
            return
        names = ", ".join(_quoted(f.name) if f.name != "_error" else "NULL" for f in self.schema.fields)
        where = " AND ".join(["rowid BETWEEN ? AND ?", *self.where])
        try:
            with _open(part.path) as db:
                yield from db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE {where}", [part.first, part.last, *self.values])
        except sqlite3.Error as e:
            yield _error_row(self.schema, part.path, e)


@dataclass
class Written(WriterCommitMessage):
    path: str


class SqliteWriter(DataSourceWriter):
    """One file a task, under a name of its own until the job ends; files of failed tasks are not kept."""

    def __init__(self, options, schema: StructType):
        self.path, self.table, self.schema = options["path"].removeprefix("file://"), options["table"], schema

    def write(self, rows) -> Written:
        os.makedirs(self.path, exist_ok=True)
        at = f"{self.path}/{uuid.uuid4().hex}.part"
        kind = {LongType: "INTEGER", DoubleType: "REAL", BinaryType: "BLOB"}
        declared = ", ".join(f"{_quoted(f.name)} {'INTEGER' if 'int' in f.dataType.simpleString() else kind.get(type(f.dataType), 'TEXT')}" for f in self.schema.fields)
        with sqlite3.connect(at) as db:
            db.execute(f"CREATE TABLE {_quoted(self.table)} ({declared})")
            db.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema.fields))})", (tuple(r) for r in rows))
        return Written(at)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.rename(m.path, m.path.removesuffix(".part") + ".db")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


# ------------------------------------------------------------------ NumPy archives


class Npz(DataSource):
    """Options: ``path``, ``split``. Arrays of one length are columns, in order of their names: numbers, strings, or rows of numbers as arrays."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        for path in _files(self.options["path"], ".npz"):
            try:
                with np.load(path) as z:
                    kind = {n: _spark_kind(z[n]) for n in sorted(z.files)}
            except (OSError, ValueError, EOFError):
                continue
            return StructType([*[StructField(n, k) for n, k in kind.items()], StructField("_error", StringType())])
        raise ValueError(f"no readable archive in {self.options['path']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(self.options, schema)


def _spark_kind(a: np.ndarray):
    one = LongType() if a.dtype.kind in "iu" else DoubleType() if a.dtype.kind == "f" else StringType()
    return ArrayType(one) if a.ndim == 2 else one


class NpzReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.split, self.schema = options["path"], int(options.get("split", SPLIT_ROWS)), schema

    def partitions(self):
        out = []
        for path in _files(self.path, ".npz"):
            try:
                with np.load(path) as z:
                    n = len(z[sorted(z.files)[0]])
            except (OSError, ValueError, EOFError):
                n = 1  # the task finds the error again and reports it
            out += [Stretch(path, k, min(k + self.split, n) - 1) for k in range(0, n, self.split)]
        return out or [Stretch("", 0, -1)]

    def read(self, part: Stretch):
        if part.last < part.first:
            return
        try:
            with np.load(part.path) as z:
                columns = [z[f.name][part.first : part.last + 1].tolist() if f.name != "_error" else [None] * (part.last + 1 - part.first) for f in self.schema.fields]
                if len({len(c) for c in columns}) > 1:
                    raise ValueError("arrays of different lengths")
        except (OSError, ValueError, EOFError, KeyError) as e:
            yield _error_row(self.schema, part.path, e)
            return
        yield from zip(*columns, strict=True)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, and let filters reach them."""
    spark.dataSource.register(SqliteFiles)
    spark.dataSource.register(Npz)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
