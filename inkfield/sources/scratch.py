"""Scratch tables: Parquet tables in the folder that the cluster names in ``spark.checkpoint.dir``.

A scratch table cuts lineage the way a reliable checkpoint does (every executor can read it, a
lost executor loses nothing) but is columnar and compressed.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_scope: str | None = None
_tables: dict[str, list[tuple[SparkSession, str]]] = {}


def root(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is named and driver and executors are one process (tests)."""
    global _own_root
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if _own_root is None:
        _own_root = "file://" + tempfile.mkdtemp(prefix="inkfield-")
        atexit.register(_remove_own_root)
    return _own_root


def _remove_own_root() -> None:
    import shutil

    shutil.rmtree(_own_root.removeprefix("file://"), ignore_errors=True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back. It lives until its scope is entered again; without a scope, as long as the shared folder."""
    out, path = write_kept(df, label)
    if _scope:
        _tables[_scope].append((df.sparkSession, path))
    return out


@contextmanager
def scope(name: str):
    """Scratch tables made inside belong to ``name``; those of its last time are deleted, and no others."""
    global _scope
    for spark, path in _tables.pop(name, []):
        drop_path(spark, path)
    outer, _scope, _tables[name] = _scope, name, []
    try:
        yield
    finally:
        _scope = outer


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def write_kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Like ``stash``, but of no scope; returns the path too, for ``drop_path``."""
    spark = df.sparkSession
    path = f"{root(spark)}/inkfield/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
