"""A stored table of people that takes changes: key-range files, copy-on-write of the ranges that changes touch, and a pointer to the current version.

A version is a manifest: one row for each range with its lowest key, its folder and its number of rows. Changes are folded by key, sent to
their ranges, merged there, and written as new folders; all other ranges keep theirs. The pointer is a file that names the manifest and
is put in place by one rename, so a reader sees the old version or the new one, never a part. Changes themselves are kept as a log, one folder a version.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a range, about, when a table is made.
RANGE_ROWS = 100_000
_MANIFEST = "low string, folder string, n long"


@dataclass
class PeopleStore:
    spark: SparkSession
    path: str
    key: str = "uri"

    # ------------------------------------------------------------------ versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The number of the current version: the largest that has a pointer."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/pointers")):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path(f"{self.path}/pointers"))), default=0)

    def _point(self, version: int) -> None:
        """Make a version current. Two writers of one version: the second rename fails."""
        fs, path = self._fs()
        own = path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        fs.create(own).close()
        fs.mkdirs(path(f"{self.path}/pointers"))
        to = path(f"{self.path}/pointers/{version}")
        if fs.exists(to) or not fs.rename(own, to):
            raise RuntimeError(f"version {version} was written by another change")

    def manifest(self, version: int | None = None) -> list[tuple[str | None, str, int]]:
        """(lowest key, folder, rows) of each range, in order; the first range's lowest key is null, as it begins before all keys."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/{version or self.version()}").collect()
        return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or ""))

    def _publish(self, ranges: list[tuple[str | None, str, int]], version: int) -> None:
        self.spark.createDataFrame(ranges, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")
        self._point(version)

    # ------------------------------------------------------------------ rows

    def read(self, version: int | None = None) -> DataFrame:
        """All people of a version, the current one if none is named."""
        held = self.manifest(version)
        full = [folder for _, folder, n in held if n] or [held[0][1]]
        return self.spark.read.parquet(*full).drop("_low")

    def lookup(self, uri: str) -> DataFrame:
        """The person of a key; reads one range."""
        held = self.manifest()
        return self.spark.read.parquet(held[bisect_right([low for low, _, _ in held[1:]], uri)][1]).drop("_low").filter(F.col(self.key) == uri)

    def _write(self, rows: DataFrame, rest: list[tuple[str | None, str, int]], version: int) -> None:
        """Rows with their range's number ``_range`` and its lowest key ``_low`` as folders of a new version, beside the ranges that stay."""
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.repartition("_range").sortWithinPartitions("_range", self.key).write.partitionBy("_range").parquet(at)
        counted = self.spark.read.parquet(at).groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_low").alias("low")).collect()  # one row a range
        self._publish(rest + [(r["low"], f"{at}/_range={r['_range']}", r["n"]) for r in counted], version)

    def upsert(self, changes: DataFrame, columns: list[str], order: str = "seq") -> tuple[int, int]:
        """Fold changes into the table; (ranges written, ranges kept).

        Of a key's changes, the last value of each column that is not empty holds; it replaces the stored one, and an empty one never does. Unknown keys become new rows with
        empty columns. Changes without a key are left out; without any change nothing is written.
        """
        held, version = self.manifest(), self.version()
        lows = [low for low, _, _ in held[1:]]
        log = f"{self.path}/log/{version + 1}-{uuid.uuid4().hex}"
        last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col(order)))
        folded = changes.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[last(c).alias(c) for c in columns])
        _numbered(folded, self.key, lows).write.parquet(log)
        log_rows = self.spark.read.parquet(log)
        touched = sorted(r[0] for r in log_rows.select("_range").distinct().collect())
        if not touched:
            return 0, len(held)
        stored = _numbered(self.spark.read.parquet(*[held[k][1] for k in touched]).drop("_low"), self.key, lows)
        fresh = log_rows.select(self.key, F.col("_range").alias("_r"), *[F.nullif(F.col(c), F.lit("")).alias(f"_new_{c}") for c in columns])
        both = stored.join(fresh, self.key, "full_outer")

        def value(c: str) -> Column:
            if c == "_range":
                return F.coalesce("_range", "_r").alias(c)
            if c in columns:
                return F.coalesce(f"_new_{c}", c, F.lit("")).alias(c)
            return F.col(c)

        bounds = self.spark.createDataFrame([(k, low) for k, (low, _, _) in enumerate(held)], "_range int, _low string")  # one row a range
        merged = both.select(*[value(c) for c in stored.columns]).join(F.broadcast(bounds), "_range")
        self._write(merged, [r for k, r in enumerate(held) if k not in set(touched)], version + 1)
        return len(touched), len(held) - len(touched)


def _numbered(rows: DataFrame, key: str, lows: list[str]) -> DataFrame:
    """Rows with the number of the range that their key belongs to."""
    at = rows.columns.index(key)
    schema = StructType([*rows.schema.fields, StructField("_range", IntegerType())])

    def run(it):
        for b in it:
            which = pa.array([bisect_right(lows, k) for k in b.column(at).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, which], names=[*b.schema.names, "_range"])

    return rows.mapInArrow(run, schema)


def create(people: DataFrame, path: str, key: str = "uri", range_rows: int = RANGE_ROWS) -> PeopleStore:
    """A new store of people whose keys are distinct strings; null keys are left out. An empty table gives one empty range."""
    spark = people.sparkSession
    made = PeopleStore(spark, path, key)
    if made.version():
        raise FileExistsError(path)
    kept = people.filter(F.col(key).isNotNull())
    n = max(1, -(-kept.count() // range_rows))
    # Bounds of even ranges, from the sort's own sampling: the lowest key of each of its parts.
    parts = kept.select(key).repartitionByRange(n, key).withColumn("_p", F.spark_partition_id())
    lows = sorted(r[0] for r in parts.groupBy("_p").agg(F.min(key)).select(f"min({key})").collect())[1:]  # one row a range
    rows = _numbered(kept, key, lows)
    bounds = spark.createDataFrame([(k, low) for k, low in enumerate([None, *lows])], "_range int, _low string")
    if kept.isEmpty():
        at = f"{path}/data/{uuid.uuid4().hex}"
        kept.withColumn("_low", F.lit(None).cast("string")).write.parquet(at)
        made._publish([(None, at, 0)], 1)
    else:
        made._write(rows.join(F.broadcast(bounds), "_range"), [], 1)
    return made
