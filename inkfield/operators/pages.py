"""Pages at any depth from a stored order: files by ranges of the order, with their bounds and running counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file, about.
FILE_ROWS = 100_000


@dataclass
class Pages:
    spark: SparkSession
    path: str
    keys: list[str]

    def __post_init__(self):
        self.rows = self.spark.read.parquet(f"{self.path}/rows")
        #: (part, n, before, low, high): one row a file.
        self.files = self.spark.read.parquet(f"{self.path}/files")

    def total(self) -> int:
        return self.files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows from ``offset`` on, in order; reads only the files that hold them: one or two, if a page is shorter than a file."""
        held = self.files.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("part", "before").orderBy("part").collect()
        return self._of([r["part"] for r in held]).offset(offset - held[0]["before"] if held else 0).limit(limit)

    def after(self, key: tuple, limit: int) -> DataFrame:
        """The ``limit`` rows that follow a key's rows, in order: a page that is asked for by where the last one ended."""
        past = F.struct(*[F.lit(v).cast(self.rows.schema[c].dataType).alias(c) for c, v in zip(self.keys, key, strict=True)])
        # Files in order from the one that holds the next key, as many as hold the page, and one more as the first may begin before the key.
        begin = self.files.filter(F.col("high") > past).agg(F.min(F.struct("part", "before", "n")).alias("f")).first()["f"]
        if begin is None:
            return self._of([])
        held = self.files.filter((F.col("part") >= begin["part"]) & (F.col("before") < begin["before"] + begin["n"] + limit)).select("part").collect()
        return self._of([r["part"] for r in held], F.struct(*self.keys) > past).limit(limit)

    def _of(self, parts: list[int], kept=None) -> DataFrame:
        rows = self.rows.limit(0)
        if parts:  # the others' folders are not even listed
            rows = self.spark.read.schema(self.rows.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/part={p}" for p in parts])
        return (rows if kept is None else rows.filter(kept)).orderBy(*self.keys).drop("part", "_tie")


def store(rows: DataFrame, path: str, keys: list[str], file_rows: int = FILE_ROWS) -> Pages:
    """Write rows in the order of ``keys``, which should be total but for equal rows; equal rows may lie in several files. Nulls come first. An empty table gives an empty store."""
    spark = rows.sparkSession
    n_files = max(1, -(-rows.count() // file_rows))
    order = [*keys, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # so that the rows of one key need not be one file's
    ranged = tied.repartitionByRange(n_files, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(f"{path}/rows")
    if n_files == 1 and rows.isEmpty():  # nothing was written under a part
        ranged.limit(0).write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    bound = F.struct(*keys)
    counts = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(bound).alias("low"), F.max(bound).alias("high"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    counts.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/files")
    return Pages(spark, path, keys)
