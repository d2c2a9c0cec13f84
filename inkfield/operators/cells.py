"""Exact nearest vectors from stored cells: bounds by the triangle inequality say which blocks of which cells a query visits.

The centres of the cells are fitted on a bounded sample; every row is stored, in the cell of its nearest centre, sorted by its distance
from it and cut into blocks. A row x of a block whose distances from the centre c lie in [low, high] is at least
``max(low - d(q, c), d(q, c) - high)`` from a query q. Blocks near the query give its k-th distance so far, and
only blocks whose bound does not pass that are visited. Queries stay a table; a block that many of them visit is
copied over several tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .meeting import matrix, meet, squared_distances

#: Rows the centres are fitted on, centres, and rounds of fitting, at most; rows of a block; visits of one copy of a block.
SAMPLE, MOST_CENTRES, ROUNDS, BLOCK, VISITS = 4_096, 512, 8, 512, 4_096
#: Decimal places of squared distances, and what bounds allow for rounding.
PLACES, SLACK = 9, 1e-7
_SOUND = "{0} IS NOT NULL AND forall({0}, x -> x IS NOT NULL AND x = x AND abs(x) < double('Infinity'))"


@dataclass
class Cells:
    spark: SparkSession
    path: str
    key: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # MOST_CENTRES at most
        return np.array([r["centre"] for r in rows], dtype=np.float64)


def fitted(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of a sample by rounds of means, from evenly spaced rows; centres left without rows stay where they are."""
    x = np.unique(sample, axis=0)
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)] if len(x) else x
    for _ in range(ROUNDS):
        own = squared_distances(x, c).argmin(axis=1) if len(x) else np.zeros(0, dtype=int)
        total, count = np.zeros_like(c), np.zeros(len(c))
        np.add.at(total, own, x)
        np.add.at(count, own, 1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def _points(rows: list) -> np.ndarray:
    return np.array([r["v"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))


def build(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", tasks: int | None = None) -> Cells:
    """Store all vectors; null ones and those with null or non-finite components are left out. Other columns are not kept. An empty table gives an empty store."""
    spark = vectors.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).filter(_SOUND.format("v"))
    n = rows.count()
    some = rows.filter(F.pmod(F.xxhash64("v"), F.lit(max(1, n // (SAMPLE // 2)))) == 0).orderBy(F.xxhash64("v", F.lit(1)), key).limit(SAMPLE).collect()
    centres = fitted(_points(some), min(MOST_CENTRES, math.isqrt(n) + 1))
    if not len(centres):  # the sample's hash met no row, or there is none
        centres = _points(rows.orderBy(key).limit(1).collect())
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    kind = rows.schema[key].dataType.simpleString()

    def place(it):
        for b in it:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                far = squared_distances(matrix(c.column(1)), centres)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(far[np.arange(len(cell)), cell]))], names=[key, "v", "cell", "far"])

    def cut(it):
        made = TaskContext.get().partitionId() << 32
        for b in it:
            if not b.num_rows:
                continue
            cell, far = b.column(2).to_numpy(), b.column(3).to_numpy()
            new = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            first = np.repeat(new, np.diff(np.append(new, len(cell))))
            at = np.flatnonzero((np.arange(len(cell)) - first) % BLOCK == 0)
            stop = np.append(at[1:], len(cell))
            offsets = pa.array(np.append(at, len(cell)), type=pa.int32())
            keys, many = (pa.ListArray.from_arrays(offsets, pa.concat_arrays([b.column(i)])) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(made + np.arange(len(at))), pa.array((stop - at).astype(np.int32)), pa.array(far[at]), pa.array(far[stop - 1]), keys, many], names=["cell", "block", "n", "low", "high", "keys", "vectors"])
            made += len(at)

    placed = rows.mapInArrow(place, f"{key} {kind}, v array<double>, cell int, far double")
    order = ["cell", "far", key]
    blocks = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(cut, f"cell int, block long, n int, low double, high double, keys array<{kind}>, vectors array<array<double>>")
    blocks.write.parquet(f"{path}/blocks")
    return Cells(spark, path, key)


def visited(cells: Cells, visits: DataFrame, qkey: str, k: int) -> DataFrame:
    """(query, key, distance): of each visit (query, q, bound, block), the block's k nearest rows that are no farther than the bound."""
    key, blocks = cells.key, cells.blocks().select("block", "keys", "vectors")
    kind, qkind = blocks.schema["keys"].dataType.elementType.simpleString(), visits.schema[qkey].dataType.simpleString()
    copies = stash(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("copies")), "cells-copies")
    cell = F.xxhash64("block", "copy")  # two blocks of one hash would be told apart by their number
    held = blocks.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(cell.alias("cell"), "block", "keys", "vectors")
    asked = visits.join(copies, "block").withColumn("copy", F.pmod(F.xxhash64(qkey), F.col("copies")).cast("int")).select(cell.alias("cell"), "block", F.col(qkey).alias("_query"), "q", "bound")

    def start(t: pa.Table):
        return {b: (pa.concat_arrays([own.values]), matrix(own_v.values)) for b, own, own_v in zip(t["block"].to_pylist(), t["keys"].combine_chunks(), t["vectors"].combine_chunks(), strict=True)}

    def step(state, b):
        if b is None:
            return None
        out, (block, asking, bound) = [], (b.column(names.index(c)) for c in ("block", "_query", "bound"))
        q, block, bound = matrix(b.column(names.index("q"))), block.to_numpy(), bound.to_numpy()
        for own in np.unique(block):
            mine = np.flatnonzero(block == own)
            keys, x = state[own]
            for at in range(0, len(mine), 512):
                part = mine[at : at + 512]
                far = np.round(squared_distances(q[part], x), PLACES)
                i, j = np.nonzero(far <= bound[part][:, None])
                order = np.lexsort((keys.take(pa.array(j)).to_numpy(zero_copy_only=False), far[i, j], i)) if len(i) else i
                i, j = i[order], j[order]
                first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else i
                few = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                i, j = i[few], j[few]
                out.append(pa.RecordBatch.from_arrays([asking.take(pa.array(part[i])), keys.take(pa.array(j)), pa.array(far[i, j])], names=[qkey, key, "distance"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(o.num_rows for o in out) else None

    names = ["cell", "_late", "block", "keys", "vectors", "_query", "q", "bound"]
    parts = int(cells.spark.conf.get("spark.sql.shuffle.partitions"))
    return meet(held, asked, parts, start, step, f"{qkey} {qkind}, {key} {kind}, distance double")


def search(cells: Cells, queries: DataFrame, k: int, qkey: str = "query_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """((query, key, distance, rank), (query, cells, cells_visited, blocks, blocks_visited)): the k nearest rows by squared distance, rounded to nine places, ties by key.

    Queries without a sound vector have no rows; repeated queries (same id and vector) count once. Fewer rows than k: all of them.
    """
    key, centres = cells.key, cells.centres()
    qkind = queries.schema[qkey].dataType.simpleString()
    asked = queries.select(qkey, F.col(vector).cast("array<double>").alias("q")).filter(_SOUND.format("q")).distinct()

    def measure(it):
        for b in it:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                far = np.sqrt(squared_distances(matrix(c.column(1)), centres)) if len(centres) else np.zeros((c.num_rows, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], type=pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), lists], names=[qkey, "q", "far"])

    measured = stash(asked.mapInArrow(measure, f"{qkey} {qkind}, q array<double>, far array<double>"), "cells-queries")
    heads = stash(cells.blocks().select("cell", "block", "n", "low", "high"), "cells-heads")
    radii = heads.groupBy("cell").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("blocks"), F.min("low").alias("least"), F.max("high").alias("most"))  # MOST_CENTRES rows
    each = measured.select(qkey, F.posexplode("far").alias("cell", "d")).join(F.broadcast(radii), "cell")
    # The nearest cells that hold k rows, and of these the blocks whose rings are nearest, until k rows are met.
    near = Window.partitionBy(qkey).orderBy("d", "cell").rowsBetween(Window.unboundedPreceding, -1)
    start = each.withColumn("before", F.coalesce(F.sum("rows").over(near), F.lit(0))).filter(F.col("before") < k).select(qkey, "cell", "d")
    gap = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
    rings = Window.partitionBy(qkey).orderBy("d", "gap", "block").rowsBetween(Window.unboundedPreceding, -1)
    first = start.join(heads, "cell").withColumn("gap", gap).withColumn("before", F.coalesce(F.sum("n").over(rings), F.lit(0))).filter(F.col("before") < k)
    first = stash(first.select(qkey, "block"), "cells-first")
    q = measured.select(qkey, "q")
    met = visited(cells, first.join(q, qkey).withColumn("bound", F.lit(float("inf"))), qkey, k)
    order = Window.partitionBy(qkey).orderBy("distance", key)
    kth = met.withColumn("i", F.row_number().over(order)).filter(F.col("i") == k).select(qkey, F.col("distance").alias("kth"))
    bound = stash(q.join(kth, qkey, "left").select(qkey, "q", F.coalesce("kth", F.lit(float("inf"))).alias("bound")), "cells-bounds")
    reach = F.sqrt(F.col("bound")) + SLACK * (1.0 + F.col("d"))
    open_cells = each.join(bound.select(qkey, "bound"), qkey).filter((F.col("d") - F.col("most") <= reach) & (F.col("least") - F.col("d") <= reach)).select(qkey, "cell", "d", "bound")
    needed = open_cells.join(heads, "cell").filter(gap <= reach).select(qkey, "cell", "block")
    needed = stash(needed, "cells-needed")
    found = visited(cells, needed.select(qkey, "block").join(bound, qkey), qkey, k)
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    all_cells, all_blocks = heads.agg(F.count_distinct("cell"), F.count(F.lit(1))).first()
    report = needed.groupBy(qkey).agg(F.lit(all_cells).alias("cells"), F.count_distinct("cell").alias("cells_visited"), F.lit(all_blocks).alias("blocks"), F.count_distinct("block").alias("blocks_visited"))
    return best, report
