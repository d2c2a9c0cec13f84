"""Operator 5: exact uniform shuffle into shards by a hypergeometric communication matrix.

A uniform permutation of N rows cut into shards sends a number of rows from each source
partition to each shard that follows the multivariate hypergeometric law. So

1. permute each source partition where it lies: sort its rows by a keyed hash and number them;
2. draw the matrix (partitions x shards, from the partitions' counts) and cut each partition's
   numbers by its row of the matrix: each row now has its shard;
3. exchange, and permute inside each shard: rank by a second keyed hash.

Shard sizes are exact (at most one row apart) whatever the data; equal texts, a hot source,
null or repeated ids or long texts change nothing because only the row count matters (law ``rows``). Texts never
move: only id, size and checksum are shuffled. The matrix has at most ``MOST_CELLS`` numbers: with
more source partitions than that allows, tasks take several of them together.

A shard is ranked in hash ranges whose offsets come from pre-aggregated counts, so
that no task sorts a whole shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stash, table

N_SHARDS = 40
SEED = 20_231
#: Numbers in the matrix, and rows of a range of a shard, at most and about.
MOST_CELLS, ROWS_PER_RANGE = 400_000, 50_000


def communication_matrix(block_rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows sent from each block to each shard under a uniform permutation; column sums differ by at most one."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(block_rows)
    room = np.full(n_shards, total // n_shards, dtype=np.int64)
    room[rng.permutation(n_shards)[: total % n_shards]] += 1
    sent = []
    for n in block_rows:
        row = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= row
        sent.append([int(x) for x in row])
    return sent


def shuffle_into_shards(rows: DataFrame, id_column: str = "doc_id", tie_columns: tuple[str, ...] = (), n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` and ``slot`` (its place there, gapless from 0) to ``rows``; columns of these names are replaced, all others stay.

    ``id_column`` may be null or repeated: ``tie_columns`` then order the rows, and rows equal
    in all of these are interchangeable. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    keep = F.struct(*[F.col(c) for c in rows.columns if c not in ("shard", "slot")]).alias("row")
    key = F.xxhash64(F.lit(seed), F.col(id_column), *[F.col(c) for c in tie_columns])
    local = rows.coalesce(max(1, MOST_CELLS // n_shards)).select(keep, key.alias("h")).sortWithinPartitions("h")
    # The low 33 bits are the row's place in its sorted partition.
    placed = stash(local.withColumns({"part": F.spark_partition_id(), "rank": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "op5-local")
    # One row a source partition, a bounded number of them.
    counted = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    matrix = communication_matrix([n for _, n in counted], n_shards, seed)
    upto = [(part, [int(x) for x in np.cumsum(row)]) for (part, _), row in zip(counted, matrix, strict=True)]
    cuts = F.broadcast(spark.createDataFrame(upto, "part int, upto array<bigint>"))
    shard = F.size(F.filter("upto", lambda u: u <= F.col("rank"))).cast("int")
    # Inside a shard: ranges of the second key, their offsets from counts of range and shard.
    n_ranges = pieces(sum(n for _, n in counted), n_shards * ROWS_PER_RANGE, 1)
    sent = placed.join(cuts, "part").select("row", shard.alias("shard"), F.xxhash64(F.lit(seed + 2), "h", "part", "rank").alias("g"))
    sent = sent.withColumn("range", F.floor((F.col("g") / F.lit(2.0**63) + 1.0) / 2.0 * n_ranges).cast("int"))
    per_range = sent.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per_range.select("shard", "range", (F.sum("count").over(before) - F.col("count")).alias("before"))
    inside = Window.partitionBy("shard", "range").orderBy("g")
    ranked = sent.withColumn("in_range", F.row_number().over(inside)).join(offsets, ["shard", "range"])
    return ranked.select("row.*", "shard", (F.col("before") + F.col("in_range") - 1).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``rows``.

    Null text: size 16, checksum of no bytes (0). Null or repeated doc_id: dealt like any
    row. An empty table: no rows. Other columns of the table are not read.
    """
    docs = table(spark, sf_dir, "documents")
    facts = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = shuffle_into_shards(facts, tie_columns=("text_crc32", "size"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
