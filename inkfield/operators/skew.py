"""Joins and numbering that no single key or order sends to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash

#: A key is hot with more than this many rows, and more than a HOT_KEYS-th of all: there are fewer than HOT_KEYS hot keys, whatever the table.
HOT_ROWS, HOT_KEYS = 2_000, 10_000


def hot_from(total: int) -> int:
    return max(HOT_ROWS, total // HOT_KEYS)


def join_counted(big: DataFrame, small: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (one row a key, whose ``n`` counts the key's rows in ``big``; ``total`` of all).

    Hot keys' rows of ``small``, fewer than HOT_KEYS, are broadcast, so that the rows of a hot key stay
    spread as they lie; the others meet by shuffle, no key with more than ``hot_from(total)`` rows.
    """
    limit = hot_from(total)
    hot = small.filter(F.col(n) > limit)
    if hot.isEmpty():
        return big.join(small, keys, how)
    hot = F.broadcast(hot)
    cold = big.join(hot.select(*keys), keys, "left_anti").join(small.filter(F.col(n) <= limit), keys, how)
    return big.join(hot, keys, "left_semi" if how == "left_semi" else "inner").unionByName(cold)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in a total order: a distributed sort, written once, then numbered part by part from the parts' counts."""
    parts = stash(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = dict(parts.groupBy("_part").count().collect())  # one row for each part of the sort
    before, at = [], 0
    for part in sorted(counts):
        before.append((part, at))
        at += counts[part]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))  # empty for an empty table
    inside = Window.partitionBy("_part").orderBy(*order)
    return parts.join(offsets, "_part").withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long")).drop("_part", "_before")
