"""Names that differ by few edits: a self-join by segments, and the clusters that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .graph import clusters

#: Names of a segment's text from which on they are dealt over several tasks.
HOT_SEGMENT = 1_000


def similar_pairs(names: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, distance) of distinct names, a before b, whose similarity 1 - distance / longer length is ``percent`` at least.

    A pair (l <= L characters) has at most t = (100 - percent) * L // 100 edits. Cut the shorter name into more
    segments than edits are possible for any partner, and one of them is whole in the longer name, shifted by no more than the edits before it and those
    after it allow. So names are joined by (length, segment number, text), which is exact, and the pairs are verified. Names of which a segment has very many are dealt
    over tasks; nothing is left out. Null and empty names pair nothing.
    """
    own = stash(names.select("name").filter("name IS NOT NULL AND name <> ''").distinct().withColumn("l", F.length("name").cast("long")), "names")
    # Of a length l: edits t with its longest partner, k segments, the first ones base characters long and the others one more.
    t = lambda l: f"({100 - percent} * ({l} * 100 div {percent}) div 100)"  # noqa: E731, E741
    k, base = (lambda l: f"({t(l)} + 1)"), (lambda l: f"({l} div ({t(l)} + 1))")  # noqa: E731, E741
    few = lambda l: f"({k(l)} - {l} % {k(l)})"  # noqa: E731, E741
    start = lambda l: f"(i * {base(l)} + greatest(0L, i - {few(l)}))"  # noqa: E731, E741
    size = lambda l: f"({base(l)} + if(i >= {few(l)}, 1, 0))"  # noqa: E731, E741
    held = own.selectExpr("name AS b", "l", f"explode(sequence(0L, {t('l')})) AS i").selectExpr("b", "l", "i", f"substring(b, int({start('l')} + 1), int({size('l')})) AS segment")
    asked = own.selectExpr("name AS a", "l AS own", f"explode(sequence((l * {percent} + 99) div 100, l)) AS l").selectExpr("a", "own", "l", f"explode(sequence(0L, {t('l')})) AS i")
    low = f"greatest(0L, {start('l')} - i, {start('l')} + own - l - ({t('l')} - i))"
    high = f"least(own - {size('l')}, {start('l')} + i, {start('l')} + own - l + ({t('l')} - i))"
    asked = asked.selectExpr("a", "l", "i", f"{size('l')} AS size", f"{low} AS low", f"{high} AS high").filter("low <= high")
    asked = asked.selectExpr("a", "l", "i", "size", "explode(sequence(low, high)) AS at").selectExpr("a", "l", "i", "substring(a, int(at + 1), int(size)) AS segment").distinct()
    # Segments of many names: their names are dealt to salts, and those who ask for them go to every salt.
    counted = held.groupBy("l", "i", "segment").agg(F.ceil(F.count(F.lit(1)) / HOT_SEGMENT).cast("int").alias("salts"))
    hot = stash(counted.filter("salts > 1"), "names-hot")
    salted = lambda df: df.join(hot, ["l", "i", "segment"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    if not hot.isEmpty():
        held = salted(held).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
        asked = salted(asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    keys = [c for c in ("l", "i", "segment", "salt") if c in held.columns]
    near = held.join(asked, keys).filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b")
    allowed = (F.greatest(F.length("a"), F.length("b")) * (100 - percent) / 100).cast("int")
    near = near.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= allowed)
    return near.distinct()


def resolved(names: DataFrame, percent: int = 75) -> DataFrame:
    """(name, cluster): names tied by similar pairs, each with the smallest name that it can be reached from; null and empty names have no row."""
    pairs = similar_pairs(names, percent).select("a", "b")
    alone = names.select(F.col("name").alias("a"), F.col("name").alias("b")).filter("a <> ''").distinct()
    return clusters(pairs.unionByName(alone)).withColumnRenamed("node", "name")
