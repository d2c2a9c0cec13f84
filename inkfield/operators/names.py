"""Places of many names in texts by Aho-Corasick automata, one for each shard of the names."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .meeting import meet

#: Names of one automaton; texts of one batch that are read at a time.
SHARD, PART = 100_000, 4


@lru_cache(maxsize=2)
def _automaton(names: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for n in names:
        made.add_word(n, len(n))
    made.make_automaton()
    return made


def places(docs: DataFrame, names: DataFrame, key: str, text: str = "text", shard: int = SHARD) -> DataFrame:
    """(key, start, end, name) of every place of every name in every text, overlaps included, in characters from 0.

    Names (distinct, not null, not empty) are dealt by hash to shards of bounded size. Each shard's automaton is built where its texts
    are read, and a text is read once for each shard, from its first character to its last; neither names nor texts are cut into substrings. Null texts have no places.
    """
    spark = docs.sparkSession
    known = names.select("name").filter("name IS NOT NULL AND name <> ''").distinct()
    shards = max(1, -(-known.count() // shard))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * PART // shards)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    kind = docs.schema[key].dataType.simpleString()
    held = known.groupBy(deal("name", shards).alias("s")).agg(F.sort_array(F.collect_list("name")).alias("names")).select("s", "names", every(parts).alias("p"))
    held = held.select((F.col("s") * parts + F.col("p")).cast("long").alias("cell"), "names")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).filter("_text <> ''")
    streamed = rows.select("*", every(shards).alias("s")).select((F.col("s") * parts + deal("_text", parts)).cast("long").alias("cell"), "_key", "_text")
    out = pa.schema([(key, to_arrow_type(docs.schema[key].dataType)), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string())])

    def start(t: pa.Table):
        return _automaton(tuple(n for own in t["names"].to_pylist() for n in own))

    def step(made, b):
        if b is None:
            return None
        row, begin, end, name = [], [], [], []
        for i, x in enumerate(b.column(4).to_pylist()):
            for last, size in made.iter(x):
                row.append(i)
                begin.append(last + 1 - size)
                end.append(last + 1)
                name.append(x[last + 1 - size : last + 1])
        keys = b.column(3).take(pa.array(row, type=pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], schema=out)

    return meet(held, streamed, shards * parts, start, step, f"{key} {kind}, start int, end int, name string")


def longest(found: DataFrame, key: str) -> DataFrame:
    """Of places, those that no longer one covers: at each start the longest name, and none inside another."""
    by_start = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("end").over(by_start)).filter("reach IS NULL OR end > reach").drop("reach")


def nearest_before(found: DataFrame, marks: DataFrame, key: str, within: int) -> DataFrame:
    """``marks`` (key, at) with ``name``: the name that ends nearest before each mark, at most ``within`` characters away, the longest of equal ones."""
    both = found.select(key, F.col("end").alias("at"), F.struct("end", (F.col("end") - F.col("start")).alias("size"), "name").alias("hit")).unionByName(marks.select(key, "at"), allowMissingColumns=True)
    last = F.max("hit").over(Window.partitionBy(key).orderBy("at").rangeBetween(-within, 0))
    return both.withColumn("last", last).filter("hit IS NULL AND last IS NOT NULL").select(key, "at", F.col("last.name").alias("name"))
