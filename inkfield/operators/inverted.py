"""A stored inverted index: impact-ordered postings in blocks, appended by segments, and top-k search that skips blocks.

A segment has three Parquet tables, each written once:

* ``postings``: rows are blocks of at most ``BLOCK`` postings of one term (documents, frequencies, lengths), the term's heaviest
  first, with what bounds the block (largest frequency, smallest length) beside them. A distributed sort
  by term and impact makes them, so the postings of a frequent term lie over many tasks and files; files have
  bounds of terms.
* ``documents``: of each document its length and its terms, by ranges of the key, to score candidates.
* ``totals``: one row, documents and words.

Bounds hold under any average length, so segments stay as they are when others are appended.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash

K1, B = 1.5, 0.75
#: Postings of a block; blocks of each term that are read first, for a bound; rows that are broadcast at most.
BLOCK, FIRST, MOST_BROADCAST = 128, 2, 200_000
#: Scores are compared with bounds less this, as they are rounded to six places.
SLACK = 2e-6


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a posting adds to a score, but for the term's weight; larger with ``tf``, smaller with ``dl``."""
    return tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * dl / avgdl))


@dataclass
class Index:
    spark: SparkSession
    path: str
    key: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/segment=*")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def documents(self) -> DataFrame:
        return self._read("documents")

    def totals(self) -> tuple[float, float]:
        """Documents, and their average length."""
        n, words = self._read("totals").agg(F.sum("n").cast("double"), F.sum("words").cast("double")).first()
        return n, words / n if n else 0.0


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """Blocks of (term, key, tf, dl) rows that are sorted within partitions by term and falling impact."""
    kind = rows.schema[key].dataType.simpleString()

    def run(it):
        made = TaskContext.get().partitionId() << 32
        for b in it:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode().indices.to_numpy()
            new = np.flatnonzero(np.concatenate(([True], coded[1:] != coded[:-1])))
            run_of = np.repeat(new, np.diff(np.concatenate((new, [len(coded)]))))
            cut = np.flatnonzero((np.arange(len(coded)) - run_of) % BLOCK == 0)
            offsets = pa.array(np.concatenate((cut, [len(coded)])), type=pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, b.column(i)) for i in (1, 2, 3)]
            tf, dl = b.column(2).to_numpy(), b.column(3).to_numpy()
            block, made = made + np.arange(len(cut)), made + len(cut)
            small = [np.diff(offsets.to_numpy()).astype(np.int32), np.maximum.reduceat(tf, cut), np.minimum.reduceat(dl, cut)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cut)), pa.array(block, type=pa.int64()), *[pa.array(s, type=pa.int32()) for s in small], *lists], names=["term", "block", "n", "top_tf", "least_dl", "docs", "tfs", "dls"])

    return rows.select("term", key, "tf", "dl").mapInArrow(run, f"term string, block long, n int, top_tf int, least_dl int, docs array<{kind}>, tfs array<int>, dls array<int>")


def append(docs: DataFrame, path: str, segment: int, key: str = "doc_id", text: str = "text", tasks: int | None = None) -> Index:
    """Write a segment of documents, whose keys no other segment has; one pass over the texts.

    A null text has no words; it counts as a document of length 0. An empty table gives an empty segment. Segment numbers name
    folders: one that exists raises.
    """
    spark = docs.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Sorted before they are cut into words, as the sort samples what it is given.
    sorted_docs = docs.select(key, text).repartitionByRange(tasks, key).sortWithinPartitions(key)
    own = sorted_docs.select(key, tokens(F.col(text)).alias("t")).select(key, F.size("t").alias("dl"), F.sort_array("t").alias("t"))
    # The places where a sorted list of words has a new one give the terms, and their distances the frequencies.
    placed = own.select(key, "dl", "t", F.expr("array_compact(transform(t, (x, i) -> if(i = 0 OR x <> t[i - 1], i, null)))").alias("at"))
    counted = placed.select(key, "dl", F.expr("transform(at, x -> t[x])").alias("terms"), F.expr("transform(at, (x, i) -> coalesce(get(at, i + 1), dl) - x)").alias("tfs"))
    at = f"{path}/documents/segment={segment}"
    counted.write.parquet(at)
    stored = spark.read.parquet(at)
    totals = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("words"))
    totals.write.parquet(f"{path}/totals/segment={segment}")
    n, words = spark.read.parquet(f"{path}/totals/segment={segment}").first()
    each = stored.select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), key, F.col("p.tfs").alias("tf"), "dl")
    order = [F.col("term"), impact(F.col("tf"), F.col("dl"), F.lit(max(words / n, 1.0) if n else 1.0)).desc(), F.col(key)]
    blocks(each.repartitionByRange(tasks, *order).sortWithinPartitions(*order), key).write.parquet(f"{path}/postings/segment={segment}")
    return Index(spark, path, key)


def search(index: Index, queries: DataFrame, k: int, qkey: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((query, document, score, rank), (query, blocks, read)): the k best documents of each query by BM25, scores rounded to six places, ties by document; and how many blocks its terms have and how many of them it needed.

    Three readings. The heaviest blocks of each term give partial scores, whose k-th best is a lower bound. Then a query's terms
    whose largest impacts together stay below the bound name no candidates; of the other terms, blocks that with the largest
    impacts of all other terms stay below it are skipped. Documents that can still reach the bound are scored from their own terms. A
    document left out has a score below the bound, so the result is exact. Queries without a hit have no rows.
    """
    key = index.key
    n, avgdl = index.totals()
    q = queries.select(qkey, F.explode(tokens(F.col(text))).alias("term")).groupBy(qkey, "term").agg(F.count(F.lit(1)).alias("qtf"))
    hint = F.broadcast if q.count() <= MOST_BROADCAST else lambda df: df
    postings = index.postings().withColumn("block", F.struct("segment", "block"))
    heads = stash(postings.join(hint(q.select("term").distinct()), "term", "left_semi").select("term", "block", "n", "top_tf", "least_dl"), "index-heads")
    df = heads.groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weights = stash(q.join(df, "term").select(qkey, "term", (F.col("qtf") * idf).alias("w")), "index-weights")
    bound = F.col("w") * impact(F.col("top_tf"), F.col("least_dl"), F.lit(avgdl or 1.0))
    bounds = stash(heads.join(hint(weights), "term").select(qkey, "term", "block", "w", bound.alias("bound")), "index-bounds")
    upper = bounds.groupBy(qkey, "term").agg(F.max("bound").alias("upper"))

    def scored(chosen: DataFrame) -> DataFrame:
        """(query, document, partial score) of chosen blocks."""
        few = chosen.select("term", "block").distinct()
        few = F.broadcast(few) if few.count() <= MOST_BROADCAST else few
        opened = postings.join(few, ["term", "block"], "left_semi").select("term", "block", F.arrays_zip("docs", "tfs", "dls").alias("p"))
        met = opened.join(chosen, ["term", "block"]).select(qkey, "w", F.explode("p").alias("p"))
        part = F.col("w") * impact(F.col("p.tfs"), F.col("p.dls"), F.lit(avgdl or 1.0))
        return met.select(qkey, F.col("p.docs").alias(key), part.alias("s")).groupBy(qkey, key).agg(F.sum("s").alias("s"))

    # A term's heaviest blocks by bound: a top-k of each, cut before the shuffle.
    heaviest = bounds.withColumn("i", F.row_number().over(Window.partitionBy(qkey, "term").orderBy(F.desc("bound"), "block"))).filter(F.col("i") <= FIRST).drop("i")
    heaviest = stash(heaviest, "index-heaviest")
    ranked = scored(heaviest).withColumn("i", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("s"), key))).filter(F.col("i") == k)
    least = stash(queries.select(qkey).distinct().join(ranked.select(qkey, "s"), qkey, "left").select(qkey, (F.coalesce("s", F.lit(0.0)) - SLACK).alias("least")), "index-least")
    upto = Window.partitionBy(qkey).orderBy("upper", "term").rowsBetween(Window.unboundedPreceding, 0)
    ruled = upper.withColumn("upto", F.sum("upper").over(upto)).withColumn("all", F.sum("upper").over(Window.partitionBy(qkey))).join(hint(least), qkey)
    # Terms that name candidates, what all others of the query can add at most, and what the terms that name none can.
    ruled = ruled.withColumn("naming", F.col("upto") >= F.col("least")).withColumn("silent", F.sum(F.when(F.col("naming"), 0.0).otherwise(F.col("upper"))).over(Window.partitionBy(qkey)))
    ruled = stash(ruled, "index-ruled")
    needed = bounds.join(hint(ruled), [qkey, "term"]).filter("naming AND bound + `all` - upper >= least")
    needed = stash(needed.select(qkey, "term", "block", "w"), "index-needed")
    silent = ruled.select(qkey, "silent", "least").distinct()
    candidates = stash(scored(needed).join(hint(silent), qkey).filter("s + silent >= least").select(qkey, key), "index-candidates")
    asked = candidates.select(key).distinct()
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    own = index.documents().join(asked, key, "left_semi").select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    own = own.join(hint(weights.select("term").distinct()), "term", "left_semi")
    whole = candidates.join(own, key).join(hint(weights), [qkey, "term"]).groupBy(qkey, key).agg(F.round(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), F.lit(avgdl or 1.0))), 6).alias("score"))
    best = whole.withColumn("rank", F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)
    seen = needed.select(qkey, "term", "block").union(heaviest.select(qkey, "term", "block")).distinct().groupBy(qkey).agg(F.count(F.lit(1)).alias("read"))
    report = bounds.groupBy(qkey).agg(F.count(F.lit(1)).alias("blocks")).join(seen, qkey).select(qkey, "blocks", "read")
    return best, report
