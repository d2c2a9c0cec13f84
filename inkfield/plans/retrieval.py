"""Keyword, vector and hybrid retrieval as DataFrame plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.meeting import matrix, meet, squared_distances

K1, B = 1.5, 0.75
#: Rows of queries' terms that are broadcast at most; queries of a group that vectors are compared with.
MOST_BROADCAST, QUERY_BLOCK = 200_000, 1_024
#: What an answer says without a model: with sources, and without any (fixed values).
SORRY_WITH_SOURCES = "抱歉，生成回答时遇到问题。请参考以下相关来源："
SORRY = "抱歉，暂时无法生成回答，请稍后重试。"


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased; a run of Chinese characters is one token."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf), tallied before any other shuffle needs them."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_lengths(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.size(tokens(F.col(text))).alias("dl"))


def corpus_stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    n = document_lengths(docs, key)
    return n.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_len"), F.round(F.avg("dl"), 6).alias("avg_len"))


def inverse_frequencies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, idf)."""
    df = term_frequencies(docs, key).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def bm25_scores(queries: DataFrame, docs: DataFrame, qkey: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, document, score) of every document that shares a term with a query. A term repeated in a query counts as often.

    Words are cut to the queries' terms where documents lie, and move once, by document: postings, the meeting
    with the queries and the sums all follow from that partitioning, so no frequent term is hot. That holds while
    the queries' terms are few enough to broadcast (counted first); beyond, terms meet by shuffle.
    """
    q = term_frequencies(queries, qkey).withColumnRenamed("tf", "qtf")
    sent = F.broadcast if q.count() <= MOST_BROADCAST else lambda df: df
    words = docs.select(key, tokens(F.col("text")).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term"))
    postings = words.join(sent(q.select("term").distinct()), "term", "left_semi").repartition(key).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    whole = document_lengths(docs, key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weighed = postings.join(sent(df), "term").crossJoin(F.broadcast(whole)).select("term", key, (idf * F.col("tf") * (K1 + 1.0) / (F.col("tf") + K1 * (1.0 - B + B * F.col("dl") / F.col("avgdl")))).alias("w"))
    return weighed.join(sent(q), "term").groupBy(qkey, key).agg(F.sum(F.col("qtf") * F.col("w")).alias("score")).filter("score > 0")


def top_k(scores: DataFrame, query: str, key: str, k: int, best: str = "score", smaller: bool = False) -> DataFrame:
    """The k best documents of each query, ties by document; adds ``rank``."""
    order = F.asc(best) if smaller else F.desc(best)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(order, key))).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, qkey: str, key: str, k: int, places: int = 9) -> DataFrame:
    """(query, document, distance, rank): the k smallest squared distances of each query, rounded, ties by document.

    A stated query set against all rows, in blocks: queries in groups of ``QUERY_BLOCK``, rows in shards; each row goes once to every group and each
    query once to every shard. A task holds its queries' k best and passes those on.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(qkey).alias("_query"), F.col("embedding").alias("q")).filter("q IS NOT NULL")
    rows = vectors.select(F.col(key).alias("_row"), F.col("embedding").alias("x")).filter("x IS NOT NULL")
    kinds = [f.dataType.simpleString() for f in (asked.schema["_query"], rows.schema["_row"])]
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    deal = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = asked.select("*", every(shards).alias("s")).select((F.col("s") * groups + deal("_query", groups)).cast("long").alias("cell"), "_query", "q")
    streamed = rows.select("*", every(groups).alias("g")).select((deal("_row", shards) * groups + F.col("g")).cast("long").alias("cell"), "_row", "x")

    def step(state, b):
        if b is None:
            i, far, own = state["best"]
            return pa.RecordBatch.from_arrays([state["ids"].take(pa.array(i)), pa.array(own, type=state["kind"]), pa.array(far)], names=[qkey, key, "distance"])
        for at in range(0, b.num_rows, 1_024):
            c = b.slice(at, 1_024)
            own, far = c.column(4).to_numpy(zero_copy_only=False), np.round(squared_distances(state["q"], matrix(c.column(5))), places)
            few = np.argpartition(far, k - 1, axis=1)[:, :k] if k < far.shape[1] else None
            i, j = np.nonzero(far <= np.take_along_axis(far, few, axis=1).max(axis=1)[:, None]) if few is not None else np.nonzero(np.ones(far.shape, dtype=bool))
            before = state["best"]
            i, far, own = np.concatenate((before[0], i)), np.concatenate((before[1], far[i, j])), np.concatenate((before[2], own[j]))
            order = np.lexsort((own, far, i))
            i, far, own = i[order], far[order], own[order]
            first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
            kept = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
            state["best"], state["kind"] = (i[kept], far[kept], own[kept]), b.schema.field(4).type
        return None

    def start(t: pa.Table):
        return {"ids": t["_query"].combine_chunks(), "q": matrix(t["q"]), "best": (np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int))}

    found = meet(held, streamed, shards * groups, start, step, f"{qkey} {kinds[0]}, {key} {kinds[1]}, distance double")
    return top_k(found, qkey, key, k, "distance", smaller=True)


def min_max(hits: DataFrame, query: str, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(query)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return hits.withColumn(out, (F.col(value) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, query: str, key: str, alpha: float, k: int) -> DataFrame:
    """Min-max fusion: similarity 1/(1+distance) on one side, keyword score on the other, a missing side counts 0."""
    v = min_max(vector_hits.withColumn("sim", 1.0 / (1.0 + F.col("distance"))), query, "sim", "v").select(query, key, "v")
    b = min_max(keyword_hits, query, "score", "b").select(query, key, "b")
    both = v.join(b, [query, key], "full_outer")
    fused = both.select(
        query,
        key,
        F.when(F.col("v").isNotNull(), "vector").otherwise("bm25").alias("source"),
        F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1.0 - alpha) * F.coalesce("b", F.lit(0.0)), 6).alias("score"),
    )
    return top_k(fused, query, key, k)


def reciprocal_rank(vector_hits: DataFrame, keyword_hits: DataFrame, query: str, key: str, k: int, offset: int = 60) -> DataFrame:
    every = vector_hits.select(query, key, "rank").unionByName(keyword_hits.select(query, key, "rank"))
    fused = every.groupBy(query, key).agg(F.round(F.sum(1.0 / (offset + F.col("rank"))), 9).alias("score"))
    return top_k(fused, query, key, k)


def per_collection(scores: DataFrame, query: str, key: str, collections: DataFrame, k: int, n_collections: int) -> DataFrame:
    """The best few of each collection, k // collections + 1 each, then the k best overall."""
    each = max(1, k // max(1, n_collections) + 1)
    named = scores.join(collections, key)
    few = named.withColumn("in_collection", F.row_number().over(Window.partitionBy(query, "source").orderBy(F.desc("score"), key))).filter(F.col("in_collection") <= each).drop("in_collection")
    return top_k(few, query, key, k)


def tfidf_fit(docs: DataFrame, key: str = "doc_id", features: int = 768) -> DataFrame:
    """The model (term, place, idf): the most frequent terms of a corpus, with their places in a vector, in order of the terms."""
    kept = term_frequencies(docs, key).groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    place = (F.row_number().over(Window.orderBy("term")) - 1).alias("place")  # as many rows as features
    return kept.crossJoin(F.broadcast(n)).select("term", place, (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_weights(model: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, place, weight): texts, of the corpus or new, under a fitted model; rows of unit length. Texts without a term of the model have no rows."""
    raw = term_frequencies(texts, key, text).join(F.broadcast(model), "term").select(key, "term", "place", (F.col("tf") * F.col("idf")).alias("w"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).drop("w")


def tfidf_vectors(model: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, vector) of every text under a fitted model; zeros where it has none of the model's terms."""
    size = F.broadcast(model.agg(F.count(F.lit(1)).cast("int").alias("size")))
    own = tfidf_weights(model, texts, key, text).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("m"))
    each = texts.select(key).distinct().join(own, key, "left").crossJoin(size)
    return each.select(key, F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).otherwise(F.array().cast("array<double>")).alias("vector"))


def tfidf(docs: DataFrame, key: str = "doc_id", features: int = 768) -> DataFrame:
    """(document, term, weight): smoothed TF-IDF over the most frequent terms, rows of unit length."""
    return tfidf_weights(tfidf_fit(docs, key, features), docs, key).drop("place")


def prompt(hits: DataFrame, query: str) -> DataFrame:
    """Numbered context blocks of each query's hits, in rank order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("text"))
    return hits.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"))


def with_fallback(queries: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """Hits, and one row of method ``fallback`` for each query without any."""
    return queries.select(query).join(hits, query, "left").select(query, F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.when(F.col("doc_id").isNull(), "fallback").otherwise("bm25").alias("method"))


def shown_title(chapter: Column, title: Column) -> Column:
    """The chapter's title, or the document's where that is empty or "Unknown"."""
    chapter = F.coalesce(chapter, F.lit(""))
    return F.when(chapter.isin("", "Unknown"), F.coalesce(title, F.lit(""))).otherwise(chapter)


def retrieve(vector_hits: DataFrame, keyword_hits: DataFrame, passages: DataFrame, query: str, key: str, alpha: float, k: int) -> DataFrame:
    """(query, document, title, source, score, rank): fused hits of queries with both kinds, else those of the kind that there is.

    ``passages`` has the documents' ``chapter`` and ``title``; hits by keywords alone keep the chapter as it is. Vector
    hits alone are scored by their distance, as they come. Queries without hits have no rows.
    """
    v, b = vector_hits.select(query).distinct(), keyword_hits.select(query).distinct()
    fused = hybrid(vector_hits.join(b, query, "left_semi"), keyword_hits.join(v, query, "left_semi"), query, key, alpha, k).drop("rank")
    only_v = vector_hits.join(b, query, "left_anti").select(query, key, F.lit("vector").alias("source"), F.col("distance").alias("score"))
    only_b = keyword_hits.join(v, query, "left_anti").select(query, key, F.lit("bm25").alias("source"), "score")
    named = lambda hits, title: hits.join(passages.select(key, title.alias("title")), key)
    shown = shown_title(F.col("chapter"), F.col("title"))
    every = named(fused.unionByName(only_v), shown).unionByName(named(only_b, F.coalesce("chapter", F.lit(""))))
    return top_k(every, query, key, k)


def of_source(collections: DataFrame, source: str | None) -> DataFrame:
    """Rows of the collections asked for: all for none or "all", else those of one source (none if it is unknown)."""
    return collections if source in (None, "", "all") else collections.filter(F.col("source") == source)


def plain_answers(queries: DataFrame, hits: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(query, answer) without a model: the sources of the best hits, or an apology."""
    listed = hits.filter(F.col("rank") <= most).groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: F.concat(F.lit("- "), x["source"])), "\n").alias("sources"))
    answer = F.when(F.col("sources").isNull(), SORRY).otherwise(F.concat(F.lit(SORRY_WITH_SOURCES + "\n"), F.col("sources")))
    return queries.select(query).join(listed, query, "left").select(query, answer.alias("answer"))
