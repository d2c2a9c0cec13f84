"""Queries answered from stored structures: each builds its structure in the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cells, inverted, pages, spatial
from ..sources import formats, people_store
from ..sources.scratch import root
from ..sources.tables import PEOPLE_SQL, RELATIONS_SQL, load, people, relations
from .catalog import ORACLE, _points, query


def _folder(spark, label: str) -> str:
    return f"{root(spark)}/inkfield/{label}-{uuid.uuid4().hex}"


def _answers(spark, d):
    """All of ``benchmark`` answered from an index of two segments."""
    docs, path = load(spark, d, "documents"), _folder(spark, "inverted")
    inverted.append(docs.filter("doc_id % 2 = 0"), path, 0)
    index = inverted.append(docs.filter("doc_id % 2 <> 0 OR doc_id IS NULL"), path, 1)
    return inverted.search(index, load(spark, d, "benchmark"), 5)


@query(ORACLE["bm25_topk"])
def stored_index_topk(spark, d):
    return _answers(spark, d)[0].select("item_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))


@query(None)
def stored_index_blocks(spark, d):
    """Of each item's terms, how many blocks there are and how many were read; its documents are those of ``stored_index_topk``."""
    return _answers(spark, d)[1]


def _near(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    stored = cells.build(v, _folder(spark, "cells"))
    return cells.search(stored, v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5)


@query(ORACLE["vector_topk"])
def stored_cells_topk(spark, d):
    return _near(spark, d)[0].select("query_id", "vec_id", "distance", "rank")


@query(None)
def stored_cells_visits(spark, d):
    """Of each query of ``stored_cells_topk``, the cells and blocks that it visited of all."""
    return _near(spark, d)[1]


_EDGES = ["src", "dst", "relation"]


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY src, dst, relation) - 1 AS i, count(*) OVER () AS n FROM {RELATIONS_SQL})
SELECT p AS tenth, src, dst, relation FROM r, (VALUES (0), (5), (9)) t(p) WHERE i BETWEEN n * p // 10 AND n * p // 10 + 49""")
def deep_page(spark, d):
    """Fifty edges from the beginning, the middle and nine tenths on, each from the one or two files that hold them."""
    stored = pages.store(relations(spark, d), _folder(spark, "pages"), _EDGES, 10_000)
    n = stored.total()
    every = [stored.page(50, n * p // 10).select(F.lit(p).alias("tenth"), *_EDGES) for p in (0, 5, 9)]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY src, dst, relation) AS i, count(*) OVER () AS n FROM {RELATIONS_SQL}),
k AS (SELECT src, dst, relation FROM r WHERE i = n // 2) SELECT r.src, r.dst, r.relation FROM r, k WHERE (r.src, r.dst, r.relation) > (k.src, k.dst, k.relation) ORDER BY i LIMIT 30""")
def page_after(spark, d):
    """Thirty edges after the one in the middle, found by its key."""
    stored = pages.store(relations(spark, d), _folder(spark, "pages"), _EDGES, 10_000)
    last = stored.page(1, stored.total() // 2 - 1).first()
    return stored.after(tuple(last[c] for c in _EDGES) if last else ("", "", ""), 30)


def _box(spark, d):
    return spatial.store_layout(_points(spark, d), _folder(spark, "layout"), 20).box("-0.1,-0.1,0.1,0.2")


@query(ORACLE["bbox_slice"])
def stored_box_slice(spark, d):
    return _box(spark, d)[0].orderBy("uri").offset(5).limit(100)


@query(None)
def stored_box_reads(spark, d):
    """How many files and rows of the stored layout the box of ``stored_box_slice`` reads."""
    return _box(spark, d)[1]


_CHANGES = ("family_name", "birthday")


@query(f"""WITH c AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'n:' || o_custkey ELSE 'c:' || o_custkey END AS uri, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS family_name,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE::VARCHAR ELSE '' END AS birthday FROM orders WHERE o_orderpriority <> '5-LOW'),
f AS (SELECT uri, arg_max(family_name, seq) FILTER (family_name <> '') AS family_name, arg_max(birthday, seq) FILTER (birthday <> '') AS birthday FROM c GROUP BY ALL)
SELECT uri, name, coalesce(f.family_name, p.family_name, '') AS family_name, coalesce(f.birthday, p.birthday, '') AS birthday, balance FROM {PEOPLE_SQL} p FULL JOIN f USING (uri)""")
def stored_people(spark, d):
    """People after the changes that orders make, read from the second version of their store."""
    kept = people_store.create(people(spark, d), _folder(spark, "people"), "uri", 400)
    number = F.col("o_custkey").cast("string")
    changes = load(spark, d, "orders").filter("o_orderpriority <> '5-LOW'").select(
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("n:"), number)).otherwise(F.concat(F.lit("c:"), number)).alias("uri"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("family_name"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("birthday"),
    )
    kept.upsert(changes, list(_CHANGES))
    return kept.read().select("uri", "name", *_CHANGES, "balance")


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 12 AND c_acctbal >= 0")
def sqlite_customers(spark, d):
    """Customers written as SQLite files and read from them with pushed filters."""
    formats.register(spark)
    path = _folder(spark, "sqlite")
    customers = load(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_acctbal")
    customers.write.format("sqlite_files").option("table", "customer").mode("append").save(path)
    stored = spark.read.format("sqlite_files").option("table", "customer").option("split", "500").load(path)
    return stored.filter("c_nationkey < 12 AND c_acctbal >= 0").drop("_error")
