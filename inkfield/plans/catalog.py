"""Every query of the engine by name, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people as kin
from ..functions import text as tx
from ..operators import graph, insights, relational
from ..sources.tables import PEOPLE_SQL, RELATIONS_SQL, load, people, relations
from . import fixtures as fx
from . import retrieval as rt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
P, R = PEOPLE_SQL, RELATIONS_SQL
ENDS = ".!?;"


def query(sql: str | None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ retrieval

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_BM25 = f"""
tok AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, sum(qtf * (ln((n - df + 5e-1) / (df + 5e-1) + 1e0) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl)))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _scores(spark, d):
    return rt.bm25_scores(load(spark, d, "benchmark"), load(spark, d, "documents"))


@query(f"WITH dl AS (SELECT len({_TOK}) AS dl FROM documents) SELECT count(*) AS n_docs, sum(dl)::BIGINT AS total_len, round(avg(dl), 6) AS avg_len FROM dl")
def bm25_corpus_stats(spark, d):
    return rt.corpus_stats(load(spark, d, "documents"))


@query(f"WITH {_BM25} SELECT term, df, round(ln((n - df + 5e-1) / (df + 5e-1) + 1e0), 6) AS idf FROM df, st")
def bm25_idf(spark, d):
    return rt.inverse_frequencies(load(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc) SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_topk(spark, d):
    return rt.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 5)


_VEC = """dist AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {_VEC}, r AS (SELECT query_id, vec_id, round(distance, 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM dist) SELECT * FROM r WHERE rank <= 5")
def vector_topk(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return rt.nearest(q, v, "query_id", "vec_id", 5)


_HITS = f"""{_BM25},
kw AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(score, 6) AS score FROM sc) QUALIFY rank <= 10),
di AS (SELECT q.vec_id AS item_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))), 9) AS distance
  FROM embeddings q JOIN benchmark ON q.vec_id = item_id, embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
ve AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM di QUALIFY rank <= 10)"""


def _hits(spark, d):
    """Ten keyword and ten vector hits of each benchmark item; a document's vector is the one of its id."""
    kw = rt.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 10)
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.withColumnRenamed("doc_id", "item_id").join(load(spark, d, "benchmark").select("item_id"), "item_id", "left_semi")
    stored = v.join(load(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    return rt.nearest(q, stored, "item_id", "doc_id", 10), kw


_HYBRID = f"""{_HITS},
v AS (SELECT item_id, doc_id, (s - min(s) OVER w) / CASE WHEN max(s) OVER w > min(s) OVER w THEN max(s) OVER w - min(s) OVER w ELSE 1 END AS v FROM (SELECT *, 1 / (1 + distance) AS s FROM ve) WINDOW w AS (PARTITION BY item_id)),
b AS (SELECT item_id, doc_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS b FROM kw WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT item_id, doc_id, CASE WHEN v IS NOT NULL THEN 'vector' ELSE 'bm25' END AS source, round(5e-1 * coalesce(v, 0) + 5e-1 * coalesce(b, 0), 6) AS score FROM v FULL JOIN b USING (item_id, doc_id))
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5"""


@query(f"WITH {_HYBRID}")
def hybrid_minmax(spark, d):
    v, b = _hits(spark, d)
    return rt.hybrid(v, b, "item_id", "doc_id", 0.5, 5)


@query(f"WITH {_HITS}, f AS (SELECT item_id, doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM ve UNION ALL SELECT item_id, doc_id, rank FROM kw) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5")
def hybrid_rrf(spark, d):
    v, b = _hits(spark, d)
    return rt.reciprocal_rank(v, b, "item_id", "doc_id", 5)


@query(f"""WITH {_BM25}, few AS (SELECT item_id, doc_id, source, round(score, 6) AS score FROM sc JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY round(score, 6) DESC, doc_id) <= 1)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM few QUALIFY rank <= 5""")
def per_collection_topk(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source")
    return rt.per_collection(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", docs, 5, docs.select("source").distinct().count())


@query("SELECT source AS collection, count(*) AS n FROM documents GROUP BY ALL")
def list_collections(spark, d):
    return load(spark, d, "documents").groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BM25}, kept AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL ORDER BY total DESC, term LIMIT 768),
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + kept.df)) + 1) AS w FROM tf JOIN kept USING (term), st)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, d):
    return rt.tfidf(load(spark, d, "documents")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_BM25}, kept AS (SELECT term, df, row_number() OVER (ORDER BY term) AS place FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL ORDER BY total DESC, term LIMIT 768)),
w AS (SELECT item_id, place, qtf * (ln((1 + n) / (1 + df)) + 1) AS w FROM q JOIN kept USING (term), st)
SELECT item_id, place::INT AS place, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w""")
def tfidf_new_texts(spark, d):
    """Vectors of ``benchmark`` under the model of ``documents``, without their zeros; places from 1."""
    model = rt.tfidf_fit(load(spark, d, "documents"))
    v = rt.tfidf_vectors(model, load(spark, d, "benchmark"), "item_id").select("item_id", F.posexplode("vector").alias("place", "weight"))
    return v.filter("weight <> 0").select("item_id", (F.col("place") + 1).alias("place"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {_BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 3)
SELECT item_id, string_agg('[' || rank || '] ' || source || chr(10) || substring(text, 1, 80), chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents USING (doc_id) GROUP BY ALL""")
def prompt_context(spark, d):
    top = rt.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 3)
    return rt.prompt(top.join(load(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 80).alias("text")), "doc_id"), "item_id")


@query(f"""WITH {_BM25}, r AS (SELECT item_id, doc_id FROM sc WHERE score > 20 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) = 1)
SELECT b.item_id, coalesce(doc_id, -1) AS doc_id, CASE WHEN doc_id IS NULL THEN 'fallback' ELSE 'bm25' END AS method FROM benchmark b LEFT JOIN r USING (item_id)""")
def evidence_fallback(spark, d):
    top = rt.top_k(_scores(spark, d).filter("score > 20").withColumn("score", F.round("score", 6)), "item_id", "doc_id", 1)
    return rt.with_fallback(load(spark, d, "benchmark"), top, "item_id")


# ------------------------------------------------------------------ relational


@query(f"SELECT count(*) AS n FROM {P}")
def person_count(spark, d):
    return relational.count(people(spark, d))


@query(f"SELECT uri, name, family_name FROM {P} ORDER BY uri LIMIT 20 OFFSET 40")
def person_page(spark, d):
    return relational.page(people(spark, d), 20, 40).select("uri", "name", "family_name")


@query(f"SELECT uri, name, family_name FROM {P} WHERE family_name = 'BUILDING' ORDER BY uri LIMIT 20")
def person_page_surname(spark, d):
    return relational.page(people(spark, d), 20, 0, "BUILDING").select("uri", "name", "family_name")


@query(f"SELECT uri FROM {P} WHERE uri IN (SELECT src FROM {R} UNION SELECT dst FROM {R})")
def has_relations_semi(spark, d):
    return people(spark, d).join(relational.related_ids(relations(spark, d)), "uri", "left_semi").select("uri")


@query(f"SELECT src AS source, dst AS target, relation AS type FROM {R} WHERE src = 'c:7' OR dst = 'c:7'")
def incident_edges(spark, d):
    return relational.incident_edges(relations(spark, d), "c:7")


@query(f"SELECT * FROM {R} ORDER BY src, dst, relation LIMIT 50 OFFSET 100")
def edge_page(spark, d):
    return relational.edge_page(relations(spark, d), 50, 100)


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def bridge_top5(spark, d):
    return relational.first_of_each(load(spark, d, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rn")


@query(f"""SELECT uri, 'work' AS kind, 'o:' || o_orderkey AS item, 9e-1 AS confidence FROM {P} JOIN orders ON uri = 'c:' || o_custkey QUALIFY row_number() OVER (PARTITION BY uri ORDER BY o_orderkey) <= 5
UNION ALL SELECT uri, 'place', n_name, 8e-1 FROM {P} JOIN nation ON role = 'n' || n_nationkey""")
def evidence_union(spark, d):
    p = people(spark, d)
    works = p.join(load(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("uri"), "o_orderkey"), "uri")
    works = relational.first_of_each(works, "uri", [F.col("o_orderkey")], 5).select("uri", F.lit("work").alias("kind"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("item"), F.lit(0.9).alias("confidence"))
    places = p.join(load(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("role"), "n_name"), "role").select("uri", F.lit("place").alias("kind"), F.col("n_name").alias("item"), F.lit(0.8).alias("confidence"))
    return works.unionByName(places)


def _points(spark, d):
    e = load(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("uri"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


_PT = "(SELECT vec_id::VARCHAR AS uri, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(f"SELECT * FROM {_PT} WHERE x BETWEEN -1e-1 AND 1e-1 AND y BETWEEN -1e-1 AND 2e-1 ORDER BY uri LIMIT 100 OFFSET 5")
def bbox_slice(spark, d):
    return relational.in_box(_points(spark, d), "-0.1,-0.1,0.1,0.2").orderBy("uri").offset(5).limit(100)


@query(f"SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM {_PT}")
def layout_meta(spark, d):
    return relational.layout_extent(_points(spark, d))


@query(f"""SELECT uri, coalesce(name, uri) AS name, coalesce(family_name, '') AS family_name, x FROM (SELECT 'c:' || uri AS uri, x FROM {_PT}) LEFT JOIN {P} USING (uri)""")
def layout_people(spark, d):
    pts = _points(spark, d).select(F.concat(F.lit("c:"), "uri").alias("uri"), "x")
    return pts.join(people(spark, d), "uri", "left").select("uri", F.coalesce("name", "uri").alias("name"), F.coalesce("family_name", F.lit("")).alias("family_name"), "x")


@query("SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS tail FROM pages")
def uri_tail(spark, d):
    return load(spark, d, "pages").select("page_id", relational.uri_tail(F.col("url")).alias("tail"))


@query(f"SELECT uri, TRY_CAST(nullif(regexp_extract(trim(birthday), '^-?[0-9]{{2,4}}'), '') AS INTEGER) AS birth_year FROM {P}")
def birth_year_parse(spark, d):
    return people(spark, d).select("uri", relational.birth_year(F.col("birthday")).alias("birth_year"))


@query("SELECT doc_id, substring(coalesce(nullif(text, ''), lang, ''), 1, 300) AS snippet FROM documents")
def snippets(spark, d):
    return load(spark, d, "documents").select("doc_id", relational.snippet(F.col("text"), F.col("lang"), 300).alias("snippet"))


@query(f"SELECT uri, greatest(0e0, least(1e0, 1 - abs(x) * 10)) AS confidence FROM {_PT}")
def confidence_clamp(spark, d):
    return _points(spark, d).select("uri", relational.confidence(F.abs("x") * 10).alias("confidence"))


@query("SELECT doc_id FROM documents WHERE contains(text || lang, 'the')")
def substring_filter(spark, d):
    return load(spark, d, "documents").filter(F.concat("text", "lang").contains("the")).select("doc_id")


@query(f"SELECT src, dst, relation FROM {R} WHERE src IN (SELECT uri FROM {P} WHERE family_name = 'BUILDING') AND dst IN (SELECT DISTINCT dst FROM {R} WHERE relation = 'R')")
def induced_edges(spark, d):
    r = relations(spark, d)
    nodes = people(spark, d).filter("family_name = 'BUILDING'").select("uri").union(r.filter("relation = 'R'").select("dst"))
    return relational.induced_edges(r, nodes)


# ------------------------------------------------------------------ insights


@query(f"SELECT family_name, count(*) AS n FROM {P} WHERE family_name <> '' GROUP BY ALL ORDER BY n DESC, family_name LIMIT 3")
def top_surnames(spark, d):
    return insights.top_surnames(people(spark, d), 3)


@query(f"""WITH r AS (SELECT n, row_number() OVER (ORDER BY n DESC, family_name) AS r FROM (SELECT family_name, count(*) AS n FROM {P} GROUP BY ALL)), t AS (SELECT count(*) AS total FROM {P}),
s AS (SELECT sum(n) FILTER (r <= 1)::BIGINT AS top1, sum(n) FILTER (r <= 5)::BIGINT AS top5, sum(n) FILTER (r <= 20)::BIGINT AS top20 FROM r)
SELECT total, top1, top5, top20, round(top1 / total, 6) AS share1, round(top5 / total, 6) AS share5, CASE WHEN top1 / total > 5e-2 THEN 'concentrated' ELSE 'spread' END AS label FROM s, t""")
def surname_concentration(spark, d):
    return insights.surname_concentration(people(spark, d))


@query(f"SELECT role AS family_name, count(*) AS n FROM {P} GROUP BY ALL ORDER BY n DESC, role LIMIT 5")
def role_top5(spark, d):
    return insights.top_surnames(people(spark, d).drop("family_name").withColumnRenamed("role", "family_name"), 5)


@query(f"SELECT count(*) FILTER (family_name IN ('BUILDING', 'MACHINERY')) AS n_first, count(*) FILTER (family_name = 'AUTOMOBILE') AS n_second, round(count(*) FILTER (family_name IN ('BUILDING', 'MACHINERY')) / nullif(count(*) FILTER (family_name = 'AUTOMOBILE'), 0), 6) AS ratio FROM {P}")
def gender_ratio(spark, d):
    return insights.ratio(people(spark, d), "family_name", ["BUILDING", "MACHINERY"], ["AUTOMOBILE"])


@query(f"SELECT p AS persons, r AS relations, round(1e2 * r / p, 4) AS percent FROM (SELECT count(*) AS p FROM {P}), (SELECT count(*) AS r FROM {R})")
def completeness(spark, d):
    return insights.completeness(people(spark, d), relations(spark, d))


_DEG = f"deg AS (SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM {R} UNION ALL SELECT dst FROM {R}) GROUP BY ALL)"


@query(f"""WITH {_DEG}, o AS (SELECT list_sort(list(degree)) AS l FROM deg)
SELECT count(*) AS nodes, round(avg(degree), 6) AS mean, any_value(l[(len(l) // 2) + 1]) AS median, max(degree) AS max_degree, min(degree) AS min_degree, count(*) FILTER (degree >= 5) AS hubs, round(1e2 * count(*) FILTER (degree >= 5) / count(*), 6) AS hub_percent FROM deg, o""")
def degree_distribution(spark, d):
    return insights.degree_distribution(relations(spark, d))


@query(f"WITH t AS (SELECT relation, count(*) AS n FROM {R} GROUP BY ALL) SELECT relation, n, round(1e2 * n / sum(n) OVER (), 6) AS percent, row_number() OVER (ORDER BY n DESC, relation) = 1 AS dominant FROM t")
def relation_types(spark, d):
    return insights.relation_types(relations(spark, d))


_PS = f"(SELECT uri, family_name FROM {P} UNION ALL SELECT 's:' || s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN '' ELSE 'HOUSEHOLD' END FROM supplier)"


@query(f"SELECT count(*) AS n, count(*) FILTER (a.family_name <> '' AND b.family_name <> '' AND a.family_name <> b.family_name) AS crossing, round(1e2 * count(*) FILTER (a.family_name <> '' AND b.family_name <> '' AND a.family_name <> b.family_name) / count(*), 6) AS percent FROM {R} r JOIN {_PS} a ON src = a.uri JOIN {_PS} b ON dst = b.uri")
def cross_surname(spark, d):
    name = F.when(F.col("s_nationkey") % 3 == 0, "BUILDING").when(F.col("s_nationkey") % 3 == 1, "").otherwise("HOUSEHOLD")
    makers = load(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("uri"), name.alias("family_name"))
    return insights.cross_surname(relations(spark, d), people(spark, d).select("uri", "family_name").unionByName(makers))


@query(f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(birthday, '^[0-9]')) AS dated, round(1e2 * count(*) FILTER (regexp_matches(birthday, '^[0-9]')) / count(*), 6) AS percent FROM {P}")
def birthday_coverage(spark, d):
    return insights.birthday_coverage(people(spark, d))


@query(f"SELECT kind, kind_no, seq, text, rn FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) AS rn FROM {fx.values("findings")}) WHERE rn <= 2 ORDER BY kind_no, rn LIMIT 6")
def findings_top6(spark, d):
    return insights.first_findings(fx.rows(spark, d, "findings"))


@query(f"SELECT count(*) AS checks, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS overall FROM {fx.values("checks")}")
def health_rollup(spark, d):
    return insights.health(fx.rows(spark, d, "checks"))


@query(f"SELECT family_name AS before, CASE WHEN balance < 0 THEN 'debt' ELSE family_name END AS after, count(*) AS n FROM {P} GROUP BY ALL")
def reclassify_counts(spark, d):
    p = people(spark, d).withColumn("new", F.when(F.col("balance") < 0, "debt").otherwise(F.col("family_name")))
    return insights.class_changes(p, "family_name", "new")


# ------------------------------------------------------------------ graph

_WAYS = f"ways AS (SELECT src AS a, dst AS b FROM {R} UNION SELECT dst, src FROM {R})"
_KHOP = f"{_WAYS}, h1 AS (SELECT DISTINCT b AS uri FROM ways WHERE a = 'c:7'), h2 AS (SELECT DISTINCT b AS uri FROM ways WHERE a IN (FROM h1)), k AS (SELECT uri, min(hop) AS hop FROM (SELECT 'c:7' AS uri, 0 AS hop UNION ALL SELECT uri, 1 FROM h1 UNION ALL SELECT uri, 2 FROM h2) GROUP BY ALL)"


@query(f"WITH {_KHOP} SELECT * FROM k WHERE hop > 0")
def khop_neighbors(spark, d):
    return graph.k_hop(relations(spark, d), "c:7", 2)


@query(f"WITH {_KHOP}, n AS (SELECT uri FROM k ORDER BY hop, uri LIMIT 80) SELECT DISTINCT src, dst, relation FROM {R} WHERE src IN (FROM n) AND dst IN (FROM n)")
def bounded_subgraph(spark, d):
    return graph.bounded_subgraph(relations(spark, d), "c:7", 2, 80)[1].select("src", "dst", "relation")


@query(f"WITH {_DEG} SELECT uri, degree::BIGINT AS degree FROM deg ORDER BY degree DESC, uri LIMIT 50")
def top_degree_nodes(spark, d):
    return graph.top_degree_subgraph(relations(spark, d), 50)[0]


_CO = "(SELECT 'p:' || l_partkey AS src, 'p:' || nxt AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL)"


def _bought_together(spark, d):
    """Parts of neighbouring lines of an order."""
    from pyspark.sql import Window

    li = load(spark, d, "lineitem").withColumn("nxt", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    return li.filter("nxt IS NOT NULL").select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("p:"), F.col("nxt").cast("string")).alias("dst"))


@query(f"WITH deg AS (SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM {_CO} UNION ALL SELECT dst FROM {_CO}) GROUP BY ALL), t AS (SELECT uri FROM deg ORDER BY degree DESC, uri LIMIT 50) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_CO} WHERE src <> dst AND src IN (FROM t) AND dst IN (FROM t)")
def top_degree_subgraph(spark, d):
    return graph.top_degree_subgraph(_bought_together(spark, d), 50)[1].select("a", "b")


@query(f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {R} WHERE src <> dst")
def undirected_dedupe(spark, d):
    return graph.undirected(relations(spark, d))


@query(f"WITH {_DEG} SELECT uri, degree::BIGINT AS degree, CASE WHEN degree >= (SELECT quantile_cont(degree, 95e-2) FROM deg) THEN 3e0 ELSE 1e0 END AS size FROM deg")
def hub_p95(spark, d):
    return graph.hubs(graph.degrees(relations(spark, d)))


@query(f"""WITH m AS (SELECT uri, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM {_PT}), c AS (SELECT quantile_cont(abs(x), 99e-2) AS cx, quantile_cont(abs(y), 99e-2) AS cy FROM m)
SELECT uri, round(greatest(-cx, least(cx, x)) / cx * 100, 6) AS x, round(greatest(-cy, least(cy, y)) / cy * 100, 6) AS y FROM m, c""")
def clip_scale(spark, d):
    return graph.recentred(_points(spark, d)).select("uri", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_DEG}, r AS (SELECT uri, degree, row_number() OVER (ORDER BY degree DESC, uri) AS rank, count(*) OVER () AS n FROM deg) SELECT uri, degree::BIGINT AS degree, rank FROM r WHERE n <= 500 OR rank <= greatest(100, floor(n * 30 / 100))")
def density_cut(spark, d):
    return graph.importance_cut(graph.degrees(relations(spark, d)), 30, 100, 500)


_PART = "(SELECT DISTINCT p_partkey % 300 AS p, (p_partkey * 7) % 301 + 300 * (p_size % 3) AS c FROM part)"


@query(f"""WITH down AS (SELECT DISTINCT p, c FROM {_PART}), l0 AS (SELECT DISTINCT p AS root, p AS node FROM down WHERE p NOT IN (SELECT c FROM down)),
{", ".join(f"l{k} AS (SELECT DISTINCT root, c AS node FROM l{k - 1} JOIN down ON node = p)" for k in range(1, 7))}
SELECT root::VARCHAR AS root, max(depth)::INT AS depth FROM ({" UNION ALL ".join(f"SELECT root, {k} AS depth FROM l{k}" for k in range(7))}) GROUP BY ALL""")
def generation_depth(spark, d):
    p = load(spark, d, "part")
    edges = p.select((F.col("p_partkey") % 300).cast("string").alias("src"), ((F.col("p_partkey") * 7) % 301 + 300 * (F.col("p_size") % 3)).cast("string").alias("dst"))
    return graph.generation_depth(edges)


_NEXT = "(SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS b FROM part)"


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {_NEXT} WHERE b IS NOT NULL UNION SELECT b, a FROM {_NEXT} WHERE b IS NOT NULL),
r AS (SELECT DISTINCT a AS node, a AS spot FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.spot = e.a) SELECT node, min(spot) AS cluster FROM r GROUP BY ALL""")
def entity_clusters(spark, d):
    """Components of chains: each part is tied to the next of its brand by price."""
    from pyspark.sql import Window

    after = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    return graph.clusters(load(spark, d, "part").select(F.col("p_partkey").alias("a"), after.alias("b")))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_NEXT} WHERE b IS NOT NULL), r AS (SELECT a AS root, a AS node, 0 AS depth FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT root, b, depth + 1 FROM r JOIN e ON node = a)
SELECT root, max(depth)::INT AS depth FROM r GROUP BY ALL""")
def descent_depth(spark, d):
    """Lines of parts, each followed by the next of its brand by price, at their whole length."""
    from pyspark.sql import Window

    after = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    return graph.descent_depth(load(spark, d, "part").select(F.col("p_partkey").alias("src"), after.alias("dst")))


@query(f"""WITH down AS (SELECT DISTINCT p, c FROM {_PART}), l0 AS (SELECT DISTINCT p AS root, p AS node FROM down WHERE p NOT IN (SELECT c FROM down)),
{", ".join(f"l{k} AS (SELECT DISTINCT root, c AS node FROM l{k - 1} JOIN down ON node = p)" for k in range(1, 7))},
t AS (SELECT root::VARCHAR AS root, max(depth)::INT AS depth FROM ({" UNION ALL ".join(f"SELECT root, {k} AS depth FROM l{k}" for k in range(7))}) GROUP BY ALL), o AS (SELECT list_sort(list(depth)) AS l FROM t)
SELECT count(*) AS roots, max(depth) AS max_depth, any_value(l[len(l) // 2 + 1]) AS median, round(avg(depth), 2) AS mean_depth,
  (SELECT string_agg(root || ':' || depth, ',' ORDER BY depth DESC, root) FROM (SELECT * FROM t ORDER BY depth DESC, root LIMIT 5)) AS samples FROM t, o""")
def depth_summary(spark, d):
    p = load(spark, d, "part")
    edges = p.select((F.col("p_partkey") % 300).cast("string").alias("src"), ((F.col("p_partkey") * 7) % 301 + 300 * (F.col("p_size") % 3)).cast("string").alias("dst"))
    return graph.depth_summary(graph.generation_depth(edges))


# ------------------------------------------------------------------ text


@query("SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?;]*[.!?;]?'), lambda s: trim(regexp_replace(s, '[.!?;]$', '')) <> ''))::INT AS n FROM documents")
def sentence_split(spark, d):
    return load(spark, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"), ENDS)).alias("n"))


@query("SELECT doc_id, i AS start, substring(text, i + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 480))::INT AS i FROM documents)")
def sliding_windows(spark, d):
    return tx.sliding_windows(load(spark, d, "documents"), "doc_id", 500, 20)


@query("SELECT doc_id, floor(length(text) / 15e-1)::INT AS tokens FROM documents")
def token_estimates(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_CHUNKS = """WITH RECURSIVE k AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?;]*[.!?;]?'), lambda s: trim(regexp_replace(s, '[.!?;]$', '')) <> '') AS s FROM documents),
p AS MATERIALIZED (SELECT doc_id, s, len(s) AS n, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: length(rtrim(x, '.!?;')))), 0)::BIGINT) AS u FROM k WHERE len(s) > 0),
w AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS first, coalesce(list_min(list_filter(range(1, n), lambda j: u[j + 2] > 200)), n) AS stop FROM p
  UNION ALL SELECT doc_id, i + 1, b, coalesce(list_min(list_filter(range(stop + 1, n), lambda j: u[j + 2] - u[b + 1] > 200)), n)
    FROM (SELECT doc_id, i, stop, n, u, CASE WHEN u[stop + 1] - u[first + 1] <= 50 THEN stop ELSE list_min(list_filter(range(first, stop + 1), lambda j: u[stop + 1] - u[j + 1] <= 50)) END AS b FROM w JOIN p USING (doc_id) WHERE stop < n))
SELECT doc_id, i::INT AS chunk_index, array_to_string(s[first + 1:stop], '') AS text FROM w JOIN p USING (doc_id)"""


@query(_CHUNKS)
def chunk_max_tokens(spark, d):
    return tx.chunks_by_size(load(spark, d, "documents"), "doc_id", 200, 50, ENDS)


_LINES = f"""ln AS (SELECT id, i AS n, l[i] AS line FROM (SELECT id, string_split(text, chr(10)) AS l FROM {fx.values("chapters")}), unnest(range(1, len(l) + 1)) t(i)),
mk AS (SELECT *, regexp_matches(line, '{fx.HEADING}') AS h, regexp_matches(line, '{fx.SECTION}') AND NOT regexp_matches(line, '{fx.HEADING}') AS s, trim(line) = '' AS e FROM ln),
ru AS (SELECT *, last_value(CASE WHEN h THEN line END IGNORE NULLS) OVER w AS chapter, count_if(h) OVER w AS cn, count_if(h OR s OR e) OVER w AS pn FROM mk WINDOW w AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
se AS (SELECT *, last_value(CASE WHEN s THEN line END IGNORE NULLS) OVER (PARTITION BY id, cn ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM ru)"""


@query(f"WITH {_LINES}, pa AS (SELECT id, pn, any_value(chapter) AS chapter, any_value(section) AS section, string_agg(line, chr(10) ORDER BY n) AS text FROM se WHERE NOT h AND NOT s AND NOT e GROUP BY id, pn) SELECT id, coalesce(chapter, 'Unknown') AS chapter, section, (row_number() OVER (PARTITION BY id ORDER BY pn) - 1)::INT AS chunk_index, text FROM pa")
def chunk_by_heading(spark, d):
    return tx.chunks_by_heading(fx.rows(spark, d, "chapters"), "id", fx.HEADING, fx.SECTION)


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL")
def char_explode(spark, d):
    return tx.characters(load(spark, d, "documents"), ["doc_id"]).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


_OCR = fx.values("ocr")


@query(f"SELECT page, line, (i - 1)::INT AS pos, text[i] AS ch, trunc(x0 + (i - 1) * ((x1 - x0) / length(text)))::INT AS left, y0, trunc(x0 + i * ((x1 - x0) / length(text)))::INT AS right, y1 FROM {_OCR} o, unnest(range(1, length(text) + 1)) t(i)")
def char_bbox(spark, d):
    return tx.character_boxes(fx.rows(spark, d, "ocr"), ["page", "line"])


@query(f"SELECT page, round(avg(confidence), 6) AS confidence, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM {_OCR} WHERE confidence >= 5e-1 AND text <> '' GROUP BY ALL")
def page_stats(spark, d):
    o = fx.rows(spark, d, "ocr").filter("confidence >= 0.5 AND text <> ''")
    return o.groupBy("page").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT vec_id, list_min(embedding[1:4])::DOUBLE AS x0, list_min(embedding[5:8])::DOUBLE AS y0, list_max(embedding[1:4])::DOUBLE AS x1, list_max(embedding[5:8])::DOUBLE AS y1 FROM embeddings")
def polygon_bbox(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get("embedding", i), F.get("embedding", i + 4))).alias("p"))
    return e.select("vec_id", tx.polygon_box(F.col("p")).alias("b")).select("vec_id", *[F.col("b")[i].cast("double").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


_VAR = fx.values("variants")


@query(f"SELECT DISTINCT variant, standard FROM (SELECT variant, standard FROM {_VAR} WHERE length(standard) = 1 AND length(variant) = 1 UNION ALL SELECT standard, standard FROM {_VAR} WHERE length(standard) = 1)")
def variant_reverse(spark, d):
    return tx.variant_index(fx.rows(spark, d, "variants"))


_NORMAL = f"SELECT variant AS ch, arg_min(standard, strlen(standard) * 2000000 + unicode(standard)) AS standard FROM {_VAR} WHERE length(variant) = 1 AND length(standard) = 1 AND variant <> standard GROUP BY ALL"


def _folded(rules: str) -> str:
    """SQL for texts with characters replaced by rules (ch, new)."""
    return f"SELECT page, line, coalesce(string_agg(coalesce(new, ch), '' ORDER BY i), '') AS text FROM (SELECT page, line, i, o.text[i] AS ch FROM {_OCR} o LEFT JOIN unnest(range(1, greatest(length(o.text), 1) + 1)) t(i) ON true) LEFT JOIN ({rules}) USING (ch) GROUP BY ALL"


@query(_folded(f"SELECT variant AS ch, arg_min(standard, strlen(standard) * 2000000 + unicode(standard)) AS new FROM {_VAR} WHERE length(variant) = 1 AND length(standard) = 1 GROUP BY ALL"))
def variant_normalize(spark, d):
    return tx.normalize(fx.rows(spark, d, "ocr"), fx.rows(spark, d, "variants")).select("page", "line", "text")


_TAB = fx.values("taboo")


@query(f"SELECT o.text AS key, (i - 1)::INT AS pos, ch, replacement, substring(o.text, greatest(i - 5, 1), i - greatest(i - 5, 1) + 6) AS context FROM {_OCR} o, unnest(range(1, length(o.text) + 1)) t(i) JOIN (SELECT ch, replacement FROM {_TAB} WHERE dynasty = 'qing') ON ch = o.text[i]")
def taboo_detect(spark, d):
    o = fx.rows(spark, d, "ocr").withColumn("key", F.col("text"))
    return tx.taboo_hits(o, fx.rows(spark, d, "taboo"), "key", "qing")


@query(_folded(f"SELECT ch, arg_max(replacement, seq) AS new FROM {_TAB} WHERE dynasty = 'qing' GROUP BY ALL"))
def taboo_replace(spark, d):
    return tx.replace_taboo(fx.rows(spark, d, "ocr"), fx.rows(spark, d, "taboo"), "qing").select("page", "line", "text")


# ------------------------------------------------------------------ people in texts

_PER = fx.values("persons")
_TXT = fx.values("texts")
_HAN = "\\x{4e00}-\\x{9fff}"
_CLASS = f"""CASE WHEN regexp_matches(role_of_family, '妻|妾|孺人|夫人|氏') OR regexp_matches(label_chs, '妻|妾|孺人|夫人|^.氏$') THEN 1
  WHEN contains('{''.join(kin.CLAN_SURNAMES)}', nullif(coalesce(nullif(regexp_extract(family_name, '[{_HAN}]'), ''), regexp_extract(label_chs, '[{_HAN}]')), '')) THEN 0
  WHEN dynasty <> '' AND title <> '' THEN 3 ELSE 2 END"""


@query(f"SELECT id, ({_CLASS})::INT AS person_type FROM {_PER}")
def classify_person(spark, d):
    p = fx.rows(spark, d, "persons").withColumn("name", F.lit(""))
    return kin.classify(p).select("id", "person_type")


@query(f"SELECT id, coalesce({', '.join(f'CASE WHEN contains(biography, {chr(39)}{x}{chr(39)}) THEN {chr(39)}{x}{chr(39)} END' for x in kin.DYNASTIES)}) AS dynasty_found FROM {_PER}")
def dynasty_identify(spark, d):
    return fx.rows(spark, d, "persons").select("id", kin.dynasty_of(F.col("biography")).alias("dynasty_found"))


@query(f"SELECT dynasty, count(*) AS n FROM (SELECT CASE WHEN y IS NULL THEN '未知' {' '.join(f'WHEN y < {y} THEN {chr(39)}{n}{chr(39)}' for y, n in kin.YEAR_DYNASTIES)} ELSE '近现代' END AS dynasty FROM (SELECT TRY_CAST(nullif(regexp_extract(trim(birthday), '^-?[0-9]{{2,4}}'), '') AS INTEGER) AS y FROM {P})) GROUP BY ALL")
def dynasty_hist(spark, d):
    return people(spark, d).select(kin.dynasty_of_year(relational.birth_year(F.col("birthday"))).alias("dynasty")).groupBy("dynasty").agg(F.count(F.lit(1)).alias("n"))


_KIN = ", ".join(f"('{x}', '{t}')" for x, t in kin.KIN_SUFFIXES)
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_STOPS = kin.STOP_CHARS.replace("'", "''")


def _kin_sql(texts: str, names: str) -> str:
    """Rules of kinship as SQL, place by place; ``names`` is a query of one column, name."""
    return f"""SELECT id, src, dst, type, 85e-2 AS confidence FROM (
  SELECT DISTINCT id, src, type, coalesce(back, follow) AS dst FROM (
    SELECT *, CASE WHEN year <> '' THEN year ELSE regexp_replace(plain, '^(后裔|后)', '') END AS follow,
      (SELECT arg_max(n.name, j * 100 + length(n.name)) FROM ({names}) n, unnest(range(1, length(win) + 1)) u(j)
        WHERE j >= length(n.name) AND length(n.name) > 1 AND substring(win, j - length(n.name) + 1, length(n.name)) = n.name AND NOT starts_with(src || sfx || nxt, n.name)) AS back
    FROM (SELECT *, regexp_extract(rest, '^([{_HAN}]{{2,3}})年', 1) AS year, regexp_extract(CASE WHEN run = '' THEN substring(rest, 1, 4) ELSE run END, '^[{_HAN}]{{2,4}}') AS plain
      FROM (SELECT *, regexp_extract(rest, '^[^{_STOPS}]*') AS run
        FROM (SELECT *, regexp_extract(nxt, '(?s)^[^{_HAN}]*(.*)', 1) AS rest
          FROM (SELECT id, p, sfx, type, s.name AS src, substring(text, p + length(sfx), 8) AS nxt, substring(text, greatest(1, p - length(s.name) - 10), p - length(s.name) - greatest(1, p - length(s.name) - 10)) AS win
            FROM (SELECT t.*, p, k.sfx, k.type FROM {texts} t, unnest(range(2, length(text) + 1)) q(p) JOIN (VALUES {_KIN}) k(sfx, type) ON substring(text, p, length(k.sfx)) = k.sfx QUALIFY row_number() OVER (PARTITION BY t.id, p ORDER BY length(k.sfx) DESC) = 1)
            JOIN ({names}) s ON length(s.name) BETWEEN 2 AND 4 AND p > length(s.name) AND substring(text, p - length(s.name), length(s.name)) = s.name))))))
WHERE length(dst) >= 2 AND NOT starts_with(dst, '之') AND dst NOT IN ({_LIST((*kin.DYNASTIES, *kin.ERAS))}) AND NOT EXISTS (SELECT 1 FROM ({names}) m WHERE m.name <> dst AND contains(m.name, dst))"""


_NAMED = f"SELECT name FROM {fx.values('names')}"


@query(_kin_sql(_TXT, _NAMED))
def suffix_relations(spark, d):
    return kin.kin_relations(fx.rows(spark, d, "texts"), fx.rows(spark, d, "names"), "id")


_STARTS = "|".join(kin.BIOGRAPHY_STARTS)
_NER = f"""(WITH ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM {_TXT} WHERE length(text) >= 10)
SELECT DISTINCT id, type, name FROM (
  SELECT id, 'PER' AS type, regexp_extract(line, '^([{_HAN}]{{2,3}})，(?:{_STARTS})', 1) AS name FROM ln
  UNION ALL SELECT id, 'PER', unnest(regexp_extract_all(line, '([{_HAN}]{{2,3}})\\([\\d‐–—．·～\\-]+\\)', 1)) FROM ln
  UNION ALL SELECT id, 'PER', regexp_extract(line, '^([{_HAN}]{{3}})，字', 1) FROM ln
  UNION ALL SELECT id, 'PER', unnest(regexp_extract_all(line, '([{_HAN}]{{2,3}})之[父母子女兄弟姐妹]', 1)) FROM ln
  UNION ALL SELECT id, 'LOC', unnest(regexp_extract_all(line, '\\(今([{_HAN}]{{2,5}})\\)', 1)) FROM ln)
WHERE name <> '' AND name NOT IN ({_LIST((*kin.NOISE_WORDS, *kin.NOISE_STATES, *kin.NOISE_DATES))})
  AND NOT (length(name) >= 2 AND name[-1] IN ({_LIST((*kin.NOISE_YEAR_ENDS, *kin.NOISE_PLACE_ENDS, *kin.NOISE_TITLE_ENDS, *kin.NOISE_EVENT_ENDS, *kin.NOISE_BOOK_ENDS, *kin.NOISE_HOUSE_ENDS))})))"""


@query(f"SELECT * FROM {_NER}")
def ner_rules(spark, d):
    return kin.named_entities(fx.rows(spark, d, "texts"), "id")


@query(f"""WITH n AS (SELECT id, type, name FROM {_NER}), p AS (SELECT id, type, name, text, strpos(text, name) - 1 AS a FROM n JOIN {_TXT} USING (id))
SELECT id, type, name, substring(text, greatest(a - 50, 0) + 1, least(a, 50) + length(name) + 50) AS context,
  trim(regexp_replace(substring(text, greatest(a - 100, 0) + 1, least(a, 100) + length(name) + 100), '\\s+', ' ', 'g')) AS biography FROM p""")
def entity_context(spark, d):
    t = fx.rows(spark, d, "texts")
    return kin.decorated(t, "id", kin.named_entities(t, "id"))


@query(f"SELECT id, src, dst, type, max(confidence) AS confidence FROM (SELECT * FROM ({_kin_sql(_TXT, _NAMED)}) UNION ALL SELECT id, src, dst, type, confidence FROM {fx.values('found')} WHERE src IN ({_NAMED}) AND dst IN ({_NAMED}) AND dst NOT IN ({_LIST(kin.DYNASTIES)})) GROUP BY ALL")
def stored_relations(spark, d):
    return kin.stored_relations(fx.rows(spark, d, "texts"), fx.rows(spark, d, "names"), "id", fx.rows(spark, d, "found"))


@query(f"""WITH n AS (SELECT * FROM {_NER}), rel AS (SELECT id, count(*) AS total_relations FROM ({_kin_sql(_TXT, f"SELECT DISTINCT name FROM {_NER} WHERE type = 'PER'")}) GROUP BY ALL),
c AS (SELECT id, count(*) AS total_entities, count(*) FILTER (type = 'PER') AS person_entities FROM n GROUP BY ALL)
SELECT id, coalesce(total_entities, 0) AS total_entities, coalesce(person_entities, 0) AS person_entities, coalesce(total_relations, 0) AS total_relations FROM {_TXT} LEFT JOIN c USING (id) LEFT JOIN rel USING (id)""")
def text_graph_stats(spark, d):
    return kin.graph_of_texts(fx.rows(spark, d, "texts"), "id")[2]


def _place_sql(tail: str, relation: str, sure: str) -> str:
    m = f"SELECT id, unnest(regexp_extract_all(text, '([{_HAN}]{{2,4}}{tail.replace('(', '(?:')})', 1)) AS m FROM {_TXT}"
    cut = f"SELECT id, regexp_extract(m, '^([{_HAN}]{{2,4}}?){tail}$', 1) AS before, regexp_extract(m, '^[{_HAN}]{{2,4}}?{tail}$', 1) AS location FROM ({m})"
    return f"SELECT DISTINCT id, n.name AS src, '{relation}' AS relation, location, {sure} AS confidence FROM ({cut}) JOIN ({_NAMED}) n ON ends_with(before, n.name) AND length(n.name) > 1"


@query(f"{_place_sql(f'，([{_HAN}]{{2,6}})人', 'NATIVE_OF', '8e-1')} UNION ALL {_place_sql(f'[知任拜]([{_HAN}]{{1,3}}[州府县])', 'OFFICIAL', '75e-2')}")
def native_official(spark, d):
    return kin.places_of(fx.rows(spark, d, "texts"), fx.rows(spark, d, "names"), "id")


@query(f"""WITH f AS (SELECT name, {", ".join(f"coalesce(arg_max({c}, seq) FILTER ({c} <> ''), '') AS {c}" for c in fx.UPSERT_COLUMNS)} FROM {fx.values("upserts")} GROUP BY name)
SELECT *, ({_CLASS.replace("label_chs", "name")})::INT AS person_type FROM f""")
def upsert_persons(spark, d):
    return kin.upsert(fx.rows(spark, d, "upserts"), list(fx.UPSERT_COLUMNS))


_RELS = fx.values("relations")


@query(f"SELECT DISTINCT name FROM (SELECT src AS name FROM {_RELS} UNION ALL SELECT dst FROM {_RELS}) WHERE name NOT IN (SELECT label_chs FROM {_PER})")
def stubs(spark, d):
    return kin.stubs(fx.rows(spark, d, "relations"), fx.rows(spark, d, "persons").select(F.col("label_chs").alias("name")))


@query(f"SELECT label_chs AS name, '' AS type, min(id) AS position, max_by(biography, (length(biography), biography)) AS biography FROM {_PER} GROUP BY label_chs")
def resolve_entities(spark, d):
    p = fx.rows(spark, d, "persons")
    return kin.resolve(p.select(F.col("label_chs").alias("name"), F.lit("").alias("type"), F.col("id").alias("position"), "biography"))


@query(f"""WITH b AS (SELECT id, trim(regexp_replace(regexp_replace(trim(reply), '^```[A-Za-z]*\\s*', ''), '\\s*```$', '')) AS b FROM {fx.values("replies")}),
j AS (SELECT id, CASE WHEN starts_with(b, '[') THEN b::JSON ELSE coalesce(json_extract(b, '$.entities'), json_extract(b, '$.relations')) END AS j FROM b WHERE json_valid(b)), e AS (SELECT id, unnest(json_extract(j, '$[*]')) AS e FROM j)
SELECT id, json_extract_string(e, '$.name') AS name, json_extract_string(e, '$.type') AS type FROM e WHERE json_extract_string(e, '$.name') IS NOT NULL""")
def llm_json_repair(spark, d):
    r = fx.rows(spark, d, "replies")
    return r.select("id", F.explode(kin.repair_json(F.col("reply"), "name:string,type:string")).alias("e")).select("id", "e.name", "e.type").filter("name IS NOT NULL")


@query("SELECT a.n_name AS a, b.n_name AS b, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def edit_similarity(spark, d):
    n = load(spark, d, "nation")
    a, b = (n.select("n_regionkey", F.col("n_name").alias(c)) for c in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", F.round(kin.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"SELECT *, row_number() OVER (PARTITION BY work ORDER BY score DESC, version) AS rank FROM (SELECT *, round(4e-1 * age + 3e-1 * completeness + 2e-1 * authority + 1e-1 * rarity, 6) AS score FROM {fx.values("versions")})")
def version_rank(spark, d):
    return kin.ranked_versions(fx.rows(spark, d, "versions"))


@query("SELECT d.doc_id, count(i)::BIGINT AS chunks FROM documents d, unnest(CASE WHEN length(text) > 0 THEN range(0, length(text), 480) ELSE [NULL] END) t(i) GROUP BY ALL")
def ingest_counts(spark, d):
    docs = load(spark, d, "documents")
    chunks = tx.sliding_windows(docs.filter("length(text) > 0"), "doc_id", 500, 20).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(chunks, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"))


# ------------------------------------------------------------------ further operators


@query(f"SELECT (SELECT count(*) FROM {P}) AS persons, (SELECT count(*) FROM {R}) AS relations")
def graph_stats(spark, d):
    return people(spark, d).agg(F.count(F.lit(1)).alias("persons")).crossJoin(relations(spark, d).agg(F.count(F.lit(1)).alias("relations")))


@query(f"SELECT count(*) AS total, sum(enabled)::BIGINT AS enabled, (count(*) - sum(enabled))::BIGINT AS disabled, string_agg(name, ',' ORDER BY name) FILTER (enabled = 1) AS names FROM {fx.values("audited")}")
def source_audit(spark, d):
    s = fx.rows(spark, d, "audited")
    return s.agg(F.count(F.lit(1)).alias("total"), F.sum("enabled").alias("enabled"), (F.count(F.lit(1)) - F.sum("enabled")).alias("disabled"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("enabled") == 1, F.col("name")))), ",").alias("names"))


def _everyone(spark, d):
    name = F.when(F.col("s_nationkey") % 3 == 0, "BUILDING").when(F.col("s_nationkey") % 3 == 1, "").otherwise("HOUSEHOLD")
    makers = load(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("uri"), name.alias("family_name"))
    return people(spark, d).select("uri", "family_name").unionByName(makers)


@query(f"WITH e AS (SELECT * FROM {R} ORDER BY src, dst, relation LIMIT 200 OFFSET 50), n AS (SELECT uri FROM {_PS} WHERE family_name <> 'HOUSEHOLD' AND uri IN (SELECT src FROM e UNION SELECT dst FROM e)) SELECT src, dst, relation FROM e WHERE src IN (FROM n) AND dst IN (FROM n)")
def graph_page(spark, d):
    return graph.graph_page(relations(spark, d), _everyone(spark, d), 200, 50, F.col("family_name") != "HOUSEHOLD")[1].select("src", "dst", "relation")


@query(f"WITH s AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS r FROM {_PT}) SELECT uri, round((x - lx) / r, 9) AS x, round((y - ly) / r, 9) AS y, round((z - lz) / r, 9) AS z FROM {_PT}, s")
def unit_coordinates(spark, d):
    return graph.unit_coordinates(_points(spark, d)).select("uri", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(None)
def stand_in_layout(spark, d):
    return graph.stand_in_layout(people(spark, d).select("uri"), 5000)


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY n DESC, family_name) AS surname_rank FROM (SELECT family_name, count(*) AS n FROM {P} WHERE family_name <> '' GROUP BY ALL) QUALIFY surname_rank <= 200) SELECT uri, n, surname_rank FROM {P} LEFT JOIN r USING (family_name)")
def surname_rank(spark, d):
    from pyspark.sql import Window

    p = people(spark, d)
    r = insights.top_surnames(p, 200).withColumn("surname_rank", F.row_number().over(Window.orderBy(F.desc("n"), "family_name")))
    return p.join(F.broadcast(r), "family_name", "left").select("uri", "n", "surname_rank")


_HALF = lambda k: f"(SELECT src, dst, type, confidence FROM {_RELS} WHERE id % 2 = {k})"


@query(f"SELECT * FROM {_HALF(0)} UNION ALL SELECT * FROM {_HALF(1)} b WHERE NOT EXISTS (SELECT 1 FROM {_HALF(0)} a WHERE (a.src, a.dst, a.type) = (b.src, b.dst, b.type))")
def anti_merge(spark, d):
    """Relations of even orders, and those of odd orders that these do not have."""
    half = lambda k: fx.rows(spark, d, "relations").filter(f"id % 2 = {k}").select("src", "dst", "type", "confidence")
    return kin.anti_merge(half(0), half(1), ["src", "dst", "type"])


@query(f"SELECT DISTINCT src, dst, type FROM {_RELS}")
def distinct_links(spark, d):
    return fx.rows(spark, d, "relations").select("src", "dst", "type").distinct()


@query(f"""SELECT DISTINCT id, src, dst, type, 8e-1 AS confidence FROM (
  SELECT id, type, dst, (SELECT arg_max(n.name, j * 100 + length(n.name)) FROM ({_NAMED}) n, unnest(range(1, length(before) + 1)) u(j)
    WHERE length(n.name) BETWEEN 2 AND 5 AND j >= length(n.name) AND substring(before, j - length(n.name) + 1, length(n.name)) = n.name) AS src
  FROM (SELECT id, type, regexp_extract(substring(text, p + length(w), 4), '^[{_HAN}]{{2,4}}') AS dst, substring(text, greatest(1, p - 50), least(50, p - 1)) AS before
    FROM {fx.values("prefix_texts")} t, unnest(range(2, length(text) + 1)) q(p) JOIN (VALUES {", ".join(f"('{w}', '{k}')" for w, k in kin.KIN_PREFIXES)}) k(w, type) ON substring(text, p, length(w)) = w
    WHERE NOT regexp_matches(substring(text, p - 1, 1), '[{_HAN}]')) WHERE dst <> '') WHERE src IS NOT NULL""")
def prefix_relations(spark, d):
    return kin.prefix_relations(fx.rows(spark, d, "prefix_texts"), fx.rows(spark, d, "names"), "id")


@query(f"SELECT id, {', '.join(f"TRY_CAST(nullif(regexp_extract(text, name || '[^字]*?(?:{w})于?([0-9]{{4}})年?', 1), '') AS INTEGER) AS {c}" for w, c in (('生', 'birth_year'), ('卒|殁', 'death_year')))} FROM {fx.values("lives")}")
def life_years(spark, d):
    born, died = kin.life_years(F.col("text"), F.col("name"))
    return fx.rows(spark, d, "lives").select("id", born.alias("birth_year"), died.alias("death_year"))


@query(f"SELECT id, round(3e-1 * (CASE WHEN greatest(length(n1), length(n2)) = 0 THEN 1 ELSE 1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)) END) + 25e-2 * (CASE WHEN greatest(t1, t2) > least(f1, f2) THEN greatest(0, least(t1, t2) - greatest(f1, f2)) / (greatest(t1, t2) - least(f1, f2)) ELSE 0 END) + 25e-2 * (p1 = p2)::INT + 2e-1 * (o1 = o2)::INT, 6) AS similarity FROM {fx.values("alike")} WHERE id > 1")
def entity_similarity(spark, d):
    side = lambda k: {"name": F.col(f"n{k}"), "from": F.col(f"f{k}"), "to": F.col(f"t{k}"), "place": F.col(f"p{k}"), "title": F.col(f"o{k}")}
    return fx.rows(spark, d, "alike").filter("id > 1").select("id", kin.entity_similarity(side(1), side(2)).alias("similarity"))


_SERVICE = f"(SELECT id, reply::JSON AS j FROM {fx.values("services")} WHERE json_valid(reply))"
_BOX = lambda v: f"coalesce(json_extract(i, '$.rect.{v}')::INTEGER, 0)"


@query(f"""WITH s AS (SELECT * FROM {_SERVICE} WHERE json_extract_string(j, '$.success') = 'true'), m AS (SELECT id, n - 1 AS n, json_extract(j, '$.data.results[' || (n - 1) || ']') AS i FROM s, unnest(range(1, coalesce(json_array_length(j, '$.data.results'), 0)::BIGINT + 1)) t(n))
SELECT id, n, coalesce(json_extract_string(i, '$.text'), '') AS text, coalesce(json_extract(i, '$.probability.average')::DOUBLE, json_extract(i, '$.probability.max')::DOUBLE, 9e-1) AS confidence, {_BOX('x')} AS x0, {_BOX('y')} AS y0, {_BOX('x')} + {_BOX('width')} AS x1, {_BOX('y')} + {_BOX('height')} AS y1 FROM m
UNION ALL SELECT id, 0, json_extract_string(j, '$.data.text'), coalesce(json_extract(j, '$.data.probability.average')::DOUBLE, 9e-1), 0, 0, 0, 0 FROM s WHERE json_extract(j, '$.data.results') IS NULL AND json_extract_string(j, '$.data.text') IS NOT NULL""")
def ocr_service_lines(spark, d):
    from ..functions import ocr

    return ocr.service_lines(fx.rows(spark, d, "services"), "id")


@query(f"""SELECT page, line, (i - 1)::INT AS pos, text[i] AS ch, variant_of, taboo_for FROM {_OCR} o, unnest(range(1, length(text) + 1)) t(i)
LEFT JOIN (SELECT ch, standard AS variant_of FROM ({_NORMAL})) v ON v.ch = text[i] LEFT JOIN (SELECT ch, replacement AS taboo_for FROM {_TAB} WHERE dynasty = 'qing') b ON b.ch = text[i]""")
def char_flags(spark, d):
    from ..functions import ocr

    v, o = fx.rows(spark, d, "variants"), fx.rows(spark, d, "ocr")
    out = ocr.character_flags(tx.characters(o, ["page", "line"]), tx.normal_forms(v), v, fx.rows(spark, d, "taboo"), "qing")
    return out.select("page", "line", "pos", "ch", "variant_of", "taboo_for")


@query(f"SELECT dynasty, emperor, replacement FROM {_TAB} WHERE ch = '弘'")
def taboo_lookup(spark, d):
    from ..functions import ocr

    return ocr.taboo_rules(fx.rows(spark, d, "taboo"), "弘")


@query(f"SELECT standard, string_agg(variant, ',' ORDER BY variant) AS variants FROM {_VAR} GROUP BY ALL ORDER BY standard LIMIT 3")
def variant_listing(spark, d):
    v = fx.rows(spark, d, "variants")
    return v.groupBy("standard").agg(F.array_join(F.sort_array(F.collect_set("variant")), ",").alias("variants")).orderBy("standard").limit(3)


@query(None)  # a sequential recursion; tested against all alignments
def version_alignment(spark, d):
    from ..operators import alignment

    a, b = (fx.rows(spark, d, x) for x in ("version_a", "version_b"))
    return alignment.align_versions(a, b, "id")


@query(f"WITH {_BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 3) SELECT item_id, string_agg(source, '; ' ORDER BY rank) AS answer FROM r JOIN documents USING (doc_id) GROUP BY ALL")
def extractive_answer(spark, d):
    top = rt.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 3)
    named = top.join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return named.groupBy("item_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), "; ").alias("answer"))


# ------------------------------------------------------------------ lookups and lists


@query(f"SELECT uri, name, family_name, birthday FROM {P} WHERE uri = 'c:7'")
def person_lookup(spark, d):
    return relational.lookup(people(spark, d), "c:7").select("uri", "name", "family_name", "birthday")


@query(f"WITH k AS (SELECT * FROM {P} WHERE family_name = 'BUILDING' AND uri IN (SELECT src FROM {R} UNION SELECT dst FROM {R})), p AS (SELECT * FROM k ORDER BY uri LIMIT 20 OFFSET 5) SELECT uri, name, (SELECT count(*) FROM k) AS total FROM p WHERE coalesce(name, '') <> ''")
def person_list(spark, d):
    return relational.listed(people(spark, d), 20, 5, "BUILDING", relations(spark, d)).select("uri", "name", "total")


@query(f"SELECT *, (SELECT count(*) FROM {R}) AS total FROM (SELECT * FROM {R} ORDER BY src, dst, relation LIMIT 50 OFFSET 100)")
def edge_list(spark, d):
    return relational.listed_edges(relations(spark, d), 50, 100)


@query(f"SELECT uri, family_name FROM {P} ORDER BY uri LIMIT 5000")
def node_cap(spark, d):
    return relational.capped(people(spark, d).select("uri", "family_name"), 5000)


@query(f"SELECT dst AS uri, relation, 'outgoing' AS direction FROM {R} WHERE src = 's:3' UNION ALL SELECT src, relation, 'incoming' FROM {R} WHERE dst = 's:3' AND src <> 's:3'")
def direct_relations(spark, d):
    return graph.direct_relations(relations(spark, d), "s:3")


@query(f"SELECT uri, name, family_name, coalesce(birthday, '') AS birthday, 'genealogy' AS source, ({_CLASS.replace('role_of_family', 'role').replace('label_chs', 'name').replace('dynasty', 'birthday').replace('title', 'birthday')})::INT AS person_type FROM {P}")
def person_records(spark, d):
    from ..sources.tables import person_rows

    p = people(spark, d).withColumns({"label_chs": F.lit(""), "role_of_family": F.col("role"), "dynasty": F.col("birthday"), "title": F.col("birthday")})
    return person_rows(p, "genealogy").select("uri", "name", "family_name", "birthday", "source", "person_type")


_WORKS = "(SELECT 'o:' || o_orderkey AS work_uri, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || ' ' || o_orderpriority END AS description FROM orders)"


def _works(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat_ws(" ", "o_orderstatus", "o_orderpriority"))
    return load(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("work_uri"), F.col("o_orderpriority").alias("title"), text.alias("description"))


@query(f"SELECT '家谱-' || coalesce(nullif(title, ''), work_uri) AS title, description AS text, 'work_descriptions' AS extractor, work_uri AS uri FROM {_WORKS} WHERE description <> '' ORDER BY work_uri LIMIT 10000")
def work_records(spark, d):
    from ..sources.tables import text_records

    return text_records(_works(spark, d), "work_descriptions")


@query("SELECT title, text, dynasty FROM (SELECT source AS dynasty, lang || doc_id AS title, text FROM documents ORDER BY title LIMIT 200) WHERE length(text) >= 10")
def biography_records(spark, d):
    from ..sources.tables import biographies

    docs = load(spark, d, "documents")
    return biographies(docs.select(F.concat("lang", F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("biography"), F.col("source").alias("dynasty")))


_EV = {"work_description": 0.9, "place_record": 0.8, "biography": 0.7, "rag_chunk": 0.6}


@query(f"""WITH w AS (SELECT uri, coalesce(nullif(description, ''), title) AS item FROM {P} JOIN orders ON uri = 'c:' || o_custkey JOIN {_WORKS} ON work_uri = 'o:' || o_orderkey),
pl AS (SELECT uri, n_name AS item FROM {P} JOIN nation ON role = 'n' || n_nationkey), b AS (SELECT uri, birthday AS item FROM {P} WHERE birthday <> ''),
c AS (SELECT 'c:' || item_id AS uri, '[' || rank || '] ' || doc_id AS item FROM (WITH {_BM25} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 3)),
e AS (SELECT uri, 'work_description' AS kind, item, 9e-1 AS confidence FROM w UNION ALL SELECT uri, 'place_record', item, 8e-1 FROM pl UNION ALL SELECT uri, 'biography', item, 7e-1 FROM b UNION ALL SELECT uri, 'rag_chunk', item, 6e-1 FROM c)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY uri, kind ORDER BY item) <= 5""")
def evidence_chain(spark, d):
    p = people(spark, d)
    owned = load(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("uri"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("work_uri"))
    works = p.select("uri").join(owned, "uri").join(_works(spark, d), "work_uri").select("uri", F.coalesce(F.nullif(F.col("description"), F.lit("")), "title").alias("item"))
    places = p.join(load(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("role"), "n_name"), "role").select("uri", F.col("n_name").alias("item"))
    lives = p.filter("birthday <> ''").select("uri", F.col("birthday").alias("item"))
    top = rt.top_k(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", 3)
    chunks = top.select(F.concat(F.lit("c:"), F.col("item_id").cast("string")).alias("uri"), F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("doc_id").cast("string")).alias("item"))
    return relational.evidence({"work_description": works, "place_record": places, "biography": lives, "rag_chunk": chunks}, 5, _EV)


# ------------------------------------------------------------------ modes of retrieval

_SURE = f"""{_HITS}, kb AS (SELECT item_id, doc_id, score FROM kw WHERE score > 30), vb AS (SELECT item_id, doc_id, distance FROM ve WHERE distance < 12e-1),
kq AS (SELECT DISTINCT item_id FROM kb), vq AS (SELECT DISTINCT item_id FROM vb),
v AS (SELECT item_id, doc_id, (s - min(s) OVER w) / CASE WHEN max(s) OVER w > min(s) OVER w THEN max(s) OVER w - min(s) OVER w ELSE 1 END AS v FROM (SELECT *, 1 / (1 + distance) AS s FROM vb WHERE item_id IN (FROM kq)) WINDOW w AS (PARTITION BY item_id)),
b AS (SELECT item_id, doc_id, (score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END AS b FROM (SELECT * FROM kb WHERE item_id IN (FROM vq)) WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT item_id, doc_id, CASE WHEN v IS NOT NULL THEN 'vector' ELSE 'bm25' END AS source, round(5e-1 * coalesce(v, 0) + 5e-1 * coalesce(b, 0), 6) AS score FROM v FULL JOIN b USING (item_id, doc_id)),
few AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5),
u AS (SELECT *, true AS filled FROM few UNION ALL SELECT item_id, doc_id, 'vector', distance, true FROM vb WHERE item_id NOT IN (FROM kq) UNION ALL SELECT item_id, doc_id, 'bm25', score, false FROM kb WHERE item_id NOT IN (FROM vq))"""


@query(f"""WITH {_SURE}, n AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Unknown' WHEN lang = 'fr' THEN '' ELSE lang END AS chapter, documents.source AS title FROM documents)
SELECT item_id, doc_id, CASE WHEN filled AND chapter IN ('', 'Unknown') THEN title ELSE chapter END AS title, source, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM u JOIN n USING (doc_id) QUALIFY rank <= 5""")
def retrieve_modes(spark, d):
    v, b = _hits(spark, d)
    chapter = F.when(F.col("lang") == "en", "Unknown").when(F.col("lang") == "fr", "").otherwise(F.col("lang"))
    passages = load(spark, d, "documents").select("doc_id", chapter.alias("chapter"), F.col("source").alias("title"))
    return rt.retrieve(v.filter("distance < 1.2"), b.filter("score > 30").drop("rank"), passages, "item_id", "doc_id", 0.5, 5)


def _one_source(spark, d):
    return load(spark, d, "documents").agg(F.min("source")).first()[0]


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, source, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) WHERE source = (SELECT min(source) FROM documents) QUALIFY rank <= 5")
def ask_source(spark, d):
    docs = rt.of_source(load(spark, d, "documents").select("doc_id", "source"), _one_source(spark, d))
    return rt.per_collection(_scores(spark, d).withColumn("score", F.round("score", 6)), "item_id", "doc_id", docs, 5, 1)


@query(f"""WITH {_BM25}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM sc WHERE score > 40 QUALIFY rank <= 3),
a AS (SELECT item_id, string_agg('- ' || source, chr(10) ORDER BY rank) AS s FROM r JOIN documents USING (doc_id) GROUP BY ALL)
SELECT item_id, CASE WHEN s IS NULL THEN '{rt.SORRY}' ELSE '{rt.SORRY_WITH_SOURCES}' || chr(10) || s END AS answer FROM benchmark LEFT JOIN a USING (item_id)""")
def plain_answers(spark, d):
    top = rt.top_k(_scores(spark, d).filter("score > 40").withColumn("score", F.round("score", 6)), "item_id", "doc_id", 3)
    named = top.join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rt.plain_answers(load(spark, d, "benchmark"), named, "item_id")


# ------------------------------------------------------------------ texts, pages and versions


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^.!?;]*[.!?;]?') AS p FROM documents), x AS (SELECT doc_id, i, p[i] AS sentence FROM p, unnest(range(1, len(p) + 1)) t(i)),
s AS (SELECT *, (sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) - length(sentence))::INT AS start FROM x)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS n, start, (start + length(sentence))::INT AS "end", sentence FROM s WHERE trim(regexp_replace(sentence, '[.!?;]$', '')) <> ''""")
def sentence_offsets(spark, d):
    return tx.sentence_offsets(load(spark, d, "documents"), "doc_id", ENDS)


@query(f"""WITH f AS (SELECT page, line, v.standard, b.replacement FROM {_OCR} o, unnest(range(1, length(text) + 1)) t(i) LEFT JOIN ({_NORMAL}) v ON v.ch = o.text[i] LEFT JOIN (SELECT ch, replacement FROM {_TAB} WHERE dynasty = 'qing') b ON b.ch = o.text[i] WHERE confidence >= 5e-1 AND text <> ''),
c AS (SELECT page, count(standard) AS n_variants, count(replacement) AS n_taboo FROM f GROUP BY ALL)
SELECT page, round(avg(confidence), 6) AS confidence, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, any_value(n_variants) AS n_variants, any_value(n_taboo) AS n_taboo FROM {_OCR} JOIN c USING (page) WHERE confidence >= 5e-1 AND text <> '' GROUP BY ALL""")
def page_summary(spark, d):
    from ..functions import ocr

    return ocr.page_summary(fx.rows(spark, d, "ocr"), fx.rows(spark, d, "variants"), fx.rows(spark, d, "taboo"), "qing")


@query("SELECT vec_id, i::INT AS i, CASE WHEN h > w * 12e-1 THEN w - y ELSE x END AS x, CASE WHEN h > w * 12e-1 THEN x ELSE y END AS y FROM (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS x, embedding[i + 4]::DOUBLE AS y, (vec_id % 7 + 1)::DOUBLE AS h, (vec_id % 5 + 1)::DOUBLE AS w FROM embeddings, unnest(range(1, 5)) t(i))")
def rotated_boxes(spark, d):
    from ..functions import ocr

    corner = lambda i: F.struct(F.get("embedding", i).cast("double").alias("x"), F.get("embedding", i + 4).cast("double").alias("y"))
    e = load(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), corner).alias("points"), (F.col("vec_id") % 7 + 1).cast("double").alias("height"), (F.col("vec_id") % 5 + 1).cast("double").alias("width"))
    return ocr.rotated_back(e).select("vec_id", F.posexplode("points").alias("i", "p")).select("vec_id", "i", "p.x", "p.y")


@query(f"SELECT id, coalesce({', '.join(f'CASE WHEN contains(b, {chr(39)}{x}{chr(39)}) THEN {chr(39)}{x}{chr(39)} END' for x in kin.DYNASTIES)}, '') AS dynasty FROM (SELECT id, substring(biography, greatest(a - 200, 0) + 1, least(a, 200)) AS b FROM (SELECT *, greatest(length(biography) - 1, 0) AS a FROM {_PER}))")
def dynasty_context(spark, d):
    return fx.rows(spark, d, "persons").select("id", kin.dynasty_before(F.col("biography"), F.greatest(F.length("biography") - 1, F.lit(0))).alias("dynasty"))


_KIND = "CASE WHEN a = b THEN 'SAME' WHEN a = '' THEN 'INSERTION' WHEN b = '' THEN 'DELETION' WHEN na = nb THEN 'VARIANT' WHEN pa = pb THEN 'TABOO' WHEN list_sort(string_split(a, '')) = list_sort(string_split(b, '')) THEN 'TRANSPOSITION' ELSE 'SUBSTITUTION' END"


def _typed(spark, d):
    from ..operators import alignment

    return fx.rows(spark, d, "typed").withColumn("kind", alignment.difference_kind(*[F.col(c) for c in ("a", "b", "na", "nb", "pa", "pb")]))


@query(f"SELECT id, {_KIND} AS kind FROM {fx.values("typed")}")
def difference_types(spark, d):
    return _typed(spark, d).select("id", "kind")


@query(f"""WITH t AS (SELECT *, {_KIND} AS kind, CASE WHEN id % 3 = 0 THEN 1700 END AS ya, CASE WHEN id % 3 = 0 THEN 1650 END AS yb FROM {fx.values("typed")})
SELECT id, CASE WHEN kind = 'TABOO' THEN pa WHEN kind = 'VARIANT' THEN CASE WHEN length(b) < length(a) THEN b ELSE a END WHEN yb IS NOT NULL THEN CASE WHEN yb < ya THEN b ELSE a END ELSE a END AS choice,
CASE WHEN kind = 'TABOO' THEN 'TABOO_FIRST' WHEN kind = 'VARIANT' THEN 'GRAPHIC_SIM' WHEN yb IS NOT NULL THEN 'CHRONOLOGY' ELSE 'CONTEXT_SCORE' END AS rule, CASE WHEN kind = 'TABOO' THEN 9e-1 WHEN kind = 'VARIANT' THEN 85e-2 WHEN yb IS NOT NULL THEN 75e-2 ELSE 3e-1 END AS confidence FROM t""")
def judged_differences(spark, d):
    from ..operators import alignment

    dated = F.col("id") % 3 == 0
    return alignment.judged(_typed(spark, d).withColumns({"year_a": F.when(dated, 1700), "year_b": F.when(dated, 1650), "original": F.col("pa")})).select("id", "choice", "rule", "confidence")


_EDITIONS = "(SELECT conv_id % 7 AS work, conv_id AS version, turn AS place, text, length(text) AS completeness, length(role) * 1e0 AS quality, -conv_id AS age, 1e0 AS weight FROM conversations)"


def _editions(spark, d):
    return load(spark, d, "conversations").select((F.col("conv_id") % 7).alias("work"), F.col("conv_id").alias("version"), F.col("turn").alias("place"), "text", F.length("text").alias("completeness"), (F.length("role") * 1.0).alias("quality"), (-F.col("conv_id")).alias("age"), F.lit(1.0).alias("weight"))


@query(f"SELECT work, place, arg_max(text, (w, text)) AS text FROM (SELECT work, place, text, sum(weight) AS w FROM {_EDITIONS} GROUP BY ALL) GROUP BY ALL")
def vote_merge(spark, d):
    return kin.merged_versions(_editions(spark, d), "vote")


@query(f"SELECT work, place, text FROM {_EDITIONS} e WHERE version = (SELECT arg_max(version, (age, -version)) FROM {_EDITIONS} f WHERE f.work = e.work)")
def original_merge(spark, d):
    return kin.merged_versions(_editions(spark, d), "original")


@query(f"SELECT cluster, uri AS src, nxt AS dst FROM (SELECT *, lead(uri) OVER (PARTITION BY cluster ORDER BY uri) AS nxt FROM (SELECT uri, family_name AS cluster FROM {P})) WHERE nxt IS NOT NULL")
def chain_edges(spark, d):
    placed = people(spark, d).select("uri", F.col("family_name").alias("cluster"))
    edges = graph.stand_in_edges(placed)
    return edges.join(placed.withColumnRenamed("uri", "src"), "src").select("cluster", "src", "dst")


@query(f"WITH n AS (SELECT uri, row_number() OVER (ORDER BY uri) - 1 AS i FROM {P}) SELECT a.i, b.i AS j FROM (SELECT uri AS src, nxt AS dst FROM (SELECT uri, lead(uri) OVER (PARTITION BY family_name ORDER BY uri) AS nxt FROM {P}) WHERE nxt IS NOT NULL) JOIN n a ON a.uri = src JOIN n b ON b.uri = dst")
def layout_edges(spark, d):
    from ..sources.tables import edge_numbers

    p = people(spark, d).select("uri", F.col("family_name").alias("cluster"))
    return edge_numbers(p, graph.stand_in_edges(p))


@query(None)
def constrained_alignment(spark, d):
    from ..operators import alignment

    a, b = (fx.rows(spark, d, x) for x in ("version_a", "version_b"))
    made = alignment.align_versions(a, b, "id")
    side = lambda df, k: df.select("id", F.col("n").cast("int").alias(k), F.col("text").alias("t" + k))
    like = side(a, "i").join(side(b, "j"), "id").select("id", "i", "j", kin.similarity(F.col("ti"), F.col("tj")).alias("score"))
    return alignment.alignment_scores(made, alignment.constrained(made, like, "id"), "id")
