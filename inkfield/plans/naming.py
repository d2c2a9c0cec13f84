"""Queries about many names: their places in texts, and which of them are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import names, resolution
from ..sources.tables import load
from .catalog import query

_WORDS = "SELECT DISTINCT name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT unnest(['the', 'her', 'ther', 'he', 'tion', 'ion'])) WHERE name <> ''"


def _places(spark, d):
    """Words of parts, and some pieces of words that overlap, in all documents."""
    p = load(spark, d, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("name")).union(p.select("p_type")).union(p.select(F.explode(F.array(*map(F.lit, ("the", "her", "ther", "he", "tion", "ion"))))))
    return names.places(load(spark, d, "documents"), words, "doc_id")


@query(f"SELECT doc_id, name, sum((length(text) - length(replace(text, name, ''))) // length(name))::BIGINT AS n FROM documents, ({_WORDS}) WHERE contains(text, name) GROUP BY ALL")
def name_counts(spark, d):
    """How often each name is in each document; none of them overlaps itself."""
    return _places(spark, d).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH sg AS (SELECT doc_id, name, g, k FROM (SELECT doc_id, name, string_split(text, name) AS s FROM ({_WORDS}) n, documents WHERE contains(text, name)), unnest(s) WITH ORDINALITY t(g, k)),
pl AS (SELECT doc_id, name, stop - length(name) AS start, stop FROM (SELECT doc_id, name, k, sum(length(g) + length(name)) OVER (PARTITION BY doc_id, name ORDER BY k) AS stop, max(k) OVER (PARTITION BY doc_id, name) AS n FROM sg) WHERE k < n)
SELECT name, count(*) AS n FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pl) WHERE reach IS NULL OR stop > reach GROUP BY ALL""")
def longest_names(spark, d):
    """How often each name stands and no longer one covers it."""
    return names.longest(_places(spark, d), "doc_id").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part),
e AS MATERIALIZED (SELECT a.name AS a, b.name AS b FROM n a, n b WHERE levenshtein(a.name, b.name) * 100 <= 25 * greatest(length(a.name), length(b.name))),
r AS (SELECT name, name AS spot FROM n UNION SELECT r.name, e.b FROM r JOIN e ON spot = e.a)
SELECT name, min(spot) AS cluster FROM r GROUP BY ALL""")
def resolved_names(spark, d):
    return resolution.resolved(load(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("name")))


@query("SELECT a.name AS a, b.name AS b, levenshtein(a.name, b.name)::INT AS distance FROM (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part) a JOIN (SELECT DISTINCT p_name || ' ' || p_type AS name FROM part) b ON a.name < b.name AND levenshtein(a.name, b.name) * 100 <= 25 * greatest(length(a.name), length(b.name))")
def similar_names(spark, d):
    return resolution.similar_pairs(load(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("name")))
