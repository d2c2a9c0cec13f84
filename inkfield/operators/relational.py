"""Paging, filters, semi-joins and bridges over people and relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count(people: DataFrame) -> DataFrame:
    return people.agg(F.count(F.lit(1)).alias("n"))


def related_ids(relations: DataFrame) -> DataFrame:
    """Everyone on either side of a relation, once. A union, so that a filter by it is one semi-join."""
    return relations.select(F.col("src").alias("uri")).union(relations.select("dst")).distinct()


def page(people: DataFrame, limit: int, offset: int = 0, surname: str | None = None, relations: DataFrame | None = None) -> DataFrame:
    """A page by uri; ``relations`` keeps only people who have one."""
    if surname is not None:
        people = people.filter(F.col("family_name") == surname)
    if relations is not None:
        people = people.join(related_ids(relations), "uri", "left_semi")
    return people.orderBy("uri").offset(offset).limit(limit)


def listed(people: DataFrame, limit: int, offset: int = 0, surname: str | None = None, relations: DataFrame | None = None) -> DataFrame:
    """The rows of a page that have a name, and ``total``: all that the filters keep, those without a name too."""
    kept = people if surname is None else people.filter(F.col("family_name") == surname)
    if relations is not None:
        kept = kept.join(related_ids(relations), "uri", "left_semi")
    rows = kept.orderBy("uri").offset(offset).limit(limit).filter(F.coalesce("name", F.lit("")) != "")
    return rows.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("total"))))


def lookup(people: DataFrame, uri: str) -> DataFrame:
    """The person of a uri, or no row."""
    return people.filter(F.col("uri") == uri)


def listed_edges(relations: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of edges in a total order, and ``total`` of all."""
    return edge_page(relations, limit, offset).crossJoin(F.broadcast(relations.agg(F.count(F.lit(1)).alias("total"))))


def capped(nodes: DataFrame, most: int) -> DataFrame:
    """The first nodes by uri, as many as a view shows."""
    return nodes.orderBy("uri").limit(most)


def evidence(uri_facts: dict[str, DataFrame], each: int, confidences: dict[str, float]) -> DataFrame:
    """(uri, kind, item, confidence) of several kinds of facts (uri, item), at most ``each`` of a person and kind, by item."""
    parts = [first_of_each(rows, "uri", [F.col("item")], each).select("uri", F.lit(kind).alias("kind"), "item", F.lit(confidences[kind]).alias("confidence")) for kind, rows in uri_facts.items()]
    return reduce(DataFrame.unionByName, parts)


def incident_edges(relations: DataFrame, uri: str) -> DataFrame:
    return relations.filter((F.col("src") == uri) | (F.col("dst") == uri)).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("relation").alias("type"))


def edge_page(relations: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return relations.orderBy("src", "dst", "relation").offset(offset).limit(limit)


def induced_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (uri)."""
    ids = nodes.select("uri").distinct()
    return relations.join(ids.withColumnRenamed("uri", "src"), "src", "left_semi").join(ids.withColumnRenamed("uri", "dst"), "dst", "left_semi")


def first_of_each(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in a total order."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n)


def in_box(points: DataFrame, box: str) -> DataFrame:
    """Points inside "x0,y0,x1,y1", bounds included."""
    x0, y0, x1, y1 = parse_box(box)
    return points.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def parse_box(box: str) -> tuple[float, float, float, float]:
    parts = box.split(",")
    if len(parts) != 4:
        raise ValueError("a box is four numbers")
    x0, y0, x1, y1 = map(float, parts)
    return x0, y0, x1, y1


def layout_extent(points: DataFrame) -> DataFrame:
    return points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))])


def uri_tail(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def birth_year(birthday: Column) -> Column:
    """A leading year of two to four digits, perhaps negative; null otherwise."""
    return F.nullif(F.regexp_extract(F.trim(birthday), "^-?[0-9]{2,4}", 0), F.lit("")).cast("int")


def snippet(text: Column, other: Column, most: int) -> Column:
    """The start of the first of two texts that is not empty."""
    return F.substring(F.coalesce(F.nullif(text, F.lit("")), other, F.lit("")), 1, most)


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - distance))
