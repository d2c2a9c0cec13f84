"""Table and text sources, a registry of sources, and sinks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Source:
    name: str
    path: str
    label: str = ""
    tables: tuple[str, ...] = ()
    enabled: bool = True


@dataclass
class SourceRegistry:
    """Named sources; an environment variable ``INKFIELD_SOURCE_<NAME>`` overrides a path."""

    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, source: Source) -> None:
        self.sources[source.name] = source

    def names(self, enabled_only: bool = False) -> list[str]:
        return [n for n, s in self.sources.items() if s.enabled or not enabled_only]

    def get(self, name: str) -> Source:
        if name not in self.sources:
            raise ValueError(f"unknown source: {name}")
        return self.sources[name]

    def path(self, name: str) -> str:
        return os.environ.get(f"INKFIELD_SOURCE_{name.upper()}", self.get(name).path)

    def require_enabled(self, name: str, must_exist: bool = True) -> Source:
        source = self.get(name)
        if not source.enabled:
            raise ValueError(f"source is disabled: {name}")
        if must_exist and "://" not in self.path(name) and not os.path.exists(self.path(name)):
            raise FileNotFoundError(self.path(name))
        return source


def read_text_folder(spark: SparkSession, path: str, skip: tuple[str, ...] = (), least_chars: int = 50) -> DataFrame:
    """Whole ``*.txt`` files as (title, text), stripped, short ones dropped."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(path)
    named = raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("title"), F.trim(F.col("value")).alias("text"))
    return named.filter(~F.col("title").isin(*skip) if skip else F.lit(True)).filter(F.length("text") >= least_chars)


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(persons, relations) of a graph file; an unreadable file gives an empty graph."""
    person = "name:string,biography:string,dynasty:string,person_type:int,stub:boolean"
    relation = "`from`:string,`to`:string,type:string,confidence:double"
    schema = f"persons array<struct<{person}>>, relations array<struct<{relation}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.selectExpr("inline(persons)"), doc.selectExpr("inline(relations)")


def write_graph_json(persons: DataFrame, relations: DataFrame, path: str) -> None:
    """The graph as JSON files of persons and relations, one object a line."""
    persons.write.mode("overwrite").json(f"{path}/persons")
    relations.write.mode("overwrite").json(f"{path}/relations")


#: Kinds of text records: the column of the id, of the label, the title's prefix.
TEXT_RECORDS = {"work_descriptions": ("work_uri", "title", "家谱-"), "person_biographies": ("uri", "label_chs", "人物-"), "place_records": ("uri", "label_chs", "地名-")}


def text_records(rows: DataFrame, kind: str, limit: int = 10_000) -> DataFrame:
    """(title, text, extractor, uri) of rows with a description, the first ``limit`` by uri."""
    if kind not in TEXT_RECORDS:
        raise ValueError(f"unknown kind of records: {kind}")
    uri, label, prefix = TEXT_RECORDS[kind]
    kept = rows.filter(F.coalesce("description", F.lit("")) != "").orderBy(uri).limit(limit)
    name = F.coalesce(F.nullif(F.col(label), F.lit("")), F.col(uri))
    return kept.select(F.concat(F.lit(prefix), name).alias("title"), F.col("description").alias("text"), F.lit(kind).alias("extractor"), F.col(uri).alias("uri"))


def biographies(persons: DataFrame, most: int = 200, least_chars: int = 10) -> DataFrame:
    """(title, text, dynasty) of the first persons by name; those without a biography of some length go after the cut, not before."""
    return persons.orderBy("name").limit(most).filter(F.length("biography") >= least_chars).select(F.col("name").alias("title"), F.col("biography").alias("text"), F.coalesce("dynasty", F.lit("")).alias("dynasty"))


def person_rows(people: DataFrame, source: str) -> DataFrame:
    """People with ``source`` and ``person_type``; missing fields are empty strings."""
    from ..functions.people import classify

    texts = [f.name for f in people.schema.fields if f.dataType.simpleString() == "string"]
    return classify(people.fillna("", texts)).withColumn("source", F.lit(source))


def write_collection(vectors: DataFrame, path: str) -> None:
    """Store vectors by collection; a collection written again replaces the old one only."""
    named = vectors.withColumn("id", F.sha2(F.concat_ws("\x1f", "collection", "text"), 256))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def plain_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata as a store takes it: null as an empty string, numbers and truth values as they are, all else as a string."""
    plain = {"string", "int", "bigint", "double", "float", "boolean"}
    kind = dict(rows.dtypes)
    as_text = lambda c: F.to_json(F.col(c)) if kind[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) if kind[c] == "string" else F.col(c) if kind[c] in plain else F.coalesce(as_text(c), F.lit("")) for c in columns})


def collections(spark: SparkSession, path: str) -> list[str]:
    """Names of the stored collections; none where nothing is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(where)]
    return sorted(n.removeprefix("collection=") for n in found if n.startswith("collection="))


def read_collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One collection; only its partition is read."""
    if name not in collections(spark, path):
        raise ValueError(f"no such collection: {name}")
    return spark.read.parquet(path).filter(F.col("collection") == name)


def drop_collection(spark: SparkSession, path: str, name: str) -> bool:
    """Delete one collection; false if there is none."""
    if name not in collections(spark, path):
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection={name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_ocr_json(lines: DataFrame, path: str) -> None:
    """Recognised pages as JSON, one object a page with its lines in order."""
    fields = [c for c in lines.columns if c != "page"]
    lines.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("lines")).write.mode("overwrite").json(path)


def read_layout(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a stored layout."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def edge_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as (i, j): places of their ends among the nodes by uri, from 0; edges with an end elsewhere go."""
    from ..operators.skew import numbered

    placed = numbered(nodes.select("uri"), [F.col("uri")], "place").select("uri", (F.col("place") - 1).alias("place"))
    end = lambda name, to: placed.select(F.col("uri").alias(name), F.col("place").alias(to))
    return edges.join(end("src", "i"), "src").join(end("dst", "j"), "dst").select("i", "j")


def write_layout(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Layout sink: positions, and edges whose ends are nodes."""
    ids = nodes.select("uri")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.join(ids.withColumnRenamed("uri", "src"), "src", "left_semi").join(ids.withColumnRenamed("uri", "dst"), "dst", "left_semi").write.mode("overwrite").parquet(f"{path}/edges")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person table on the test data: customers with a surname-like segment and a birthday-like string."""
    c = load(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("uri"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("family_name"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("role"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.floor("c_acctbal").cast("string")).alias("birthday"),
        F.col("c_acctbal").alias("balance"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges from customers to suppliers through their orders."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("relation"),
    )


#: The same two as DuckDB SQL.
PEOPLE_SQL = "(SELECT 'c:' || c_custkey AS uri, c_name AS name, c_mktsegment AS family_name, 'n' || c_nationkey AS role, CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS birthday, c_acctbal AS balance FROM customer)"
RELATIONS_SQL = "(SELECT 'c:' || o_custkey AS src, 's:' || l_suppkey AS dst, l_returnflag AS relation FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
