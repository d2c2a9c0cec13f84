"""Relational parts of page recognition: replies of services, line filters, character flags, image folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY = "success boolean, data struct<text:string, probability:struct<average:double>, results:array<struct<text:string, rect:struct<x:int,y:int,width:int,height:int>, probability:struct<average:double,max:double>>>>"
IMAGES = ("jpg", "jpeg", "png", "tif", "bmp")


def service_lines(replies: DataFrame, key: str) -> DataFrame:
    """(key, n, text, confidence, x0, y0, x1, y1) of a service's JSON reply; failed replies give nothing, a missing box is zeros."""
    r = replies.select(key, F.from_json("reply", REPLY).alias("r")).filter("r.success")
    many = r.select(key, F.posexplode("r.data.results").alias("n", "i")).select(
        key, "n", F.coalesce("i.text", F.lit("")).alias("text"), F.coalesce("i.probability.average", "i.probability.max", F.lit(0.9)).alias("confidence"),
        *[F.coalesce(f"i.rect.{c}", F.lit(0)).alias(v) for c, v in (("x", "x0"), ("y", "y0"))],
        (F.coalesce("i.rect.x", F.lit(0)) + F.coalesce("i.rect.width", F.lit(0))).alias("x1"), (F.coalesce("i.rect.y", F.lit(0)) + F.coalesce("i.rect.height", F.lit(0))).alias("y1"),
    )
    zero = [F.lit(0).alias(v) for v in ("x0", "y0", "x1", "y1")]
    one = r.filter("r.data.results IS NULL AND r.data.text IS NOT NULL").select(key, F.lit(0).alias("n"), "r.data.text", F.coalesce("r.data.probability.average", F.lit(0.9)).alias("confidence"), *zero)
    return many.unionByName(one)


def sure_lines(lines: DataFrame, least: float = 0.5) -> DataFrame:
    return lines.filter((F.col("confidence") >= least) & (F.coalesce(F.col("text"), F.lit("")) != ""))


def character_flags(characters: DataFrame, normal: DataFrame, standards: DataFrame, taboo: DataFrame, dynasty: str) -> DataFrame:
    """Characters with what they are a variant of (only of a known standard) and what replaced them under a dynasty."""
    of = normal.join(standards.select(F.col("standard").alias("normal")).distinct(), "normal", "left_semi").select(F.col("variant").alias("ch"), F.col("normal").alias("variant_of"))
    rules = taboo.filter(F.col("dynasty") == dynasty).groupBy("ch").agg(F.max_by("replacement", "seq").alias("taboo_for"))
    return characters.join(F.broadcast(of), "ch", "left").join(F.broadcast(rules), "ch", "left")


def taboo_rules(taboo: DataFrame, ch: str) -> DataFrame:
    return taboo.filter(F.col("ch") == ch).select("dynasty", "emperor", "replacement")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files of a folder with their bytes, whatever the case of their endings."""
    glob = "*.{" + ",".join(x for e in IMAGES for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("image_path"), "length", "content")


#: How files of each kind begin, in hexadecimal (fixed values).
BEGINNINGS = {"jpeg": ("FFD8FF",), "png": ("89504E470D0A1A0A",), "tiff": ("49492A00", "4D4D002A"), "bmp": ("424D",)}


def page_files(files: DataFrame) -> DataFrame:
    """(image_path, length, kind, content, error) of ``image_files``: pages that can be read have a kind and their bytes, the others a row that says what is wrong. By path, as pages are numbered. Spark lists no empty files."""
    begins = F.hex(F.substring("content", 1, 8))
    kind = F.coalesce(*[F.when(reduce(Column.__or__, [begins.startswith(m) for m in marks]), k) for k, marks in BEGINNINGS.items()])
    error = F.when(F.col("kind").isNull(), "not an image")
    known = files.withColumn("kind", kind)
    return known.select("image_path", "length", "kind", F.when(F.col("kind").isNotNull(), F.col("content")).alias("content"), error.alias("error")).orderBy("image_path")


def rotated_back(boxes: DataFrame, tall: float = 1.2) -> DataFrame:
    """Corners (x, y) of lines found on pages turned clockwise, back on the page as it was; ``height`` and ``width`` are the page's.

    Only pages higher than ``tall`` times their width were turned.
    """
    turned = F.col("height") > F.col("width") * tall
    back = F.transform("points", lambda p: F.struct((F.col("width") - p["y"]).cast("double").alias("x"), p["x"].cast("double").alias("y")))
    same = F.transform("points", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return boxes.withColumn("points", F.when(turned, back).otherwise(same))


def page_summary(lines: DataFrame, variants: DataFrame, taboo: DataFrame, dynasty: str, least: float = 0.5) -> DataFrame:
    """(page, confidence, n_lines, n_chars, n_variants, n_taboo): sure lines, their mean confidence, and flagged characters."""
    from . import text as tx

    sure = sure_lines(lines, least)
    whole = sure.groupBy("page").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    flags = character_flags(tx.characters(sure, ["page", "line"]), tx.normal_forms(variants), variants, taboo, dynasty)
    return whole.join(flags.groupBy("page").agg(F.count("variant_of").alias("n_variants"), F.count("taboo_for").alias("n_taboo")), "page")
