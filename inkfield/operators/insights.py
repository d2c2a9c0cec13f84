"""Figures about people and relations that a report is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees


def top_surnames(people: DataFrame, n: int) -> DataFrame:
    named = people.filter("family_name <> ''").groupBy("family_name").agg(F.count(F.lit(1)).alias("n"))
    return named.orderBy(F.desc("n"), "family_name").limit(n)


def surname_concentration(people: DataFrame) -> DataFrame:
    """Shares of the first and the first five surnames in all people, and the label that follows."""
    ranked = people.filter("family_name <> ''").groupBy("family_name").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.orderBy(F.desc("n"), "family_name").limit(20).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "family_name")))  # 20 rows
    total = people.agg(F.count(F.lit(1)).alias("total"))
    s = ranked.agg(*[F.sum(F.when(F.col("r") <= k, F.col("n")).otherwise(0)).alias(f"top{k}") for k in (1, 5, 20)])
    return s.crossJoin(total).select("total", "top1", "top5", "top20", F.round(F.col("top1") / F.col("total"), 6).alias("share1"), F.round(F.col("top5") / F.col("total"), 6).alias("share5"), F.when(F.col("top1") / F.col("total") > 0.05, "concentrated").otherwise("spread").alias("label"))


def ratio(people: DataFrame, column: str, first: list[str], second: list[str]) -> DataFrame:
    """Counts of two classes of values and their ratio, null if the second is empty."""
    a, b = F.count_if(F.col(column).isin(*first)), F.count_if(F.col(column).isin(*second))
    return people.agg(a.alias("n_first"), b.alias("n_second")).withColumn("ratio", F.round(F.try_divide("n_first", "n_second"), 6))


def completeness(people: DataFrame, relations: DataFrame) -> DataFrame:
    p, r = people.agg(F.count(F.lit(1)).alias("persons")), relations.agg(F.count(F.lit(1)).alias("relations"))
    return p.crossJoin(r).withColumn("percent", F.round(100.0 * F.col("relations") / F.col("persons"), 4))


def degree_distribution(relations: DataFrame, hub_from: int = 5) -> DataFrame:
    """Count, mean, upper median, extremes and hubs. The median is taken from the histogram of degrees, not from a list of all."""
    d = degrees(relations)
    hist = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    run = hist.withColumn("upto", F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    s = hist.agg(
        F.sum("n").alias("nodes"), F.sum(F.col("n") * F.col("degree")).alias("total"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.sum(F.when(F.col("degree") >= hub_from, F.col("n")).otherwise(0)).alias("hubs")
    )
    median = run.crossJoin(F.broadcast(s)).filter(F.col("upto") > F.floor(F.col("nodes") / 2)).agg(F.min("degree").alias("median"))
    return s.crossJoin(median).select("nodes", F.round(F.col("total") / F.col("nodes"), 6).alias("mean"), "median", "max_degree", "min_degree", "hubs", F.round(100.0 * F.col("hubs") / F.col("nodes"), 6).alias("hub_percent"))


def relation_types(relations: DataFrame) -> DataFrame:
    n = relations.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(1))
    return n.select("relation", "n", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 6).alias("percent"), (F.row_number().over(Window.orderBy(F.desc("n"), "relation")) == 1).alias("dominant"))


def cross_surname(relations: DataFrame, people: DataFrame) -> DataFrame:
    """Relations whose two ends have surnames, and different ones."""
    s = people.select(F.col("uri").alias("src"), F.col("family_name").alias("a"))
    d = people.select(F.col("uri").alias("dst"), F.col("family_name").alias("b"))
    both = relations.join(s, "src").join(d, "dst")
    crossing = (F.col("a") != "") & (F.col("b") != "") & (F.col("a") != F.col("b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(crossing).alias("crossing")).withColumn("percent", F.round(100.0 * F.try_divide("crossing", "n"), 6))


def birthday_coverage(people: DataFrame) -> DataFrame:
    return people.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("birthday").rlike("^[0-9]")).alias("dated")).withColumn("percent", F.round(100.0 * F.try_divide("dated", "n"), 6))


def first_findings(findings: DataFrame, each: int = 2, most: int = 6) -> DataFrame:
    """The first findings of each class, up to a number in all."""
    few = findings.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("seq"))).filter(F.col("rn") <= each)
    return few.orderBy("kind_no", "rn").limit(most)


def health(checks: DataFrame) -> DataFrame:
    """FAIL if any check fails, else WARN if any warns, else PASS."""
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.agg(F.count(F.lit(1)).alias("checks"), F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), worst + 1).alias("overall"))


def class_changes(people: DataFrame, old: str, new: str) -> DataFrame:
    return people.groupBy(F.col(old).alias("before"), F.col(new).alias("after")).agg(F.count(F.lit(1)).alias("n"))
