"""Neighbourhoods, subgraphs, degrees and components over an edge table (src, dst)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .quantiles import percentiles
from .skew import join_counted, numbered


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst").distinct()


def k_hop(edges: DataFrame, centre: str, depth: int) -> DataFrame:
    """(uri, hop): everyone within ``depth`` undirected hops of a centre, without it; the hop is the least one."""
    ways = stash(both_ways(edges), "ways")  # once for all hops, as the edges may be a join
    front = edges.sparkSession.createDataFrame([(centre,)], "uri string")
    rings = [front.withColumn("hop", F.lit(0))]
    for hop in range(1, max(1, depth) + 1):
        front = stash(ways.join(front.withColumnRenamed("uri", "src"), "src", "left_semi").select(F.col("dst").alias("uri")).distinct(), "ring")
        rings.append(front.withColumn("hop", F.lit(hop)))
    return reduce(DataFrame.union, rings).groupBy("uri").agg(F.min("hop").alias("hop")).filter(F.col("hop") > 0)


def direct_relations(relations: DataFrame, centre: str) -> DataFrame:
    """(uri, relation, direction) of the centre's own relations: outgoing from it, incoming to it; a self-loop is outgoing."""
    out = relations.filter(F.col("src") == centre).select(F.col("dst").alias("uri"), "relation", F.lit("outgoing").alias("direction"))
    into = relations.filter((F.col("dst") == centre) & (F.col("src") != centre)).select(F.col("src").alias("uri"), "relation", F.lit("incoming").alias("direction"))
    return out.unionByName(into)


def depth_summary(depths: DataFrame, samples: int = 5) -> DataFrame:
    """One row of (root, depth): largest, upper median and mean (2 places) depth, and some of the deepest roots with theirs."""
    few = depths.orderBy(F.desc("depth"), "root").limit(samples).agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "root"))).alias("s"))
    # The upper median, from how many roots have each depth: a few rows.
    tally = depths.groupBy("depth").agg(F.count(F.lit(1)).alias("k"))
    upto = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    middle = tally.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(Window.partitionBy(F.lit(1)))).filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("depth").alias("median"))
    whole = depths.agg(F.count(F.lit(1)).alias("roots"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 2).alias("mean_depth"))
    show = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["root"], (-x["d"]).cast("string"))), ",")
    return whole.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(few)).select("roots", "max_depth", "median", "mean_depth", show.alias("samples"))


def bounded_subgraph(edges: DataFrame, centre: str, hops: int, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Nodes nearest to a centre (ties by uri) up to a cap, and the edges among them, once each."""
    near = k_hop(edges, centre, hops).orderBy("hop", "uri").limit(most_nodes - 1)
    nodes = near.union(edges.sparkSession.createDataFrame([(centre, 0)], "uri string, hop int")).withColumn("is_centre", F.col("uri") == centre)
    ids = nodes.select("uri")
    inside = edges.distinct().join(ids.withColumnRenamed("uri", "src"), "src", "left_semi").join(ids.withColumnRenamed("uri", "dst"), "dst", "left_semi")
    return nodes, inside


def degrees(edges: DataFrame) -> DataFrame:
    """(uri, degree); a self-loop counts twice. Ends are counted apart and summed, so partial sums combine early."""
    ends = edges.groupBy(F.col("src").alias("uri")).count().unionByName(edges.groupBy(F.col("dst").alias("uri")).count())
    return ends.groupBy("uri").agg(F.sum("count").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, self-loops dropped."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def top_degree_subgraph(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    top = degrees(edges).orderBy(F.desc("degree"), "uri").limit(n)
    pairs = undirected(edges)
    ids = top.select("uri")
    return top, pairs.join(ids.withColumnRenamed("uri", "a"), "a", "left_semi").join(ids.withColumnRenamed("uri", "b"), "b", "left_semi")


def hubs(degree: DataFrame, share: float = 0.95) -> DataFrame:
    """Nodes with a size: three times as large from the given percentile of degrees on."""
    cut = percentiles(degree, "degree", [share])[0]
    return degree.select("uri", "degree", F.when(F.col("degree") >= F.lit(cut), 3.0).otherwise(1.0).alias("size"))


def recentred(points: DataFrame, share: float = 0.99, to: float = 100.0) -> DataFrame:
    """Coordinates about their mean, clipped at a percentile of the distance and scaled to +-``to``."""
    mean = points.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = points.crossJoin(F.broadcast(mean)).select("uri", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    cut = {c: percentiles(moved.select(F.abs(c).alias(c)), c, [share])[0] for c in "xy"}
    clip = lambda c: F.greatest(F.lit(-cut[c]), F.least(F.lit(cut[c]), F.col(c))) / F.lit(cut[c]) * to
    return moved.select("uri", *[(clip(c) if cut[c] is not None else F.lit(None).cast("double")).alias(c) for c in "xy"])


def generation_depth(edges: DataFrame, most: int = 6) -> DataFrame:
    """(root, depth): for parents that are nobody's child, the length of the longest line of descent, up to ``most`` levels.

    Each level is one join on distinct pairs, so lines never multiply.
    """
    down = edges.select(F.col("src").alias("parent"), F.col("dst").alias("child")).distinct()
    front = down.select(F.col("parent").alias("root")).distinct().join(down.select(F.col("child").alias("root")).distinct(), "root", "left_anti").withColumn("at", F.col("root"))
    levels = [front.select("root", F.lit(0).alias("depth"))]
    for depth in range(1, most + 1):
        front = front.join(down, F.col("at") == F.col("parent")).select("root", F.col("child").alias("at")).distinct()
        levels.append(front.select("root").distinct().withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.union, levels).groupBy("root").agg(F.max("depth").alias("depth"))


def descent_depth(edges: DataFrame) -> DataFrame:
    """(root, depth): for parents that are nobody's child, how many generations away their farthest descendant is, without a cap on levels.

    Where nobody has two parents, each row points to an ancestor and pointers double: the rounds grow with the logarithm of the longest line, and people below
    a cycle have no root. Otherwise levels are taken one by one; a descendant met before is not followed again, so cycles end. Nulls and self-parents are left out.
    """
    down = stash(edges.select(F.col("src").alias("parent"), F.col("dst").alias("child")).filter("parent IS NOT NULL AND child IS NOT NULL AND parent <> child").distinct(), "down")
    children = down.groupBy("child").agg(F.count(F.lit(1)).alias("parents"))
    roots = down.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).join(children.select(F.col("child").alias("parent")), "parent", "left_anti")
    if children.filter("parents > 1").isEmpty():
        return _by_doubling(down, roots)
    front = stash(roots.select(F.col("parent").alias("root"), F.col("parent").alias("at")), "front")
    seen, levels, depth = [front], [front.select("root", F.lit(0).alias("depth"))], 0
    while True:
        depth += 1
        met = front.join(down, F.col("at") == F.col("parent")).select("root", F.col("child").alias("at")).distinct()
        front = stash(met.join(reduce(DataFrame.unionByName, seen), ["root", "at"], "left_anti"), "front")
        if front.isEmpty():
            return reduce(DataFrame.union, levels).groupBy("root").agg(F.max("depth").alias("depth"))
        seen = [stash(reduce(DataFrame.unionByName, [*seen, front]), "seen")] if len(seen) > 8 else [*seen, front]
        levels.append(front.select("root").distinct().withColumn("depth", F.lit(depth)))


def _by_doubling(down: DataFrame, roots: DataFrame) -> DataFrame:
    total = down.count()
    roots = stash(roots, "roots")
    # (node, up, steps): an ancestor and how far it is; rows whose ancestor is a root are done.
    done = [join_counted(down, roots, ["parent"], "n", total).select(F.col("parent").alias("root"), F.lit(1).cast("long").alias("steps"), F.col("child").alias("node"))]
    done = [stash(done[0], "reached")]
    up = stash(down.join(done[0].select(F.col("node").alias("child")), "child", "left_anti").select(F.col("child").alias("node"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")), "up")
    for _ in range(max(1, total).bit_length() + 1):
        left = up.count()
        if not left:
            break
        # What the ancestors point to: to a root, or farther up.
        reached = reduce(DataFrame.unionByName, done)
        asked = up.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
        there = reached.select(F.col("node").alias("up"), "root", F.col("steps").alias("more")).join(asked, "up")
        higher = up.select(F.col("node").alias("up"), F.col("up").alias("to"), F.col("steps").alias("more")).join(asked, "up")
        done.append(stash(join_counted(up, there, ["up"], "n", left).select("root", (F.col("steps") + F.col("more")).alias("steps"), "node"), "reached"))
        up = stash(join_counted(up, higher, ["up"], "n", left).select("node", F.col("to").alias("up"), (F.col("steps") + F.col("more")).alias("steps")), "up")
    return reduce(DataFrame.unionByName, done).groupBy(F.col("root")).agg(F.max("steps").cast("int").alias("depth"))


def contracted(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each component of links (a, b), by alternating star contraction.

    Each round is written as a scratch table. Rounds grow with the logarithm of the nodes; an error, never a
    part result, if they do not settle. The rows of a hub meet its smallest neighbour by broadcast.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "stars")
    total, before = edges.count(), None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), low, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stash(large, "stars-large")
        # Small star: u and its smaller neighbours are tied to the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        ends = join_counted(large, least, ["u"], "n", total).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stash(ends.select("e.*").filter("u <> v").distinct(), "stars")
        total, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (total, mark) == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
        before = total, mark
    raise RuntimeError("the components did not settle")


def clusters(pairs: DataFrame) -> DataFrame:
    """(node, cluster): connected components of pairs (a, b); a node paired only with itself is its own cluster. Nulls pair nothing."""
    pairs = pairs.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return nodes.join(contracted(pairs), "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def importance_cut(degree: DataFrame, percent: int, least: int = 100, from_nodes: int = 3000) -> DataFrame:
    """Above ``from_nodes`` nodes only the most connected ``percent`` stay (``least`` at least)."""
    n = degree.count()
    kept = n if n <= from_nodes else max(least, n * percent // 100)
    return numbered(degree.select("uri", "degree"), [F.desc("degree"), F.col("uri")], "rank").filter(F.col("rank") <= kept)


def unit_coordinates(points: DataFrame) -> DataFrame:
    """Coordinates from their minimum on, over the largest range of any axis."""
    s = points.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    most = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    span = F.when(most > 0, most).otherwise(F.lit(1.0))
    return points.crossJoin(F.broadcast(s)).select("uri", *[((F.col(c) - F.col(f"lo{c}")) / span).alias(c) for c in "xyz"])


def stand_in_layout(nodes: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Clustered positions for nodes without a layout: cluster and place follow from a hash of the uri, so they never change."""
    k = max(8, min(40, n // 80))
    h = lambda salt: F.pmod(F.xxhash64("uri", F.lit(seed + salt)), F.lit(1_000_000)) / 1_000_000.0
    cluster = F.floor(h(1) * k)
    angle = cluster * (2 * 3.141592653589793 / k)
    return nodes.select("uri", cluster.cast("int").alias("cluster"), (F.cos(angle) * 60 + (h(2) - 0.5) * 20).alias("x"), (F.sin(angle) * 60 + (h(3) - 0.5) * 20).alias("y"), ((h(4) - 0.5) * 40).alias("z"))


def stand_in_edges(placed: DataFrame) -> DataFrame:
    """(src, dst): in each cluster of a stand-in layout, every node tied to the next by uri."""
    placed = stash(numbered(placed.select("cluster", "uri"), [F.col("cluster"), F.col("uri")], "place"), "placed")
    after = placed.select("cluster", (F.col("place") - 1).alias("place"), F.col("uri").alias("dst"))
    return placed.join(after, ["cluster", "place"]).select(F.col("uri").alias("src"), "dst")


def graph_page(edges: DataFrame, people: DataFrame, limit: int, offset: int = 0, keep=None) -> tuple[DataFrame, DataFrame]:
    """A slice of edges, the people at their ends that pass ``keep``, and the slice's edges among those."""
    part = edges.orderBy("src", "dst", "relation").offset(offset).limit(limit)
    ends = part.select(F.col("src").alias("uri")).union(part.select("dst")).distinct()
    nodes = people.join(ends, "uri", "left_semi")
    if keep is not None:
        nodes = nodes.filter(keep)
    ids = nodes.select("uri")
    inside = part.join(ids.withColumnRenamed("uri", "src"), "src", "left_semi").join(ids.withColumnRenamed("uri", "dst"), "dst", "left_semi")
    return nodes, inside
