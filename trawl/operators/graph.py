"""Closures over tables of edges: ancestors, hierarchies, connected projects. Rounds end at the fixpoint, not at a depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.sources.tables import cut_lineage


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id, depth of everything each seed reaches over edges(src, dst), itself included at depth 0.

    A frontier loop: what a root has seen is never visited again, so cycles end. Only a count a round meets the driver.
    """
    frontier = cut_lineage(seeds.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct())
    seen = frontier
    step = edges.select("src", "dst").distinct()
    depth = 0
    while True:
        depth += 1
        ahead = frontier.join(step, frontier["id"] == step["src"]).select("root", F.col("dst").alias("id"), F.lit(depth).alias("depth")).distinct()
        frontier = cut_lineage(ahead.join(seen.select("root", "id"), ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and root (the smallest id reachable) of every node that has a link, by alternating star contraction.

    Each round hangs larger neighbours, then smaller ones, on a node's smallest neighbour, so that every component ends
    as a star around its root after a number of rounds that grows with the logarithm of its size, not with its diameter.
    Only one count and two sums a round come to the driver. Self-links and repeated links do no harm; nulls are dropped.
    """
    edges = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("v < u").distinct()
    before = None
    while True:
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("v < u").distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionAll(least.select("u", F.col("m").alias("v"))).filter("v < u").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h")).first()
        if before == now:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def project_closure(projects: DataFrame, edges: DataFrame) -> DataFrame:
    """project and component of every open project: edges count both ways between open ones; closed projects are neither
    returned nor crossed. Projects are numbers here, and a component is named by its smallest."""
    open_ = projects.filter("is_open").select("project").distinct()
    inner = edges.join(open_.select(F.col("project").alias("src")), "src", "left_semi").join(open_.select(F.col("project").alias("dst")), "dst", "left_semi")
    roots = connected(inner, "src", "dst")
    return open_.join(roots.select(F.col("id").alias("project"), "root"), "project", "left").select("project", F.coalesce("root", "project").alias("component"))


def scope_for(seeds: DataFrame, closed: DataFrame, indexed: DataFrame) -> DataFrame:
    """seed and every indexed project connected with it."""
    own = seeds.select(F.col("project").alias("seed")).join(closed.select(F.col("project").alias("seed"), "component"), "seed")
    return own.join(closed, "component").join(indexed.select("project").distinct(), "project", "left_semi").select("seed", "project")


def direct_supertypes(types: DataFrame, parents: DataFrame) -> DataFrame:
    """id and its ordered parents that are types; the root type stands first where no class is among them.

    types(id, is_class), parents(child_id, parent_id, ord); unknown parents are left out.
    """
    known = types.select(F.col("id").alias("parent_id"), "is_class")
    grouped = parents.join(known, "parent_id").groupBy(F.col("child_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "parent_id"))).alias("list"), F.max("is_class").alias("any_class"))
    names = F.transform("list", lambda p: p["parent_id"].cast("string"))
    full = types.select("id").join(grouped, "id", "left")
    listed = F.coalesce(names, F.array().cast("array<string>"))
    return full.select("id", F.when(F.coalesce("any_class", F.lit(False)), listed).otherwise(F.concat(F.array(F.lit("Object")), listed)).alias("supertypes"))


def type_hierarchy(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """root, id, depth, and whether nothing lies beyond the node; edges(src, dst) lead in the wanted direction."""
    reached = closure(roots, edges)
    inner = edges.select(F.col("src").alias("id")).distinct().withColumn("more", F.lit(True))
    return reached.join(inner, "id", "left").select("root", "id", "depth", F.col("more").isNull().alias("is_leaf"))
