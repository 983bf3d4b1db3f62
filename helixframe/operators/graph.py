"""Graphs as edge tables: components by large-star and small-star rounds, reachability by a frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.lineage import stash


def _hang(arcs: DataFrame) -> DataFrame:
    """arcs (u, v) with m, the least of u and its v."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return arcs.join(least, "u")


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """L1: (node, root) for every node of an edge (a, b), root being the component's least node.

    Repeated edges, both directions and loops are allowed; every round is checkpointed, and only a count and a
    checksum come to the driver, which tell when nothing changes any more.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        hung = _hang(large)
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v")))
        now = stash(small.where("u <> v").distinct())
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == last:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        last = state
    raise RuntimeError(f"no end after {rounds} rounds")


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes, those without an edge on their own."""
    return nodes.select("node").distinct().join(connected(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def of_size(found: DataFrame, least: int) -> DataFrame:
    """L3: the nodes of components of `least` nodes or more."""
    return found.join(found.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("root"), "root", "left_semi")


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, distance) of what the seeds (node) reach along undirected edges (a, b), by breadth first search.

    A node next to the last ones found is one of them, of those before them or new, so only these two are looked into.
    """
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = [stash(seeds.select("node").distinct().withColumn("distance", F.lit(0)))]
    for step in range(1, rounds + 1):
        near = reduce(DataFrame.unionByName, found[-2:]).select("node")
        frontier = stash(found[-1].join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(near, "node", "left_anti").withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        found.append(frontier)
    raise RuntimeError(f"no end after {rounds} rounds")
