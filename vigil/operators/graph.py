"""Graphs as edge DataFrames: closure, simple paths and shortest chains by bounded self-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, drop


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """(start, node, depth, path): all simple paths from ``starts`` (start), up to max_depth edges.

    One equi-join per level, each written before the next reads it; a path never visits a node twice, so cycles end by
    themselves. A level without paths ends the search.
    """
    edges = edges.select("src", "dst")
    level = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"))
    levels = []  # each is read by the result
    for d in range(1, max_depth + 1):
        level = cut(
            level.select("start", F.col("node").alias("src"), "path").join(edges, "src").where(~F.array_contains("path", F.col("dst")))
            .select("start", F.col("dst").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        )
        if level.isEmpty():
            drop(level)
            break
        levels.append(level)
    return reduce(DataFrame.union, levels) if levels else starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path")).limit(0)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs connected by a path; doubles the reach each round until nothing new comes."""
    known = cut(edges.select("src", "dst").distinct())
    before = known.count()
    while True:
        step = known.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        wider = cut(known.union(step).distinct())
        drop(known)
        known, now = wider, wider.count()
        if now == before:
            return known
        before = now


def shortest_chains(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_depth: int = 5) -> DataFrame:
    """(start, node, depth, path): the shortest path per pair, the least by node names among equals."""
    paths = simple_paths(edges, starts, max_depth).join(ends.select(F.col("end").alias("node")), "node", "left_semi")
    return paths.groupBy("start", "node").agg(F.min(F.struct("depth", "path")).alias("m")).select("start", "node", "m.depth", "m.path")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of undirected ``edges`` (a, b): the label is the least node it reaches.

    Rounds of large star (each node hangs its larger neighbours on its least one) and small star (each node hangs itself and
    its smaller neighbours on the least): O(log n) of them for a path of any order. They end when all edges of a round lead
    from a node to one that has no other. Loops make a component of one node.
    """
    own = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct())
    while True:
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = cut(large.join(below, "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select(F.col("m").alias("v"), "u").distinct())
        drop(e)
        e = nxt
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("d")).union(e.select("v", F.lit(0)).distinct())
        if ends.groupBy("x").agg(F.sum("d").alias("d"), F.min("d").alias("head")).where("d > 1 or (d = 1 and head = 0)").isEmpty():
            break
    named = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = cut(named.union(e.select("v", "v")).union(own).groupBy("node").agg(F.min("label").alias("label")))
    drop(e)
    return out
