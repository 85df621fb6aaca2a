"""Dependency trees and graphs of any depth: breadth-first depths, ancestor paths, and what lies in each subtree.

Graphs (yarn, Cargo) become trees by the shortest way from a direct dependency. On a tree every question is answered by
pointer doubling: after round k a package points to its 2^k-th ancestor and knows all of the way there, and has the sums of
its descendants nearer than 2^k. A tree of depth 1000 takes ten rounds instead of a thousand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut, drop

SEVERITIES = ("critical", "high", "medium", "low")


def depths(packages: DataFrame, edges: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(path, name, depth, parent, is_direct) of packages (path, name) along edges (path, name, dependency).

    ``direct`` (path, name) are the roots; without it, packages that no other one depends on. The depth is the fewest edges
    from a root, the parent the least name of those one edge nearer; both are null where no root leads. Each round goes on
    from the packages found last only, so cycles end by themselves. Edges to packages that are not listed count for nothing.
    """
    known = cut(packages.select("path", "name").where("name is not null").distinct())
    e = cut(edges.select("path", "name", F.col("dependency")).where("name <> dependency").distinct().join(known.select("path", F.col("name").alias("dependency")), ["path", "dependency"], "left_semi"))
    roots = known.join(e.select("path", F.col("dependency").alias("name")), ["path", "name"], "left_anti") if direct is None else known.join(direct, ["path", "name"], "left_semi")
    level = cut(roots.select("path", "name", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    levels = [level]
    while not level.isEmpty():
        seen = reduce(DataFrame.union, [x.select("path", "name") for x in levels])
        step = e.join(level.select("path", "name"), ["path", "name"]).groupBy("path", F.col("dependency").alias("child")).agg(F.min("name").alias("parent"))
        level = cut(step.select("path", F.col("child").alias("name"), F.lit(len(levels)).alias("depth"), "parent").join(seen, ["path", "name"], "left_anti"))
        levels.append(level)
    found = reduce(DataFrame.union, levels)
    return known.join(found, ["path", "name"], "left").select("path", "name", "depth", "parent", F.coalesce(F.col("depth") == 0, F.lit(False)).alias("is_direct"))


def rollup(tree: DataFrame, findings: DataFrame, digest: bool = False) -> DataFrame:
    """(path, name, depth, root, way, own, below, and below_ of each severity) of a tree (path, name, parent).

    ``way`` is the array of names from the root down; with ``digest`` instead way_md5, that of the names joined by ">", and no
    way is ever written out: all ways of a deep tree together grow with the square of its packages. ``own`` counts the
    package's findings (path, name, severity), ``below`` those of its whole subtree, itself included, of any severity. A
    package listed twice has its least parent; a parent that is not listed is none. Packages on or under a cycle of parents
    never reach a root: their depth, root and way are null and their sums -1.
    """
    count = [F.count_if(F.lower("severity") == s).alias(s) for s in SEVERITIES]
    sums = ["all", *SEVERITIES, "size"]
    n = findings.groupBy("path", "name").agg(F.count("*").alias("all"), *count)
    listed = tree.where("name is not null").groupBy("path", "name").agg(F.min("parent").alias("parent"))
    listed = listed.join(listed.select("path", F.col("name").alias("parent"), F.lit(True).alias("there")), ["path", "parent"], "left")
    start = listed.select("path", "name", F.when(F.col("there"), F.col("parent")).alias("up")).join(n, ["path", "name"], "left").fillna(0, sums[:-1]).withColumn("size", F.lit(1).cast("long"))
    now = first = cut(start.withColumn("top", F.col("name")).withColumn("steps", F.lit(0)).withColumn("own", F.col("all")).withColumn("way", F.lit(None).cast("array<string>") if digest else F.array("name")))
    rounds = 1
    packages = now.count()
    while True:
        open_ = now.where("up is not null")
        if open_.isEmpty() or 2 ** (rounds - 1) > packages:  # a chain has no more edges than packages: what is open lies on a cycle
            break
        more = open_.groupBy("path", F.col("up").alias("name")).agg(*[F.sum(s).alias(f"+{s}") for s in sums])
        above = now.select("path", F.col("name").alias("up"), F.col("up").alias("next"), F.col("top").alias("before"), F.col("steps").alias("further"), F.col("way").alias("way_before"))
        step = now.join(more, ["path", "name"], "left").join(above, ["path", "up"], "left")
        added = [(F.col(s) + F.coalesce(F.col(f"`+{s}`"), F.lit(0))).alias(s) for s in sums]
        steps = (F.col("steps") + F.coalesce(F.col("further") + 1, F.lit(0))).alias("steps")
        nxt = cut(step.select("path", "name", F.col("next").alias("up"), *added, F.coalesce("before", "top").alias("top"), steps, "own", F.when(F.col("way_before").isNotNull(), F.concat("way_before", "way")).otherwise(F.col("way")).alias("way")))
        drop(*(now,) if now is not first else ())
        now, rounds = nxt, rounds + 1
    ends = F.col("up").isNull()
    part = lambda s: F.when(ends, F.col(s)).otherwise(F.lit(-1)).cast("long")
    out = now.select("path", "name", F.when(ends, F.col("steps")).alias("depth"), F.when(ends, F.col("top")).alias("root"), F.when(ends, F.col("way")).alias("way"), "own", part("all").alias("below"), *[part(s).alias(f"below_{s}") for s in SEVERITIES])
    if not digest:
        return out
    whole = now.where(ends).select("path", "name", "size", F.col("top").alias("root"), F.col("steps").alias("depth")).join(first.select("path", "name", "up"), ["path", "name"])
    return out.drop("way").join(_way_digests(whole), ["path", "name"], "left")


def _way_digests(nodes: DataFrame) -> DataFrame:
    """(path, name, way_md5) of nodes (path, name, up, root, depth, size), all of which reach their root.

    A digest goes on from the parent's, so a tree is read in order, parents first, as a stream; trees are spread over the
    tasks. Of siblings the one with the largest subtree comes last and takes its parent's state over: a task holds one state
    for each ancestor with a larger subtree to come, which is the logarithm of the tree's size at most.
    """
    by = Window.partitionBy("path", "root", "up").orderBy("size", "name")
    before = F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    at = F.when(F.col("up").isNull(), F.lit(0)).otherwise(before).cast("long")
    fixed = cut(nodes.withColumn("at", at).withColumn("last", F.lead("name").over(by).isNull()))
    now = cut(fixed.select("path", "name", "up", "at"))
    while not now.where("up is not null").isEmpty():
        above = now.select("path", F.col("name").alias("up"), F.col("up").alias("next"), F.col("at").alias("more"))
        nxt = cut(now.join(above, ["path", "up"], "left").select("path", "name", F.col("next").alias("up"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
        drop(now)
        now = nxt
    placed = fixed.drop("at", "up").join(now.select("path", "name", "at"), ["path", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: list = []
        for b in batches:
            out = []
            for name, depth, size, last in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("name", "depth", "size", "last")), strict=True):
                if depth == 0:
                    states, state = [], hashlib.md5(name.encode(), usedforsecurity=False)
                else:
                    state = states.pop() if last else states[-1].copy()
                    state.update(b">" + name.encode())
                if size > 1:
                    states.append(state)
                out.append(state.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("path")), b.column(b.schema.get_field_index("name")), pa.array(out, pa.string())], ["path", "name", "way_md5"])

    ordered = placed.select("path", "root", "at", "name", "depth", "size", "last").repartition("path", "root").sortWithinPartitions("path", "root", "at")
    return ordered.mapInArrow(run, "path string, name string, way_md5 string")
