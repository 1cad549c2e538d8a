"""Walks on directed graphs of many repositories (``repo, source, target``): reachability within levels, cycles.

Loops over frontiers: each level is one join that is cut in the shared folder; a node is visited once, whatever
the number of walks that lead to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, stored


def reachable(edges: DataFrame, starts: DataFrame, levels: int, reverse: bool = False) -> DataFrame:
    """``repo, start, node, level``: nodes within ``levels`` steps of each start (``repo, node``), the start itself
    left out, also where a cycle leads back. ``reverse``: against the direction of the edges."""
    a, b = ("target", "source") if reverse else ("source", "target")
    e = edges.select("repo", F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = cut(starts.select("repo", F.col("node").alias("start"), "node", F.lit(0).alias("level")).distinct())
    front = seen
    for level in range(1, levels + 1):
        step = front.join(e, ["repo", "node"]).select("repo", "start", F.col("next").alias("node")).distinct().join(seen, ["repo", "start", "node"], "left_anti")
        front = cut(step.withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("level > 0")


def cycles(edges: DataFrame) -> DataFrame:
    """``repo, component, node``: strongly connected components of more than one node, named by their least node.

    Each round every node learns the least name that reaches it forwards (``a``) and backwards (``b``). A node for which
    both are the same name is in that name's component. Nodes with another pair of names can't share a component, so
    edges between nodes whose pairs differ are dropped, with those of finished components, and the rest goes round
    again, until no edge is left. At least one component of each connected part is finished in each round, and parts
    run side by side. Names are ordered by a hash, as if drawn at random, so that the least one of a stretch of a path
    is anywhere in it and what a node knows grows by a factor a step (see ``_least``): a chain of n nodes takes some
    log n steps, not n. Each step is a join over the nodes and edges that are left; no node's neighbourhood is gathered.

    Null ends and loops are left out, repeated edges count once; an empty table has no components."""
    ranked = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.col(c)).alias(c)
    left = stored(edges.filter("source IS NOT NULL AND target IS NOT NULL AND source <> target").select("repo", ranked("source"), ranked("target")).distinct())
    parts: list[DataFrame] = []
    while not left.isEmpty():
        left = _trimmed(left)
        if left.isEmpty():
            break
        a, b = _least(left), _least(left.select("repo", F.col("target").alias("source"), F.col("source").alias("target")))
        names = stored(a.withColumnRenamed("name", "a").join(b.withColumnRenamed("name", "b"), ["repo", "node"]))
        parts.append(names.filter("a = b").select("repo", F.col("a").alias("component"), "node"))
        open_ = names.filter("a <> b")
        ends = lambda c, x, y: open_.select("repo", F.col("node").alias(c), F.col("a").alias(x), F.col("b").alias(y))  # noqa: B023, E731
        left = stored(left.join(ends("source", "a", "b"), ["repo", "source"]).join(ends("target", "c", "d"), ["repo", "target"]).filter("a = c AND b = d").select("repo", "source", "target"))
    if not parts:
        return edges.sparkSession.createDataFrame([], "repo string, component string, node string")
    found = reduce(DataFrame.unionByName, parts).withColumn("node", F.substr("node", F.lit(17)))
    size = found.groupBy("repo", "component").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    return found.join(size, ["repo", "component"]).select("repo", F.col("least").alias("component"), "node")


def _trimmed(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """The edges without some that are in no cycle: those of nodes without a way in or out. Only to have less to do."""
    for _ in range(rounds):
        into, out = edges.select("repo", F.col("target").alias("source")).distinct(), edges.select("repo", F.col("source").alias("target")).distinct()
        edges = edges.join(into, ["repo", "source"], "left_semi").join(out, ["repo", "target"], "left_semi").select("repo", "source", "target")
    return stored(edges)


def _least(edges: DataFrame) -> DataFrame:
    """``repo, node, name``: the least node from which a path leads to the node, itself included. Each node keeps one
    pointer, to the least node known to reach it; a step takes the pointers of the nodes before it and the pointer of
    the node that its own pointer names, so that what is known spreads along edges and jumps along pointers."""
    nodes = edges.select("repo", F.col("source").alias("node")).union(edges.select("repo", "target")).distinct()
    known = stored(nodes.withColumn("name", F.col("node")))
    while True:
        sent = edges.join(known.withColumnRenamed("node", "source"), ["repo", "source"]).select("repo", F.col("target").alias("node"), "name")
        jump = known.join(known.select("repo", F.col("node").alias("name"), F.col("name").alias("far")), ["repo", "name"]).select("repo", "node", F.col("far").alias("name"))
        new = stored(known.unionByName(sent).unionByName(jump).groupBy("repo", "node").agg(F.min("name").alias("name")))
        moved = new.join(known.withColumnRenamed("name", "old"), ["repo", "node"]).filter("name <> old")
        known = new
        if moved.isEmpty():
            return known


def between(edges: DataFrame, pairs: DataFrame, modules: DataFrame) -> DataFrame:
    """Relationships and number of files of the file edges between each pair (``repo, source, target``) of modules."""
    m = modules.select("repo", "path", "module")
    e = edges.filter("target_kind = 'file'").select("repo", F.col("source").alias("f"), F.col("target").alias("g"), "relationship")
    e = e.join(m.withColumnsRenamed({"path": "f", "module": "source"}), ["repo", "f"]).join(m.withColumnsRenamed({"path": "g", "module": "target"}), ["repo", "g"])
    return pairs.join(e, ["repo", "source", "target"], "left").groupBy("repo", "source", "target").agg(F.array_sort(F.collect_set("relationship")).alias("relationships"), F.count_distinct("f").alias("files"))


def affected(changed: DataFrame, modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, module, direct``: modules of changed files (``repo, path``), and those that depend on them."""
    own = changed.join(modules.select("repo", "path", "module"), ["repo", "path"]).select("repo", "module").distinct()
    users = edges.select("repo", F.col("target").alias("module"), "source").join(own, ["repo", "module"]).select("repo", F.col("source").alias("module")).distinct()
    return own.withColumn("direct", F.lit(True)).unionByName(users.withColumn("direct", F.lit(False))).groupBy("repo", "module").agg(F.max("direct").alias("direct"))
