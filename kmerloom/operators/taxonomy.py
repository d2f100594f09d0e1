"""The taxonomy graph as edges (parent, child): nodes, orders, expansion and descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions import lineage
from kmerloom.session import numbered, stored


def nodes(index: DataFrame, lineage_col: str = "lineage") -> DataFrame:
    """Distinct rank labels of all lineages: the node domain, with or without sequences."""
    return index.select(F.explode(lineage.all_ranks(F.col(lineage_col))).alias("node")).distinct()


def edges(index: DataFrame, lineage_col: str = "lineage") -> DataFrame:
    """Distinct pairs of successive valid labels (a blank rank is skipped over)."""
    tokens = lineage.lineage_tokens(F.col(lineage_col))
    pairs = index.select(tokens.alias("t")).select(F.explode(F.arrays_zip(F.col("t").alias("parent"), F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))).alias("child"))).alias("e"))
    return pairs.select("e.parent", "e.child").where("child is not null").distinct()


def nodes_at(graph: DataFrame, prefix: str) -> DataFrame:
    """Nodes of a rank that have children."""
    return graph.where(F.col("parent").startswith(prefix)).select(F.col("parent").alias("node")).distinct()


def expand(beams: DataFrame, graph: DataFrame, top: DataFrame) -> DataFrame:
    """Candidates (all columns of beams, child): children of the last path entry, itself if it has none, all ``top`` nodes for an empty path."""
    roots = top.agg(F.array_sort(F.collect_set("node")).alias("roots"))
    first = beams.where(F.size("path") == 0).crossJoin(F.broadcast(roots)).withColumn("child", F.explode("roots")).drop("roots")
    last = beams.where(F.size("path") > 0).withColumn("last", F.element_at("path", -1))
    later = last.join(graph, F.col("last") == F.col("parent"), "left").withColumn("child", F.coalesce("child", "last")).drop("last", "parent")
    return first.unionByName(later)


def paths(index: DataFrame, lineage_col: str = "lineage") -> DataFrame:
    """(node, path): each node with every way from a root to it, as the lineages say (labels from the root to the node)."""
    tokens = lineage.lineage_tokens(F.col(lineage_col))
    upto = index.select(tokens.alias("t")).distinct().select(F.explode(F.transform("t", lambda _, k: F.slice("t", F.lit(1), k + 1))).alias("path"))
    return upto.distinct().select(F.element_at("path", -1).alias("node"), "path")


def is_forest(ways: DataFrame) -> bool:
    """Whether each node of :func:`paths` has one way, and no label twice on it: then the lineages form trees."""
    once = ways.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path") - F.size(F.array_distinct("path"))).alias("again"))
    return once.where("n > 1 or again > 0").isEmpty()


def intervals(ways: DataFrame) -> DataFrame:
    """(node, parent, depth, first, last) of a forest: Euler-tour numbers.

    Nodes are numbered depth first, siblings by label: ``first`` is a node's own number and ``last`` the greatest number below it, so that d is a descendant of a
    where ``a.first < d.first <= a.last``. The numbers are places in the order of the ways; a subtree's size is a count of the ways that lead
    through its root. No step depends on the depth.
    """
    numbers = numbered(ways, None, ["path"], "first")
    sizes = ways.select(F.explode("path").alias("through")).groupBy("through").agg(F.count(F.lit(1)).alias("n"))
    joined = numbers.join(sizes, F.col("node") == F.col("through"))
    return joined.select("node", F.try_element_at("path", F.lit(-2)).alias("parent"), F.size("path").cast("bigint").alias("depth"), "first", (F.col("first") + F.col("n") - 1).alias("last"))


def subtrees(nodes: DataFrame, tour: DataFrame) -> DataFrame:
    """(ancestor, descendant, first) of each of the given nodes (column node) by its interval; ordered by ``first`` the descendants come depth first."""
    up = nodes.select("node").join(tour, "node").select(F.col("node").alias("ancestor"), F.col("first").alias("lo"), F.col("last").alias("hi"), "depth")
    down = tour.select(F.col("node").alias("descendant"), "first")
    return up.join(down, (F.col("lo") < F.col("first")) & (F.col("first") <= F.col("hi"))).select("ancestor", "descendant", "first")


def descendants_of(index: DataFrame, graph: DataFrame | None = None, lineage_col: str = "lineage") -> DataFrame:
    """The rows of :func:`descendants`, without a step for each level where the lineages form trees: a node's ancestors are the labels on its way."""
    ways = stored(paths(index, lineage_col), "paths")
    if not is_forest(ways):
        return descendants(graph if graph is not None else edges(index, lineage_col))
    at = F.explode(F.sequence(F.lit(1), F.size("path") - 1))
    up = ways.where(F.size("path") > 1).select("node", "path", at.alias("at"))
    return up.select(F.element_at("path", F.col("at")).alias("ancestor"), F.col("node").alias("descendant"), F.slice("path", F.col("at") + 1, F.size("path")).alias("path"))


def descendants(graph: DataFrame, most_steps: int = 64) -> DataFrame:
    """(ancestor, descendant, path): one row per way down (a bag), path from the ancestor's child to the descendant.

    One join per level, stored in between; it ends with the depth of the graph. A graph deeper than ``most_steps``
    (a cycle) raises.
    """
    step = graph.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.array("child").alias("path"))
    found = None
    for _ in range(most_steps):
        step = stored(step, "descendants")
        if step.isEmpty():
            return found if found is not None else step
        found = step if found is None else found.union(step)
        step = step.join(graph, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant"), F.concat("path", F.array("child")).alias("path"))
    raise ValueError(f"the taxonomy is deeper than {most_steps} levels or has a cycle")
