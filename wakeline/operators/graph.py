"""Graph operations on nodes(name, ...) and edges(source, target, edge_type, weight, evidence, evidence_total)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EVIDENCE_CAP
from .components import cut

#: Lists of one row hold up to so many names.
MOST_IN_ROW = 100_000


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """(name, n) of names that stand more than once; empty for a sound graph."""
    return nodes.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    names = nodes.select(F.col("name"))
    lost = edges.join(names, edges["source"] == names["name"], "left_anti")
    found = edges.join(names, edges["source"] == names["name"], "left_semi")
    return lost.unionByName(found.join(names, found["target"] == names["name"], "left_anti"))


def cap_evidence(edges: DataFrame, cap: int = EVIDENCE_CAP) -> DataFrame:
    """evidence sorted and cut to `cap`; evidence_total keeps the full count."""
    total = F.greatest(F.coalesce("evidence_total", F.lit(0)), F.size("evidence")).cast("long")
    return edges.withColumn("evidence_total", total).withColumn("evidence", F.slice(F.array_sort("evidence"), 1, cap))


def remove_edges(edges: DataFrame, name: str, side: str = "source", edge_types: list[str] | None = None) -> DataFrame:
    """Without the edges that leave (side="source") or enter (side="target") a node, of some types or all."""
    gone = F.col(side) == name
    if edge_types is not None:
        gone = gone & F.col("edge_type").isin(edge_types)
    return edges.where(~gone)


def node(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def dependencies(edges: DataFrame, name: str) -> DataFrame:
    """Distinct targets of a node, over all edge types."""
    return edges.where(F.col("source") == name).select(F.col("target").alias("name")).distinct()


def consumers(edges: DataFrame, name: str, edge_types: list[str] | None = None) -> DataFrame:
    """Distinct sources of edges into a node."""
    into = edges.where(F.col("target") == name)
    if edge_types is not None:
        into = into.where(F.col("edge_type").isin(edge_types))
    return into.select(F.col("source").alias("name")).distinct()


def incident(edges: DataFrame, name: str) -> DataFrame:
    """Edges out of and into a node; a self-loop stands twice."""
    return edges.where(F.col("source") == name).unionByName(edges.where(F.col("target") == name))


def between(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edges of both directions between two nodes."""
    return edges.where(((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a)))


def importing(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes that import a build file."""
    return nodes.where(F.array_contains("imports", path.replace("\\", "/")))


def import_index(nodes: DataFrame) -> DataFrame:
    """(import_path, name): which nodes import a build file."""
    return nodes.select(F.explode("imports").alias("import_path"), "name").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, backward: bool = True, limit: Column | None = None) -> DataFrame:
    """(seed, name, depth, parent): bounded breadth-first search from each seed, first visit wins.

    seeds has (seed) and, if `limit` is used, what limit refers to. A seed is not in its own result. parent is the
    smallest discoverer. Each hop is one join; lineage is cut after it, so plans don't grow with depth.
    """
    near, far = ("target", "source") if backward else ("source", "target")
    steps = cut(edges.select(F.col(near).alias("at"), F.col(far).alias("next")).distinct(), "steps")
    most = F.lit(depth) if limit is None else limit
    visited = seeds.select("seed", F.col("seed").alias("name"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), most.alias("most")).distinct()
    front = visited
    for hop in range(1, depth + 1):
        found = front.where(F.col("most") >= hop).join(steps, F.col("name") == F.col("at")).groupBy("seed", F.col("next").alias("name")).agg(F.min("name").alias("parent"), F.max("most").alias("most"))
        front = cut(found.join(visited.select("seed", "name"), ["seed", "name"], "left_anti").select("seed", "name", F.lit(hop).alias("depth"), "parent", "most"), "hop")
        visited = visited.unionByName(front)
    return visited.where("depth > 0").drop("most")


def _list_sizes(steps: DataFrame, depth: int) -> DataFrame:
    """(at, k1 .. k<depth>): at most so many nodes are within each number of steps of a node."""
    sizes = steps.groupBy("at").agg(F.count("*").alias("k1"))
    for d in range(2, depth + 1):
        sizes = cut(sizes, "sizes")
        more = steps.join(sizes.select(F.col("at").alias("next"), f"k{d - 1}"), "next", "left").groupBy("at").agg(F.sum(F.coalesce(f"k{d - 1}", F.lit(0)) + 1).alias(f"k{d}"))
        sizes = sizes.join(more, "at")
    return cut(sizes, "sizes")


def reach_all(edges: DataFrame, depth: int, backward: bool = True) -> DataFrame:
    """(seed, name, depth) of reach() from every node that has a step to take.

    A node's lists of names by distance are made of its neighbours' lists, so each hop moves an edge and the lists of its
    end, not a row for each pair. Nodes whose lists could hold more than MOST_IN_ROW names are left to reach().
    """
    near, far = ("target", "source") if backward else ("source", "target")
    steps = cut(edges.select(F.col(near).alias("at"), F.col(far).alias("next")).where("at <> next").distinct(), "steps")
    bounded = [steps] * depth
    large = None
    if (steps.groupBy("at").count().agg(F.max("count")).first()[0] or 0) + 1 > MOST_IN_ROW ** (1 / depth):
        sizes = _list_sizes(steps, depth)
        bounded = [steps.join(sizes.where(F.col(f"k{d}") <= MOST_IN_ROW), "at", "left_semi") for d in range(1, depth + 1)]
        large = cut(sizes.where(F.col(f"k{depth}") > MOST_IN_ROW).select(F.col("at").alias("seed")), "large")
    lists = bounded[0].groupBy("at").agg(F.collect_list("next").alias("l1"))
    for d in range(2, depth + 1):
        held = lists.select(F.col("at").alias("next"), *(f"l{i}" for i in range(1, d)))
        found = bounded[d - 1].join(held, "next", "left").groupBy("at").agg(F.collect_list("next").alias("l1"), *(F.array_distinct(F.flatten(F.collect_list(f"l{i}"))).alias(f"l{i + 1}") for i in range(1, d)))
        seen = F.array_append("l1", F.col("at"))
        for i in range(2, d + 1):
            found = found.withColumn(f"l{i}", F.array_except(f"l{i}", seen))
            seen = F.concat(seen, f"l{i}")
        lists = found

    def at_depth(d: int) -> Column:
        return F.transform(f"l{d}", lambda x: F.struct(x.alias("name"), F.lit(d).alias("depth")))

    rows = F.concat(*map(at_depth, range(1, depth + 1)))
    out = lists.select(F.col("at").alias("seed"), F.inline(rows))
    if large is None or not large.head(1):
        return out
    return out.unionByName(reach(edges, large, depth, backward).drop("parent"))


def transitive_consumers(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return reach(edges, seeds, depth, backward=True)


def transitive_dependencies(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    return reach(edges, seeds, depth, backward=False)
