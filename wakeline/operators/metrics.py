"""Coupling metrics, solution metrics, enrichment, health and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import REFERENCE, coupling_weight
from .components import cut, numbered

HOTSPOT_PROJECTS, BRIDGE_SOLUTIONS = 3, 3
STABLE_FAN_IN, STABLE_INSTABILITY, COUPLING_LIMIT, COHESION_LIMIT, CROSS_LIMIT, IMPORT_LIMIT = 5, 0.3, 500.0, 0.3, 0.5, 10


def _long(c: Column, name: str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("long").alias(name)


def coupling_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node. fan_in and fan_out count reference edges, not neighbours; consumer_count counts distinct sources."""
    weight = F.col("weight") * coupling_weight()
    both = edges.select(F.col("source").alias("name"), F.lit(1).alias("out"), "edge_type", weight.alias("w"), F.lit(None).cast("string").alias("who"))
    both = both.unionByName(edges.select(F.col("target").alias("name"), F.lit(0).alias("out"), "edge_type", weight.alias("w"), F.col("source").alias("who")))
    is_ref = F.col("edge_type") == REFERENCE
    sums = both.groupBy("name").agg(
        F.count_if((F.col("out") == 0) & is_ref).alias("fan_in"),
        F.count_if((F.col("out") == 1) & is_ref).alias("fan_out"),
        F.count_if(F.col("out") == 0).alias("afferent"),
        F.count_if(F.col("out") == 1).alias("efferent"),
        # tenths are added as whole numbers, so the sum doesn't depend on the order of rows
        (F.sum(F.round(F.col("w") * 10).cast("long")) / 10).alias("coupling"),
    )
    sources = edges.select("target", "source").distinct().groupBy(F.col("target").alias("name")).agg(F.count("*").alias("consumer_count"))
    objects = nodes.select("name", F.explode("object_refs").alias("object")).distinct()
    shared = objects.groupBy("object").agg((F.count("*") > 1).cast("int").alias("shared"))
    density = objects.join(shared, "object").groupBy("name").agg((F.sum("shared") / F.count("*")).alias("shared_db_density"))
    out = nodes.select("name", F.size("type_declarations").alias("n_types")).join(sums, "name", "left").join(sources, "name", "left").join(density, "name", "left")
    total = F.coalesce(F.col("fan_in") + F.col("fan_out"), F.lit(0))
    return out.select(
        "name",
        *(_long(F.col(c), c) for c in ("fan_in", "fan_out")),
        F.when(total > 0, F.col("fan_out") / total).otherwise(0.0).alias("instability"),
        F.coalesce("coupling", F.lit(0.0)).alias("coupling"),
        *(_long(F.col(c), c) for c in ("afferent", "efferent")),
        F.coalesce("shared_db_density", F.lit(0.0)).alias("shared_db_density"),
        _long(F.greatest(F.col("n_types"), F.lit(0)), "type_export_count"),
        _long(F.col("consumer_count"), "consumer_count"),
    )


def top_coupled(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n most coupled nodes; names decide ties."""
    return metrics.orderBy(F.desc("coupling"), "name").limit(n).select("name", "coupling")


def _sides(known: DataFrame, near: str, words: str, placed: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, n) edges at nodes of each solution, (id, other) solutions at far ends that are none of the near end)."""
    far = known.select(F.col(near).alias("name"), F.posexplode_outer(words).alias("pos", "x"))
    got = far.groupBy("name", F.col("x.w").alias("w")).agg(F.bit_or("x.bits").alias("bits"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("k"))
    got = cut(got, "sides")
    at = placed.join(got.groupBy("name").agg(F.sum("k").alias("k")), "name").groupBy("id").agg(F.sum("k").alias("n"))
    new = got.where("w is not null").join(own, ["name", "w"], "left").select("name", "w", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("own", F.lit(0).cast("long")))).alias("bits"))
    sums = placed.join(new, "name").groupBy("id", "w").agg(F.bit_or("bits").alias("bits"))
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return at, sums.select("id", "w", F.explode(held).alias("i")).select("id", (F.col("w") * 64 + F.col("i")).alias("other"))


def solution_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(solution, projects, internal, external, cross_ratio, incoming, outgoing): edges by whether both ends are inside.

    An edge counts for each solution of either end; edges between nodes without solutions count nowhere. Solutions are
    numbered and a node's are bits by words of 64, so what an edge leads to is gathered for its node first and dealt to
    the node's solutions afterwards; only solutions of both ends are rows of an edge.
    """
    nodes = cut(nodes.select("name", "solutions"), "solutions")
    inside = nodes.select("name", F.explode("solutions").alias("solution"))
    ids = numbered(inside.select(F.col("solution").alias("name"))).withColumnRenamed("name", "solution")
    placed = cut(inside.join(ids, "solution").select("name", "id").distinct(), "placed")
    own = placed.groupBy("name", F.shiftright("id", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("own"))
    words = own.groupBy("name").agg(F.collect_list(F.struct("w", F.col("own").alias("bits"))).alias("words"))
    sets = cut(nodes.select("name").join(placed.groupBy("name").agg(F.collect_list("id").alias("ids")).join(words, "name"), "name", "left"), "sets")
    known = edges.select("source", "target").join(sets.toDF("source", "ss", "sw"), "source").join(sets.toDF("target", "ts", "tw"), "target")
    internal = known.select(F.explode(F.array_intersect("ss", "ts")).alias("id")).groupBy("id").agg(F.count("*").alias("internal"))
    (leaving, after), (entering, before) = _sides(known, "source", "tw", placed, own), _sides(known, "target", "sw", placed, own)
    sums = leaving.unionByName(entering).groupBy("id").agg(F.sum("n").alias("ends")).join(internal, "id", "left")

    def named(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.join(ids.toDF("__name", "other"), "other").groupBy("id").agg(F.array_sort(F.collect_list("__name")).alias(name))

    none = F.array().cast("array<string>")
    found = inside.groupBy("solution").agg(F.count("*").alias("projects")).join(ids, "solution").join(sums, "id", "left").join(named(before, "incoming"), "id", "left").join(named(after, "outgoing"), "id", "left")
    both, ends = F.coalesce("internal", F.lit(0)), F.coalesce("ends", F.lit(0))
    external = ends - 2 * both
    ratio = F.when(both + external > 0, external / (both + external)).otherwise(0.0)
    return found.select("solution", "projects", both.cast("long").alias("internal"), external.cast("long").alias("external"), ratio.alias("cross_ratio"), F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing"))


def bridges(nodes: DataFrame, least: int = BRIDGE_SOLUTIONS) -> DataFrame:
    """Nodes in at least three solutions."""
    return nodes.where(F.size("solutions") >= least).select("name", F.size("solutions").cast("long").alias("n_solutions"))


def object_projects(nodes: DataFrame) -> DataFrame:
    """(object, projects): the sorted distinct nodes that use each shared object."""
    return nodes.select("name", F.explode("object_refs").alias("object")).groupBy("object").agg(F.array_sort(F.collect_set("name")).alias("projects"))


def enrich(rows: DataFrame, metrics: DataFrame, members: DataFrame, key: str = "consumer") -> DataFrame:
    """rows with rounded metrics and whether the consumer is in a cycle; unknown consumers get nulls."""
    own = metrics.select(F.col("name").alias(key), F.round("coupling", 2).alias("coupling_score"), "fan_in", "fan_out", F.round("instability", 3).alias("instability"), F.lit(True).alias("__known"))
    flags = members.select(F.col("name").alias(key), F.lit(True).alias("__in")).distinct()
    out = rows.join(own, key, "left").join(flags, key, "left")
    return out.withColumn("in_cycle", F.when(F.col("__known"), F.coalesce("__in", F.lit(False)))).drop("__known", "__in")


def dashboard(nodes: DataFrame, edges: DataFrame, metrics: DataFrame, groups: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """One row of totals and averages."""
    sums = metrics.agg(
        F.count("*").alias("n_nodes"),
        F.round(F.avg("fan_in"), 6).alias("avg_fan_in"),
        F.round(F.avg("fan_out"), 6).alias("avg_fan_out"),
        F.round(F.sum(F.round(F.col("coupling") * 10).cast("long")) / 10 / F.count("*"), 6).alias("avg_coupling"),
        F.max("coupling").alias("max_coupling"),
        F.max_by("name", F.struct("coupling", -F.substring("name", 2, 20).cast("long"))).alias("most_coupled"),
    )
    hot = object_projects(nodes).where(F.size("projects") >= HOTSPOT_PROJECTS).agg(F.count("*").alias("n_hotspots"))
    cyc = groups.agg(F.count("*").alias("n_cycles"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("n_in_cycles"))
    out = sums.crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(hot).crossJoin(cyc)  # single rows
    if clusters is not None:
        out = out.crossJoin(clusters.agg(F.count("*").alias("n_clusters")))
    return out


def observations(nodes: DataFrame, metrics: DataFrame, members: DataFrame, solutions: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(rule, subject, severity): what stands out."""

    def rule(df: DataFrame, name: str, subject: str, severity: str, where: Column) -> DataFrame:
        return df.where(where).select(F.lit(name).alias("rule"), F.col(subject).alias("subject"), F.lit(severity).alias("severity"))

    parts = [
        rule(metrics, "stable_core", "name", "info", (F.col("fan_in") >= STABLE_FAN_IN) & (F.col("instability") <= STABLE_INSTABILITY)),
        rule(metrics, "high_coupling", "name", "warning", F.col("coupling") > COUPLING_LIMIT),
        rule(members.select("name").distinct(), "in_cycle", "name", "warning", F.lit(True)),
        rule(object_projects(nodes), "db_hotspot", "object", "warning", F.size("projects") >= HOTSPOT_PROJECTS),
        rule(solutions, "high_cross_solution_coupling", "solution", "warning", F.col("cross_ratio") > CROSS_LIMIT),
        rule(bridges(nodes), "solution_bridge_project", "name", "info", F.lit(True)),
        rule(nodes.select(F.explode("imports").alias("path"), "name").distinct().groupBy("path").agg(F.count("*").alias("n")), "wide_blast_radius_import", "path", "warning", F.col("n") >= IMPORT_LIMIT),
    ]
    if clusters is not None:
        parts.append(rule(clusters, "low_cohesion_cluster", "cluster", "info", F.col("cohesion") < COHESION_LIMIT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_stats(metrics: DataFrame, members: DataFrame) -> DataFrame:
    """One row: spread of coupling, outliers beyond twice the median, stable core, leaves, nodes in cycles."""
    median = metrics.agg(F.median("coupling").alias("median"))
    flags = members.select("name", F.lit(1).alias("in_cycle")).distinct()
    own = metrics.crossJoin(F.broadcast(median)).join(flags, "name", "left")  # median is one row
    return own.agg(
        F.min("coupling").alias("min_coupling"),
        F.max("coupling").alias("max_coupling"),
        F.max("median").alias("median_coupling"),
        F.round(F.sum(F.round(F.col("coupling") * 10).cast("long")) / 10 / F.count("*"), 6).alias("mean_coupling"),
        F.count_if(F.col("coupling") > 2 * F.col("median")).alias("n_outliers"),
        F.count_if((F.col("instability") <= STABLE_INSTABILITY) & (F.col("fan_in") >= STABLE_FAN_IN)).alias("n_stable_core"),
        F.count_if((F.col("instability") >= 0.8) & F.col("in_cycle").isNull()).alias("n_leaves"),
        F.count("in_cycle").alias("n_in_cycle"),
    )


def risk_highlights(metrics: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, name): the three most used stable nodes, the three most coupled over the limit, the three safest."""
    own = cut(metrics.join(members.select("name", F.lit(True).alias("c")).distinct(), "name", "left"), "highlights")

    def top(where: Column, kind: str, order: Column) -> DataFrame:
        return own.where(where).orderBy(order, "name").limit(3).select(F.lit(kind).alias("kind"), "name")

    stable = top((F.col("instability") <= 0.5) & (F.col("fan_in") >= 5), "stable", F.desc("fan_in"))
    coupled = top(F.col("coupling") > 500, "coupled", F.desc("coupling"))
    safe = top((F.col("instability") >= 0.7) & F.col("c").isNull(), "lowest_risk", F.asc("coupling"))
    return stable.unionByName(coupled).unionByName(safe)
