"""Risk profiles over seven dimensions, impact traces, key consumers, changed types and effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores as S
from ..schemas import CONFIDENCE, FAN_OUT_LIMIT, KEY_CONSUMERS, MOST_TARGETS
from .components import cut, numbered


#: Lists of one row hold up to so many numbers.
MOST_IN_ROW = 200_000
DAYS = ("investigation", "implementation", "testing", "integration_risk", "database_migration")


def coupling_cut(metrics: DataFrame) -> DataFrame:
    """One row (n, cut): the coupling at the zero-based place int(0.95 n) - 1 of the sorted scores, by an order
    statistic over distinct scores with their counts. Counts are summed by ranges of scores, and running sums are made
    over ranges and then inside each, so neither nodes nor scores are gathered in one task."""
    counts = metrics.groupBy("coupling").agg(F.count("*").alias("k"))
    own = cut(counts.repartitionByRange("coupling").withColumn("__p", F.spark_partition_id()), "scores")
    by_range = own.groupBy("__p").agg(F.sum("k").alias("n"))  # as many rows as there are partitions
    before = by_range.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = by_range.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    inside = F.sum("k").over(W.partitionBy("__p").orderBy("coupling"))
    run = own.join(F.broadcast(before), "__p").withColumn("upto", inside + F.col("before")).crossJoin(F.broadcast(total))  # total is one row
    place = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))
    return run.where(F.col("upto") >= place).groupBy("n").agg(F.min("coupling").alias("cut"))


def structural(metrics: DataFrame) -> DataFrame:
    top = F.broadcast(coupling_cut(metrics))  # one row
    return metrics.crossJoin(top).select("name", S.structural(F.col("fan_in"), (F.col("n") >= 10) & (F.col("coupling") >= F.col("cut"))).alias("structural"))


def dimensions(metrics: DataFrame, members: DataFrame, direct: DataFrame, transitive: DataFrame, crossed: DataFrame | None = None, surface: DataFrame | None = None, shared_by_teams: DataFrame | None = None) -> DataFrame:
    """(name, seven scores): members (name, size) of cycles, direct and transitive (name, n) consumers, crossed
    (name, n) clusters, shared_by_teams (name) whose objects several teams use. A dimension without data is null and
    takes no part in the composite."""
    out = metrics.join(structural(metrics), "name").join(members.select("name", F.col("size").alias("cycle_size")), "name", "left")
    out = out.join(direct.select("name", F.col("n").alias("n_direct")), "name", "left").join(transitive.select("name", F.col("n").alias("n_transitive")), "name", "left")
    zero = F.lit(0)
    if crossed is not None:
        out = out.join(crossed.select("name", F.col("n").alias("n_crossed")), "name", "left")
    if surface is not None:
        out = out.join(surface.select("name", "change_surface"), "name", "left")
    if shared_by_teams is not None:
        out = out.join(shared_by_teams.select("name", F.lit(True).alias("cross_team")), "name", "left")
    cross_team = F.coalesce("cross_team", F.lit(False)) if shared_by_teams is not None else F.lit(False)
    return out.select(
        "name",
        "structural",
        S.instability(F.col("instability"), F.col("fan_in")).alias("instability"),
        S.cycle(F.coalesce("cycle_size", zero)).alias("cycle"),
        S.database(F.col("shared_db_density"), cross_team).alias("database"),
        S.blast_radius(F.coalesce("n_direct", zero), F.coalesce("n_transitive", zero)).alias("blast_radius"),
        (S.domain_boundary(F.coalesce("n_crossed", zero)) if crossed is not None else F.lit(None).cast("double")).alias("domain_boundary"),
        (F.col("change_surface") if surface is not None else F.lit(None).cast("double")).alias("change_surface"),
    )


def profile(dims: DataFrame, context: str = "pr") -> DataFrame:
    """dims with composite score and level; severities come from unrounded scores."""
    return dims.withColumn("composite", S.composite(list(S.DIMENSIONS), context)).withColumn("level", S.level(F.col("composite")))


def ranked(context: str = "pr") -> Column:
    """The weighted dimensions of a row as sorted structs (k, i, dimension) of negative score, place and name."""
    weights = S.CONTEXTS[context]
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("dimension"), F.when(F.col(d).isNotNull(), F.col(d) * w).when(F.lit(w > 0.5), w * 0.5).alias("score")) for i, (d, w) in enumerate(zip(S.DIMENSIONS, weights, strict=True))))
    return F.array_sort(F.transform(F.filter(each, lambda x: x["score"] > 0), lambda x: F.struct((-x["score"]).alias("k"), x["i"].alias("i"), x["dimension"].alias("dimension"))))


def factors(dims: DataFrame, context: str = "pr", top: int = 5) -> DataFrame:
    """(name, place, dimension, score): the highest weighted dimensions; a dimension without data counts half its
    weight if that weight is above a half. Ties keep the order of dimensions."""
    return dims.select("name", F.posexplode(F.slice(ranked(context), 1, top)).alias("place", "x")).select("name", F.col("place").cast("long").alias("place"), F.col("x.dimension").alias("dimension"), F.round(-F.col("x.k"), 6).alias("score"))


def aggregate(profiles: DataFrame, direct: DataFrame, transitive: DataFrame) -> DataFrame:
    """One row: the greatest score of each dimension, composite, counts by level, sums of consumers."""
    own = profiles.join(direct.select("name", F.col("n").alias("d")), "name", "left").join(transitive.select("name", F.col("n").alias("t")), "name", "left")
    return own.agg(
        *(F.round(F.max(d), 6).alias(f"max_{d}") for d in S.DIMENSIONS[:6]),
        F.round(F.max("composite"), 6).alias("composite"),
        *(F.count_if(F.col("level") == x).alias(x.lower()) for x in ("RED", "YELLOW", "GREEN")),
        F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("direct"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("transitive"),
    ).withColumn("level", S.level(F.col("composite")))


def two_hops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, n) of direct consumers, and of those two hops away that are neither direct nor the node itself.

    Consumers are lists of numbers, so a node's second hop is one row for each of its direct consumers; it is made pair
    by pair where the lists of a node hold more than MOST_IN_ROW together.
    """
    into = cut(edges.where("source <> target").select(F.col("target").alias("name"), F.col("source").alias("consumer")).distinct(), "into")
    ids = numbered(into.select("name").union(into.select(F.col("consumer").alias("name"))))
    pairs = into.join(ids.select(F.col("name").alias("consumer"), F.col("id").alias("c")), "consumer").join(ids.withColumnRenamed("id", "n"), "name").select("n", "c")
    pairs = cut(pairs, "pairs")
    degree = cut(pairs.groupBy("n").agg(F.count("*").alias("d")), "degrees")
    small, listed, far = pairs, pairs, None
    if ((degree.agg(F.max("d")).first()[0] or 0) + 1) ** 2 > MOST_IN_ROW:
        held = pairs.join(degree.select(F.col("n").alias("c"), "d"), "c", "left").groupBy("n").agg(F.sum(F.coalesce("d", F.lit(0)) + 1).alias("k"))
        large = cut(held.where(F.col("k") > MOST_IN_ROW).select("n"), "large")
        small, listed = pairs.join(large, "n", "left_anti"), pairs.join(degree.where(F.col("d") > MOST_IN_ROW), "n", "left_anti")
        steps = pairs.join(large, "n", "left_semi").join(pairs.select(F.col("n").alias("c"), F.col("c").alias("far")), "c").where("far <> n").select("n", F.col("far").alias("c")).distinct()
        far = steps.join(pairs, ["n", "c"], "left_anti").groupBy("n").agg(F.count("*").alias("k"))
    lists = listed.groupBy("n").agg(F.collect_list("c").alias("own"))
    second = small.join(lists.toDF("c", "far"), "c").groupBy("n").agg(F.array_distinct(F.flatten(F.collect_list("far"))).alias("far"))
    counts = second.join(lists, "n").select("n", F.size(F.array_except("far", F.array_append("own", F.col("n")))).cast("long").alias("k")).where("k > 0")
    counts = counts if far is None else counts.unionByName(far)
    names = ids.withColumnRenamed("id", "n")
    return degree.join(names, "n").select("name", F.col("d").alias("n")), counts.join(names, "n").select("name", F.col("k").alias("n"))


def trace(direct: DataFrame, edges: DataFrame, depth: int = 2, limit: int = FAN_OUT_LIMIT) -> DataFrame:
    """(target, consumer, depth, confidence, confidence_label, parent): direct consumers (target, consumer) at depth 0,
    then consumers of consumers over all edge types, as deep as adaptive_depth() allows the target. The target isn't
    marked, so in a cycle it can be its own consumer."""
    steps = edges.select(F.col("target").alias("at"), F.col("source").alias("next")).where("at <> next").distinct()
    seen = front = cut(direct.select("target", "consumer", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).distinct(), "trace")
    hubs = cut(adaptive_depth(direct, depth, limit).where(F.col("depth") < depth).select("target", F.col("depth").alias("most")), "hubs")
    for d in range(1, depth + 1):
        found = front.join(hubs.where(F.col("most") < d), "target", "left_anti").join(steps, F.col("consumer") == F.col("at")).groupBy("target", F.col("next").alias("consumer")).agg(F.min("consumer").alias("parent"))
        front = cut(found.join(seen.select("target", "consumer"), ["target", "consumer"], "left_anti").select("target", "consumer", F.lit(d).alias("depth"), "parent"), "trace")
        seen = seen.unionByName(front)
    conf = F.get(F.array(*map(F.lit, CONFIDENCE)), F.least(F.col("depth"), F.lit(2)))
    return seen.select("target", "consumer", F.col("depth").cast("long").alias("depth"), conf.alias("confidence"), S.confidence_label(conf).alias("confidence_label"), "parent")


def adaptive_depth(direct: DataFrame, depth: int = 2, limit: int = FAN_OUT_LIMIT) -> DataFrame:
    """(target, n_direct, depth): targets with more than `limit` direct consumers are traced one hop at most."""
    return direct.groupBy("target").agg(F.count_distinct("consumer").alias("n_direct")).withColumn("depth", F.when(F.col("n_direct") > limit, F.least(F.lit(depth), F.lit(1))).otherwise(depth).cast("long"))


def choose_targets(targets: DataFrame, least: float = 0.0, most: int = MOST_TARGETS) -> DataFrame:
    """The most confident targets (target, confidence)."""
    return targets.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "target").limit(most)


def clarity(targets: DataFrame) -> DataFrame:
    one = targets.agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    return one.select("n", S.ambiguity(F.col("n"), F.col("mean")).alias("ambiguity"))


def key_consumers(rows: DataFrame, most: int = KEY_CONSUMERS) -> DataFrame:
    """rows (target, consumer, depth, rating): direct consumers of two targets or rated High or worse."""
    rank = F.when(F.col("rating") == "Critical", 3).when(F.col("rating") == "High", 2).when(F.col("rating") == "Medium", 1).otherwise(0)
    own = rows.where("depth = 0").groupBy("consumer").agg(F.count_distinct("target").alias("appearances"), F.max(rank).alias("rank"))
    label = F.get(F.array(*map(F.lit, ("Low", "Medium", "High", "Critical"))), F.col("rank"))
    return own.where("appearances >= 2 or rank >= 2").orderBy(F.desc("appearances"), F.desc("rank"), "consumer").limit(most).select("consumer", "appearances", label.alias("max_risk"))


def type_diff(base: DataFrame, feature: DataFrame) -> DataFrame:
    """(project, type, kind, change) from two snapshots (project, type, kind); a name on both sides is modified."""
    out = base.select("project", "type", F.col("kind").alias("old")).join(feature.select("project", "type", F.col("kind").alias("new")), ["project", "type"], "full_outer")
    return out.select("project", "type", F.coalesce("new", "old").alias("kind"), F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("modified").alias("change"))


def surface(changes: DataFrame) -> DataFrame:
    """(name, change_surface) from (project, kind, change)."""
    n = changes.groupBy(F.col("project").alias("name")).agg(
        F.count_if(F.col("change") == "deleted").alias("d"),
        F.count_if((F.col("change") == "modified") & F.col("kind").isin("interface", "abstract")).alias("i"),
        F.count_if((F.col("change") == "modified") & ~F.col("kind").isin("interface", "abstract")).alias("m"),
        F.count_if(F.col("change") == "added").alias("a"),
    )
    return n.select("name", S.change_surface(F.col("d"), F.col("i"), F.col("m"), F.col("a")).alias("change_surface"))


def crossed_clusters(direct: DataFrame, members: DataFrame) -> DataFrame:
    """(name, n): clusters of a node's direct consumers other than its own; direct is (target, consumer)."""
    own = direct.join(members.select(F.col("name").alias("target"), F.col("cluster").alias("a")), "target", "left").join(members.select(F.col("name").alias("consumer"), F.col("cluster").alias("b")), "consumer")
    return own.where("a is null or a <> b").groupBy(F.col("target").alias("name")).agg(F.count_distinct("b").alias("n"))


def shared_by_teams(nodes: DataFrame, teams: DataFrame) -> DataFrame:
    """(name) of nodes one of whose objects is used by several teams; teams is (name, team)."""
    uses = nodes.select("name", F.explode("object_refs").alias("object"))
    several = nodes.select("name", "object_refs").join(teams, "name").select(F.explode("object_refs").alias("object"), "team").groupBy("object").agg(F.min("team").alias("lo"), F.max("team").alias("hi")).where("lo <> hi").select("object")
    return uses.join(several, "object", "left_semi").select("name").distinct()


def database_impact(nodes: DataFrame, involved: DataFrame) -> DataFrame:
    """(object, n_projects, days): objects of two or more nodes, one of them involved; three more days beyond three."""
    uses = nodes.select("name", F.explode("object_refs").alias("object")).distinct()
    touched = uses.join(involved.select("name").distinct(), "name", "left_semi").select("object").distinct()
    n = uses.groupBy("object").agg(F.count("*").alias("n_projects")).where("n_projects >= 2")
    return n.join(touched, "object", "left_semi").select("object", "n_projects", F.when(F.col("n_projects") > 3, 3).otherwise(1).cast("long").alias("days"))


def involved_names(rows: DataFrame) -> DataFrame:
    """(name) of all targets and consumers."""
    return rows.select(F.col("target").alias("name")).union(rows.select("consumer")).distinct()


def effort(facts: DataFrame) -> DataFrame:
    """facts, one row: targets, clusters, in_cycle, direct, depth1, deeper, shared, wide_shared, cross_domain,
    fan_in_above_5, composite, clarity. Days by category with the band's least and most."""
    c = F.col
    bool_days: dict[str, Column] = {k: c(k).cast("int") for k in ("in_cycle", "cross_domain", "fan_in_above_5")}
    extra = F.greatest(F.lit(0), c("clusters") - 1)
    days = {
        "investigation": F.least(F.lit(3.0), F.greatest(F.lit(1.0), 0.5 * c("targets") + 0.5 * extra + bool_days["in_cycle"])),
        "implementation": F.least(c("direct"), F.lit(5)) + 0.3 * F.greatest(F.lit(0), c("direct") - 5) + 0.5 * c("depth1") + 0.25 * c("deeper"),
        "testing": 0.5 * c("direct") + c("shared") + 0.5 * bool_days["cross_domain"],
        "integration_risk": bool_days["in_cycle"] + 0.5 * c("shared") + extra + 0.5 * bool_days["fan_in_above_5"],
        "database_migration": (c("shared") + 2 * c("wide_shared")).cast("double"),
    }
    label, width = S.confidence_band(c("composite"), c("clarity"))
    each = F.array(*(F.struct(F.lit(k).alias("category"), v.cast("double").alias("days")) for k, v in days.items()))
    rows = facts.select(label.alias("confidence"), width.alias("w"), F.inline(each))
    return rows.select("category", "confidence", F.round("days", 2).alias("days"), F.round(c("days") * (1 - c("w")), 2).alias("least"), F.round(c("days") * (1 + c("w")), 2).alias("most"))


def with_total(rows: DataFrame) -> DataFrame:
    """effort rows and a TOTAL row."""
    return rows.rollup("category").agg(F.round(F.sum("days"), 2).alias("days"), F.round(F.sum("least"), 2).alias("least"), F.round(F.sum("most"), 2).alias("most")).select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "days", "least", "most")


