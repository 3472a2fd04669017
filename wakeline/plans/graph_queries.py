"""Queries of graph construction, traversal, metrics, cycles and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import cycles as Y
from ..operators import graph as G
from ..operators import metrics as M
from ..operators.components import connected_components, cut
from ..operators.consumers import direct_consumers
from ..schemas import REFERENCE
from ..sources.testdata import module_edges, module_steps, part_edges, part_nodes, table
from .registry import CLUSTERS, CYCLES, METRICS, MODULE_EDGES, PART_EDGES, PART_NODES, joined, query

E, N = f"WITH {PART_EDGES}", f"WITH {PART_NODES}"
EN = f"WITH {PART_EDGES}, {PART_NODES}"
ENM = f"{EN}, {METRICS}"
ENMC = f"WITH RECURSIVE {PART_EDGES}, {PART_NODES}, {METRICS}, {CYCLES}"
_SEED = "P1"


def metrics(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """Metrics of the part graph; edges, if they are at hand already."""
    return M.coupling_metrics(part_nodes(spark, sf_dir), part_edges(spark, sf_dir) if edges is None else edges)


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and weights of edges of the part graph, written down for queries that read them several times."""
    nodes = part_nodes(spark, sf_dir).select("name", "type_declarations", "object_refs", "solutions", "imports")
    return cut(nodes, "nodes"), cut(part_edges(spark, sf_dir).select("source", "target", "edge_type", "weight"), "edges")


def cycle_members(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    return Y.members_of(cut(Y.cycle_groups(part_edges(spark, sf_dir) if edges is None else edges), "groups"))


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules: objects are their brand, the solution is the supplier's nation, types the words of the part's type."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    nations = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    own = pairs.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return own.select(F.concat(F.lit("S"), "l_suppkey", F.lit(".P"), "l_partkey").alias("name"), F.array("p_brand").alias("object_refs"), F.array("n_name").alias("solutions"), F.array_sort(F.array_distinct(F.split("p_type", " "))).alias("type_declarations"))


MODULES = """
mnodes AS (SELECT DISTINCT 'S' || l_suppkey || '.P' || l_partkey AS name, p_brand AS object, n_name AS solution, list_sort(list_distinct(string_split(p_type, ' '))) AS type_declarations
           FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
MC = f"WITH RECURSIVE {MODULE_EDGES}, {MODULES}, {CLUSTERS}"


def references(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """The reference layer of the module graph; edges, if they are at hand already."""
    return (module_edges(spark, sf_dir) if edges is None else edges).where(F.col("edge_type") == REFERENCE)


def cluster_members(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    """(name, cluster): components of the reference layer."""
    return cut(connected_components(references(spark, sf_dir, edges), "source", "target").select(F.col("node").alias("name"), F.col("component").alias("cluster")), "clusters")


@query(f"{E} SELECT source, target, edge_type, weight, array_to_string(proofs[1:10], ',') AS evidence, CAST(len(proofs) AS BIGINT) AS evidence_total FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).withColumn("evidence", F.array_join("evidence", ","))


@query(f"{N} SELECT name, namespace, file_count, array_to_string(type_declarations, ',') AS type_declarations, array_to_string(object_refs, ',') AS object_refs, array_to_string(solutions, ',') AS solutions FROM nodes")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).select("name", "namespace", "file_count", *(joined(c) for c in ("type_declarations", "object_refs", "solutions")))


@query(f"{N} SELECT name, count(*) AS n FROM nodes GROUP BY name HAVING count(*) > 1")
def assert_unique_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.duplicate_names(part_nodes(spark, sf_dir))


@query(f"{EN} SELECT source, target FROM edges WHERE source NOT IN (SELECT name FROM nodes) OR target NOT IN (SELECT name FROM nodes)")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dangling_edges(part_nodes(spark, sf_dir), part_edges(spark, sf_dir)).select("source", "target")


@query("WITH e AS (SELECT 'C' || o_custkey AS source, o_orderstatus AS target, list_sort(list(CAST(o_orderkey AS VARCHAR))) AS p FROM orders GROUP BY 1, 2) SELECT source, target, array_to_string(p[1:10], ',') AS evidence, CAST(len(p) AS BIGINT) AS evidence_total FROM e")
def evidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("source"), F.col("o_orderstatus").alias("target")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("evidence"))
    return G.cap_evidence(own.withColumn("evidence_total", F.lit(None).cast("long"))).withColumn("evidence", F.array_join("evidence", ","))


@query(f"{E} SELECT source, target, edge_type FROM edges WHERE NOT (source = '{_SEED}' AND edge_type IN ('type_usage', 'namespace_usage')) AND NOT target = '{_SEED}'")
def remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = G.remove_edges(part_edges(spark, sf_dir), _SEED, "source", ["type_usage", "namespace_usage"])
    return G.remove_edges(own, _SEED, "target").select("source", "target", "edge_type")


@query(f"{N} SELECT name, namespace FROM nodes WHERE name = '{_SEED}'")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node(part_nodes(spark, sf_dir), _SEED).select("name", "namespace")


@query(f"{E} SELECT DISTINCT target AS name FROM edges WHERE source = '{_SEED}'")
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dependencies(part_edges(spark, sf_dir), _SEED)


@query(f"{E} SELECT DISTINCT source AS name FROM edges WHERE target = '{_SEED}'")
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.consumers(part_edges(spark, sf_dir), _SEED)


@query(f"{E} SELECT source, target, edge_type FROM edges WHERE source = '{_SEED}' UNION ALL SELECT source, target, edge_type FROM edges WHERE target = '{_SEED}'")
def incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.incident(part_edges(spark, sf_dir), _SEED).select("source", "target", "edge_type")


@query(f"{E} SELECT source, target, edge_type, weight FROM edges WHERE (source = 'P1' AND target = 'P2') OR (source = 'P2' AND target = 'P1')")
def edges_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.between(part_edges(spark, sf_dir), "P1", "P2").select("source", "target", "edge_type", "weight")


@query(f"{N} SELECT name FROM nodes WHERE import_path = 'build/Brand_11.props'")
def projects_importing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.importing(part_nodes(spark, sf_dir), "build\\Brand_11.props").select("name")


@query(f"{N} SELECT import_path, count(*) AS n, md5(string_agg(name, ',' ORDER BY name)) AS names FROM nodes GROUP BY 1")
def import_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = G.import_index(part_nodes(spark, sf_dir)).groupBy("import_path").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return own.withColumn("names", F.md5(F.array_join("names", ",")))


def _bfs(near: str, far: str) -> str:
    return f"""WITH RECURSIVE {MODULE_EDGES}, d AS (SELECT DISTINCT source, target FROM edges), seeds AS (SELECT DISTINCT {near} AS seed FROM edges),
    w AS (SELECT seed, seed AS name, 0 AS depth FROM seeds UNION SELECT seed, d.{far}, depth + 1 FROM w JOIN d ON w.name = d.{near} WHERE depth < 3)
    SELECT seed, name, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0"""


@query(_bfs("target", "source"))
def transitive_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach_all(module_steps(spark, sf_dir), 3)


@query(_bfs("source", "target"))
def transitive_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reach_all(module_steps(spark, sf_dir), 3, backward=False)


@query(f"WITH RECURSIVE {MODULE_EDGES}, {CLUSTERS} SELECT name AS node, cluster AS component FROM members", name="connected_components")
def components_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(references(spark, sf_dir), "source", "target")


@query(f"{ENM} SELECT * FROM metrics")
def coupling_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@query(f"{ENM} SELECT name, coupling FROM metrics ORDER BY coupling DESC, name LIMIT 10")
def top_coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_coupled(metrics(spark, sf_dir))


@query(f"""WITH RECURSIVE {PART_EDGES}, {CYCLES}, inner_ AS (SELECT x.component, count(*) AS edge_count FROM ref JOIN members x ON x.name = source JOIN members y ON y.name = target AND y.component = x.component GROUP BY 1)
SELECT m.component, count(*) AS size, any_value(edge_count) AS edge_count, md5(string_agg(name, ',' ORDER BY name)) AS members FROM members m JOIN inner_ USING (component) GROUP BY 1 HAVING count(*) > 1""")
def cycle_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.cycle_groups(part_edges(spark, sf_dir)).withColumn("members", F.md5(F.array_join("members", ",")))


@query()
def shortest_cycle_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(part_edges(spark, sf_dir).where(F.col("edge_type") == REFERENCE), "references")
    return Y.shortest_cycles(edges, cut(Y.cycle_groups(edges), "groups"))


#: Needs edges and nodes.
_SOLUTIONS = """ends AS (SELECT s.solutions AS ss, t.solutions AS ts FROM edges JOIN nodes s ON s.name = source JOIN nodes t ON t.name = target),
each AS (SELECT unnest(list_distinct(list_concat(ss, ts))) AS solution, ss, ts FROM ends),
sums AS (SELECT solution, count(*) FILTER (list_contains(ss, solution) AND list_contains(ts, solution)) AS internal, count(*) FILTER (list_contains(ss, solution) <> list_contains(ts, solution)) AS external FROM each GROUP BY 1),
p AS (SELECT DISTINCT ss, ts FROM ends),
o AS (SELECT solution, string_agg(DISTINCT other, ',' ORDER BY other) AS outgoing FROM (SELECT unnest(ss) AS solution, ss, ts FROM p), unnest(ts) AS u(other) WHERE NOT list_contains(ss, other) GROUP BY 1),
i AS (SELECT solution, string_agg(DISTINCT other, ',' ORDER BY other) AS incoming FROM (SELECT unnest(ts) AS solution, ss, ts FROM p), unnest(ss) AS u(other) WHERE NOT list_contains(ts, other) GROUP BY 1),
n AS (SELECT solution, count(*) AS projects FROM (SELECT unnest(solutions) AS solution FROM nodes) GROUP BY 1)"""
_SOLUTION_METRICS = f"""{EN}, {_SOLUTIONS}
SELECT solution, projects, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external,
       CASE WHEN coalesce(internal + external, 0) > 0 THEN external::DOUBLE / (internal + external) ELSE 0.0 END::DOUBLE AS cross_ratio, coalesce(incoming, '') AS incoming, coalesce(outgoing, '') AS outgoing
FROM n LEFT JOIN sums USING (solution) LEFT JOIN i USING (solution) LEFT JOIN o USING (solution)"""


@query(_SOLUTION_METRICS)
def solution_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = M.solution_metrics(part_nodes(spark, sf_dir), cut(part_edges(spark, sf_dir).select("source", "target"), "edges"))
    return own.select("solution", "projects", "internal", "external", "cross_ratio", joined("incoming"), joined("outgoing"))


@query(f"{N} SELECT name, CAST(len(solutions) AS BIGINT) AS n_solutions FROM nodes WHERE len(solutions) >= 3")
def bridge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bridges(part_nodes(spark, sf_dir))


@query(f"{N} SELECT object, md5(string_agg(name, ',' ORDER BY name)) AS projects FROM (SELECT name, unnest(object_refs) AS object FROM nodes) GROUP BY 1")
def object_project_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.object_projects(part_nodes(spark, sf_dir)).withColumn("projects", F.md5(F.array_join("projects", ",")))


@query(f"""{ENMC} SELECT count(*) AS n_nodes, round(avg(fan_in), 6) AS avg_fan_in, round(avg(fan_out), 6) AS avg_fan_out, round(CAST(sum(CAST(round(coupling * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*), 6) AS avg_coupling,
 max(coupling) AS max_coupling, (SELECT name FROM metrics ORDER BY coupling DESC, CAST(name[2:] AS BIGINT) LIMIT 1) AS most_coupled, (SELECT count(*) FROM edges) AS n_edges,
 (SELECT count(*) FROM (SELECT object FROM obj GROUP BY 1 HAVING count(*) >= 3)) AS n_hotspots,
 (SELECT count(DISTINCT component) FROM members WHERE size > 1) AS n_cycles, (SELECT count(*) FROM members WHERE size > 1) AS n_in_cycles FROM metrics""")
def health_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = part_nodes(spark, sf_dir), part_edges(spark, sf_dir)
    return M.dashboard(nodes, edges, M.coupling_metrics(nodes, edges), Y.cycle_groups(edges))


@query(f"""{ENMC}, {_SOLUTIONS}, sm AS (SELECT solution, CASE WHEN coalesce(internal + external, 0) > 0 THEN external::DOUBLE / (internal + external) ELSE 0.0 END AS cross_ratio FROM n LEFT JOIN sums USING (solution))
SELECT 'stable_core' AS rule, name AS subject, 'info' AS severity FROM metrics WHERE fan_in >= 5 AND instability <= 0.3
UNION ALL SELECT 'high_coupling', name, 'warning' FROM metrics WHERE coupling > 500
UNION ALL SELECT 'in_cycle', name, 'warning' FROM members WHERE size > 1
UNION ALL SELECT 'db_hotspot', object, 'warning' FROM obj GROUP BY object HAVING count(*) >= 3
UNION ALL SELECT 'high_cross_solution_coupling', solution, 'warning' FROM sm WHERE cross_ratio > 0.5
UNION ALL SELECT 'solution_bridge_project', name, 'info' FROM nodes WHERE len(solutions) >= 3
UNION ALL SELECT 'wide_blast_radius_import', import_path, 'warning' FROM nodes GROUP BY import_path HAVING count(*) >= 10""")
def health_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return M.observations(nodes, cut(M.coupling_metrics(nodes, edges), "metrics"), cycle_members(spark, sf_dir, edges), M.solution_metrics(nodes, edges))


@query(f"""{ENMC} SELECT d.target, d.source AS consumer, round(coupling, 2) AS coupling_score, fan_in, fan_out, round(instability, 3) AS instability, coalesce(size > 1, false) AS in_cycle
FROM ref d JOIN metrics m ON m.name = d.source LEFT JOIN members s ON s.name = d.source""")
def enriched_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.enrich(direct_consumers(part_edges(spark, sf_dir)), metrics(spark, sf_dir), cycle_members(spark, sf_dir)).select("target", "consumer", "coupling_score", "fan_in", "fan_out", "instability", "in_cycle")


@query(f"""{ENMC}, med AS (SELECT median(coupling) AS median FROM metrics), c AS (SELECT name, 1 AS in_cycle FROM members WHERE size > 1)
SELECT min(coupling) AS min_coupling, max(coupling) AS max_coupling, max(median) AS median_coupling, round(CAST(sum(CAST(round(coupling * 10) AS BIGINT)) AS DOUBLE) / 10 / count(*), 6) AS mean_coupling,
 count(*) FILTER (coupling > 2 * median) AS n_outliers, count(*) FILTER (instability <= 0.3 AND fan_in >= 5) AS n_stable_core, count(*) FILTER (instability >= 0.8 AND in_cycle IS NULL) AS n_leaves, count(in_cycle) AS n_in_cycle
FROM metrics CROSS JOIN med LEFT JOIN c USING (name)""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary_stats(metrics(spark, sf_dir), cycle_members(spark, sf_dir))


@query(f"""{ENMC} SELECT * FROM (SELECT 'stable' AS kind, name FROM metrics WHERE instability <= 0.5 AND fan_in >= 5 ORDER BY fan_in DESC, name LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'coupled', name FROM metrics WHERE coupling > 500 ORDER BY coupling DESC, name LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'lowest_risk', name FROM metrics WHERE instability >= 0.7 AND name NOT IN (SELECT name FROM members WHERE size > 1) ORDER BY coupling, name LIMIT 3)""")
def risk_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return M.risk_highlights(M.coupling_metrics(nodes, edges), cycle_members(spark, sf_dir, edges))


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the reference layer, its large components split by labels; tests compare it with brute force."""
    return C.assign(module_nodes(spark, sf_dir), references(spark, sf_dir))


@query()
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the whole module graph, its large components split by labels."""
    return C.assign(module_nodes(spark, sf_dir), module_edges(spark, sf_dir))


_COUNTS = """cnt AS (SELECT cluster, count(*) FILTER (same) AS internal, count(*) FILTER (NOT same) AS external FROM (
  SELECT unnest(CASE WHEN x.cluster = y.cluster THEN [x.cluster] ELSE [x.cluster, y.cluster] END) AS cluster, coalesce(x.cluster = y.cluster, false) AS same
  FROM edges LEFT JOIN members x ON x.name = source LEFT JOIN members y ON y.name = target) WHERE cluster IS NOT NULL GROUP BY 1)"""


@query(f"{MC}, {_COUNTS} SELECT DISTINCT cluster, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external FROM members LEFT JOIN cnt USING (cluster)")
def cluster_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(module_edges(spark, sf_dir).select("source", "target", "edge_type"), "edges")
    return C.edge_counts(edges, cluster_members(spark, sf_dir, edges))


_SHARED = """uses AS (SELECT m.object, c.cluster FROM mnodes m LEFT JOIN members c USING (name)),
shared AS (SELECT cluster, object FROM (SELECT cluster, object, count(*) AS own FROM uses WHERE cluster IS NOT NULL GROUP BY 1, 2) JOIN (SELECT object, count(*) AS n FROM uses GROUP BY 1) USING (object) WHERE own < n)"""


@query(f"{MC}, {_SHARED} SELECT * FROM shared")
def shared_objects_cross_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.shared_across(module_nodes(spark, sf_dir), cluster_members(spark, sf_dir))


_API = """api AS (SELECT y.cluster, count(DISTINCT e) AS used FROM (SELECT source, target, unnest(proofs[1:10]) AS e FROM edges WHERE edge_type = 'type_usage') JOIN members y ON y.name = target LEFT JOIN members x ON x.name = source
  WHERE x.cluster IS NULL OR x.cluster <> y.cluster GROUP BY 1),
decl AS (SELECT cluster, CAST(sum(len(type_declarations)) AS BIGINT) AS declared FROM mnodes JOIN members USING (name) GROUP BY 1)"""


@query(f"{MC}, {_API} SELECT cluster, coalesce(used, 0) AS used, declared FROM decl LEFT JOIN api USING (cluster)")
def api_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(module_edges(spark, sf_dir), "edges")
    return C.api_surface(module_nodes(spark, sf_dir), edges, cluster_members(spark, sf_dir, edges))


@query(f"""{MC}, k AS (SELECT cluster, solution, count(*) AS k FROM mnodes JOIN members USING (name) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY k DESC, solution) AS r FROM k),
n AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1) SELECT cluster, solution, k::DOUBLE / n AS share FROM r JOIN n USING (cluster) WHERE r = 1""")
def solution_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.solution_alignment(module_nodes(spark, sf_dir), cluster_members(spark, sf_dir))


@query(f"""{MC}, e AS (SELECT cluster, min(name) AS lo, max(name) AS hi FROM members GROUP BY 1)
SELECT cluster, CASE WHEN lo = hi THEN lo WHEN split_part(lo, '.', 1) = split_part(hi, '.', 1) AND len(split_part(lo, '.', 1)) >= 3 THEN split_part(lo, '.', 1) ELSE 'cluster_' || cluster END AS prefix FROM e""")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.common_prefix(cluster_members(spark, sf_dir))


@query(f"""{MC}, {_COUNTS}, {_SHARED}, {_API}, size AS (SELECT cluster, count(*) AS size FROM members GROUP BY 1), refs AS (SELECT cluster, count(*) AS refs FROM mnodes JOIN members USING (name) GROUP BY 1),
ns AS (SELECT cluster, count(*) AS n_shared FROM shared GROUP BY 1),
f AS (SELECT cluster, size, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, CASE WHEN coalesce(internal + external, 0) > 0 THEN external::DOUBLE / (internal + external) ELSE 0.0 END AS outside,
  coalesce(n_shared, 0)::DOUBLE / greatest(coalesce(refs, 0), 1) AS o, coalesce(used, 0)::DOUBLE / greatest(coalesce(declared, 0), 1) AS a
  FROM size LEFT JOIN cnt USING (cluster) LEFT JOIN refs USING (cluster) LEFT JOIN ns USING (cluster) LEFT JOIN api USING (cluster) LEFT JOIN decl USING (cluster)),
g AS (SELECT *, greatest(0.0, 1 - (0.4 * outside + 0.25 * o + 0.15 * a))::DOUBLE AS s FROM f)
SELECT cluster, size, internal, external, round(CASE WHEN size > 1 THEN internal::DOUBLE / (size * (size - 1)) ELSE 0.0 END, 6)::DOUBLE AS cohesion, round(outside, 6)::DOUBLE AS coupling_outside, round(s, 6) AS feasibility,
 CASE WHEN s >= 0.75 THEN 'easy' WHEN s >= 0.5 THEN 'moderate' WHEN s >= 0.25 THEN 'hard' ELSE 'very_hard' END AS label FROM g""")
def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = cut(module_nodes(spark, sf_dir), "nodes"), cut(module_edges(spark, sf_dir), "edges")
    members = cluster_members(spark, sf_dir, edges)
    none = members.select("name", F.col("cluster").alias("component")).limit(0)  # clusters are whole components: no cycle leaves one
    return C.describe(nodes, edges, members, none)
