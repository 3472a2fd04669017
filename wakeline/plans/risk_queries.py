"""Queries of impact, risk, change, effort, the text index, incremental maintenance and report tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S

from ..operators import builders as B
from ..operators import consumers as K
from ..operators import documents as Dc
from ..operators import index as I
from ..operators import reports as Rp
from ..operators import risk as R
from ..operators.components import cut, shared_folder
from ..operators.metrics import coupling_metrics, enrich
from ..schemas import FAN_OUT_LIMIT
from ..sources import trees
from ..sources.testdata import files, module_edges, part_edges, part_nodes, table
from ..streaming import incremental as Inc
from .graph_queries import cluster_members, cycle_members, metrics
from .registry import CLUSTERS, CYCLES, METRICS, MODULE_EDGES, PART_EDGES, PART_NODES, joined, query
from .text_queries import _IDS, FILES

ENM = f"WITH {PART_EDGES}, {PART_NODES}, {METRICS}"
ENMC = f"WITH RECURSIVE {PART_EDGES}, {PART_NODES}, {METRICS}, {CYCLES}"


def _lin(v: str, a: float, b: float, p: float, q: float) -> str:
    return f"({p} + least(1.0, greatest(0.0, ({v} - {a}) / {b - a}::DOUBLE)) * {q - p})"


_STRUCTURAL = f"least(1.0, CASE WHEN fan_in >= 10 THEN 1.0 WHEN fan_in >= 5 THEN {_lin('fan_in', 5, 10, 0.7, 1.0)} WHEN fan_in >= 3 THEN {_lin('fan_in', 3, 5, 0.4, 0.7)} ELSE {_lin('fan_in', 0, 3, 0.1, 0.4)} END + CASE WHEN n >= 10 AND coupling >= cut THEN 0.1 ELSE 0.0 END)"
_INSTABILITY = f"CASE WHEN fan_in >= 3 THEN CASE WHEN instability >= 0.8 THEN {_lin('instability', 0.8, 1.0, 0.7, 0.9)} WHEN instability >= 0.6 THEN {_lin('instability', 0.6, 0.8, 0.5, 0.7)} WHEN instability >= 0.5 THEN {_lin('instability', 0.5, 0.6, 0.3, 0.5)} ELSE 0.1 END WHEN instability >= 0.8 THEN 0.3 ELSE 0.1 END"
_DATABASE = f"CASE WHEN d <= 0 THEN 0.0 WHEN d > 0.5 AND x THEN {_lin('d', 0.5, 1.0, 0.8, 1.0)} WHEN d > 0.3 OR x THEN {_lin('d', 0.1, 0.5, 0.5, 0.8)} ELSE {_lin('d', 0.0, 0.3, 0.2, 0.5)} END"
_BLAST = f"CASE WHEN t >= 20 THEN 1.0 WHEN t >= 10 THEN {_lin('t', 10, 20, 0.7, 1.0)} WHEN d >= 5 THEN {_lin('d', 5, 10, 0.5, 0.7)} WHEN d >= 2 THEN {_lin('d', 2, 5, 0.3, 0.5)} ELSE 0.1 END"
_CUT = "pct AS (SELECT count(*) AS n, (list_sort(list(coupling)))[greatest(1, CAST(floor(count(*) * 0.95) AS INTEGER))] AS cut FROM metrics)"
_HOPS = """into_ AS (SELECT DISTINCT target AS name, source AS consumer FROM edges WHERE source <> target),
far AS (SELECT a.name, b.consumer FROM into_ a JOIN into_ b ON b.name = a.consumer WHERE b.consumer <> a.name EXCEPT SELECT name, consumer FROM into_),
direct AS (SELECT name, count(*) AS d FROM into_ GROUP BY 1), trans AS (SELECT name, count(*) AS t FROM far GROUP BY 1)"""
_LEVEL = "CASE WHEN {0} >= 0.7 THEN 'RED' WHEN {0} >= 0.4 THEN 'YELLOW' ELSE 'GREEN' END"
_BOUNDARY = f"CASE WHEN n >= 3 THEN {_lin('n', 3, 6, 0.6, 0.8)} WHEN n >= 2 THEN {_lin('n', 2, 3, 0.3, 0.6)} WHEN n >= 1 THEN {_lin('n', 1, 2, 0.2, 0.3)} ELSE 0.0 END"
_DIFF = """o AS (SELECT 'C' || o_custkey AS project, o_orderpriority || '-' || o_orderstatus AS type, CASE WHEN o_orderstatus = 'F' THEN 'interface' ELSE 'class' END AS kind, o_orderdate < TIMESTAMP '1995-06-01' AS old FROM orders),
diff AS (SELECT project, type, any_value(kind) AS kind, CASE WHEN NOT bool_or(old) THEN 'added' WHEN bool_and(old) THEN 'deleted' ELSE 'modified' END AS change FROM o GROUP BY 1, 2)"""
#: Types declared by projects named like parts, before and after.
_SURFACE = _DIFF.replace("'C' || o_custkey", "'P' || o_custkey") + """,
n AS (SELECT project AS name, count(*) FILTER (change = 'deleted') AS dd, count(*) FILTER (change = 'modified' AND kind = 'interface') AS i, count(*) FILTER (change = 'modified' AND kind <> 'interface') AS mm, count(*) FILTER (change = 'added') AS a FROM diff GROUP BY 1),
surf AS (SELECT name, greatest(CASE WHEN dd > 0 THEN least(1.0, 0.7 + (dd - 1) * 0.1) ELSE 0.0 END, CASE WHEN i > 0 THEN least(0.8, 0.5 + (i - 1) * 0.1) ELSE 0.0 END, CASE WHEN mm > 0 THEN least(0.6, 0.3 + (mm - 1) * 0.05) ELSE 0.0 END, CASE WHEN a > 0 THEN 0.1 ELSE 0.0 END) AS surface FROM n)"""
#: Brands stand for domains and, by their first digit, for teams.
_DOMAINS = """domain AS (SELECT 'P' || p_partkey AS name, p_brand AS cluster, substr(p_brand, length(p_brand) - 1, 1) AS team FROM part),
crossed AS (SELECT e.target AS name, count(DISTINCT b.cluster) AS n FROM (SELECT DISTINCT source, target FROM edges) e JOIN domain b ON b.name = e.source LEFT JOIN domain a ON a.name = e.target WHERE a.cluster IS NULL OR a.cluster <> b.cluster GROUP BY 1),
uses AS (SELECT name, unnest(object_refs) AS o FROM nodes), several AS (SELECT o FROM uses JOIN domain USING (name) GROUP BY 1 HAVING count(DISTINCT team) > 1),
xteam AS (SELECT DISTINCT name, true AS x FROM uses JOIN several USING (o))"""
_DIMS = f"""{ENMC}, {_CUT}, {_HOPS}, {_SURFACE}, {_DOMAINS}, dims AS (
 SELECT m.name, {_STRUCTURAL.replace(' n >= 10', ' pct.n >= 10')} AS structural, {_INSTABILITY} AS instability_, CASE WHEN coalesce(s.size, 0) >= 5 THEN 1.0 WHEN s.size >= 3 THEN {_lin('s.size', 2, 5, 0.6, 1.0)} WHEN s.size = 2 THEN 0.6 ELSE 0.0 END AS cycle,
  (SELECT {_DATABASE} FROM (SELECT m.shared_db_density AS d, coalesce(xteam.x, false) AS x)) AS database, (SELECT {_BLAST} FROM (SELECT coalesce(direct.d, 0) AS d, coalesce(trans.t, 0) AS t)) AS blast_radius,
  (SELECT {_BOUNDARY} FROM (SELECT coalesce(crossed.n, 0) AS n)) AS boundary, surf.surface AS surface, coalesce(direct.d, 0) AS d, coalesce(trans.t, 0) AS t
 FROM metrics m CROSS JOIN pct LEFT JOIN (SELECT * FROM members WHERE size > 1) s ON s.name = m.name LEFT JOIN direct ON direct.name = m.name LEFT JOIN trans ON trans.name = m.name
 LEFT JOIN crossed ON crossed.name = m.name LEFT JOIN xteam ON xteam.name = m.name LEFT JOIN surf ON surf.name = m.name),
prof AS (SELECT *, greatest(structural * 0.7, instability_ * 0.6, cycle * 1.0, database * 0.8, blast_radius * 0.7, boundary * 0.5, surface * 0.9, 0.0) AS composite FROM dims)"""


def _dims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All seven dimensions: brands are the clusters and teams of parts, orders the types that projects declare."""
    edges = cut(part_edges(spark, sf_dir).select("source", "target", "edge_type", "weight"), "edges")  # made once for all that follows
    direct, transitive = R.two_hops(edges)
    direct, transitive = cut(direct, "direct"), cut(transitive, "transitive")
    part = table(spark, sf_dir, "part")
    name = F.concat(F.lit("P"), "p_partkey").alias("name")
    domains, teams = part.select(name, F.col("p_brand").alias("cluster")), part.select(name, F.substring("p_brand", F.length("p_brand") - 1, F.lit(1)).alias("team"))
    crossed = R.crossed_clusters(edges.select("target", F.col("source").alias("consumer")), domains)
    surface = R.surface(R.type_diff(*_part_snapshots(spark, sf_dir)))
    nodes = cut(part_nodes(spark, sf_dir).select("name", "type_declarations", "object_refs"), "nodes")
    shared = R.shared_by_teams(nodes, teams)
    return R.dimensions(cut(coupling_metrics(nodes, edges), "metrics"), cycle_members(spark, sf_dir, edges), direct, transitive, crossed, surface, shared), direct, transitive


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({_lin('l_quantity', 5, 10, 0.7, 1.0)}, 6) AS score FROM lineitem")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.interpolate(F.col("l_quantity"), 5, 10, 0.7, 1.0), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v >= 0.8 THEN 'critical' WHEN v >= 0.6 THEN 'high' WHEN v >= 0.3 THEN 'medium' ELSE 'low' END AS severity, " + _LEVEL.format("v") + " AS level FROM (SELECT *, l_discount * 10 AS v FROM lineitem)")
def severity_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_discount") * 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.severity(v).alias("severity"), S.level(v).alias("level"))


@query(f"{ENM}, {_CUT} SELECT name, round({_STRUCTURAL}, 6)::DOUBLE AS structural FROM metrics CROSS JOIN pct")
def risk_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.structural(cut(metrics(spark, sf_dir), "metrics")).withColumn("structural", F.round("structural", 6))


@query(f"{ENM} SELECT name, round({_INSTABILITY}, 6)::DOUBLE AS score FROM metrics")
def risk_instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("name", F.round(S.instability(F.col("instability"), F.col("fan_in")), 6).alias("score"))


@query(f"SELECT p_partkey, round(CASE WHEN p_size >= 5 THEN 1.0 WHEN p_size >= 3 THEN {_lin('p_size', 2, 5, 0.6, 1.0)} WHEN p_size = 2 THEN 0.6 ELSE 0.0 END, 6)::DOUBLE AS score FROM part")
def risk_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.cycle(F.col("p_size")), 6).alias("score"))


@query(f"SELECT p_partkey, round({_DATABASE}, 6)::DOUBLE AS score FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS d, p_brand = 'Brand#11' AS x FROM part)")
def risk_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.database(F.col("p_size") / 50.0, F.col("p_brand") == "Brand#11"), 6).alias("score"))


@query(f"WITH {PART_EDGES}, {_HOPS} SELECT name, d, coalesce(t, 0) AS t, round({_BLAST}, 6)::DOUBLE AS score FROM (SELECT name, d, coalesce(t, 0) AS t FROM direct LEFT JOIN trans USING (name))")
def risk_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct, far = R.two_hops(part_edges(spark, sf_dir))
    own = direct.withColumnRenamed("n", "d").join(far.withColumnRenamed("n", "t"), "name", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return own.select("name", "d", "t", F.round(S.blast_radius(F.col("d"), F.col("t")), 6).alias("score"))




@query(f"""WITH RECURSIVE {MODULE_EDGES}, {CLUSTERS}, c AS (SELECT e.target AS name, count(DISTINCT b.cluster) AS n FROM (SELECT DISTINCT source, target FROM edges WHERE edge_type <> 'project_reference') e
JOIN members b ON b.name = e.source LEFT JOIN members a ON a.name = e.target WHERE a.cluster IS NULL OR a.cluster <> b.cluster GROUP BY 1) SELECT name, n, round({_BOUNDARY}, 6)::DOUBLE AS score FROM c""")
def risk_domain_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = module_edges(spark, sf_dir).where("edge_type <> 'project_reference'").select("target", F.col("source").alias("consumer")).distinct()
    return R.crossed_clusters(direct, cluster_members(spark, sf_dir)).select("name", "n", F.round(S.domain_boundary(F.col("n")), 6).alias("score"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as projects that declare the priorities of their orders, before and after the middle of the period."""
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("project"), F.concat("o_orderpriority", F.lit("-"), "o_orderstatus").alias("type"), F.when(F.col("o_orderstatus") == "F", "interface").otherwise("class").alias("kind"), "o_orderdate")
    cols = ["project", "type", "kind"]
    return own.where("o_orderdate < timestamp'1995-06-01'").select(cols).distinct(), own.where("o_orderdate >= timestamp'1995-06-01'").select(cols).distinct()


def _part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same snapshots of projects that are named like parts."""
    base, feature = (d.withColumn("project", F.concat(F.lit("P"), F.substring("project", 2, 20))) for d in _snapshots(spark, sf_dir))
    return base, feature


@query(f"WITH {_DIFF} SELECT * FROM diff")
def type_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.type_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT change, kind, count(*) AS n FROM diff GROUP BY 1, 2")
def changed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.type_diff(*_snapshots(spark, sf_dir)).groupBy("change", "kind").agg(F.count("*").alias("n"))


@query("SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'A' WHEN b.k IS NULL THEN 'D' ELSE 'M' END AS status FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') b ON a.k = b.k")
def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old, new = (orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("path")).distinct().withColumn(c, F.lit(1)) for s, c in (("O", "o"), ("F", "n")))
    return old.join(new, "path", "full_outer").select("path", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M").alias("status"))


@query(f"""WITH {_DIFF}, n AS (SELECT project AS name, count(*) FILTER (change = 'deleted') AS d, count(*) FILTER (change = 'modified' AND kind = 'interface') AS i, count(*) FILTER (change = 'modified' AND kind <> 'interface') AS m, count(*) FILTER (change = 'added') AS a FROM diff GROUP BY 1)
SELECT name, round(greatest(CASE WHEN d > 0 THEN least(1.0, 0.7 + (d - 1) * 0.1) ELSE 0.0 END, CASE WHEN i > 0 THEN least(0.8, 0.5 + (i - 1) * 0.1) ELSE 0.0 END, CASE WHEN m > 0 THEN least(0.6, 0.3 + (m - 1) * 0.05) ELSE 0.0 END, CASE WHEN a > 0 THEN 0.1 ELSE 0.0 END), 6)::DOUBLE AS change_surface FROM n""")
def risk_change_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.surface(R.type_diff(*_snapshots(spark, sf_dir))).withColumn("change_surface", F.round("change_surface", 6))


@query(f"{_DIMS} SELECT name, round(structural, 6)::DOUBLE AS structural, round(instability_, 6)::DOUBLE AS instability, round(cycle, 6)::DOUBLE AS cycle, round(database, 6)::DOUBLE AS database, round(blast_radius, 6)::DOUBLE AS blast_radius, round(boundary, 6)::DOUBLE AS domain_boundary, round(surface, 6)::DOUBLE AS change_surface, round(composite, 6)::DOUBLE AS composite, {_LEVEL.format('round(composite, 9)')} AS level FROM prof")
def risk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.profile(_dims(spark, sf_dir)[0])
    return own.select("name", *(F.round(c, 6).alias(c) for c in (*S.DIMENSIONS, "composite")), S.level(F.round("composite", 9)).alias("level"))


@query(f"{_DIMS} SELECT name, round(greatest(structural * 0.6, instability_ * 0.5, cycle * 0.8, database * 1.0, blast_radius * 0.8, boundary * 0.9, surface * 0.4), 6)::DOUBLE AS work_request, round(greatest(structural * 0.7, instability_ * 0.6, cycle * 1.0, database * 0.6, blast_radius * 0.7, boundary * 0.3, surface * 0.9), 6)::DOUBLE AS local FROM dims")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = _dims(spark, sf_dir)[0]
    return dims.select("name", *(F.round(S.composite(list(S.DIMENSIONS), c), 6).alias(c) for c in ("work_request", "local")))


@query(f"""{_DIMS}, w AS (SELECT name, unnest([structural * 0.7, instability_ * 0.6, cycle * 1.0, database * 0.8, blast_radius * 0.7, boundary * 0.5, coalesce(surface * 0.9, 0.45)]) AS score, unnest(['structural', 'instability', 'cycle', 'database', 'blast_radius', 'domain_boundary', 'change_surface']) AS dimension, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM dims),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, i) - 1 AS place FROM w WHERE score > 0) SELECT name, place, dimension, round(score, 6)::DOUBLE AS score FROM r WHERE place < 5""")
def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.factors(_dims(spark, sf_dir)[0])


@query(f"""{_DIMS} SELECT round(max(structural), 6)::DOUBLE AS max_structural, round(max(instability_), 6)::DOUBLE AS max_instability, round(max(cycle), 6)::DOUBLE AS max_cycle, round(max(database), 6)::DOUBLE AS max_database, round(max(blast_radius), 6)::DOUBLE AS max_blast_radius, round(max(boundary), 6)::DOUBLE AS max_domain_boundary,
 round(max(composite), 6)::DOUBLE AS composite, count(*) FILTER (round(composite, 9) >= 0.7) AS red, count(*) FILTER (round(composite, 9) >= 0.4 AND round(composite, 9) < 0.7) AS yellow, count(*) FILTER (round(composite, 9) < 0.4) AS green, CAST(sum(d) AS BIGINT) AS direct, CAST(sum(t) AS BIGINT) AS transitive, {_LEVEL.format('max(round(composite, 6))')} AS level FROM prof""")
def aggregate_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims, direct, transitive = _dims(spark, sf_dir)
    return R.aggregate(R.profile(dims.withColumns({d: F.round(d, 9) for d in S.DIMENSIONS[:5]})).withColumn("level", S.level(F.round("composite", 9))), direct, transitive)


@query(f"{_DIMS} SELECT name, round(composite, 6)::DOUBLE AS composite, {_LEVEL.format('round(composite, 9)')} AS level FROM prof WHERE surface IS NOT NULL")
def pr_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects with changed types."""
    own = _dims(spark, sf_dir)[0].where("change_surface is not null")
    done = R.profile(own).withColumn("level", S.level(F.round("composite", 9)))
    return done.select("name", F.round("composite", 6).alias("composite"), "level")


_TRACE = f"""WITH RECURSIVE {MODULE_EDGES}, d AS (SELECT DISTINCT target, source AS consumer FROM edges WHERE edge_type = 'project_reference'), st AS (SELECT DISTINCT target AS at, source AS nxt FROM edges),
nd AS (SELECT target, CASE WHEN count(*) > {FAN_OUT_LIMIT} THEN 1 ELSE 2 END AS most FROM d GROUP BY 1),
w AS (SELECT target, consumer, 0 AS depth FROM d UNION SELECT w.target, st.nxt, depth + 1 FROM w JOIN nd ON nd.target = w.target JOIN st ON st.at = w.consumer WHERE depth < most),
tr AS (SELECT target, consumer, min(depth) AS depth FROM w GROUP BY 1, 2)"""


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = cut(module_edges(spark, sf_dir), "edges")
    return R.trace(K.direct_consumers(edges), edges)


@query(f"{_TRACE} SELECT target, consumer, CAST(depth AS BIGINT) AS depth, CASE depth WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, CASE depth WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label FROM tr")
def impact_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).drop("parent")


@query(f"{_TRACE} SELECT target, count(*) FILTER (depth = 0) AS direct, count(*) FILTER (depth > 0) AS transitive, CAST(max(depth) AS BIGINT) AS depth FROM tr GROUP BY 1")
def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trace(spark, sf_dir).groupBy("target").agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("transitive"), F.max("depth").alias("depth"))


@query(f"{_TRACE} SELECT DISTINCT target AS name FROM tr UNION SELECT consumer FROM tr")
def involved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.involved_names(_trace(spark, sf_dir))


@query(f"WITH {PART_EDGES} SELECT target, count(DISTINCT source) AS n_direct, CASE WHEN count(DISTINCT source) > 9 THEN 1 ELSE 2 END::BIGINT AS depth FROM edges WHERE edge_type = 'project_reference' GROUP BY 1")
def adaptive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.adaptive_depth(K.direct_consumers(part_edges(spark, sf_dir)), limit=9)


@query("SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) > 10 OR avg(o_totalprice) < 0.4 THEN 'vague' WHEN count(*) > 5 THEN 'moderate' ELSE 'clear' END AS ambiguity FROM orders GROUP BY 1")
def ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))
    return n.select("o_orderpriority", "n", S.ambiguity(F.col("n"), F.col("mean")).alias("ambiguity"))


@query(f"{_DIMS} SELECT CASE {_LEVEL.format('max(round(composite, 9))')} WHEN 'RED' THEN 'High' WHEN 'YELLOW' THEN 'Medium' ELSE 'Low' END AS overall FROM prof")
def overall_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.profile(_dims(spark, sf_dir)[0]).agg(S.level_label(S.level(F.max(F.round("composite", 9)))).alias("overall"))


_RATED = f"""WITH {PART_EDGES}, rated AS (SELECT DISTINCT target, source AS consumer, CASE WHEN p_size > 45 THEN 'Critical' WHEN p_size > 40 THEN 'High' WHEN p_size > 20 THEN 'Medium' ELSE 'Low' END AS rating FROM edges JOIN part ON 'P' || p_partkey = source WHERE edge_type = 'project_reference')"""


@query(f"""{_RATED}, k AS (SELECT consumer, count(DISTINCT target) AS appearances, max(CASE rating WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) AS r FROM rated GROUP BY 1)
SELECT consumer, appearances, CASE r WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS max_risk FROM k WHERE appearances >= 2 OR r >= 2 ORDER BY appearances DESC, r DESC, consumer LIMIT 10""")
def key_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rating = F.when(size > 45, "Critical").when(size > 40, "High").when(size > 20, "Medium").otherwise("Low")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("consumer"), rating.alias("rating"))
    rows = K.direct_consumers(part_edges(spark, sf_dir)).join(parts, "consumer").withColumn("depth", F.lit(0))
    return R.key_consumers(rows)


@query(f"""WITH {PART_NODES}, obj AS (SELECT name, unnest(object_refs) AS object FROM nodes), inv AS (SELECT 'P' || p_partkey AS name FROM part WHERE p_brand = 'Brand#11')
SELECT object, count(*) AS n_projects, CASE WHEN count(*) > 3 THEN 3 ELSE 1 END::BIGINT AS days FROM obj WHERE object IN (SELECT object FROM obj WHERE name IN (SELECT name FROM inv)) GROUP BY 1 HAVING count(*) >= 2""")
def database_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = table(spark, sf_dir, "part").where("p_brand = 'Brand#11'").select(F.concat(F.lit("P"), "p_partkey").alias("name"))
    return R.database_impact(part_nodes(spark, sf_dir), inv)


@query("SELECT p_partkey, CASE WHEN s = 0 THEN 'HIGH' WHEN s = 1 THEN 'MODERATE' ELSE 'LOW' END AS confidence, CASE WHEN s = 0 THEN 0.2 WHEN s = 1 THEN 0.3 ELSE 0.5 END::DOUBLE AS width FROM (SELECT p_partkey, CASE WHEN p_size / 50.0 < 0.3 THEN 0 WHEN p_size / 50.0 < 0.6 THEN 1 ELSE 2 END + CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS s FROM part)")
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, width = S.confidence_band(F.col("p_size") / 50.0, F.when(F.col("p_brand") == "Brand#11", "vague").otherwise("clear"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("confidence"), width.alias("width"))


_EFFORT = f"""{_TRACE}, c AS (SELECT count(*) FILTER (depth = 0) AS direct, count(*) FILTER (depth = 1) AS d1, count(*) FILTER (depth > 1) AS d2, count(DISTINCT target) AS targets FROM tr),
cat AS (SELECT unnest(['investigation', 'implementation', 'testing', 'integration_risk', 'database_migration']) AS category,
 unnest([least(3.0, greatest(1.0, 0.5 * targets + 0.5 * 2 + 1)), least(direct, 5) + 0.3 * greatest(0, direct - 5) + 0.5 * d1 + 0.25 * d2, 0.5 * direct + 7 + 0.5, 1 + 0.5 * 7 + 2 + 0.5, 7 + 2 * 4]::DOUBLE[]) AS days FROM c),
eff AS (SELECT category, 'MODERATE' AS confidence, round(days, 2) AS days, round(days * 0.7, 2) AS least, round(days * 1.3, 2) AS most FROM cat)"""


def _effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trace(spark, sf_dir)
    facts = t.agg(F.count_distinct("target").alias("targets"), F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") == 1).alias("depth1"), F.count_if(F.col("depth") > 1).alias("deeper"))
    fixed = {"clusters": 3, "shared": 7, "wide_shared": 4, "in_cycle": True, "cross_domain": True, "fan_in_above_5": True, "composite": 0.5, "clarity": "clear"}
    return R.effort(facts.withColumns({k: F.lit(v) for k, v in fixed.items()}))


@query(f"{_EFFORT} SELECT category, confidence, round(days, 1) AS days, round(least, 1) AS least, round(most, 1) AS most FROM eff")
def effort_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _effort(spark, sf_dir).withColumns({c: F.round(c, 1) for c in ("days", "least", "most")})


@query(f"{_EFFORT} SELECT category, round(days, 0) AS days, round(least, 0) AS least, round(most, 0) AS most FROM eff UNION ALL SELECT 'TOTAL', round(sum(days), 0), round(sum(least), 0), round(sum(most), 0) FROM eff")
def effort_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_total(_effort(spark, sf_dir)).withColumns({c: F.round(c, 0) for c in ("days", "least", "most")})


_LINE = "'P:' || name || ' NS:' || namespace || ' T:' || array_to_string({0}, ',') || ' SP:' || array_to_string(object_refs, ',')"


@query(f"WITH {PART_NODES} SELECT name, {_LINE.format('type_declarations')} AS line FROM nodes")
def codebase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.codebase_index(part_nodes(spark, sf_dir))


@query(f"""WITH {PART_NODES}, sh AS (SELECT sum(strlen('SHARED ' || object || ':' || names) + 1) AS b FROM (SELECT object, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT name, unnest(object_refs) AS object FROM nodes) GROUP BY 1 HAVING count(*) >= 2)),
l AS (SELECT sum(strlen({_LINE.format('type_declarations')}) + 1) AS b FROM nodes)
SELECT CAST(s AS BIGINT) AS step, CAST(l.b + CASE WHEN s = 0 THEN sh.b ELSE 0 END AS BIGINT) AS bytes FROM l, sh, (VALUES (0), (1), (2), (3), (4), (5), (6)) AS v(s)""")
def index_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.variants(part_nodes(spark, sf_dir))


@query("SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(list_sort(list_transform(string_split(p_type, ' '), lambda t, i: {'k': -len(t), 'i': i}))[1:2], lambda p: p.i)), lambda i: string_split(p_type, ' ')[i]), ',') || CASE WHEN len(string_split(p_type, ' ')) > 2 THEN ',...' ELSE '' END AS types FROM part")
def cap_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(I.cap_longest(F.split("p_type", " "), 2), ",").alias("types"))


@query(f"WITH {PART_NODES} SELECT 'P' || o_custkey AS target, CASE WHEN o_orderstatus = 'P' THEN 'root' ELSE o_orderstatus END AS role, o_orderkey FROM orders WHERE 'P' || o_custkey IN (SELECT name FROM nodes)")
def validate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("target"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("role"), "o_orderkey")
    return I.validate_targets(own, part_nodes(spark, sf_dir)).select("target", "role", "o_orderkey")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts of all documents as files, and changes: German ones are deleted, Spanish ones say more."""
    own = files(spark, sf_dir)
    old = B.file_facts(own)
    lang = F.split("path", "/")[1]
    gone = old.where(lang == "de").withColumn("content_hash", F.lit(None).cast("string"))
    more = B.file_facts(own.where(lang == "es").withColumn("text", F.concat("text", F.lit("\nclass Añadido uses License; class Ley "), F.col("project"))))
    return old, gone.unionByName(more)


#: A code base of all documents: project P0..P16, namespaces, types, procedures; the tenths 3, 4 and 5 of the documents
#: are deleted, changed and new.
_CODE = "concat(coalesce(text, ''), '\nusing NS', doc_id % {using}, ';\nclass C', doc_id % 11, ' { C', doc_id % {uses}, ' x; } \"usp_p', doc_id % 13, '\"')"
_SQL_CODE = "coalesce(text, '') || chr(10) || 'using NS' || doc_id % {using} || ';' || chr(10) || 'class C' || doc_id % 11 || ' {{ C' || doc_id % {uses} || ' x; }} \"usp_p' || doc_id % 13 || '\"'"


def _code_base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts before, changed facts, projects before and after, references before and after."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("P"), F.col("doc_id") % 17, F.lit("/doc"), "doc_id", F.lit(".cs")).alias("path"), F.concat(F.lit("P"), F.col("doc_id") % 17).alias("project"), "doc_id", "text")

    def facts(rows: DataFrame, using: int, uses: int) -> DataFrame:
        return B.file_facts(rows.select("path", "project", F.expr(_CODE.replace("{using}", str(using)).replace("{uses}", str(uses))).alias("text")))

    tenth = F.col("doc_id") % 10
    old = facts(docs.where(tenth != 5), 17, 5)
    gone = facts(docs.where(tenth == 3), 17, 5).withColumn("content_hash", F.lit(None).cast("string"))
    changed = facts(docs.where(tenth.isin(4, 5)), 7, 9).unionByName(gone)
    names = spark.range(17).select(F.concat(F.lit("P"), "id").alias("name"), F.concat(F.lit("src/P"), "id", F.lit("/P"), "id", F.lit(".csproj")).alias("path"), F.concat(F.lit("NS"), "id").alias("namespace"))
    after = names.where("name <> 'P16'").withColumn("namespace", F.when(F.col("name") == "P3", F.lit("NS4")).otherwise(F.col("namespace")))

    def references(step: int) -> DataFrame:
        include = F.concat(F.lit("..\\P"), (F.col("id") + step) % 17, F.lit("\\P"), (F.col("id") + step) % 17, F.lit(".csproj"))
        return spark.range(17).select(F.concat(F.lit("P"), "id").alias("source"), F.concat(F.lit("src/P"), "id").alias("directory"), include.alias("include"))

    return old, changed, names, after, references(1), references(2)


@query(rf"""WITH file AS (SELECT 'P' || doc_id % 17 || '/doc' || doc_id || '.cs' AS path, 'P' || doc_id % 17 AS project, CASE WHEN doc_id % 10 IN (4, 5) THEN {_SQL_CODE.format(using=7, uses=9)} ELSE {_SQL_CODE.format(using=17, uses=5)} END AS text
  FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 17 <> 16),
p AS (SELECT 'P' || i AS name, CASE WHEN i = 3 THEN 'NS4' ELSE 'NS' || i END AS namespace FROM range(16) AS r(i)),
ns AS (SELECT namespace, max(name) AS target FROM p GROUP BY 1),
ids AS (SELECT path, project, unnest({_IDS}) AS t FROM file),
decl AS (SELECT DISTINCT project AS target, unnest(regexp_extract_all(text, '\b(?:class|struct|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS t FROM file),
proc AS (SELECT DISTINCT project, unnest(regexp_extract_all(text, '(?i)"((?:\[?\w+\]?\.)?\[?(?:sp_|usp_)\w+\]?)"', 1)) AS o FROM file),
hit AS (
  SELECT project AS source, target, 'namespace_usage' AS edge_type, path AS proof FROM (SELECT DISTINCT path, project, unnest(regexp_extract_all(text, '(?m)^[ \t]*using[ \t]+([A-Za-z_][A-Za-z0-9_.]*)[ \t]*;', 1)) AS namespace FROM file) JOIN ns USING (namespace)
  UNION ALL SELECT project, target, 'type_usage', path || ':' || t FROM ids JOIN decl USING (t)
  UNION ALL SELECT a.project, b.project, 'sproc_shared', a.o FROM proc a JOIN proc b ON a.o = b.o
  UNION ALL SELECT 'P' || i, 'P' || (i + 2) % 17, 'project_reference', 'x' FROM range(16) AS r(i) WHERE (i + 2) % 17 < 16)
SELECT source, target, edge_type, CAST(count(DISTINCT proof) AS DOUBLE) AS weight, count(DISTINCT proof) AS evidence_total FROM hit WHERE source <> target GROUP BY 1, 2, 3""")
def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a graph that is patched after a change; the SQL builds them anew."""
    old, changed, names, after, references, new_references = _code_base(spark, sf_dir)
    old, changed = cut(old, "facts"), cut(changed, "facts")
    nodes, edges = Inc.full_graph(old, names, references)
    edges = cut(edges, "edges")
    return Inc.patch_graph(nodes, edges, old, changed, names, after, new_references)[1].select("source", "target", "edge_type", "weight", "evidence_total")


@query(rf"""WITH file AS (SELECT 'P' || doc_id % 17 AS project, CASE WHEN doc_id % 10 IN (4, 5) THEN {_SQL_CODE.format(using=7, uses=9)} ELSE {_SQL_CODE.format(using=17, uses=5)} END AS text
  FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 17 <> 16),
f AS (SELECT project AS name, count(*) AS file_count, list_sort(list_distinct(flatten(list(regexp_extract_all(text, '\b(?:class|struct|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)', 1))))) AS types,
        list_sort(list_distinct(flatten(list(regexp_extract_all(text, '(?i)"((?:\[?\w+\]?\.)?\[?(?:sp_|usp_)\w+\]?)"', 1))))) AS objects FROM file GROUP BY 1)
SELECT 'P' || i AS name, CASE WHEN i = 3 THEN 'NS4' ELSE 'NS' || i END AS namespace, coalesce(file_count, 0) AS file_count, coalesce(array_to_string(types, ','), '') AS types, coalesce(array_to_string(objects, ','), '') AS objects
FROM range(16) AS r(i) LEFT JOIN f ON f.name = 'P' || i""")
def patched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the patched graph, with what their files declare and use."""
    old, changed, names, after, references, new_references = _code_base(spark, sf_dir)
    old, changed = cut(old, "facts"), cut(changed, "facts")
    nodes, edges = Inc.full_graph(old, names, references)
    made = Inc.patch_graph(cut(nodes, "nodes"), edges, old, changed, names, after, new_references)[0]
    return made.select("name", "namespace", "file_count", F.array_join("type_declarations", ",").alias("types"), F.array_join("object_refs", ",").alias("objects"))


@query(f"""WITH {{FILES}}, cur AS (SELECT path, CASE WHEN split_part(path, '/', 2) = 'es' THEN text || chr(10) || 'class Añadido uses License; class Ley ' || project ELSE text END AS text FROM files WHERE split_part(path, '/', 2) <> 'de') SELECT path, sha256(text) AS content_hash FROM cur""".replace("{FILES}", FILES))
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inc.merge_facts(*_changes(spark, sf_dir)).select("path", "content_hash")


@query(f"WITH {FILES} SELECT path, CASE split_part(path, '/', 2) WHEN 'de' THEN 'deleted' ELSE 'declaration' END AS status FROM files WHERE split_part(path, '/', 2) IN ('de', 'es')")
def change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inc.classify(*_changes(spark, sf_dir))


@query("""WITH b AS (SELECT 'a/' || doc_id AS path, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 10 <> 5),
n AS (SELECT CASE WHEN doc_id % 10 = 7 THEN 'b/' || doc_id ELSE 'a/' || doc_id END AS path, md5(CASE WHEN doc_id % 10 = 4 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents WHERE doc_id % 10 <> 3),
j AS (SELECT coalesce(b.path, n.path) AS path, b.h AS old, n.h AS new FROM b FULL JOIN n ON b.path = n.path WHERE b.h IS NULL OR n.h IS NULL OR b.h <> n.h),
gone AS (SELECT path, old AS h, row_number() OVER (PARTITION BY old ORDER BY path) AS k FROM j WHERE new IS NULL),
came AS (SELECT path, new AS h, row_number() OVER (PARTITION BY new ORDER BY path) AS k FROM j WHERE old IS NULL)
SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS status, CASE WHEN c.path IS NOT NULL THEN g.path END AS old_path
FROM came c FULL JOIN gone g ON c.h = g.h AND c.k = g.k UNION ALL SELECT path, 'modified', NULL FROM j WHERE old IS NOT NULL AND new IS NOT NULL""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of two snapshots: tenths of them are new, deleted, changed or moved."""
    docs, tenth, text = table(spark, sf_dir, "documents"), F.col("doc_id") % 10, F.coalesce("text", F.lit(""))
    path = F.concat(F.lit("a/"), "doc_id")
    before = docs.where(tenth != 5).select(path.alias("path"), F.md5(text).alias("content_hash"))
    after = docs.where(tenth != 3).select(F.when(tenth == 7, F.concat(F.lit("b/"), "doc_id")).otherwise(path).alias("path"), F.md5(F.when(tenth == 4, F.concat(text, F.lit("!"))).otherwise(text)).alias("content_hash"))
    return Inc.diff_snapshots(before, after)


@query(f"""WITH RECURSIVE {PART_EDGES}, {PART_NODES}, {METRICS}, j AS (SELECT name, '{{"fan_in":' || fan_in || ',"fan_out":' || fan_out || ',"instability":' || round(instability, 3)::DOUBLE || ',"coupling_score":' || round(coupling, 3)::DOUBLE || ',"afferent_coupling":' || afferent || ',"efferent_coupling":' || efferent
  || ',"shared_db_density":' || round(shared_db_density, 3)::DOUBLE || ',"type_export_count":' || type_export_count || ',"consumer_count":' || consumer_count || '}}' AS body FROM metrics)
SELECT 'metrics' AS section, 0 AS place, name AS key, body FROM j
UNION ALL SELECT 'nodes', 0, name, '{{"name":"' || name || '","namespace":"' || namespace || '","file_count":' || file_count || '}}' FROM nodes
UNION ALL SELECT 'edges', 0, source || ' -> ' || target || ' -> ' || edge_type, '{{"source":"' || source || '","target":"' || target || '","edge_type":"' || edge_type || '","weight":' || weight || '}}' FROM edges
UNION ALL SELECT 'summary', 0, 'summary', '{{"node_count":' || (SELECT count(*) FROM nodes) || ',"edge_count":' || (SELECT count(*) FROM edges) || ',"cycle_count":0,"cluster_count":0}}'
UNION ALL SELECT 'top_coupled', row_number() OVER (ORDER BY coupling DESC, name), name, '{{"project":"' || name || '","fan_in":' || fan_in || ',"fan_out":' || fan_out || ',"instability":' || round(instability, 3)::DOUBLE || ',"coupling_score":' || round(coupling, 3)::DOUBLE || '}}'
 FROM (SELECT * FROM metrics ORDER BY coupling DESC, name LIMIT 10)""")
def graph_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of the part graph, without cycles and clusters."""
    edges = part_edges(spark, sf_dir)
    none = spark.createDataFrame([], "component string, size long, edge_count long")
    return Dc.graph_document(part_nodes(spark, sf_dir), edges, metrics(spark, sf_dir), none)


@query(f"""{_TRACE}, t AS (SELECT target, count(*) FILTER (depth = 0) AS d, count(*) FILTER (depth > 0) AS f, max(depth) AS m FROM tr GROUP BY 1)
SELECT 'targets' AS section, 0 AS place, target AS key, '{{"target":"' || target || '","total_direct":' || d || ',"total_transitive":' || f || ',"max_depth_reached":' || m || '}}' AS body FROM t
UNION ALL SELECT 'summary', 0, 'summary', '{{"request":"move","targets":' || count(*) || ',"total_direct":' || sum(d) || ',"total_transitive":' || sum(f) || ',"max_depth":' || max(m) || '}}' FROM t""")
def impact_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and targets of the impact document."""
    return Dc.impact_document(cut(_trace(spark, sf_dir), "trace"), "move").where("section in ('summary', 'targets')")


@query()
def patched_type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, changed = (cut(d, "facts") for d in _changes(spark, sf_dir))
    types = old.select(F.explode("types").alias("type"), "project").distinct()
    return Inc.patch_type_edges(B.type_edges_full(old, types), old, changed).select("source", "target", "weight", "evidence_total", joined("evidence"))


@query("SELECT event_type, max(ts) <= TIMESTAMP '2024-01-15' AS fresh FROM events GROUP BY 1")
def mtime_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.max("ts") <= F.lit("2024-01-15").cast("timestamp")).alias("fresh"))


@query(f"WITH {PART_NODES} SELECT name, namespace, file_count FROM nodes")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    trees.save_snapshot({"nodes": part_nodes(spark, sf_dir)}, path, {"version": 2, "scope": sf_dir})
    return trees.load_snapshot(spark, path, {"version": 2, "scope": sf_dir})["nodes"].select("name", "namespace", "file_count")


@query(f"WITH {PART_EDGES} SELECT DISTINCT source, target, 'P' || source[2:] || ' --> ' || target AS line FROM edges WHERE edge_type = 'project_reference'")
def mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Rp.mermaid_lines(part_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {PART_EDGES}, {PART_NODES}, {METRICS} SELECT name, fan_in, fan_out, round(instability, 3) AS instability, round(coupling, 3) AS coupling, round(shared_db_density, 3) AS shared_db_density, consumer_count FROM metrics")
def graph_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Rp.metrics_rows(metrics(spark, sf_dir))


@query(f"{_TRACE} SELECT target AS \"TargetName\", consumer AS \"ConsumerName\", CAST(depth AS BIGINT) AS \"Depth\" FROM tr")
def impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Rp.impact_rows(_trace(spark, sf_dir))


_SCORES = {"structural": "structural", "instability_": "instability", "cycle": "cycle", "database": "database", "blast_radius": "blast_radius", "boundary": "domain_boundary", "surface": "change_surface"}


@query(f"""{_DIMS}, w AS (SELECT name, unnest([structural * 0.7, instability_ * 0.6, cycle * 1.0, database * 0.8, blast_radius * 0.7, boundary * 0.5, coalesce(surface * 0.9, 0.45)]) AS score, unnest(['structural', 'instability', 'cycle', 'database', 'blast_radius', 'domain_boundary', 'change_surface']) AS dimension, unnest([0, 1, 2, 3, 4, 5, 6]) AS i FROM dims),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, i) AS place FROM w WHERE score > 0), top AS (SELECT name, string_agg(dimension, ',' ORDER BY place) AS factors FROM r WHERE place <= 3 GROUP BY 1)
SELECT name AS project, {_LEVEL.format('round(composite, 9)')} AS level, round(composite, 4)::DOUBLE AS composite, '' || name AS id, {', '.join(f'round(round({c}, 9), 4)::DOUBLE AS {d}, {c} IS NOT NULL AS has_{d}' for c, d in _SCORES.items())},
 CAST(coalesce(n.dd + n.i + n.mm + n.a, 0) AS BIGINT) AS changed_type_count, CAST(prof.d AS BIGINT) AS direct_consumers, CAST(prof.t AS BIGINT) AS transitive_consumers, true AS graph_available, coalesce(factors, '') AS risk_factors,
 CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS outcome_signals, CAST(NULL AS VARCHAR) AS merge_sha FROM prof LEFT JOIN n USING (name) LEFT JOIN top USING (name)""")
def prediction_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims, direct, transitive = _dims(spark, sf_dir)
    changed = R.type_diff(*_part_snapshots(spark, sf_dir)).groupBy(F.col("project").alias("name")).agg(F.count("*").alias("n"))
    own = Rp.prediction_rows(R.profile(dims).withColumn("level", S.level(F.round("composite", 9))), direct, transitive, changed)
    flat = [x for d in S.DIMENSIONS for x in (F.col("scores")[d].alias(d), F.col("available")[d].alias(f"has_{d}"))]
    return own.withColumn("id", F.col("project")).withColumn("risk_factors", F.array_join("risk_factors", ",")).select("*", *flat).drop("scores", "available")


@query(f"{ENMC} SELECT d.target AS \"TargetName\", d.source AS \"ConsumerName\", round(coupling, 2) AS \"CouplingScore\", fan_in AS \"FanIn\", row_number() OVER (PARTITION BY d.target ORDER BY coupling DESC NULLS LAST, d.source) AS \"Place\" FROM ref d JOIN metrics m ON m.name = d.source")
def console_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = metrics(spark, sf_dir).select("name").limit(0)
    return Rp.console_rows(enrich(K.direct_consumers(part_edges(spark, sf_dir)), metrics(spark, sf_dir), none))


@query(f"{ENMC} SELECT d.target AS \"TargetName\", d.source AS \"ConsumerName\", round(coupling, 2) AS \"CouplingScore\", fan_in AS \"FanIn\", fan_out AS \"FanOut\", round(instability, 3) AS \"Instability\" FROM ref d JOIN metrics m ON m.name = d.source")
def detailed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = metrics(spark, sf_dir).select("name").limit(0)
    return Rp.detailed(enrich(K.direct_consumers(part_edges(spark, sf_dir)), metrics(spark, sf_dir), none))


@query(f"WITH {PART_EDGES}, {PART_NODES} SELECT DISTINCT target || '\"' AS t, target || '|' || source || '|' || array_to_string(solutions, '; ') AS line FROM edges JOIN nodes ON name = source WHERE edge_type = 'project_reference'")
def consumer_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = K.consumer_rows(K.direct_consumers(part_edges(spark, sf_dir)), part_nodes(spark, sf_dir))
    return own.select(F.concat("target", F.lit('"')).alias("t"), F.concat_ws("|", "target", "consumer", "solutions").alias("line"))


@query(f"WITH {PART_EDGES} SELECT target, count(DISTINCT source) AS n, md5(string_agg(DISTINCT source, ',' ORDER BY source)) AS consumers FROM edges WHERE edge_type = 'project_reference' GROUP BY 1")
def consumer_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Rp.grouped(K.direct_consumers(part_edges(spark, sf_dir)))
    return own.select("target", "n", F.md5(F.array_join(F.from_json("consumers", "array<string>"), ",")).alias("consumers"))


@query(f"WITH {PART_EDGES} SELECT DISTINCT target, source AS consumer, dense_rank() OVER (ORDER BY target, source) AS place FROM (SELECT DISTINCT target, source FROM edges WHERE edge_type = 'project_reference')")
def sorted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in global order; a range-partitioned sort gives each its place without one task for all."""
    return Rp.with_places(K.direct_consumers(part_edges(spark, sf_dir)), ["target", "consumer"])


@query(f"""{_TRACE}, par AS (SELECT tr.target, tr.consumer, tr.depth, min(p.consumer) AS parent FROM tr LEFT JOIN st ON st.nxt = tr.consumer LEFT JOIN tr p ON p.target = tr.target AND p.consumer = st.at AND p.depth = tr.depth - 1 GROUP BY 1, 2, 3)
SELECT a.target, a.consumer, CASE a.depth WHEN 0 THEN a.consumer WHEN 1 THEN a.parent || '/' || a.consumer ELSE b.parent || '/' || a.parent || '/' || a.consumer END AS path FROM par a LEFT JOIN par b ON b.target = a.target AND b.consumer = a.parent AND a.depth = 2""")
def propagation_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Rp.tree_paths(cut(_trace(spark, sf_dir), "trace"))


@query(f"{_TRACE}, c AS (SELECT target, count(*) FILTER (depth = 0) AS d, count(*) FILTER (depth > 0) AS t FROM tr GROUP BY 1) SELECT target, concat_ws('; ', CASE WHEN d > 0 THEN 'review ' || d || ' direct consumers' END, CASE WHEN t > 0 THEN 'check ' || t || ' transitive consumers' END, CASE WHEN d >= 5 THEN 'plan a staged rollout' END) AS steps FROM c")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _trace(spark, sf_dir).groupBy("target").agg(F.count_if(F.col("depth") == 0).alias("direct"), F.count_if(F.col("depth") > 0).alias("transitive"))
    return own.select("target", F.array_join(Rp.next_steps(F.col("direct"), F.col("transitive")), "; ").alias("steps"))


@query()
def src_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables' own files, as an inventory scan finds them."""
    return trees.inventory(spark, sf_dir, ("parquet",)).select(F.substring_index("path", "/", -1).alias("name"), "extension")


@query()
def explicit_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of generated project files that no other property decides."""
    nation = table(spark, sf_dir, "nation")
    xml = F.concat(F.lit('<Project Sdk="Own"><Import Project="..\\shared\\'), F.col("n_name"), F.lit('.props"/><Import Project="$(Elsewhere)/x.props"/></Project>'))
    own = trees.scan_projects(nation.select(F.concat(F.lit("src/a/"), "n_name", F.lit(".csproj")).alias("path"), xml.alias("text")))
    return own.select("name", joined("imports"))


