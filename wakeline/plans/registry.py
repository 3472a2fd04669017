"""Named queries over a data directory, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name or another one."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def joined(column: str) -> Column:
    """An array column as a comma-joined string of the same name."""
    return F.array_join(column, ",").alias(column)


def _edges(name: str) -> str:
    return f"""
line AS (SELECT *, {name} AS name FROM lineitem),
step AS (SELECT *, lead(name) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice, l_shipdate) AS nxt FROM line),
edges AS (
  SELECT name AS source, nxt AS target, CASE l_returnflag WHEN 'A' THEN 'project_reference' WHEN 'N' THEN 'namespace_usage' ELSE 'type_usage' END AS edge_type,
         CAST(count(*) AS DOUBLE) AS weight, list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))) AS proofs
  FROM step WHERE nxt IS NOT NULL AND nxt <> name GROUP BY 1, 2, 3)"""


PART_EDGES = _edges("'P' || l_partkey")
MODULE_EDGES = _edges("'S' || l_suppkey || '.P' || l_partkey")
PART_NODES = """
pair AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
fact AS (SELECT l_partkey, CAST(sum(n) AS BIGINT) AS file_count, list_sort(list('obj_' || l_suppkey)) AS object_refs, list_sort(list_distinct(list(n_name) FILTER (n_name IS NOT NULL))) AS solutions
         FROM pair LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
nodes AS (SELECT 'P' || p_partkey AS name, 'Shop.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS namespace, file_count,
            list_sort(list_distinct(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:]) || 'Type'))) AS type_declarations,
            object_refs, solutions, 'build/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.props' AS import_path
          FROM part JOIN fact ON p_partkey = l_partkey)"""
WEIGHTS = "CASE edge_type WHEN 'project_reference' THEN 10 WHEN 'sproc_shared' THEN 8 WHEN 'config_di' THEN 7 WHEN 'rdl_sproc' THEN 6 WHEN 'namespace_usage' THEN 5 WHEN 'type_usage' THEN 3 ELSE 0 END"
#: Needs edges and nodes.
METRICS = f"""
fan AS (SELECT name, count(*) FILTER (o = 0 AND edge_type = 'project_reference') AS fan_in, count(*) FILTER (o = 1 AND edge_type = 'project_reference') AS fan_out,
          count(*) FILTER (o = 0) AS afferent, count(*) FILTER (o = 1) AS efferent, sum(CAST(weight AS BIGINT) * {WEIGHTS}) / 10.0 AS coupling
        FROM (SELECT source AS name, 1 AS o, edge_type, weight FROM edges UNION ALL SELECT target, 0, edge_type, weight FROM edges) GROUP BY 1),
used AS (SELECT target AS name, count(DISTINCT source) AS consumer_count FROM edges GROUP BY 1),
obj AS (SELECT name, unnest(object_refs) AS object FROM nodes),
many AS (SELECT object, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS shared FROM obj GROUP BY 1),
dense AS (SELECT name, CAST(sum(shared) AS DOUBLE) / count(*) AS shared_db_density FROM obj JOIN many USING (object) GROUP BY 1),
metrics AS (SELECT name, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out,
              CASE WHEN coalesce(fan_in + fan_out, 0) > 0 THEN fan_out::DOUBLE / (fan_in + fan_out) ELSE 0.0 END::DOUBLE AS instability,
              coalesce(coupling, 0)::DOUBLE AS coupling, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent,
              coalesce(shared_db_density, 0)::DOUBLE AS shared_db_density, CAST(len(type_declarations) AS BIGINT) AS type_export_count, coalesce(consumer_count, 0) AS consumer_count
            FROM nodes LEFT JOIN fan USING (name) LEFT JOIN used USING (name) LEFT JOIN dense USING (name))"""
#: Strong components of the reference layer, from edges.
CYCLES = """
ref AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'project_reference'),
path AS (SELECT source AS a, target AS b FROM ref UNION SELECT path.a, ref.target FROM path JOIN ref ON path.b = ref.source),
scc AS (SELECT p.a AS name, min(p.b) AS component FROM path p JOIN path q ON p.a = q.b AND p.b = q.a GROUP BY 1),
members AS (SELECT name, component, count(*) OVER (PARTITION BY component) AS size FROM scc)"""
#: Components of the reference layer with at least two nodes, from edges.
CLUSTERS = """
ref AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'project_reference'),
und AS (SELECT source AS a, target AS b FROM ref UNION SELECT target, source FROM ref),
walk AS (SELECT a, b FROM und UNION SELECT walk.a, und.b FROM walk JOIN und ON walk.b = und.a),
members AS (SELECT a AS name, min(b) AS cluster FROM walk GROUP BY 1)"""
