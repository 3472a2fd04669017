"""Queries of text facts, edge builders, mappings and consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import builders as B
from ..operators import consumers as K
from ..operators import mapping as Mp
from ..operators.components import cut
from ..sources import trees
from ..sources.testdata import files, module_edges, part_edges, part_nodes, table
from .registry import MODULE_EDGES, PART_EDGES, PART_NODES, joined, query

_KEYWORDS = ", ".join(f"'{k}'" for k in T.KEYWORDS)
_IDS = f"list_sort(list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')), lambda x: x NOT IN ({_KEYWORDS})))"
FILES = "files AS (SELECT source || '/' || lang || '/doc' || doc_id || '.txt' AS path, source AS project, coalesce(text, '') AS text FROM documents)"
#: A literal or a comment, for engines without look-around.
_LITERAL = r"""(@"(?:[^"]|"")*"|"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*'')"""
_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|$)"


def benchmark_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, project): the identifiers of each benchmark item, as types that it declares."""
    own = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("project"), F.explode(T.identifiers(F.coalesce("text", F.lit("")))).alias("type"))
    return own.where(F.length("type") >= 9)


TYPES = f"types AS (SELECT DISTINCT 'item' || item_id AS project, t AS type FROM (SELECT item_id, unnest({_IDS}) AS t FROM benchmark) WHERE len(t) >= 9)"


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as files: (path, project, identifiers, namespaces), a line imports the brand of its part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    own = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    path = F.concat_ws("/", F.lit("o"), "l_orderkey", "l_linenumber", "l_partkey")
    return own.select(path.alias("path"), F.concat(F.lit("S"), "l_suppkey").alias("project"), F.split("p_type", " ").alias("identifiers"), F.array("p_brand").alias("namespaces"))


ORDER_FACTS = "facts AS (SELECT DISTINCT 'o/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey AS path, 'S' || l_suppkey AS project, p_brand AS namespace, p_type FROM lineitem JOIN part ON p_partkey = l_partkey)"


def brand_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("namespace"), F.concat(F.lit("P"), "p_partkey").alias("project"))


def nation_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, object): nations and the parts that their suppliers deliver."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    own = lines.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("n_name").alias("project"), F.concat(F.lit("part"), "l_partkey").alias("object")).distinct()


USES = "uses AS (SELECT DISTINCT n_name AS project, 'part' || l_partkey AS object FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target", "edge_type", "weight", joined("evidence"), "evidence_total")


def _edge_sql(hits: str, kind: str) -> str:
    return f"""SELECT source, target, '{kind}' AS edge_type, CAST(len(p) AS DOUBLE) AS weight, array_to_string(p[1:10], ',') AS evidence, CAST(len(p) AS BIGINT) AS evidence_total
FROM (SELECT source, target, list_sort(list_distinct(list(proof))) AS p FROM ({hits}) WHERE source <> target GROUP BY 1, 2)"""


@query(f"WITH {FILES} SELECT path, project, CAST(len({_IDS}) AS INTEGER) AS n_identifiers, md5(array_to_string({_IDS}, ',')) AS identifiers, sha256(text) AS content_hash FROM files")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = B.file_facts(files(spark, sf_dir))
    return own.select("path", "project", F.size("identifiers").alias("n_identifiers"), F.md5(F.array_join("identifiers", ",")).alias("identifiers"), "content_hash")


@query(r"SELECT page_id, array_to_string(list_distinct(list_concat(regexp_extract_all(html, '\b(?:class|struct|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), regexp_extract_all(html, '\bdelegate\s+[\w<>\[\],.?]+\s+([A-Za-z_][A-Za-z0-9_]*)', 1))), ',') AS types FROM pages")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_distinct(T.declared_types(F.col("html"))).alias("types")).select("page_id", F.array_join("types", ",").alias("types"))


#: A declaration of each kind for each part, some names declared twice.
_CODE_TEXT = "'class C' || p_size || ' { enum E' || (p_partkey % 7) || ' { } } struct C' || p_size || '; public record R' || p_partkey || '(int a); delegate List<int> E' || (p_partkey % 5) || '(int x);'"


@query(rf"""WITH t AS (SELECT p_partkey, {_CODE_TEXT} AS text FROM part),
p AS (SELECT p_partkey, unnest(d) AS d, generate_subscripts(d, 1) AS i FROM (SELECT p_partkey, regexp_extract_all(text, '\b((?:class|struct|interface|enum|record)\s+[A-Za-z_][A-Za-z0-9_]*)', 1) AS d FROM t)),
g AS (SELECT p_partkey, unnest(regexp_extract_all(text, '\bdelegate\s+[\w<>\[\],.?]+\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name, 'delegate' AS kind, 1000000 AS i FROM t),
a AS (SELECT p_partkey, regexp_extract(d, '\s([A-Za-z0-9_]+)$', 1) AS name, regexp_extract(d, '^[a-z]+') AS kind, i FROM p UNION ALL SELECT * FROM g)
SELECT p_partkey, name, arg_min(kind, i) AS kind FROM a GROUP BY 1, 2""")
def type_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE_TEXT).alias("text"))
    return own.select("p_partkey", F.explode(T.declared_kinds(F.col("text"))).alias("x")).select("p_partkey", "x.name", "x.kind")


@query("SELECT event_id, (SELECT arg_max(d.event_id, (d.ts, d.event_id)) FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase' AND (d.ts, d.event_id) < (e.ts, e.event_id)) AS enclosing FROM events e WHERE event_type <> 'purchase'")
def asof_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the same user before each other event."""
    ev = table(spark, sf_dir, "events").withColumn("offset", F.struct("ts", "event_id"))
    refs, decl = ev.where("event_type <> 'purchase'"), ev.where("event_type = 'purchase'").withColumn("name", F.col("event_id").cast("string"))
    found = B.asof(refs.select("user_id", "offset"), decl.select("user_id", "offset", "name"), ["user_id"])
    return found.select(F.col("offset.event_id").alias("event_id"), F.col("enclosing").cast("long").alias("enclosing"))


@query(f"SELECT page_id, sha256(regexp_replace(html, '{_LITERAL}|{_COMMENT}', '\\1', 'g')) AS stripped FROM pages")
def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.strip_comments(F.coalesce("html", F.lit(""))), 256).alias("stripped"))


_CODE = f"regexp_replace(html, '{_LITERAL}|{_COMMENT}', ' ', 'g')"


@query(f"SELECT page_id, md5(array_to_string({_IDS.replace('(text,', f'({_CODE},')}, ',')) AS identifiers FROM pages")
def code_only_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.array_join(T.identifiers(T.code_only(F.coalesce("html", F.lit("")))), ",")).alias("identifiers"))


@query(f"SELECT page_id, contains({_CODE}, 'track') AS used FROM pages")
def validated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", B.used_in_code(F.coalesce("html", F.lit("")), F.lit("track")).alias("used"))


_NOISE = "'select', 'where', 'set', 'values', 'the', 'a', 'an', 'order', 'group', 'as', 'on'"


@query(rf"""WITH h AS (SELECT page_id, regexp_replace(html, '{_LITERAL}|{_COMMENT}', '\1', 'g') AS t, split_part(split_part(url, '//', 2), '/', 1) AS project FROM pages)
SELECT DISTINCT 'page' || page_id AS path, project, 'sql_table' AS kind, o AS object FROM (SELECT *, unnest(regexp_extract_all(t, '(?i)\b(?:from|join|into|update)\s+\[?(?:dbo\]?\.)?\[?([A-Za-z_]\w+)', 1)) AS o FROM h) WHERE lower(o) NOT IN ({_NOISE})""")
def db_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return trees.db_dependencies(table(spark, sf_dir, "pages").select(F.concat(F.lit("page"), "page_id").alias("path"), host.alias("project"), F.col("html").alias("text")))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line FROM documents")
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each text's last character."""
    return table(spark, sf_dir, "documents").select("doc_id", T.line_number(F.col("text"), F.length("text")).alias("line"))


@query("SELECT p_partkey, 'dbo.' || replace(p_name, ' ', '_') AS name FROM part")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" [DBO] . ["), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("]"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_procedure(raw).alias("name"))


@query(r"SELECT doc_id, regexp_matches(text, 'License') AS a, regexp_matches(text, '(?i)\bthe\s+[a-z]+') AS b, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS c FROM documents")
def regex_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike("License").alias("a"), t.rlike(r"(?i)\bthe\s+[a-z]+").alias("b"), t.rlike("[0-9]{3}-[0-9]{4}").alias("c"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query("SELECT p_brand, sha256(string_agg(p_name || p_partkey, chr(10) ORDER BY p_name || p_partkey)) AS hash FROM part GROUP BY 1")
def set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(T.set_hash(F.collect_list(F.concat("p_name", "p_partkey"))).alias("hash"))


_REDACT = "l"
for _kind, _pattern in reversed(T.CREDENTIALS):
    _REDACT = f"CASE WHEN regexp_matches(l, '{_pattern.replace("'", "''")}') THEN '[removed: {_kind}]' ELSE {_REDACT} END"


@query(f"SELECT doc_id, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda l: {_REDACT}), chr(10))) AS redacted FROM documents")
def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


@query("SELECT 'src/' || CASE WHEN p_size % 3 = 0 THEN 'Tests/' ELSE '' END || p_partkey || CASE WHEN p_size % 5 = 0 THEN 'Test.cs' ELSE '.cs' END AS path, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'test' ELSE 'production' END AS kind FROM part")
def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.when(F.col("p_size") % 3 == 0, "Tests/").otherwise(""), "p_partkey", F.when(F.col("p_size") % 5 == 0, "Test.cs").otherwise(".cs"))
    return table(spark, sf_dir, "part").select(path.alias("path"), T.classify_path(path).alias("kind"))


@query("SELECT c_custkey, replace(c_name, '#', '') AS base FROM customer")
def strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*map(F.lit, (".Tests", ".webapi", ".SERVICE", ".IntegrationTests"))), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.strip_suffix(F.concat(F.replace("c_name", F.lit("#"), F.lit("")), end)).alias("base"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS is_test FROM customer")
def exclude_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ".Tests").otherwise(".Core"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.matches_glob(name).alias("is_test"))


@query("SELECT n_nationkey, coalesce(nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE ' ' END), ''), nullif(trim(CASE WHEN n_nationkey % 3 = 1 THEN r_name ELSE '' END), ''), 'stem' || n_nationkey) AS namespace FROM nation JOIN region ON r_regionkey = n_regionkey")
def coalesce_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces of generated project files: root namespace, else assembly name, else the file's stem."""
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    xml = F.concat(F.lit('<Project Sdk="Own.Sdk"><PropertyGroup><RootNamespace>'), F.when(k % 3 == 0, F.col("n_name")).otherwise(" "), F.lit("</RootNamespace><AssemblyName>"), F.when(k % 3 == 1, F.col("r_name")).otherwise(""), F.lit("</AssemblyName></PropertyGroup></Project>"))
    own = trees.scan_projects(nations.select(F.concat(F.lit("src/stem"), "n_nationkey", F.lit(".csproj")).alias("path"), xml.alias("text")))
    return own.select(F.regexp_replace("name", "stem", "").cast("int").alias("n_nationkey"), "namespace")


@query(f"WITH {FILES}, own AS (SELECT DISTINCT source AS d, upper(source) AS o FROM documents UNION SELECT DISTINCT source || '/' || lang, upper(source) || '-' || lang FROM documents WHERE lang = 'en') SELECT path, arg_max(o, len(d)) AS owner FROM files JOIN own ON starts_with(path, d || '/') GROUP BY 1")
def nearest_ancestor_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    owners = docs.select(F.col("source").alias("directory"), F.upper("source").alias("owner")).unionByName(docs.where("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("directory"), F.concat(F.upper("source"), F.lit("-"), "lang").alias("owner"))).distinct()
    return B.nearest_owner(files(spark, sf_dir).select("path"), owners)


@query(f"WITH {FILES} SELECT path, project || CASE p WHEN 0 THEN '/' || split_part(path, '/', 2) ELSE '' END AS directory, CAST(p AS BIGINT) AS place FROM files, (VALUES (0), (1)) AS v(p) WHERE p = 0 OR split_part(path, '/', 2) <> 'de'")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    props = docs.select(F.concat_ws("/", "source", "lang").alias("directory"), (F.col("lang") != "de").alias("chains")).unionByName(docs.select(F.col("source").alias("directory"), F.lit(False).alias("chains")).distinct())
    return B.ancestor_chain(files(spark, sf_dir).select("path"), props)


@query("SELECT n_name AS solution_of, string_agg(DISTINCT r_name, ',') AS solutions, false AS collides FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    own = trees.solutions_of(nations.select(F.col("r_name").alias("solution"), F.concat(F.lit("src/"), "n_name", F.lit(".proj")).alias("project_path")))
    return own.select(F.col("project").alias("solution_of"), joined("solutions"), "collides")


@query("SELECT arg_max(trim(c_name), c_custkey) AS value, trim(c_mktsegment) || '/' || c_nationkey AS key FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 2")
def csv_mapping_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("k", F.concat(F.lit(" "), F.concat_ws("/", "c_mktsegment", "c_nationkey")))
    return Mp.clean_mapping(rows, "k", "c_name", "c_custkey").select("key", "value")


@query("SELECT coalesce(c.n_name, n.n_name) AS key, coalesce('o' || o, n.r_name) AS value FROM (SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey) n FULL JOIN (SELECT n_name, count(*) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1) c ON c.n_name = n.n_name")
def overlay_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    over = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("key")).agg(F.concat(F.lit("o"), F.count("*")).alias("value"))
    return Mp.overlay(base, over)


@query("SELECT r_name || '.' || n_name || '.' || c_mktsegment || '.' || c_custkey AS probe, r_name || CASE WHEN n_nationkey < 12 THEN '.' || n_name ELSE '' END AS key FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    placed = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = region.select(F.col("r_name").alias("key")).union(placed.where("n_nationkey < 12").select(F.concat_ws(".", "r_name", "n_name")))
    probes = customer.join(F.broadcast(placed), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment", "c_custkey").alias("probe"))
    return Mp.longest_prefix(probes, keys)


@query("""SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 4 THEN 1 ELSE 0 END AS place, CASE c_custkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'case_insensitive' WHEN 2 THEN 'suffix_stripped' WHEN 3 THEN 'prefix' ELSE 'suffix_stripped_ci' END AS strategy, n_name AS key, r_name AS value
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def resolve_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    mapping = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("value"))
    own = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    n, k = F.col("n_name"), F.col("c_custkey") % 5
    first = F.when(k == 0, n).when(k == 1, F.initcap(F.lower(n))).when(k == 2, F.concat(n, F.lit(".Tests"))).when(k == 3, F.concat(n, F.lit(".Jobs.Own"))).otherwise("nobody")
    second = F.when(k == 4, F.concat(F.lower(n), F.lit(".worker"))).otherwise("no-one")
    probes = own.select(F.col("c_custkey").alias("id"), F.posexplode(F.array(first, second)).alias("place", "probe"))
    return Mp.resolve(probes, mapping).drop("probe")


@query("SELECT n_name AS name, n_name AS match FROM nation")
def fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return Mp.fuzzy(nation.select(F.col("n_name").alias("name")), nation.select(F.concat(F.lit("x."), "n_name").alias("known")).union(nation.select("n_name")))


@query("SELECT DISTINCT c_mktsegment AS pipeline FROM customer")
def pipeline_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mp.group_by_value(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment").select(F.col("value").alias("pipeline"))


@query("SELECT c_mktsegment AS value, count(DISTINCT c_name) AS n, md5(string_agg(DISTINCT c_name, ',' ORDER BY c_name)) AS names FROM customer GROUP BY 1")
def group_by_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mp.group_by_value(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment").withColumn("names", F.md5(F.array_join("names", ",")))


_NS = "ns AS (SELECT p_brand AS namespace, max('P' || p_partkey) AS target FROM part GROUP BY 1)"


@query(f"WITH {ORDER_FACTS}, {_NS} " + _edge_sql("SELECT f.project AS source, target, path AS proof FROM facts f JOIN ns USING (namespace)", "namespace_usage"))
def namespace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rows(B.namespace_edges(order_facts(spark, sf_dir), brand_namespaces(spark, sf_dir)))


_USE = f"WITH {FILES}, {TYPES}, use AS (SELECT f.project AS source, t.project AS target, path, type FROM (SELECT project, path, unnest({_IDS}) AS type FROM files) f JOIN types t USING (type))"


@query(_USE + " " + _edge_sql("SELECT source, target, path || ':' || type AS proof FROM use", "type_usage"))
def type_usage_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rows(B.type_edges_full(B.file_facts(files(spark, sf_dir)), benchmark_types(spark, sf_dir)))


@query(_USE + """, scope AS (SELECT path, 'item1' AS target FROM files WHERE split_part(path, '/', 2) = 'en'), reach AS (SELECT DISTINCT source, 'item' || item_id AS target FROM documents, (SELECT item_id, text AS text_ FROM benchmark) WHERE len(text_) >= 200) """
    + _edge_sql("SELECT source, target, path || ':' || type AS proof FROM use WHERE (path, target) IN (SELECT path, target FROM scope) OR (path NOT IN (SELECT path FROM scope) AND (source, target) IN (SELECT source, target FROM reach))", "type_usage"))
def type_usage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English files import item 1; other files fall back to the long items, which every project reaches."""
    lang = F.split("path", "/")[1]
    facts = B.file_facts(files(spark, sf_dir)).withColumn("namespaces", F.when(lang == "en", F.array(F.lit("items.one"))).otherwise(F.array().cast("array<string>")))
    ns = spark.range(1).select(F.lit("items.one").alias("namespace"), F.lit("item1").alias("project"))
    even = table(spark, sf_dir, "benchmark").where("length(text) >= 200").select(F.concat(F.lit("item"), "item_id").alias("target"))
    reachable = table(spark, sf_dir, "documents").select("source").distinct().withColumn("k", F.lit(1)).join(even.withColumn("k", F.lit(1)), "k").select("source", "target")
    return _edge_rows(B.type_edges(facts, benchmark_types(spark, sf_dir), ns, reachable))


@query(f"WITH {USES} " + _edge_sql("SELECT a.project AS source, b.project AS target, object AS proof FROM uses a JOIN uses b USING (object)", "sproc_shared"))
def shared_object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_rows(B.shared_object_edges(nation_uses(spark, sf_dir)))


@query(f"WITH {USES}, r AS (SELECT DISTINCT 'r' || o_custkey AS report, o_orderpriority AS project, 'part' || l_partkey AS object FROM orders JOIN lineitem ON l_orderkey = o_orderkey) " + _edge_sql("SELECT r.project AS source, uses.project AS target, report || ':' || object AS proof FROM r JOIN uses USING (object)", "rdl_sproc"))
def report_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    refs = own.select(F.concat(F.lit("r"), "o_custkey").alias("report"), F.col("o_orderpriority").alias("project"), F.concat(F.lit("part"), "l_partkey").alias("object")).distinct()
    return _edge_rows(B.report_edges(refs, nation_uses(spark, sf_dir)))


@query("WITH t AS (SELECT DISTINCT n_name AS type, r_name AS project FROM nation JOIN region ON r_regionkey = n_regionkey), r AS (SELECT DISTINCT 'c' || s_suppkey AS config, s_name AS project, 'Own.' || n_name AS type_name, n_name AS type FROM supplier JOIN nation ON n_nationkey = s_nationkey) " + _edge_sql("SELECT r.project AS source, t.project AS target, config || ':' || type_name AS proof FROM r JOIN t USING (type)", "config_di"))
def config_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    types = nation.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("type"), F.col("r_name").alias("project"))
    refs = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "s_suppkey").alias("config"), F.col("s_name").alias("project"), F.concat(F.lit("Own."), "n_name").alias("type_name"))
    return _edge_rows(B.config_edges(refs, types))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Modules refer to the supplier's first project file by a relative path; those of suppliers with a negative balance are missing."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    refs = lines.select(F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("src/parts/P"), "l_partkey").alias("directory"), F.concat(F.lit("..\\..\\./suppliers\\S"), "l_suppkey", F.lit(".proj")).alias("include"))
    projects = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.concat(F.lit("src/suppliers/S"), "s_suppkey", F.lit(".proj")).alias("path"))
    return refs, projects


@query("SELECT DISTINCT 'P' || l_partkey AS source, 'S' || l_suppkey AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0")
def project_ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reference_edges(*_references(spark, sf_dir)).select("source", "target")


@query("SELECT DISTINCT 'P' || l_partkey AS source, '..\\..\\./suppliers\\S' || l_suppkey || '.proj' AS include FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0 WHERE s_suppkey IS NULL")
def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unresolved_references(*_references(spark, sf_dir))


@query(f"WITH {PART_NODES} SELECT name, array_to_string(solutions, '; ') AS solutions FROM nodes")
def node_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_nodes(spark, sf_dir).select("name", F.array_join("solutions", "; ").alias("solutions"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    name = F.concat(F.lit("[Dbo].[P"), F.col("p_partkey"), F.lit("]"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.concat(F.lit("DBO . P"), "l_partkey").alias("name"), F.concat(F.lit("S"), "l_suppkey").alias("project"))
    others = table(spark, sf_dir, "supplier").select(F.concat(F.lit("ext.Q"), "s_suppkey").alias("name"), F.col("s_name").alias("project"))
    return B.procedure_catalog(parts.select(name.alias("name"), F.col("p_brand").alias("project")), lines.unionByName(others))


_CATALOG = """d AS (SELECT 'dbo.P' || p_partkey AS procedure, count(*) AS definition_count FROM part GROUP BY 1),
r AS (SELECT procedure, count(*) AS reference_count, count(DISTINCT project) AS k FROM (SELECT 'dbo.P' || l_partkey AS procedure, 'S' || l_suppkey AS project FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'ext.Q' || s_suppkey, s_name FROM supplier) GROUP BY 1),
catalog AS (SELECT coalesce(d.procedure, r.procedure) AS procedure, CASE WHEN reference_count IS NULL THEN 'defined_only' WHEN definition_count IS NULL THEN 'referenced_only' ELSE 'defined_and_referenced' END AS status,
  coalesce(definition_count, 0) AS definition_count, coalesce(reference_count, 0) AS reference_count, coalesce(k, 0) >= 2 AS shared FROM d FULL JOIN r ON d.procedure = r.procedure)"""


@query(f"WITH {_CATALOG} SELECT * FROM catalog")
def procedure_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)


@query(f"""WITH {_CATALOG} SELECT count(*) AS n, count(*) FILTER (status = 'defined_only') AS defined_only, count(*) FILTER (status = 'referenced_only') AS referenced_only, count(*) FILTER (shared) AS shared,
round(count(*) FILTER (status = 'defined_and_referenced') * 100.0 / count(*) FILTER (status <> 'defined_only'), 1)::DOUBLE AS coverage FROM catalog""")
def catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catalog_summary(_catalog(spark, sf_dir))


@query("SELECT source AS project, count(*) AS n_files FROM documents WHERE regexp_matches(text, '(?i)license') GROUP BY 1")
def proc_reference_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.col("text").rlike("(?i)license")).groupBy("project").agg(F.count("*").alias("n_files"))


def _funnel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sources depend on languages; a language is asked for by a word of namespace, class and method."""
    docs = table(spark, sf_dir, "documents")
    edges = docs.select(F.col("source"), F.col("lang").alias("target")).distinct().select("source", "target", F.lit("project_reference").alias("edge_type"))
    words = {"en": ("the", "License", None), "fr": ("les", "License", "MIT"), "de": ("nowhere", None, None), "es": ("de", None, None)}
    rows = F.array(*(F.struct(F.lit(k).alias("target"), *(F.lit(v).cast("string").alias(n) for n, v in zip(("namespace", "class_name", "method_name"), w, strict=True))) for k, w in words.items()))
    targets = spark.range(1).select(F.inline(rows))
    return cut(K.funnel(edges, files(spark, sf_dir), targets, ("src*7",)), "funnel"), targets


_FUNNEL = """t(target, ns, cl, me) AS (VALUES ('en', 'the', 'License', NULL), ('fr', 'les', 'License', 'MIT'), ('de', 'nowhere', NULL, NULL), ('es', 'de', NULL, NULL)),
e AS (SELECT DISTINCT source AS consumer, lang AS target FROM documents),
f AS (SELECT target, e.consumer, path, regexp_matches(e.consumer, '^src.*7$') AS test, ' ' || regexp_replace(text, '[^A-Za-z0-9_.]+', ' ', 'g') || ' ' AS w, ns, cl, me FROM e JOIN t USING (target) JOIN files ON project = e.consumer),
g AS (SELECT target, consumer, path, CASE WHEN test THEN 1 WHEN NOT contains(w, ' ' || ns || ' ') THEN 2 WHEN cl IS NOT NULL AND NOT contains(w, ' ' || cl || ' ') THEN 3 WHEN me IS NOT NULL AND NOT contains(w, ' ' || me || ' ') THEN 4 ELSE 5 END AS passed FROM f)"""


@query(f"""WITH {FILES}, {_FUNNEL}, b AS (SELECT target, consumer, max(passed) AS p FROM g GROUP BY 1, 2)
SELECT target, stage, CAST(i AS BIGINT) AS place, count(*) FILTER (p > i) AS consumers FROM b, (VALUES ('project_reference', 0), ('not_test', 1), ('namespace', 2), ('class', 3), ('method', 4)) AS v(stage, i) GROUP BY 1, 2, 3""")
def consumer_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.funnel_counts(_funnel(spark, sf_dir)[0])


@query(f"""WITH {FILES}, {_FUNNEL} SELECT target, consumer, count(*) AS n_files FROM g WHERE passed = 5 GROUP BY 1, 2
UNION ALL SELECT DISTINCT target, consumer, 0 FROM g WHERE passed >= 2 AND target IN (SELECT target FROM t WHERE cl IS NULL) AND target NOT IN (SELECT target FROM g WHERE passed >= 3)""")
def consumer_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.relevant(*_funnel(spark, sf_dir))


@query(f"WITH {MODULE_EDGES} SELECT DISTINCT target, source AS consumer FROM edges WHERE edge_type = 'project_reference'")
def direct_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.direct_consumers(module_edges(spark, sf_dir))


@query(f"WITH {PART_EDGES}, {PART_NODES} SELECT source AS consumer, array_to_string(solutions, '; ') AS solutions FROM (SELECT DISTINCT source FROM edges WHERE target = 'P7' AND edge_type = 'project_reference') JOIN nodes ON name = source")
def target_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = K.direct_consumers(part_edges(spark, sf_dir)).where("target = 'P7'")
    return K.consumer_rows(direct, part_nodes(spark, sf_dir)).select("consumer", "solutions")


@query(f"""WITH {PART_EDGES}, {PART_NODES}, m AS (SELECT 'P' || p_partkey AS consumer, p_brand AS pipeline FROM part WHERE p_size > 25)
SELECT DISTINCT target, e.source AS consumer, array_to_string(solutions, '; ') AS solutions, pipeline FROM edges e JOIN nodes ON name = e.source LEFT JOIN m ON m.consumer = e.source WHERE edge_type = 'project_reference'""")
def consumer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipelines = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("P"), "p_partkey").alias("key"), F.col("p_brand").alias("value"))
    return K.consumer_rows(K.direct_consumers(part_edges(spark, sf_dir)), part_nodes(spark, sf_dir), pipelines).drop("consumer_path")


@query(f"WITH {FILES}, {TYPES} SELECT DISTINCT type, t.project, f.project AS consumer FROM types t JOIN (SELECT project, unnest({_IDS}) AS type FROM files) f USING (type)")
def changed_type_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = B.file_facts(files(spark, sf_dir)).select(F.explode("identifiers").alias("type"), F.col("project").alias("consumer")).distinct()
    return K.changed_type_consumers(benchmark_types(spark, sf_dir), uses)


@query(f"WITH {PART_NODES} SELECT import_path, count(*) AS n_projects, md5(string_agg(name, ',' ORDER BY name)) AS projects FROM nodes WHERE import_path LIKE 'build/Brand_2%' GROUP BY 1")
def import_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "part").where("p_brand LIKE 'Brand#2%'").select(F.concat(F.lit("build/"), F.regexp_replace("p_brand", "#", "_"), F.lit(".props")).alias("import_path")).distinct()
    return K.import_impacts(changed, part_nodes(spark, sf_dir)).withColumn("projects", F.md5(F.array_join("projects", ",")))


@query("""WITH r AS (SELECT DISTINCT 'part' || l_partkey AS procedure, n_name AS project, p_type AS class_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT DISTINCT p_type AS class_name, p_brand AS consumer FROM part) SELECT procedure, project, class_name, consumer FROM r JOIN u USING (class_name)""")
def procedure_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("procedure"), F.col("p_type").alias("class_name"), "p_brand")
    refs = nation_uses(spark, sf_dir).withColumnRenamed("object", "procedure").join(types, "procedure")
    return K.procedure_consumers(refs, types.select("class_name", F.col("p_brand").alias("consumer")))
