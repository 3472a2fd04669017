"""Facts of source files, and the edges that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.internal import InternalFunction

from ..functions import text as T
from .components import cut
from ..schemas import CONFIG, EVIDENCE_CAP, NAMESPACE, REFERENCE, REPORT, SHARED, TYPE


def file_facts(files: DataFrame) -> DataFrame:
    """(path, project, identifiers, types, namespaces, procedures, content_hash) of files (path, project, text), in one pass."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return files.select("path", "project", T.identifiers(t).alias("identifiers"), T.declared_types(t).alias("types"), T.imported_namespaces(t).alias("namespaces"), T.procedure_names(t).alias("procedures"), F.sha2(t, 256).alias("content_hash"))


def nearest_owner(paths: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the owner of the nearest directory above each path; owners are (directory, owner).

    Ancestors are spelled out and met by an equi-join; paths without an owner are left out, the greatest owner wins
    where a directory has several.
    """
    up = paths.select("path", F.explode(T.ancestors(F.col("path"))).alias("directory"))
    dims = owners.groupBy("directory").agg(F.max("owner").alias("owner"))
    return up.join(dims, "directory").groupBy("path").agg(F.max_by("owner", F.length("directory")).alias("owner"))


def ancestor_chain(paths: DataFrame, props: DataFrame, most: int = 10) -> DataFrame:
    """(path, directory, place): build files that apply to a path, nearest first, as long as each one chains upward.

    props is (directory, chains).
    """
    up = paths.select("path", F.explode(T.ancestors(F.col("path"))).alias("directory")).join(props, "directory")
    found = up.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.length("directory")).alias("k"), "directory", "chains"))).alias("all"))
    stop = F.array_min(F.transform(F.sequence(F.lit(1), F.size("all")), lambda i: F.when(~F.get("all", i - 1)["chains"], i).otherwise(F.size("all"))))
    return found.select("path", F.posexplode(F.slice("all", F.lit(1), F.least(stop, F.lit(most)))).alias("place", "x")).select("path", F.col("x.directory").alias("directory"), F.col("place").cast("long").alias("place"))


def _edges(hits: DataFrame, kind: str) -> DataFrame:
    """Edges of a kind from (source, target, proof); weight is the number of distinct proofs, self edges are dropped."""
    return _of_distinct(hits.select("source", "target", "proof").where("source <> target").distinct(), kind)


def _of_distinct(hits: DataFrame, kind: str) -> DataFrame:
    """_edges() of hits that stand once each. Proofs are counted, and only the smallest are kept, before rows move, so
    no edge's proofs are gathered."""
    own = hits.groupBy("source", "target").agg(F.count("proof").alias("n"), InternalFunction.collect_top_k(F.col("proof"), EVIDENCE_CAP, True).alias("evidence"))
    return own.select("source", "target", F.lit(kind).alias("edge_type"), F.col("n").cast("double").alias("weight"), F.array_sort("evidence").alias("evidence"), F.col("n").alias("evidence_total"))


def reference_edges(references: DataFrame, projects: DataFrame) -> DataFrame:
    """references (source, directory, include) met with projects (name, path) by normalised path; each include is an edge."""
    placed = references.where(~F.contains("include", F.lit("$("))).select("source", "include", T.normalize_path(F.concat_ws("/", "directory", "include")).alias("path"))
    own = placed.join(projects.select(F.col("name").alias("target"), T.normalize_path(F.col("path")).alias("path")), "path")
    return own.select("source", "target", F.lit(REFERENCE).alias("edge_type"), F.lit(1.0).alias("weight"), F.array("include").alias("evidence"), F.lit(1).cast("long").alias("evidence_total"))


def unresolved_references(references: DataFrame, projects: DataFrame) -> DataFrame:
    """(source, include) that no project has."""
    placed = references.where(~F.contains("include", F.lit("$("))).select("source", "include", T.normalize_path(F.concat_ws("/", "directory", "include")).alias("path"))
    return placed.join(projects.select(T.normalize_path(F.col("path")).alias("path")), "path", "left_anti").select("source", "include")


def namespace_edges(facts: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Files that import exactly another project's namespace; namespaces is (namespace, project), the greatest wins."""
    dims = namespaces.groupBy("namespace").agg(F.max("project").alias("target"))
    hits = facts.select(F.col("project").alias("source"), F.col("path").alias("proof"), F.explode("namespaces").alias("namespace")).join(dims, "namespace")
    return _edges(hits, NAMESPACE)


def _uses(facts: DataFrame, types: DataFrame) -> DataFrame:
    dims = types.select(F.col("type").alias("identifier"), F.col("project").alias("target")).distinct()
    return facts.select(F.col("project").alias("source"), "path", F.explode("identifiers").alias("identifier")).join(dims, "identifier").where("source <> target")


def type_edges_full(facts: DataFrame, types: DataFrame) -> DataFrame:
    """Every use of a type name that another project declares; types is (type, project) with any number of owners."""
    return _edges(_uses(facts, types).select("source", "target", F.concat_ws(":", "path", "identifier").alias("proof")), TYPE)


def type_edges(facts: DataFrame, types: DataFrame, namespaces: DataFrame, reachable: DataFrame) -> DataFrame:
    """Uses of type names in scope: projects whose namespace the file imports or, only where the file imports no known
    namespace, projects that its own project reaches. reachable is (source, target). A file that imports its own
    project's namespace has a scope, so the fallback doesn't apply to it.
    """
    dims = namespaces.groupBy("namespace").agg(F.max("project").alias("target"))
    scope = facts.select("path", F.explode("namespaces").alias("namespace")).join(dims, "namespace").select("path", "target").distinct()
    uses = _uses(facts, types)
    scoped = uses.join(scope, ["path", "target"], "left_semi")
    open_files = uses.join(scope.select("path").distinct(), "path", "left_anti").join(reachable.select("source", "target").distinct(), ["source", "target"], "left_semi")
    hits = scoped.unionByName(open_files).select("source", "target", F.concat_ws(":", "path", "identifier").alias("proof"))
    return _edges(hits, TYPE)


def shared_object_edges(uses: DataFrame) -> DataFrame:
    """Two directed edges for each pair of projects that share objects; uses is (project, object).

    Objects are met by themselves, so a pair is made once for each object that it shares; the edge back is a copy.
    """
    own = uses.select("project", "object").distinct()
    pairs = own.select("object", F.col("project").alias("a")).join(own.select("object", F.col("project").alias("b")), "object").where("a < b")
    half = _of_distinct(pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("object").alias("proof")), SHARED)
    ends = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).alias("x")
    return half.select(ends, *half.columns[2:]).select("x.*", *half.columns[2:])


def report_edges(references: DataFrame, uses: DataFrame) -> DataFrame:
    """references (report, project, object) of reports to projects that use the same procedure name.

    A proof names its report up to the first colon; only where some report has a colon or no name could proofs of
    different objects be the same, and hits are then made distinct.
    """
    refs = cut(references.select("report", F.col("project").alias("source"), "object").distinct(), "references")
    hits = refs.join(uses.select("object", F.col("project").alias("target")).distinct(), "object").where("source <> target").select("source", "target", F.concat_ws(":", "report", "object").alias("proof"))
    if refs.where("report is null or contains(report, ':')").head(1):
        return _edges(hits, REPORT)
    return _of_distinct(hits, REPORT)


def config_edges(references: DataFrame, types: DataFrame) -> DataFrame:
    """references (config, project, type_name) by the last part of the dotted type name."""
    short = F.element_at(F.split("type_name", r"\."), -1)
    hits = references.select(F.col("project").alias("source"), short.alias("type"), F.concat_ws(":", "config", "type_name").alias("proof")).join(types.select("type", F.col("project").alias("target")).distinct(), "type")
    return _edges(hits, CONFIG)


def nodes_from_facts(projects: DataFrame, facts: DataFrame) -> DataFrame:
    """projects (name, path, namespace) with what their files declare and use."""
    sums = facts.groupBy(F.col("project").alias("name")).agg(
        F.count("*").alias("file_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("type_declarations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("procedures")))).alias("object_refs"),
    )
    none = F.array().cast("array<string>")
    return projects.join(sums, "name", "left").select("name", "path", "namespace", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("type_declarations", none).alias("type_declarations"), F.coalesce("object_refs", none).alias("object_refs"))


def asof(refs: DataFrame, declarations: DataFrame, keys: list[str]) -> DataFrame:
    """refs (keys, offset) with the name of the last declaration (keys, offset, name) before each: an as-of join by
    union and a running maximum, without a pair for each declaration before."""
    both = refs.select(*keys, "offset", F.lit(1).alias("is_ref"), F.lit(None).cast("string").alias("name")).unionByName(declarations.select(*keys, "offset", F.lit(0).alias("is_ref"), "name"))
    order = W.partitionBy(*keys).orderBy("offset", F.desc("is_ref")).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("enclosing", F.last("name", ignorenulls=True).over(order)).where("is_ref = 1").select(*keys, "offset", "enclosing")


def procedure_catalog(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """definitions (name, project) and references (name, project) by normalised name: status, counts, sharing."""
    norm = T.normalize_procedure(F.col("name"))
    d = definitions.select(norm.alias("procedure"), "project").groupBy("procedure").agg(F.count("*").alias("definition_count"))
    r = references.select(norm.alias("procedure"), "project").groupBy("procedure").agg(F.count("*").alias("reference_count"), F.count_distinct("project").alias("project_count"))
    out = d.join(r, "procedure", "full_outer")
    status = F.when(F.col("reference_count").isNull(), "defined_only").when(F.col("definition_count").isNull(), "referenced_only").otherwise("defined_and_referenced")
    zero = F.lit(0)
    return out.select("procedure", status.alias("status"), F.coalesce("definition_count", zero).cast("long").alias("definition_count"), F.coalesce("reference_count", zero).cast("long").alias("reference_count"), (F.coalesce("project_count", zero) >= 2).alias("shared"))


def catalog_summary(catalog: DataFrame) -> DataFrame:
    both, refs = F.count_if(F.col("status") == "defined_and_referenced"), F.count_if(F.col("status") != "defined_only")
    return catalog.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "defined_only").alias("defined_only"), F.count_if(F.col("status") == "referenced_only").alias("referenced_only"), F.count_if("shared").alias("shared"), F.round(F.when(refs > 0, both * 100.0 / refs).otherwise(0.0), 1).alias("coverage"))


def used_in_code(text: Column, name: Column) -> Column:
    """Whether a name stands outside comments and literals."""
    return F.contains(T.code_only(text), name)
