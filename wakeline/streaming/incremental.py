"""Change-driven maintenance of a graph: facts are merged by content hash and only affected edges are made again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import builders as B
from ..operators.components import cut
from ..schemas import NAMESPACE, REFERENCE, SHARED, TYPE

MOST_PROJECTS, MOST_SHARE = 50, 0.3
#: Kinds of edges that follow from file facts.
FACT_EDGES = ("namespace_usage", "type_usage", "sproc_shared")


def classify(old: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, status) of changed facts: new, same (equal hash), usage (declarations unchanged), declaration or deleted.

    changed holds new facts; a row without a hash is a deletion.
    """
    o = old.select("path", F.col("content_hash").alias("oh"), F.array_sort("types").alias("ot"))
    n = changed.select("path", F.col("content_hash").alias("nh"), F.array_sort("types").alias("nt"))
    both = n.join(o, "path", "left")
    status = F.when(F.col("nh").isNull(), "deleted").when(F.col("oh").isNull(), "new").when(F.col("nh") == F.col("oh"), "same").when(F.col("nt") == F.col("ot"), "usage").otherwise("declaration")
    return both.select("path", status.alias("status"))


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, old_path) of two snapshots (path, content_hash): added, modified, deleted, or renamed from old_path.

    A path that went and one that came with the same content are a rename; where several have the same content they are
    paired in order of path, and what is left over is deleted or added.
    """
    both = before.select("path", F.col("content_hash").alias("old")).join(after.select("path", F.col("content_hash").alias("new")), "path", "full_outer")
    both = cut(both.where("old is null or new is null or old <> new"), "changes")
    order = W.partitionBy("hash").orderBy("path")
    gone, came = (both.where(f"{x} is null").select("path", F.col(y).alias("hash")).withColumn("place", F.row_number().over(order)) for x, y in (("new", "old"), ("old", "new")))
    moved = came.join(gone.select("hash", "place", F.col("path").alias("old_path")), ["hash", "place"], "full_outer")
    moved = moved.select(F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNull(), "deleted").when(F.col("old_path").isNull(), "added").otherwise("renamed").alias("status"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"))
    return moved.union(both.where("old is not null and new is not null").select("path", F.lit("modified"), F.lit(None).cast("string")))


def merge_facts(old: DataFrame, changed: DataFrame) -> DataFrame:
    """old facts with changed ones in their place; idempotent, keyed by path."""
    return old.join(changed.select("path"), "path", "left_anti").unionByName(changed.where("content_hash is not null"))


def needs_rebuild(old: DataFrame, statuses: DataFrame, owners: DataFrame) -> bool:
    """Whether so much changed that a patch doesn't pay."""
    moved = statuses.where("status <> 'same'").join(owners.select("path", "project"), "path", "left")
    files, projects = moved.agg(F.count("*"), F.count_distinct("project")).first()
    return projects > MOST_PROJECTS or files > MOST_SHARE * old.count()


def fact_edges(facts: DataFrame) -> DataFrame:
    """Edges that follow from facts: type usage over all projects, shared procedures."""
    types = facts.select(F.explode("types").alias("type"), "project").distinct()
    objects = facts.select("project", F.explode("procedures").alias("object"))
    return B.type_edges_full(facts, types).unionByName(B.shared_object_edges(objects))


def patch_type_edges(edges: DataFrame, old: DataFrame, changed: DataFrame) -> DataFrame:
    """Type-usage edges after a change: those of affected projects are made anew, others are kept.

    Affected are the projects of changed files and, where declared types change, all projects that use one of the types
    that came or went or were declared by a changed file.
    """
    new = cut(merge_facts(old, changed), "facts")
    before = old.join(changed.select("path"), "path", "left_semi")
    touched = before.select("project").union(changed.where("project is not null").select("project")).distinct()
    moved = before.select(F.explode("types").alias("type")).union(changed.where("content_hash is not null").select(F.explode("types").alias("type"))).distinct()
    users = old.unionByName(new).select("project", F.explode("identifiers").alias("type")).join(moved, "type", "left_semi").select("project").distinct()
    affected = cut(touched.union(users).distinct(), "affected")
    types = new.select(F.explode("types").alias("type"), "project").distinct()
    fresh = B.type_edges_full(new.join(affected, "project", "left_semi"), types)
    return edges.join(affected.select(F.col("project").alias("source")), "source", "left_anti").select(*fresh.columns).unionByName(fresh)


def full_graph(facts: DataFrame, projects: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) made anew from file facts, projects (name, path, namespace) and references (source, directory, include).

    Edges of projects that aren't there are left out.
    """
    own = facts.join(projects.select(F.col("name").alias("project")), "project", "left_semi")
    types = own.select(F.explode("types").alias("type"), "project").distinct()
    edges = B.namespace_edges(own, _namespaces(projects)).unionByName(B.type_edges_full(own, types))
    edges = edges.unionByName(B.shared_object_edges(own.select("project", F.explode("procedures").alias("object"))))
    return B.nodes_from_facts(projects, own), edges.unionByName(_references(references, projects))


def _namespaces(projects: DataFrame) -> DataFrame:
    return projects.where("namespace is not null").select("namespace", F.col("name").alias("project"))


def _references(references: DataFrame, projects: DataFrame) -> DataFrame:
    known = references.join(projects.select(F.col("name").alias("source")), "source", "left_semi")
    return B.reference_edges(known, projects).where("source <> target")


def patch_graph(nodes: DataFrame, edges: DataFrame, old: DataFrame, changed: DataFrame, old_projects: DataFrame, projects: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a change, as full_graph() would give them.

    old are the facts before and changed the rows in place of theirs; projects and references are the tables after the
    change. Touched are the projects of changed files and those that came, went or changed. Made anew are the edges that
    start at touched projects; namespace edges of users of a namespace whose owner changed; type edges of users of a type
    that came or went; shared-object edges with a touched end; and the metadata of touched nodes. Reference edges come from project files, far
    fewer than facts, and are made anew where a project changed or its references did.
    """
    new = cut(merge_facts(old, changed).join(projects.select(F.col("name").alias("project")), "project", "left_semi"), "facts")
    old = cut(old, "facts")
    columns = ["name", "path", "namespace"]
    moved = cut(projects.select(columns).exceptAll(old_projects.select(columns)).union(old_projects.select(columns).exceptAll(projects.select(columns))).select("name").distinct(), "moved")
    before = old.join(changed.select("path"), "path", "left_semi")
    touched = cut(before.select("project").union(changed.where("project is not null").select("project")).union(moved.select(F.col("name").alias("project"))).distinct(), "touched")

    def owners(p: DataFrame) -> DataFrame:
        return _namespaces(p).groupBy("namespace").agg(F.max("project").alias("project"))

    spaces = owners(projects).exceptAll(owners(old_projects)).union(owners(old_projects).exceptAll(owners(projects))).select("namespace").distinct()
    both = old.select("project", "namespaces", "identifiers").union(new.select("project", "namespaces", "identifiers"))
    importers = both.select("project", F.explode("namespaces").alias("namespace")).join(spaces, "namespace", "left_semi").select("project").distinct()

    def declared(f: DataFrame) -> DataFrame:
        return f.select(F.explode("types").alias("type"), "project").distinct()

    types = declared(new).exceptAll(declared(old)).union(declared(old).exceptAll(declared(new))).select("type").distinct()
    users = both.select("project", F.explode("identifiers").alias("type")).join(types, "type", "left_semi").select("project").distinct()
    fresh = {
        NAMESPACE: (cut(touched.union(importers).distinct(), "affected"), lambda p: B.namespace_edges(new.join(p, "project", "left_semi"), _namespaces(projects))),
        TYPE: (cut(touched.union(users).distinct(), "affected"), lambda p: B.type_edges_full(new.join(p, "project", "left_semi"), declared(new))),
    }
    kept = edges.where(~F.col("edge_type").isin(NAMESPACE, TYPE, SHARED, REFERENCE))
    for kind, (affected, make) in fresh.items():
        rest = edges.where(F.col("edge_type") == kind).join(affected.select(F.col("project").alias("source")), "source", "left_anti")
        kept = kept.unionByName(rest.select(edges.columns)).unionByName(make(affected).select(edges.columns))
    # what touched projects share now, and with whom: objects of touched projects only
    uses = new.select("project", F.explode("procedures").alias("object")).distinct()
    near = uses.join(uses.join(touched, "project", "left_semi").select("object").distinct(), "object", "left_semi")
    shared = B.shared_object_edges(near)
    ends = [touched.select(F.col("project").alias(c), F.lit(True).alias(f"__{c}")) for c in ("source", "target")]

    def at(rows: DataFrame, is_touched: bool) -> DataFrame:
        any_end = F.coalesce("__source", F.lit(False)) | F.coalesce("__target", F.lit(False))
        return rows.join(ends[0], "source", "left").join(ends[1], "target", "left").where(any_end == is_touched).select(edges.columns)

    kept = kept.unionByName(at(edges.where(F.col("edge_type") == SHARED), False)).unionByName(at(shared, True))
    kept = kept.unionByName(_references(references, projects).select(edges.columns))
    made = B.nodes_from_facts(projects.join(touched.select(F.col("project").alias("name")), "name", "left_semi"), new.join(touched, "project", "left_semi"))
    stay = nodes.join(touched.select(F.col("project").alias("name")), "name", "left_anti").join(projects.select("name"), "name", "left_semi")
    return stay.select(made.columns).unionByName(made), kept


def follow(spark: SparkSession, feed: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream that merges each micro-batch of facts into a table: read() gives the current facts, write(facts,
    batch) stores the next version. A batch that is replayed gives the same facts."""

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("path", "version")]), "version").alias("x")).select("path", "x.*")
        write(merge_facts(read(), latest), number)

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def is_fresh(modified: DataFrame, stored_at) -> bool:
    """Whether no file (modified) is newer than a stored snapshot."""
    newest = modified.agg(F.max("modified")).first()[0]
    return newest is None or newest <= stored_at
