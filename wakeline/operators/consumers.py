"""Who consumes a component: the funnel of narrowing filters, consumer rows, and consumers of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import REFERENCE
from .components import cut

#: Up to so many pairs of targets and consumers are sent to the files of all consumers.
MOST_BROADCAST, SHARES = 100_000, 64
STAGES = ("project_reference", "not_test", "namespace", "class", "method")


def funnel(edges: DataFrame, files: DataFrame, targets: DataFrame, globs: tuple[str, ...] = T.TEST_GLOBS) -> DataFrame:
    """(target, consumer, path, passed): the last stage that each file of each direct consumer passes.

    targets is (target, namespace, class_name, method_name); a null class or method skips its stage, a null namespace
    skips the namespace stage. Each stage only sees files that passed the one before. All targets go at once.
    """
    direct = edges.where((F.col("edge_type") == REFERENCE) & (F.col("source") != F.col("target"))).select("target", F.col("source").alias("consumer")).distinct().join(targets, "target")
    direct = cut(direct, "direct")
    # files are dealt to tasks by path, as neither the projects nor the parts of a table are of even size; few pairs are
    # sent to all files, and of many each goes to SHARES shares of its project's files
    words = F.concat(F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9_.]+", " "), F.lit(" "))
    own = files.repartition("path").select(F.col("project").alias("consumer"), "path", words.alias("__words"), F.pmod(F.xxhash64("path"), F.lit(SHARES)).alias("__share"))
    if direct.count() <= MOST_BROADCAST:
        met = own.drop("__share").join(F.broadcast(direct), "consumer")
    else:
        met = own.join(direct.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long")))), ["consumer", "__share"]).drop("__share")
    lone = direct.join(files.select(F.col("project").alias("consumer")).distinct(), "consumer", "left_anti")
    rows = met.unionByName(lone.withColumns({"path": F.lit(None).cast(met.schema["path"].dataType), "__words": F.lit("  ")}))

    def named(name: str) -> Column:
        """Whole-word test without building a pattern for each row."""
        return F.col(name).isNull() | F.contains(F.col("__words"), F.concat(F.lit(" "), F.col(name), F.lit(" ")))

    tests = T.matches_glob(F.col("consumer"), globs)
    ok = [F.lit(True), ~tests, named("namespace"), named("class_name"), named("method_name")]
    passed = F.lit(1)
    for i in range(1, len(STAGES)):
        passed = F.when((passed == i) & ok[i], i + 1).otherwise(passed)
    return rows.select("target", "consumer", "path", passed.alias("passed"))


def funnel_counts(rows: DataFrame) -> DataFrame:
    """(target, stage, place, consumers): distinct consumers that reach each stage, in one pass over the funnel."""
    best = rows.groupBy("target", "consumer").agg(F.max("passed").alias("passed"))
    wide = best.groupBy("target").agg(*(F.count_if(F.col("passed") >= i + 1).alias(s) for i, s in enumerate(STAGES)))
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(i).alias("place"), F.col(s).alias("consumers")) for i, s in enumerate(STAGES))))
    return wide.select("target", each.alias("x")).select("target", "x.stage", F.col("x.place").cast("long").alias("place"), F.col("x.consumers").alias("consumers"))


def relevant(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, consumer, n_files): consumers left at the end.

    Where the namespace stage leaves nobody and no class is asked for, all direct non-test consumers stay, without files.
    """
    left = rows.where(F.col("passed") == len(STAGES)).groupBy("target", "consumer").agg(F.count("path").alias("n_files"))
    none = targets.where("class_name is null").select("target").join(rows.where("passed >= 3").select("target").distinct(), "target", "left_anti")
    fallback = rows.where("passed >= 2").select("target", "consumer").distinct().join(none, "target", "left_semi").withColumn("n_files", F.lit(0).cast("long"))
    return left.unionByName(fallback)


def direct_consumers(edges: DataFrame) -> DataFrame:
    """(target, consumer) over reference edges, each once."""
    return edges.where((F.col("edge_type") == REFERENCE) & (F.col("source") != F.col("target"))).select("target", F.col("source").alias("consumer")).distinct()


def changed_type_consumers(changed: DataFrame, uses: DataFrame) -> DataFrame:
    """(type, project, consumer): changed is (type, project); uses is (type, consumer)."""
    return changed.join(uses, "type").where("project <> consumer").select("type", "project", "consumer").distinct()


def import_impacts(changed_paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_path, n_projects, projects) for changed build files (import_path)."""
    index = nodes.select(F.explode("imports").alias("import_path"), "name").distinct()
    own = changed_paths.join(index, "import_path").groupBy("import_path").agg(F.array_sort(F.collect_list("name")).alias("projects"))
    return own.select("import_path", F.size("projects").cast("long").alias("n_projects"), "projects")


def procedure_consumers(references: DataFrame, type_uses: DataFrame) -> DataFrame:
    """(procedure, project, class_name, consumer): references are (procedure, project, class_name) that call a procedure,
    type_uses (class_name, consumer) the projects that use these classes."""
    own = references.select("procedure", "project", "class_name").distinct()
    return own.join(type_uses.distinct(), "class_name").where("project <> consumer").select("procedure", "project", "class_name", "consumer")


def consumer_rows(pairs: DataFrame, nodes: DataFrame, pipelines: DataFrame | None = None) -> DataFrame:
    """(target, consumer, consumer_path, solutions, pipeline) for (target, consumer) pairs."""
    own = nodes.select(F.col("name").alias("consumer"), F.col("path").alias("consumer_path"), F.array_join("solutions", "; ").alias("solutions"))
    out = pairs.join(own, "consumer", "left")
    if pipelines is None:
        return out.withColumn("pipeline", F.lit(None).cast("string"))
    return out.join(pipelines.select(F.col("key").alias("consumer"), F.col("value").alias("pipeline")), "consumer", "left").select("target", "consumer", "consumer_path", "solutions", "pipeline")


def funnel_text(counts: list[tuple[str, int]]) -> str:
    """N -> M stage -> ..., for a report's footer."""
    return " → ".join(f"{n} {s}" for s, n in counts)
