"""Scans of source trees: file inventory, project and solution files, SQL definitions, reports, configuration, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.mapping import clean_mapping

SCANNED = ("cs", "csproj", "sln", "sql", "rdl", "config", "props", "targets")
SKIPPED = ("bin", "obj", "node_modules", "packages")
SIZE_LIMIT = 1 << 20
PROJECT_KINDS = ("FAE04EC0-301F-11D3-BF4B-00C04F79EFBC", "9A19103F-16F7-4668-BE54-9A1E7A4F7556")
_DEFINES = r"(?i)\b(?:create(?:\s+or\s+alter)?|alter)\s+proc(?:edure)?\s+((?:\[?\w+\]?\s*\.\s*)?\[?\w+\]?)"
_ASSEMBLY_TYPE = r"\b((?:[A-Z]\w*\.)+[A-Z]\w*)\s*,\s*[A-Z][\w.]*"


def skipped_directories(globs: list[str]) -> list[str]:
    """Directory names of globs like */bin/*; those with a path in the name are left out."""
    names = [g.strip("*").strip("/") for g in globs]
    return [n for n in names if n and "/" not in n and "*" not in n]


def inventory(spark: SparkSession, root: str, extensions: tuple[str, ...] = SCANNED, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, extension, size, modified) of the files below root; dot directories and skipped ones are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root).select("path", "length", "modificationTime")
    return _kept(found, F.col("path"), skip).select("path", F.substring_index("path", ".", -1).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _kept(df: DataFrame, path: Column, skip: tuple[str, ...]) -> DataFrame:
    out = df.where(~path.rlike(r"/\.[^/]+/"))
    return out.where(~path.rlike("/(" + "|".join(skip) + ")/")) if skip else out


def read_text(spark: SparkSession, root: str, extension: str, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, text) of whole files of one extension."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{extension}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _kept(found, F.col("path"), skip)


def _attribute(element: str, name: str) -> Column:
    return F.regexp_extract_all("text", F.lit(rf"<{element}\b[^>]*?\b{name}\s*=\s*\"([^\"]*)\""))


def _element(name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract("text", rf"(?s)<{name}\b[^>]*>([^<]*)</{name}\s*>", 1)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def scan_projects(texts: DataFrame) -> DataFrame:
    """(path, name, directory, namespace, framework, project_style, output_type, references, imports) of project files.

    Elements are matched by local name whatever their XML namespace. A file that is no project XML is left out.
    """
    own = texts.where(F.col("text").rlike(r"(?s)<Project\b.*</Project\s*>"))
    namespace = F.coalesce(_element("RootNamespace"), _element("AssemblyName"), stem(F.col("path")))
    imports = F.filter(_attribute("Import", "Project"), lambda x: ~F.contains(F.replace(x, F.lit("$(MSBuildThisFileDirectory)"), F.lit("")), F.lit("$(")))
    return own.select(
        "path",
        stem(F.col("path")).alias("name"),
        directory(F.col("path")).alias("directory"),
        namespace.alias("namespace"),
        F.coalesce(_element("TargetFramework"), _element("TargetFrameworkVersion")).alias("framework"),
        F.when(F.col("text").rlike(r"<Project\b[^>]*\bSdk\s*="), "sdk").otherwise("framework").alias("project_style"),
        _element("OutputType").alias("output_type"),
        _attribute("ProjectReference", "Include").alias("references"),
        F.transform(imports, lambda x: T.normalize_path(F.concat_ws("/", directory(F.col("path")), F.replace(x, F.lit("$(MSBuildThisFileDirectory)"), F.lit(""))))).alias("imports"),
    )


def scan_solutions(texts: DataFrame) -> DataFrame:
    """(solution, project_path) of solution files; unknown project kinds are left out, each path once."""
    line = r'(?m)^Project\("\{([0-9A-Fa-f-]+)\}"\)\s*=\s*"[^"]*"\s*,\s*"([^"]*)"'
    own = texts.where(F.contains("text", F.lit("Microsoft Visual Studio Solution File")))
    rows = F.arrays_zip(F.regexp_extract_all("text", F.lit(line), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(line), F.lit(2)).alias("path"))
    each = own.select(stem(F.col("path")).alias("solution"), directory(F.col("path")).alias("directory"), F.explode(rows).alias("x"))
    each = each.where(F.upper("x.kind").isin(*PROJECT_KINDS))
    return each.select("solution", T.normalize_path(F.concat_ws("/", "directory", "x.path")).alias("project_path")).distinct()


def solutions_of(solutions: DataFrame) -> DataFrame:
    """(project, solutions, collides): the solutions of each project stem, and whether one stem has several paths."""
    own = solutions.select(stem(F.col("project_path")).alias("project"), "solution", "project_path")
    return own.groupBy("project").agg(F.array_sort(F.collect_set("solution")).alias("solutions"), (F.count_distinct("project_path") > 1).alias("collides"))


def definitions(texts: DataFrame, strip: bool = False) -> DataFrame:
    """(path, name, line) of procedure definitions in files up to the size limit; strip leaves out comments first."""
    own = texts.where(F.octet_length("text") <= SIZE_LIMIT).select("path", (T.strip_comments(F.col("text")) if strip else F.col("text")).alias("text"))
    pieces = F.split("text", _DEFINES)
    rows = own.select("path", F.regexp_extract_all("text", F.lit(_DEFINES)).alias("names"), pieces.alias("pieces"), F.regexp_extract_all("text", F.lit(_DEFINES), F.lit(0)).alias("whole"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    before = lambda i: F.aggregate(F.slice("pieces", F.lit(1), i + 1), F.lit(0), lambda a, x: a + breaks(x)) + F.aggregate(F.slice("whole", F.lit(1), i), F.lit(0), lambda a, x: a + breaks(x))
    each = F.transform("names", lambda n, i: F.struct(n.alias("name"), (before(i) + 1).cast("long").alias("line")))
    return rows.select("path", F.explode(each).alias("x")).select("path", T.normalize_procedure(F.col("x.name")).alias("name"), F.col("x.line").alias("line"))


def migrations(texts: DataFrame) -> DataFrame:
    """Source files that are schema migrations by path or name."""
    return texts.where(F.col("path").rlike(r"/[Mm]igrations/") | F.substring_index("path", "/", -1).contains("Migration"))


def report_references(texts: DataFrame) -> DataFrame:
    """(path, name): the first command text of each data set of a report, once a file."""
    own = texts.where(F.octet_length("text") <= SIZE_LIMIT)
    sets = own.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?DataSet\b(.*?)</(?:\w+:)?DataSet>"))).alias("s"))
    name = F.trim(F.regexp_extract("s", r"(?s)<(?:\w+:)?CommandText\b[^>]*>([^<]*)<", 1))
    return sets.select("path", name.alias("name")).where("name <> ''").distinct()


def config_references(texts: DataFrame) -> DataFrame:
    """(path, type_name): assembly-qualified type names in a configuration file, once a file."""
    own = texts.where(F.octet_length("text") <= SIZE_LIMIT)
    return own.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_ASSEMBLY_TYPE)))).alias("type_name"))


def db_dependencies(files: DataFrame) -> DataFrame:
    """(path, project, kind, object) by five detectors over comment-stripped text (path, project, text)."""
    t = T.strip_comments(F.coalesce(F.col("text"), F.lit("")))
    own = files.select("path", "project", t.alias("t"))
    verbs = r"(?i)\b(?:from|join|into|update)\s+\[?(?:dbo\]?\.)?\[?([A-Za-z_]\w+)"
    noise = ("select", "where", "set", "values", "the", "a", "an", "order", "group", "as", "on")
    found = F.array(
        F.struct(F.lit("sproc").alias("kind"), T.procedure_names(F.col("t")).alias("objects")),
        F.struct(F.lit("ef_model").alias("kind"), F.regexp_extract_all("t", F.lit(r"\bDbSet<\s*(\w+)\s*>")).alias("objects")),
        F.struct(F.lit("ef_context").alias("kind"), F.regexp_extract_all("t", F.lit(r"\bclass\s+(\w+)\s*:[^{]*\bDbContext\b")).alias("objects")),
        F.struct(F.lit("sql_table").alias("kind"), F.filter(F.regexp_extract_all("t", F.lit(verbs)), lambda x: ~F.lower(x).isin(*noise)).alias("objects")),
        F.struct(F.lit("connection_string").alias("kind"), F.regexp_extract_all("t", F.lit(r"(?i)\"([^\"]*(?:data source|initial catalog)\s*=[^\"]*)\"")).alias("objects")),
    )
    each = own.select("path", "project", F.inline(found)).select("path", "project", "kind", F.explode("objects").alias("object"))
    return each.distinct()


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a CSV mapping with columns Application,Pipeline or AppName,PipelineName; the last row wins."""
    rows = spark.read.csv(path, header=True).withColumn("place", F.monotonically_increasing_id())
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    for a, b in (("application", "pipeline"), ("appname", "pipelinename")):
        if a in names and b in names:
            return clean_mapping(rows, names[a], names[b], "place")
    raise ValueError(f"no known columns: {rows.columns}")


def batch_jobs(paths: DataFrame, pipeline: str) -> DataFrame:
    """(pipeline, jobs): job directories of a pipeline from listed paths .../<pipeline>/<environment>/<job>/..."""
    job = F.regexp_extract("path", rf"/{pipeline}/[^/]+/([^/]+)/", 1)
    return paths.select(job.alias("job")).where("job <> ''").agg(F.array_sort(F.collect_set("job")).alias("jobs")).select(F.lit(pipeline).alias("pipeline"), "jobs")


def save_snapshot(tables: dict[str, DataFrame], path: str, meta: dict) -> None:
    """Writes tables, then the one-row meta table; a snapshot without meta is no snapshot."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True), ",".join(sorted(tables)))], "meta string, tables string").write.mode("overwrite").parquet(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str, expect: dict | None = None) -> dict[str, DataFrame] | None:
    """The tables of a snapshot; None if it is missing, unreadable, or its meta differs from what is expected."""
    try:
        meta, names = spark.read.parquet(f"{path}/meta").first()
    except Exception as e:  # noqa: BLE001  any broken snapshot is as good as none
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "CANNOT_READ_FILE" in str(e) or "FAILED_READ_FILE" in str(e):
            return None
        raise
    if expect and any(json.loads(meta).get(k) != v for k, v in expect.items()):
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names.split(",")}
