"""Queries of source-tree scans, over files generated from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import trees
from ..sources.testdata import table
from .registry import joined, query


@query("""SELECT 'P' || p_partkey AS name, CASE WHEN p_size > 25 THEN 'net8.0' ELSE 'v4.8' END AS framework, CASE WHEN p_size > 25 THEN 'sdk' ELSE 'framework' END AS project_style, p_brand AS output_type,
'..\\B' || p_brand || '.csproj,..\\C\\C.csproj' AS "references" FROM part""")
def scan_project_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as project files, new and old in style."""
    new = F.col("p_size") > 25
    head = F.when(new, '<Project Sdk="Own.Sdk">').otherwise('<Project xmlns="urn:own:build">')
    framework = F.when(new, "<TargetFramework>net8.0</TargetFramework>").otherwise("<TargetFrameworkVersion>v4.8</TargetFrameworkVersion>")
    refs = F.concat(F.lit('<ItemGroup><ProjectReference Include="..\\B'), "p_brand", F.lit('.csproj" /><ProjectReference Include="..\\C\\C.csproj"/></ItemGroup>'))
    xml = F.concat(head, F.lit("<PropertyGroup>"), framework, F.lit("<OutputType>"), "p_brand", F.lit("</OutputType></PropertyGroup>"), refs, F.lit("</Project>"))
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("src/P"), "p_partkey", F.lit(".csproj")).alias("path"), xml.alias("text"))
    return trees.scan_projects(texts).select("name", "framework", "project_style", "output_type", joined("references"))


@query("SELECT DISTINCT 'N' || s_nationkey AS solution, 'src/S' || s_suppkey || '/S' || s_suppkey || '.csproj' AS project_path FROM supplier WHERE s_acctbal >= 0")
def scan_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as solutions of their suppliers; those with a negative balance are of an unknown kind."""
    kind = F.when(F.col("s_acctbal") >= 0, trees.PROJECT_KINDS[0]).otherwise("00000000-0000-0000-0000-000000000000")
    line = F.concat(F.lit('Project("{'), F.lower(kind), F.lit('}") = "S'), F.col("s_suppkey"), F.lit('", "S'), "s_suppkey", F.lit("\\.\\S"), "s_suppkey", F.lit('.csproj", "{1}"'))
    texts = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    texts = texts.select(F.concat(F.lit("src/N"), "s_nationkey", F.lit(".sln")).alias("path"), F.concat(F.lit("Microsoft Visual Studio Solution File\n"), "body").alias("text"))
    return trees.scan_solutions(texts)


@query("SELECT 'db/' || p_partkey || '.sql' AS path, 'dbo.P' || p_partkey AS name, CAST(p_size % 4 + 1 AS BIGINT) AS line FROM part UNION ALL SELECT 'db/' || p_partkey || '.sql', 'Q' || p_partkey, p_size % 4 + 3 FROM part")
def sql_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("-- note\n"), F.col("p_size") % 4), F.lit("Create Or Alter Procedure [Dbo] . [P"), "p_partkey", F.lit("] AS\nGO\nalter proc Q"), "p_partkey", F.lit(" as"))
    return trees.definitions(table(spark, sf_dir, "part").select(F.concat(F.lit("db/"), "p_partkey", F.lit(".sql")).alias("path"), text.alias("text")))


@query("SELECT 'P' || p_partkey AS name, CAST(2 AS BIGINT) AS line FROM part WHERE p_size > 25")
def migration_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in migrations; one that stands in a comment is none, nor are those of other files."""
    text = F.concat(F.lit('// create procedure Old\nSql("create procedure P'), F.col("p_partkey"), F.lit('");'))
    path = F.concat(F.when(F.col("p_size") > 25, "src/Migrations/M").otherwise("src/Other/M"), "p_partkey", F.lit(".cs"))
    return trees.definitions(trees.migrations(table(spark, sf_dir, "part").select(path.alias("path"), text.alias("text"))), strip=True).select("name", "line")


@query("SELECT DISTINCT 'r/' || o_custkey || '.rdl' AS path, 'usp_' || o_orderpriority AS name FROM orders")
def report_proc_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports with a data set for each order."""
    one = F.concat(F.lit("<rd:DataSet Name='x'><Query><CommandText> usp_"), F.col("o_orderpriority"), F.lit(" </CommandText><CommandText>no</CommandText></Query></rd:DataSet>"))
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(one), "").alias("body"))
    return trees.report_references(texts.select(F.concat(F.lit("r/"), "o_custkey", F.lit(".rdl")).alias("path"), F.concat(F.lit("<Report>"), "body", F.lit("</Report>")).alias("text")))


@query("SELECT 'c/' || s_suppkey || '.config' AS path, 'Own.Lib.T' || s_nationkey AS type_name FROM supplier")
def config_type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('<add type="Own.Lib.T'), F.col("s_nationkey"), F.lit(', Own.Lib"/><add key="a, b"/><add type="Own.Lib.T'), "s_nationkey", F.lit(', Own.Lib"/>'))
    return trees.config_references(table(spark, sf_dir, "supplier").select(F.concat(F.lit("c/"), "s_suppkey", F.lit(".config")).alias("path"), text.alias("text")))


@query("SELECT 'batch' AS pipeline, string_agg(DISTINCT 'job' || c_nationkey, ',' ORDER BY 'job' || c_nationkey) AS jobs FROM customer WHERE c_mktsegment = 'BUILDING'")
def batch_job_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/cfg/"), F.when(F.col("c_mktsegment") == "BUILDING", "batch").otherwise("web"), F.lit("/live/job"), "c_nationkey", F.lit("/app.json"))
    return trees.batch_jobs(table(spark, sf_dir, "customer").select(path.alias("path")), "batch").select("pipeline", joined("jobs"))


@query("SELECT p_brand AS directory, p_size > 10 AS skipped, count(*) AS n FROM part GROUP BY 1, 2")
def excluded_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Globs as directory names, and the paths that they leave out."""
    names = trees.skipped_directories(["*/bin/*", "*/obj/*", "*/a/b/*"])
    path = F.concat(F.lit("/x/"), F.when(F.col("p_size") > 10, "obj").otherwise("src"), F.lit("/"), "p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("directory"), path.rlike("/(" + "|".join(names) + ")/").alias("skipped")).agg(F.count("*").alias("n"))
