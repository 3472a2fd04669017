"""Projections of order and document tables onto the dependency model, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schemas import EVIDENCE_CAP, NAMESPACE, REFERENCE, TYPE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str, names) -> DataFrame:
    """(source, target, edge_type, proof): within an order, each line's component depends on the next line's."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_shipdate")
    steps = lines.withColumn("name", names).withColumn("next", F.lead("name").over(order)).where("next is not null and next <> name")
    kind = F.when(F.col("l_returnflag") == "A", REFERENCE).when(F.col("l_returnflag") == "N", NAMESPACE).otherwise(TYPE)
    return steps.select(F.col("name").alias("source"), F.col("next").alias("target"), kind.alias("edge_type"), F.col("l_orderkey").cast("string").alias("proof"))


def _weighed(steps: DataFrame) -> DataFrame:
    grouped = steps.groupBy("source", "target", "edge_type").agg(F.count("*").cast("double").alias("weight"), F.array_sort(F.collect_set("proof")).alias("proofs"))
    return grouped.select("source", "target", "edge_type", "weight", F.slice("proofs", 1, EVIDENCE_CAP).alias("evidence"), F.size("proofs").cast("long").alias("evidence_total"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense graph: parts."""
    return _weighed(_steps(spark, sf_dir, F.concat(F.lit("P"), F.col("l_partkey"))))


def module_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a sparse graph: a part from one supplier, named supplier.part so that names have a dotted prefix."""
    return _steps(spark, sf_dir, F.concat(F.lit("S"), F.col("l_suppkey"), F.lit(".P"), F.col("l_partkey")))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighed(module_steps(spark, sf_dir))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that has a line: objects are its suppliers, solutions their nations, types the words of its type."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    nations = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    facts = pairs.groupBy("l_partkey").agg(
        F.sum("n").cast("long").alias("file_count"),
        F.array_sort(F.collect_set(F.concat(F.lit("obj_"), F.col("l_suppkey")))).alias("object_refs"),
        F.array_sort(F.collect_set("n_name")).alias("solutions"),
    )
    parts = table(spark, sf_dir, "part").join(facts, F.col("p_partkey") == F.col("l_partkey"))
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")
    return parts.select(
        F.concat(F.lit("P"), "p_partkey").alias("name"),
        F.concat(F.lit("src/"), brand, F.lit("/P"), "p_partkey", F.lit("/P"), "p_partkey", F.lit(".proj")).alias("path"),
        F.concat(F.lit("Shop."), brand).alias("namespace"),
        F.lit("net8.0").alias("framework"),
        F.lit("sdk").alias("project_style"),
        F.lit("Library").alias("output_type"),
        "file_count",
        F.array_sort(F.array_distinct(F.transform(F.split("p_type", " "), lambda w: F.concat(F.initcap(w), F.lit("Type"))))).alias("type_declarations"),
        "object_refs",
        "solutions",
        F.array(F.concat(F.lit("build/"), brand, F.lit(".props"))).alias("imports"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source files: (path, project, text)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.col("source").alias("project"), "text")
