"""Connected components by contraction in random order: each round leaves a share of the nodes, and what is small enough is
joined in one task; no hub is gathered. Also whole numbers for names, and cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_ROUNDS = 60
#: A graph of up to so many edges is joined in one task.
MOST_EDGES_IN_TASK = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own in local mode and an error on a
    cluster, whose executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'wakeline-shared')}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Ends lineage by writing df to the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(names: DataFrame) -> DataFrame:
    """(name, id): the distinct names with whole numbers from 0 up, in no order; written down, so that they stay."""
    own = cut(names.select("name").distinct().withColumn("__m", F.monotonically_increasing_id()), "names")
    own = own.select("name", F.shiftright("__m", 33).alias("__p"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
    sizes = own.groupBy("__p").agg(F.count("*").alias("n"))  # as many rows as there are partitions
    before = sizes.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    kind = "int" if own.count() < 1 << 31 else "long"
    return own.join(F.broadcast(before), "__p").select("name", (F.col("__i") + F.col("before")).cast(kind).alias("id"))


def _joined_in_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, root): the smallest node that each node is linked with."""
    root: dict = {}

    def find(x):
        at = x
        while root.setdefault(at, at) != at:
            at = root[at]
        while root[x] != at:
            root[x], x = at, root[x]
        return at

    for u, v in zip(pdf["u"], pdf["v"], strict=True):
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return pd.DataFrame({"u": list(root), "root": [find(x) for x in root]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", in_task: int | None = None) -> DataFrame:
    """(node, component): component is the smallest node that can be reached; self-loops and null ends link nothing.

    A node that occurs only in self-loops is its own component. In each round a node goes over to that of itself and its
    neighbours whose hash, drawn anew in each round, is smallest; a share of the nodes is left, whatever the graph. With
    in_task 0 there are joins only, and no Python worker.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    kind = pairs.schema["u"].dataType.simpleString()
    alone = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    now, steps = cut(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "components"), []
    most = MOST_EDGES_IN_TASK if in_task is None else in_task
    while now.count() > most:
        if len(steps) == MOST_ROUNDS:
            raise RuntimeError(f"not contracted after {MOST_ROUNDS} rounds")
        turn = F.lit(len(steps))
        both = now.union(now.select("v", "u"))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", turn).alias("h"), "v")).alias("near"))
        step = cut(near.select("u", F.least(F.struct(F.xxhash64("u", turn).alias("h"), F.col("u").alias("v")), "near")["v"].alias("m")), "contracted")
        steps.append(step)
        placed = now.join(step.select("u", F.col("m").alias("mu")), "u").join(step.select(F.col("u").alias("v"), F.col("m").alias("mv")), "v").where("mu <> mv")
        now = cut(placed.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(), "components")
    found = now.toDF("u", "root") if most == 0 else now.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(_joined_in_task, f"u {kind}, root {kind}")
    for step in reversed(steps):
        found = step.join(cut(found, "roots").withColumnRenamed("u", "m"), "m", "left").select("u", F.coalesce("root", "m").alias("root"))
    found = cut(found, "roots")
    if steps:
        least = found.groupBy("root").agg(F.min("u").alias("component"))
        linked = found.join(least, "root").select(F.col("u").alias("node"), "component")
    else:
        linked = found.toDF("node", "component")
    return linked.union(alone.join(linked, "node", "left_anti").withColumn("component", F.col("node")))
