"""Rows and text of reports; data stays in DataFrames, and only bounded summaries are formatted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scores as S
from ..schemas import REFERENCE
from .components import cut
from .risk import ranked

_NAMES = {"target": "TargetName", "consumer": "ConsumerName", "coupling_score": "CouplingScore", "fan_in": "FanIn", "fan_out": "FanOut", "instability": "Instability"}


def detailed(rows: DataFrame, with_metrics: bool = True) -> DataFrame:
    """Consumer rows under report names; metric columns only where they were asked for."""
    keys = list(_NAMES) if with_metrics else ["target", "consumer"]
    return rows.select(*(F.col(k).alias(_NAMES[k]) for k in keys))


def console_rows(rows: DataFrame) -> DataFrame:
    """Rows with their place in the target's group: most coupled first, unknown ones last, then by name."""
    order = W.partitionBy("target").orderBy(F.desc_nulls_last("coupling_score"), "consumer")
    return rows.select(F.col("target").alias("TargetName"), F.col("consumer").alias("ConsumerName"), F.col("coupling_score").alias("CouplingScore"), F.col("fan_in").alias("FanIn"), F.row_number().over(order).cast("long").alias("Place"))


def grouped(rows: DataFrame) -> DataFrame:
    """(target, n, consumers): one JSON array of sorted consumers for each target."""
    own = rows.groupBy("target").agg(F.array_sort(F.collect_set("consumer")).alias("c"))
    return own.select("target", F.size("c").cast("long").alias("n"), F.to_json("c").alias("consumers"))


def metrics_rows(metrics: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Metrics rounded for a table, with clusters (name, cluster) if given."""
    out = metrics.select("name", "fan_in", "fan_out", *(F.round(c, 3).alias(c) for c in ("instability", "coupling", "shared_db_density")), "consumer_count")
    return out if members is None else out.join(members, "name", "left")


def impact_rows(trace: DataFrame) -> DataFrame:
    return trace.select(F.col("target").alias("TargetName"), F.col("consumer").alias("ConsumerName"), F.col("depth").alias("Depth"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """(source, target, line): diagram lines of reference edges, dots in names replaced."""
    safe = lambda c: F.replace(c, F.lit("."), F.lit("_"))
    own = edges.where(F.col("edge_type") == REFERENCE).select("source", "target").distinct()
    return own.select("source", "target", F.concat(safe(F.col("source")), F.lit(" --> "), safe(F.col("target"))).alias("line"))


def prediction_rows(profiles: DataFrame, direct: DataFrame, transitive: DataFrame, changed: DataFrame, factors: int = 3) -> DataFrame:
    """Flat records for an append-only log: level, rounded scores and whether each is known, counts of changed types and
    of consumers from tables (name, n), the first risk factors, and an outcome that is yet to come."""
    names = F.array(*map(F.lit, S.DIMENSIONS))
    scores = F.map_from_arrays(names, F.array(*(F.round(F.round(d, 9), 4) for d in S.DIMENSIONS)))
    known = F.map_from_arrays(names, F.array(*(F.col(d).isNotNull() for d in S.DIMENSIONS)))
    counts = {"changed_type_count": changed, "direct_consumers": direct, "transitive_consumers": transitive}
    own = profiles
    for c, n in counts.items():
        own = own.join(n.select("name", F.col("n").alias(c)), "name", "left")
    return own.select(
        F.col("name").alias("project"),
        "level",
        F.round("composite", 4).alias("composite"),
        scores.alias("scores"),
        known.alias("available"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.lit(True).alias("graph_available"),
        F.transform(F.slice(ranked(), 1, factors), lambda x: x["dimension"]).alias("risk_factors"),
        *(F.lit(None).cast("string").alias(c) for c in ("outcome", "outcome_signals", "merge_sha")),
    )


def append_predictions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def tree_paths(trace: DataFrame) -> DataFrame:
    """(target, consumer, path): the path of each consumer from its direct ancestor; unknown parents become roots."""
    depth = int(trace.agg(F.max("depth")).first()[0] or 0)
    known = trace.select("target", "consumer", "depth", "parent")
    out = known.where("depth = 0").select("target", "consumer", F.col("consumer").alias("path"))
    level = out
    for d in range(1, depth + 1):
        above = level.select("target", F.col("consumer").alias("parent"), F.col("path").alias("above"))
        level = known.where(F.col("depth") == d).join(above, ["target", "parent"], "left").select("target", "consumer", F.concat_ws("/", "above", "consumer").alias("path"))
        out = out.unionByName(level)
    return out


def next_steps(direct: Column, transitive: Column) -> Column:
    """What to do, from counts."""
    return F.array_compact(
        F.array(
            F.when(direct > 0, F.concat(F.lit("review "), direct.cast("string"), F.lit(" direct consumers"))),
            F.when(transitive > 0, F.concat(F.lit("check "), transitive.cast("string"), F.lit(" transitive consumers"))),
            F.when(direct >= 5, F.lit("plan a staged rollout")),
        )
    )


def with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their 1-based place in a global order: a range-partitioned sort, numbered within partitions, plus the
    number of rows in the partitions before. Ranges are sampled anew in each run, so they are written down once."""
    own = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    numbered = own.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = own.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return numbered.join(F.broadcast(before), "__p").withColumn("place", (F.col("__i") + F.col("before")).cast("long")).drop("__p", "__i", "before")


def md_table(headers: list[str], rows: list[tuple]) -> str:
    """A Markdown table of a bounded number of collected rows."""
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(map(cell, r)) + " |" for r in (headers, ["---"] * len(headers), *rows)])


def mermaid(lines: DataFrame, most: int = 200) -> str:
    """A diagram of at most `most` edges, in order of names."""
    return "\n".join(["graph TD", *("    " + r[0] for r in lines.orderBy("source", "target").limit(most).select("line").collect())])


def render_tree(paths: list[str]) -> str:
    """Indented tree of slash-separated paths."""
    out: list[str] = []
    for p in sorted(paths):
        parts = p.split("/")
        out.append("    " * (len(parts) - 1) + ("└── " if len(parts) > 1 else "") + parts[-1])
    return "\n".join(out)


def risk_comment(aggregate: dict, rows: list[tuple], most: int = 20) -> str:
    """A pull-request comment: the level, the greatest scores, the first consumers."""
    head = f"## Risk: {aggregate['level']} ({aggregate['composite']:.2f})"
    table = md_table(["project", "level", "score"], rows[:most])
    return f"{head}\n\n{table}\n" + (f"\n… and {len(rows) - most} more\n" if len(rows) > most else "")
