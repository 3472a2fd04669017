"""Compact text index of a graph under a byte budget, and what supplied targets are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type names that tell nothing of a project.
STOP_TYPES = ("Program", "Startup", "Constants", "Extensions", "AssemblyInfo", "Resources", "Settings", "App", "GlobalSuppressions", "Module", "ServiceCollectionExtensions", "DependencyInjection", "AutofacModule", "MappingProfile")
CAPS = (15, 10, 5)


def keep_types(types: Column, name: Column) -> Column:
    """Without stop names, names of one character and the project's own name."""
    return F.filter(types, lambda t: ~t.isin(*STOP_TYPES) & (F.length(t) > 1) & (t != name))


def cap_longest(types: Column, cap: int) -> Column:
    """The `cap` longest names in their old order, then "..." if any was left out; the earlier one wins a tie."""
    places = F.transform(types, lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i")))
    kept = F.transform(F.slice(F.array_sort(places), 1, cap), lambda p: p["i"])
    out = F.transform(F.array_sort(kept), lambda i: F.get(types, i))
    return F.when(F.size(types) > cap, F.concat(out, F.array(F.lit("...")))).otherwise(types)


def _line(name: Column, namespace: Column, types: Column, objects: Column) -> Column:
    part = lambda tag, x: F.when(F.size(x) > 0, F.concat(F.lit(f" {tag}:"), F.array_join(x, ","))).otherwise("")
    return F.concat(F.lit("P:"), name, F.when(namespace.isNotNull() & (namespace != name), F.concat(F.lit(" NS:"), namespace)).otherwise(""), part("T", types), part("SP", objects))


def codebase_index(nodes: DataFrame) -> DataFrame:
    """(name, line): one line a project. Lines stay rows; a sink orders and joins them."""
    return nodes.select("name", _line(F.col("name"), F.col("namespace"), F.col("type_declarations"), F.array_sort("object_refs")).alias("line"))


def shared_section(nodes: DataFrame) -> DataFrame:
    """(object, line) of objects that several projects use."""
    uses = nodes.select("name", F.explode("object_refs").alias("object")).groupBy("object").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") >= 2)
    return uses.select("object", F.concat(F.lit("SHARED "), "object", F.lit(":"), F.array_join("names", ",")).alias("line"))


def variants(nodes: DataFrame) -> DataFrame:
    """(step, bytes): the size of each step of the reduction ladder, each step's lines summed where they are."""
    t, name, ns, objects = F.col("type_declarations"), F.col("name"), F.col("namespace"), F.array_sort("object_refs")
    kept = keep_types(t, name)
    steps = [_line(name, ns, t, objects), _line(name, ns, kept, objects), *(_line(name, ns, cap_longest(kept, c), objects) for c in CAPS)]
    empty = (F.size(kept) == 0) & (F.size(objects) == 0)
    steps.append(F.when(~empty, steps[-1]))
    size = lambda line: F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0)).cast("long")
    wide = nodes.agg(*(size(s).alias(f"s{i + 1}") for i, s in enumerate(steps)))
    shared = shared_section(nodes).agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).cast("long").alias("shared"))
    one = wide.crossJoin(shared).withColumn("s0", F.col("s1") + F.col("shared"))  # single rows
    return one.select(F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("step"), F.col(f"s{i}").alias("bytes")) for i in range(len(steps) + 1)))))


def fit(sizes: DataFrame, budget: int) -> DataFrame:
    """One row: the first step within the budget, the last step if none is."""
    return sizes.agg(F.coalesce(F.min(F.when(F.col("bytes") <= budget, F.struct("step", "bytes"))), F.max(F.struct("step", "bytes"))).alias("x")).select("x.step", "x.bytes")


def validate_targets(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """targets (target, role, confidence) whose name is known; a missing role is "root"."""
    return targets.join(nodes.select(F.col("name").alias("target")).distinct(), "target", "left_semi").withColumn("role", F.coalesce("role", F.lit("root")))
