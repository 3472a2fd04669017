"""Name mappings: loading, overlays, the strategy ladder of a resolver, longest dotted prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STRATEGIES = ("exact", "case_insensitive", "suffix_stripped", "suffix_stripped_ci", "prefix")


def clean_mapping(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value) trimmed; rows with an empty side are dropped and the last row of a key (greatest place) wins."""
    own = rows.select(F.trim(F.col(key)).alias("key"), F.trim(F.col(value)).alias("value"), F.col(place).alias("place")).where("key <> '' and value <> ''")
    return own.groupBy("key").agg(F.max_by("value", "place").alias("value"))


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value): an override replaces or adds."""
    return base.select("key", F.col("value").alias("old")).join(overrides.select("key", F.col("value").alias("new")), "key", "full_outer").select("key", F.coalesce("new", "old").alias("value"))


def longest_prefix(probes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(probe, key): the longest key K of which the probe starts with "K."; prefixes are met by an equi-join."""
    up = probes.select("probe", F.explode(T.dotted_prefixes(F.col("probe"))).alias("key")).distinct()
    return up.join(mapping.select("key").distinct(), "key").groupBy("probe").agg(F.max_by("key", F.length("key")).alias("key"))


def resolve(probes: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, place, probe, strategy, key, value) for the first probe of an id that matches, by its first strategy.

    probes is (id, place, probe). All strategies of an earlier probe stand before those of a later one. Where several
    keys match in the same way the smallest one is taken.
    """
    keys = mapping.select("key", "value")
    bare = T.strip_suffix(F.col("probe"))
    # each side is keyed by what a strategy compares; every strategy is an equi-join
    own = T.strip_suffix(F.col("key"))
    parts = [
        (F.col("probe"), F.col("key"), 1),
        (F.lower("probe"), F.lower("key"), 2),
        (bare, own, 3),
        (F.lower(bare), F.lower(own), 4),
    ]
    tries = None
    for probe_by, key_by, rank in parts:
        a = probes.select("id", "place", "probe", probe_by.alias("by"))
        b = keys.select("key", "value", key_by.alias("by"))
        found = a.join(b, "by").select("id", "place", "probe", F.lit(rank).alias("rank"), "key", "value")
        tries = found if tries is None else tries.unionByName(found)
    by_prefix = longest_prefix(probes.select("probe"), keys).join(keys, "key")
    tries = tries.unionByName(probes.join(by_prefix, "probe").select("id", "place", "probe", F.lit(5).alias("rank"), "key", "value"))
    best = tries.groupBy("id").agg(F.min(F.struct("place", "rank", "key", "value", "probe")).alias("x"))
    return best.select("id", F.col("x.place").alias("place"), F.col("x.probe").alias("probe"), F.get(F.array(*map(F.lit, STRATEGIES)), F.col("x.rank") - 1).alias("strategy"), F.col("x.key").alias("key"), F.col("x.value").alias("value"))


def group_by_value(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(value, n, names): sorted distinct names of each value; null values are dropped."""
    own = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(value).alias("value")).agg(F.array_sort(F.collect_set(name)).alias("names"))
    return own.select("value", F.size("names").cast("long").alias("n"), "names")


def fuzzy(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match): the known name that is equal but for case, else the smallest known one that holds it.

    Names shorter than three characters are matched as a whole only.
    """
    same = names.join(known.select(F.lower("known").alias("l"), "known"), F.lower("name") == F.col("l")).groupBy("name").agg(F.min("known").alias("match"))
    rest = names.join(same, "name", "left_anti")
    # trigrams bound what can hold a name, so no pair is made that shares none
    rest = rest.select("name", F.lower("name").alias("low"))
    grams = rest.where(F.length("low") >= 3).select("name", "low", F.substring("low", 1, 3).alias("gram"))
    k = known.select("known", F.lower("known").alias("lk"))
    kg = k.where(F.length("lk") >= 3).select("known", "lk", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("lk") - 2), lambda i: F.substring("lk", i, F.lit(3))))).alias("gram"))
    held = grams.join(kg, "gram").where(F.contains("lk", F.col("low"))).groupBy("name").agg(F.min("known").alias("match"))
    return same.unionByName(held)
