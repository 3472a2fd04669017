"""Piecewise scores of the risk model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("structural", "instability", "cycle", "database", "blast_radius", "domain_boundary", "change_surface")
#: Weight of each dimension, in the order of DIMENSIONS.
CONTEXTS = {
    "pr": (0.7, 0.6, 1.0, 0.8, 0.7, 0.5, 0.9),
    "work_request": (0.6, 0.5, 0.8, 1.0, 0.8, 0.9, 0.4),
    "local": (0.7, 0.6, 1.0, 0.6, 0.7, 0.3, 0.9),
}
RED, YELLOW = 0.7, 0.4


def interpolate(v: Column, low: float, high: float, low_score: float, high_score: float) -> Column:
    """Linear between two points, clamped; the high score where the points coincide."""
    if high <= low:
        return F.lit(high_score)
    return F.lit(low_score) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low))) * (high_score - low_score)


def structural(fan_in: Column, extreme: Column) -> Column:
    """extreme: whether coupling is among the highest of at least ten nodes."""
    base = F.when(fan_in >= 10, 1.0).when(fan_in >= 5, interpolate(fan_in, 5, 10, 0.7, 1.0)).when(fan_in >= 3, interpolate(fan_in, 3, 5, 0.4, 0.7)).otherwise(interpolate(fan_in, 0, 3, 0.1, 0.4))
    return F.least(F.lit(1.0), base + F.when(extreme, 0.1).otherwise(0.0))


def instability(value: Column, fan_in: Column) -> Column:
    used = F.when(value >= 0.8, interpolate(value, 0.8, 1.0, 0.7, 0.9)).when(value >= 0.6, interpolate(value, 0.6, 0.8, 0.5, 0.7)).when(value >= 0.5, interpolate(value, 0.5, 0.6, 0.3, 0.5)).otherwise(0.1)
    return F.when(fan_in >= 3, used).when(value >= 0.8, 0.3).otherwise(0.1)


def cycle(size: Column) -> Column:
    return F.when(size >= 5, 1.0).when(size >= 3, interpolate(size, 2, 5, 0.6, 1.0)).when(size == 2, 0.6).otherwise(0.0)


def database(density: Column, cross_team: Column) -> Column:
    return F.when(density <= 0, 0.0).when((density > 0.5) & cross_team, interpolate(density, 0.5, 1.0, 0.8, 1.0)).when((density > 0.3) | cross_team, interpolate(density, 0.1, 0.5, 0.5, 0.8)).otherwise(interpolate(density, 0.0, 0.3, 0.2, 0.5))


def blast_radius(direct: Column, transitive: Column) -> Column:
    return F.when(transitive >= 20, 1.0).when(transitive >= 10, interpolate(transitive, 10, 20, 0.7, 1.0)).when(direct >= 5, interpolate(direct, 5, 10, 0.5, 0.7)).when(direct >= 2, interpolate(direct, 2, 5, 0.3, 0.5)).otherwise(0.1)


def domain_boundary(crossed: Column) -> Column:
    return F.when(crossed >= 3, interpolate(crossed, 3, 6, 0.6, 0.8)).when(crossed >= 2, interpolate(crossed, 2, 3, 0.3, 0.6)).when(crossed >= 1, interpolate(crossed, 1, 2, 0.2, 0.3)).otherwise(0.0)


def change_surface(deleted: Column, interfaces: Column, modified: Column, added: Column) -> Column:
    """Greatest of deletions, changed interfaces, other changes and additions."""

    def grows(n: Column, first: float, more: float, most: float) -> Column:
        return F.when(n > 0, F.least(F.lit(most), F.lit(first) + (n - 1) * more)).otherwise(0.0)

    return F.greatest(grows(deleted, 0.7, 0.1, 1.0), grows(interfaces, 0.5, 0.1, 0.8), grows(modified, 0.3, 0.05, 0.6), F.when(added > 0, 0.1).otherwise(0.0))


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def level(score: Column, red: float = RED, yellow: float = YELLOW) -> Column:
    return F.when(score >= red, "RED").when(score >= yellow, "YELLOW").otherwise("GREEN")


def level_label(name: Column) -> Column:
    return F.when(name == "RED", "High").when(name == "YELLOW", "Medium").otherwise("Low")


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 1.0, "HIGH").when(confidence >= 0.6, "MEDIUM").otherwise("LOW")


def composite(columns: list[str], context: str = "pr") -> Column:
    """Greatest weighted score of the dimensions that are known (not null); 0 if none is."""
    weights = dict(zip(DIMENSIONS, CONTEXTS[context], strict=True))
    return F.coalesce(F.array_max(F.array(*(F.col(c) * weights[c] for c in columns))), F.lit(0.0))


def ambiguity(n: Column, confidence: Column) -> Column:
    """How clear a request is, from its number of targets and their mean confidence."""
    return F.when((n == 0) | (n > 10) | (confidence < 0.4), "vague").when((n > 5) | (confidence < 0.7), "moderate").otherwise("clear")


def confidence_band(score: Column, clarity: Column) -> tuple[Column, Column]:
    """(label, width): a vague request widens the band by one step."""
    step = F.when(score < 0.3, 0).when(score < 0.6, 1).otherwise(2) + F.when(clarity == "vague", 1).otherwise(0)
    return F.when(step == 0, "HIGH").when(step == 1, "MODERATE").otherwise("LOW"), F.when(step == 0, 0.2).when(step == 1, 0.3).otherwise(0.5)
