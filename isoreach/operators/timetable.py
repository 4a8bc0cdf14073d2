"""Scores of timetables: what pairs of courses cost by the days between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflict_pairs(matrix: DataFrame, key: str, courses: Sequence[str], above: float = 0) -> DataFrame:
    """(a, b, n) with a < b of a symmetric table with a row and a column for each course."""
    long = matrix.unpivot(key, list(courses), "b", "n")
    return long.select(F.col(key).alias("a"), "b", "n").where((F.col("a") < F.col("b")) & (F.col("n") > above))


def pair_costs(placed: DataFrame, pairs: DataFrame, weights: Mapping[str, float], formal: bool = True) -> DataFrame:
    """(a, b, gap, cost) of pairs (a, b, n) under a timetable (course, day, slot), day being the place in
    the list of days.

    weights: a for the same slot, b for the same day, c to g for 1 to 5 days between. formal: the same
    slot costs a alone. Otherwise it costs a and b, and 5 days cost as much as 1. Unplaced courses cost nothing.
    """
    at = lambda x: placed.select(F.col("course").alias(x), F.col("day").alias(f"day_{x}"), F.col("slot").alias(f"slot_{x}"))
    met = pairs.join(at("a"), "a").join(at("b"), "b").withColumn("gap", F.abs(F.col("day_a") - F.col("day_b")))
    clash = (F.col("gap") == 0) & (F.col("slot_a") == F.col("slot_b"))
    by_gap = [weights["b"], weights["c"], weights["d"], weights["e"], weights["f"], weights["g"] if formal else weights["c"]]
    spread = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in by_gap]), F.col("gap").cast("int")), F.lit(0.0))
    same = F.when(clash, float(weights["a"])).otherwise(0.0)
    each = F.when(clash, same).otherwise(spread) if formal else same + spread
    return met.select("a", "b", "gap", (F.col("n") * each).alias("cost"))


def clashes(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs in the same slot of the same day."""
    at = lambda x: placed.select(F.col("course").alias(x), "day", "slot")
    return pairs.join(at("a"), "a").join(at("b"), ["b", "day", "slot"]).select("a", "b", "n", "day", "slot")


def double_placed(placed: DataFrame) -> DataFrame:
    return placed.groupBy("course").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
