"""Population: grouping, block sums, thresholds, weighted quantiles and access summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Half to even on the double itself, as array libraries round."""
    return F.rint(value * F.lit(float(10**digits))) / F.lit(float(10**digits))


def group_population(points: DataFrame, digits: int) -> DataFrame:
    """Weights summed by rounded place."""
    at = [rounded(F.col(c), digits).alias(c) for c in ("lon", "lat")]
    return points.select(*at, "weight").groupBy("lon", "lat").agg(F.sum("weight").alias("weight"))


def block_sum(cells: DataFrame, factor: int, rows: int, cols: int) -> DataFrame:
    """Raster cells (row, col, value) summed over blocks of factor x factor; the incomplete edge of a
    rows x cols raster is trimmed, and null values count as 0."""
    inside = cells.where((F.col("row") < rows // factor * factor) & (F.col("col") < cols // factor * factor))
    block = [F.floor(F.col(c) / factor).cast("long").alias(c) for c in ("row", "col")]
    return inside.select(*block, F.coalesce("value", F.lit(0)).alias("value")).groupBy("row", "col").agg(F.sum("value").alias("value"))


def served_population(pairs: DataFrame, total: DataFrame) -> DataFrame:
    """Per facility of the pairs (facility_id, demand_id, weight): the served weight and its share of
    all weight in percent; a demand that a facility has several times counts once."""
    served = pairs.select("facility_id", "demand_id", "weight").distinct().groupBy("facility_id").agg(F.sum("weight").alias("served"), F.count(F.lit(1)).alias("n_demand"))
    whole = total.agg(F.sum("weight").alias("all_weight"))  # one row
    return served.crossJoin(F.broadcast(whole)).select("facility_id", "served", "n_demand", (F.lit(100.0) * F.col("served") / F.col("all_weight")).alias("percent"))


def access_summary(nearest: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Of rows (weight, distance or null): the weight within each threshold, inclusive, and its percentage."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    sums = nearest.select("weight", "distance", levels).groupBy("threshold").agg(
        F.sum(F.when(F.col("distance") <= F.col("threshold"), F.col("weight")).otherwise(0)).alias("within"), F.sum("weight").alias("total"))
    return sums.select("threshold", "within", (F.lit(100.0) * F.col("within") / F.col("total")).alias("percent"))


def weighted_quantile(rows: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """Per group, the value at quantile q with each row at the middle of its weight, in between linear,
    beyond the ends the end values. Equal values are summed before the window, so a group's window has
    its distinct values alone."""
    distinct = rows.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(group).orderBy(value)
    placed = distinct.withColumn("cum", F.sum("w").over(w)).withColumn("all_w", F.sum("w").over(Window.partitionBy(group)))
    placed = placed.withColumn("at", (F.col("cum") - F.col("w") / F.lit(2.0)) / F.col("all_w"))
    placed = placed.withColumns({"next_at": F.lead("at").over(w), "next_value": F.lead(value).over(w)})
    at, nat, v, nv = F.col("at"), F.col("next_at"), F.col(value), F.col("next_value")
    between = F.when((at <= q) & (nat > q), v + (nv - v) * (F.lit(q) - at) / (nat - at)).when((at <= q) & nat.isNull(), v)
    found = placed.groupBy(group).agg(F.max(between).alias("inside"), F.min(v).alias("least"))
    return found.select(group, F.coalesce("inside", "least").alias("quantile"))
