"""Ranks, bins, pivots, curves and error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cover import written


def dense_ids(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Numbers rows from 0 in the given order, which must be total. Rows are range-partitioned and counted per
    partition; only the partitions' counts meet in one task."""
    mid = F.monotonically_increasing_id()
    placed = written(rows.orderBy(*order).withColumn("mid", mid), "ordered").withColumn("part", F.shiftright("mid", 33))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.col("mid") - F.shiftleft("part", 33)
    return placed.join(starts, "part").withColumn(name, (F.col("start") + inside).cast("long")).drop("part", "mid", "start")


def average_rank_share(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Adds rank_share: the mean rank of equal values over the group's number of values. Equal values
    are counted first, so a window has the distinct values alone."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    share = (upto - (F.col("n") - 1) / F.lit(2.0)) / F.sum("n").over(Window.partitionBy(group))
    ranks = counts.select(group, value, share.alias("rank_share"))
    return rows.join(ranks, [group, value], "left")


def quantile_bins(rows: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """Adds bin from 0: closed on the right at the exact, linearly interpolated quantiles of the group."""
    levels = [i / bins for i in range(1, bins)]
    cuts = rows.groupBy(group).agg(F.percentile(value, levels).alias("cuts"))
    at = F.when(F.col(value).isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col(value))))
    return rows.join(cuts, group).withColumn("bin", at).drop("cuts")


def fixed_bins(value: Column, edges: Sequence[float]) -> Column:
    """The number of the interval (edges[i], edges[i+1]] that holds value; null outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(zip(edges, edges[1:])))):
        out = F.when((value > low) & (value <= high), i).otherwise(out)
    return out


def pivot_with_totals(rows: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of rows by row and each of the given values of column, with n_all, and a line All over all rows."""
    counted = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    by = rows.where(F.col(row).isNotNull()).rollup(row).agg(*counted, F.count(F.lit(1)).alias("n_all"))
    return by.withColumn(row, F.coalesce(F.col(row).cast("string"), F.lit("All")))


def marginal_gains(curve: DataFrame) -> DataFrame:
    """Of (method, budget, objective): gain over the budget before, and best, the largest objective so far."""
    w = Window.partitionBy("method").orderBy("budget")
    return curve.withColumns({"gain": F.col("objective") - F.lag("objective", 1, 0).over(w), "best": F.max("objective").over(w)})


def saturation(curve: DataFrame, share: float = 1.0) -> DataFrame:
    """Per method the smallest budget that reaches the share of its largest objective."""
    top = curve.groupBy("method").agg(F.max("objective").alias("top"))
    return curve.join(top, "method").where(F.col("objective") >= F.lit(share) * F.col("top")).groupBy("method").agg(F.min("budget").alias("budget"), F.first("top").alias("top"))


def compare_curves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(budget, delta) of two curves (budget, objective) at the budgets that both have."""
    return left.select("budget", F.col("objective").alias("a")).join(right.select("budget", F.col("objective").alias("b")), "budget").select("budget", (F.col("b") - F.col("a")).alias("delta"))


def falling_steps(curve: DataFrame) -> DataFrame:
    """The rows of (method, budget, objective) whose objective is below the budget before: none, in a sound curve."""
    w = Window.partitionBy("method").orderBy("budget")
    return curve.withColumn("was", F.lag("objective").over(w)).where("objective < was")


def error_measures(rows: DataFrame, group: str, observed: str, predicted: str) -> DataFrame:
    """Per group n, mae, rmse and mape over rows with both values; observed zeros take no part in mape."""
    o, p = F.col(observed).cast("double"), F.col(predicted).cast("double")
    both = rows.where(o.isNotNull() & p.isNotNull())
    return both.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - o)).alias("mae"), F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        (F.lit(100.0) * F.avg(F.abs((p - o) / F.nullif(o, F.lit(0.0))))).alias("mape"))


def trend(rows: DataFrame, group: str, y: str, x: str) -> DataFrame:
    return rows.groupBy(group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement with chances by weight: the largest ln(u) / weight, u hashed from seed
    and key. The top n are merged from each partition's own."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") + 1.0) / float((1 << 52) + 1)
    return rows.where(F.col(weight) > 0).withColumn("draw", F.log(u) / F.col(weight)).orderBy(F.desc("draw"), key).limit(n).drop("draw")


def sample_share(rows: DataFrame, key: str, share: float, cap: int | None = None, seed: int = 42) -> DataFrame:
    """max(1, int(n * share)) rows in an order hashed from seed and key, then at most cap."""
    n = max(1, int(rows.count() * share))
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n if cap is None else min(n, cap))
