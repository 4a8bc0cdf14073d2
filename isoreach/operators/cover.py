"""Coverage and site selection over incidence rows (facility_id, demand_id, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spatial
from .tables import shared_folder, written  # noqa: F401


def objective(incidence: DataFrame, solution: Sequence[int]) -> int:
    """Weight covered by the facilities, each demand once; duplicates in the solution change nothing."""
    chosen = incidence.where(F.col("facility_id").isin(sorted(set(solution)))).select("demand_id", "weight").distinct()
    return int(chosen.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])


def greedy_max_cover(incidence: DataFrame, budget: int) -> DataFrame:
    """Up to budget facilities by largest gain, ties to the smallest id: step, facility_id, gain, covered.

    A step is one aggregation of what is uncovered; only its best row comes to the driver. The
    uncovered incidence is written anew every few steps. It ends where no gain is positive.
    """
    spark: SparkSession = incidence.sparkSession
    left = written(incidence.select("facility_id", "demand_id", "weight").distinct(), "incidence")
    steps, covered = [], 0
    for step in range(1, budget + 1):
        best = left.groupBy("facility_id").agg(F.sum("weight").alias("gain")).orderBy(F.desc("gain"), "facility_id").first()
        if best is None or not best["gain"] or best["gain"] <= 0:
            break
        covered += best["gain"]
        steps.append((step, best["facility_id"], best["gain"], covered))
        taken = left.where(F.col("facility_id") == best["facility_id"]).select("demand_id")
        left = written(left.join(taken, "demand_id", "left_anti"), "uncovered")
    return spark.createDataFrame(steps, "step int, facility_id long, gain long, covered long")


def closest_per_demand(pairs: DataFrame) -> DataFrame:
    """Per demand_id its nearest facility of (facility_id, demand_id, distance), ties to the smaller id."""
    best = pairs.groupBy("demand_id").agg(F.min(F.struct("distance", "facility_id")).alias("b"))
    return best.select("demand_id", "b.facility_id", "b.distance")


def best_by_budget(runs: DataFrame) -> DataFrame:
    """Of runs (method, budget, objective): per budget the best, ties to the smaller method name."""
    best = runs.groupBy("budget").agg(F.min(F.struct((-F.col("objective")).alias("o"), "method")).alias("b"))
    return best.select("budget", "b.method", (-F.col("b.o")).alias("objective"))


def catchment_cumulative(pairs: DataFrame) -> DataFrame:
    """Per facility, weight summed up to each distance (facility_id, distance, cumulative)."""
    by = pairs.groupBy("facility_id", "distance").agg(F.sum("weight").alias("w"))
    w = Window.partitionBy("facility_id").orderBy("distance")
    return by.select("facility_id", "distance", F.sum("w").over(w).alias("cumulative"))


def demand_lists(incidence: DataFrame) -> DataFrame:
    """Per facility its sorted distinct demand."""
    return incidence.groupBy("facility_id").agg(F.sort_array(F.collect_set("demand_id")).alias("demand"))


def facility_lists(lists: DataFrame) -> DataFrame:
    """The transpose of demand_lists: per demand its sorted facilities."""
    return lists.select("facility_id", F.explode("demand").alias("demand_id")).groupBy("demand_id").agg(F.sort_array(F.collect_set("facility_id")).alias("facilities"))


def uncovered(incidence: DataFrame, existing: DataFrame) -> DataFrame:
    """The incidence without demand that existing (demand_id) has covered already, and without weightless demand."""
    return incidence.where("weight > 0").join(existing.select("demand_id").distinct(), "demand_id", "left_anti")


def coverage_counts(incidence: DataFrame, solution: Sequence[int]) -> DataFrame:
    """(demand_id, weight, times): how many facilities of the solution cover each demand; a repeated facility counts once."""
    rows = incidence.select("facility_id", "demand_id", "weight").distinct()
    return rows.groupBy("demand_id", "weight").agg(F.count(F.when(F.col("facility_id").isin(sorted(set(solution))), 1)).alias("times"))


def add_deltas(incidence: DataFrame, solution: Sequence[int]) -> DataFrame:
    """(facility_id, delta) for all facilities outside the solution: the weight each would add."""
    rows = incidence.select("facility_id", "demand_id", "weight").distinct()
    counts = coverage_counts(incidence, solution).select("demand_id", "times")
    out = rows.where(~F.col("facility_id").isin(sorted(set(solution)))).join(counts, "demand_id")
    return out.groupBy("facility_id").agg(F.sum(F.when(F.col("times") == 0, F.col("weight")).otherwise(0)).alias("delta"))


def drop_deltas(incidence: DataFrame, solution: Sequence[int]) -> DataFrame:
    """(facility_id, delta) for the facilities of the solution: minus the weight that each covers alone."""
    rows = incidence.select("facility_id", "demand_id", "weight").distinct()
    counts = coverage_counts(incidence, solution).select("demand_id", "times")
    mine = rows.where(F.col("facility_id").isin(sorted(set(solution)))).join(counts, "demand_id")
    return mine.groupBy("facility_id").agg((-F.sum(F.when(F.col("times") == 1, F.col("weight")).otherwise(0))).alias("delta"))


def swap_deltas(incidence: DataFrame, solution: Sequence[int]) -> DataFrame:
    """(out_id, in_id, delta) of all swaps that share demand which out_id covers alone: what in_id adds, less what
    out_id covers alone, plus what of that in_id covers too. Only shared demand is joined; a swap that
    shares none is worth add_deltas plus drop_deltas."""
    rows = incidence.select("facility_id", "demand_id", "weight").distinct()
    inside = F.col("facility_id").isin(sorted(set(solution)))
    alone = rows.where(inside).join(coverage_counts(incidence, solution).where("times = 1").select("demand_id"), "demand_id", "left_semi")
    other = rows.where(~inside).select(F.col("facility_id").alias("in_id"), "demand_id")
    both = alone.join(other, "demand_id").groupBy(F.col("facility_id").alias("out_id"), "in_id").agg(F.sum("weight").alias("shared"))
    adds, drops = add_deltas(incidence, solution), drop_deltas(incidence, solution)
    found = both.join(adds.select(F.col("facility_id").alias("in_id"), F.col("delta").alias("more")), "in_id").join(drops.select(F.col("facility_id").alias("out_id"), F.col("delta").alias("less")), "out_id")
    return found.select("out_id", "in_id", (F.col("more") + F.col("less") + F.col("shared")).alias("delta"))


def drop_redundant(incidence: DataFrame, solution: Sequence[int]) -> list[int]:
    """The solution without facilities whose demand others of it cover, looked at in order; a facility
    without demand goes. One job a facility of the solution."""
    kept = list(dict.fromkeys(solution))
    rows = written(incidence.where(F.col("facility_id").isin(kept)).select("facility_id", "demand_id", "weight").distinct(), "solution")
    for facility in list(kept):
        alone = coverage_counts(rows.where(F.col("facility_id").isin(kept)), kept).where("times = 1")
        if not rows.where(F.col("facility_id") == facility).join(alone, "demand_id", "left_semi").limit(1).count():
            kept.remove(facility)
    return kept


def swap_search(incidence: DataFrame, solution: Sequence[int], max_moves: int | None = None) -> DataFrame:
    """Swaps while one improves: (move, out_id, in_id, objective), move 0 being the start.

    The facility to leave is the first of the solution that has an improving swap with a facility
    sharing demand which it covers alone; of these the one with the largest gain enters, ties to the
    smaller id. A move is one aggregation; only its best row comes to the driver. The search ends where no swap
    improves; max_moves, if given, ends it sooner.
    """
    rows = written(incidence.select("facility_id", "demand_id", "weight").distinct(), "incidence")
    current, worth = list(dict.fromkeys(solution)), objective(rows, solution)
    moves = [(0, None, None, worth)]
    while current and (max_moves is None or len(moves) <= max_moves):
        at = F.array_position(F.array(*[F.lit(f).cast("long") for f in current]), F.col("out_id"))
        best = swap_deltas(rows, current).where("delta > 0").orderBy(at, F.desc("delta"), "in_id").first()
        if best is None:
            break
        current[current.index(best["out_id"])] = best["in_id"]
        worth += best["delta"]
        moves.append((len(moves), best["out_id"], best["in_id"], worth))
    return incidence.sparkSession.createDataFrame(moves, "move int, out_id long, in_id long, objective long")


def relink(incidence: DataFrame, start: Sequence[int], goal: Sequence[int]) -> DataFrame:
    """The way from start to goal by swaps, each the best of those that bring in a facility of goal for
    one not in it: (move, out_id, in_id, objective). Ties go to the smaller ids."""
    rows = written(incidence.where(F.col("facility_id").isin([*start, *goal])).select("facility_id", "demand_id", "weight").distinct(), "incidence")
    current, worth, moves = list(dict.fromkeys(start)), objective(rows, start), []
    spark = incidence.sparkSession
    while True:
        out, in_ = [f for f in current if f not in goal], [f for f in dict.fromkeys(goal) if f not in current]
        if not out or not in_:
            break
        ids = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} long")
        less = ids(out, "out_id").join(drop_deltas(rows, current).select(F.col("facility_id").alias("out_id"), F.col("delta").alias("less")), "out_id", "left")
        more = ids(in_, "in_id").join(add_deltas(rows, current).select(F.col("facility_id").alias("in_id"), F.col("delta").alias("more")), "in_id", "left")
        near = swap_deltas(rows, current).withColumnRenamed("delta", "both")
        # |out| x |in| pairs of two lists that the caller holds
        met = less.withColumn("one", F.lit(1)).join(more.withColumn("one", F.lit(1)), "one").join(near, ["out_id", "in_id"], "left")
        best = met.select("out_id", "in_id", F.coalesce("both", F.coalesce("less", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("delta")).orderBy(F.desc("delta"), "out_id", "in_id").first()
        current[current.index(best["out_id"])] = best["in_id"]
        worth += best["delta"]
        moves.append((len(moves) + 1, best["out_id"], best["in_id"], worth))
    return spark.createDataFrame(moves, "move int, out_id long, in_id long, objective long")


def deployment(incidence: DataFrame, pool: Sequence[int], budget: int | None = None) -> DataFrame:
    """The greedy order of a fixed pool; budgets beyond the pool end with it."""
    size = len(set(pool))
    return greedy_max_cover(incidence.where(F.col("facility_id").isin(sorted(set(pool)))), size if budget is None else min(budget, size))


def greedy_set_cover(incidence: DataFrame) -> DataFrame:
    """Facilities until every demand is covered, each by the number of demands it adds."""
    most = incidence.select("facility_id").distinct().count()
    return greedy_max_cover(incidence.withColumn("weight", F.lit(1).cast("long")), most)


def budget_order(budgets: Sequence[int]) -> list[int]:
    """Without negatives and repeats, in the order asked for."""
    return list(dict.fromkeys(int(b) for b in budgets if b >= 0))


def greedy_curve(incidence: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(budget, objective) of the greedy solution's prefixes, in the order asked for (column position)."""
    asked = budget_order(budgets)
    steps = greedy_max_cover(incidence, max(asked, default=0)).select("step", "covered")
    rows = incidence.sparkSession.createDataFrame([(i, b) for i, b in enumerate(asked)], "position int, budget int")
    met = rows.join(steps, steps["step"] <= rows["budget"], "left")
    return met.groupBy("position", "budget").agg(F.coalesce(F.max("covered"), F.lit(0)).alias("objective"))
