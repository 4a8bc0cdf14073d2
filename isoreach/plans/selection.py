"""Queries on coverage and selection of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, cover, discs, solve, spatial
from ..operators.tables import written
from . import views
from .queries import _D, _STEPS, _V

SOLUTION = [3, 7, 11, 40, 90, 131]


def _incidence(spark: SparkSession, sf_dir: str, radius: float = 1.0) -> DataFrame:
    return spatial.range_join(views.candidates(spark, sf_dir), views.demand(spark, sf_dir), radius).select("facility_id", "demand_id", "weight")


def _places(spark: SparkSession, sf_dir: str, radius: float = 1.0) -> tuple[DataFrame, DataFrame, float]:
    """What _incidence is made of, for the operators that need no pairs."""
    return views.candidates(spark, sf_dir), views.demand(spark, sf_dir), radius


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objectives by method and budget, of the orders' prices by priority and month."""
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.month("o_orderdate").alias("budget"), F.floor("o_totalprice").cast("long").alias("x"))
    return rows.groupBy("method", "budget").agg(F.sum("x").alias("objective"))


def coverage_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.demand_lists(*_places(spark, sf_dir, 0.5))


def coverage_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.facility_lists(*_places(spark, sf_dir, 0.5)).select("demand_id", "facilities")


def residual_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = spatial.range_join(views.existing(spark, sf_dir), views.demand(spark, sf_dir), 0.5)
    return cover.uncovered(_incidence(spark, sf_dir), served).groupBy("facility_id").agg(F.sum("weight").alias("gain"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.coverage_counts(*_places(spark, sf_dir), SOLUTION)


def add_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.add_deltas(*_places(spark, sf_dir), SOLUTION)


def drop_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.drop_deltas(*_places(spark, sf_dir), SOLUTION)


def swap_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.swap_deltas(*_places(spark, sf_dir), SOLUTION)


def swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.swap_search(*_places(spark, sf_dir, 2.0), SOLUTION[:3])


def path_relinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.relink(_incidence(spark, sf_dir), SOLUTION[:3], SOLUTION[3:])


def deployment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.deployment(_incidence(spark, sf_dir), SOLUTION[:5])


def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.greedy_set_cover(*_places(spark, sf_dir, 4.0))


def budget_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.greedy_curve(*_places(spark, sf_dir), [3, 1, -2, 5, 3, 0])


def best_by_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.best_by_budget(_curve(spark, sf_dir))


def marginal_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.marginal_gains(_curve(spark, sf_dir))


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.saturation(_curve(spark, sf_dir), 0.95)


def curve_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = _curve(spark, sf_dir)
    return analytics.compare_curves(curve.where("method like '1%'"), curve.where("method like '2%'"))


def falling_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.falling_steps(_curve(spark, sf_dir))


def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small instances: every 12 candidates whose keys follow one another, budgets 1 to 3."""
    sites, people, radius = _places(spark, sf_dir)
    sets = written(discs.covered_sets(sites.withColumn("instance_id", F.floor(F.col("facility_id") / 12).cast("long")), people, radius), "sets")
    budgets = sets.select("instance_id").distinct().withColumn("budget", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    return solve.exact_cover_of_sets(sets, budgets).withColumn("solution", F.array_join("solution", ","))


def location_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts of 6 suppliers and 90 customers whose keys follow one another; every site of a district reaches its customers."""
    sites = views.existing(spark, sf_dir).select(F.floor(F.col("facility_id") / 6).cast("long").alias("district"), F.col("facility_id").alias("site_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    rows = views.demand(spark, sf_dir).withColumn("district", F.floor(F.col("demand_id") / 90).cast("long")).join(sites, "district")
    distance = F.floor(spatial.planar(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")) * 1000).cast("long")
    return solve.location_table(rows.select("district", "site_id", "demand_id", "weight", distance.alias("distance")), 1e6)


def facility_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An island is a nation: all its suppliers and customers. Customers of a nation without suppliers reach none."""
    places = lambda view, key, table, nation: view.join(views.table(spark, sf_dir, table).select(F.col(f"{table[0]}_{key}").alias(view.columns[0]), F.col(nation).alias("island")), view.columns[0])
    sites = places(views.existing(spark, sf_dir), "suppkey", "supplier", "s_nationkey").withColumnRenamed("facility_id", "site_id")
    return solve.facility_location_of_places(sites, places(views.demand(spark, sf_dir), "custkey", "customer", "c_nationkey"), 300.0, 1000.0)


QUERIES = {f.__name__: f for f in (
    coverage_lists, coverage_transpose, residual_gain, coverage_counts, add_deltas, drop_deltas, swap_deltas, swap_search, path_relinking, deployment_order,
    set_cover, budget_curve, best_by_budget, marginal_gains, saturation, curve_difference, falling_steps, exact_cover, location_table, facility_location)}

_IN = ", ".join(map(str, SOLUTION))
_F = "sqrt((f.lon - d.lon) * (f.lon - d.lon) + (f.lat - d.lat) * (f.lat - d.lat))"
_INC = f"{_V}, inc as (select f.facility_id, d.demand_id, d.weight from candidates f join demand d on {_F} <= 1.0)"
_NEAR = _INC.replace("<= 1.0", "<= 0.5")
_TIMES = f"{_INC}, times as (select demand_id, weight, count(*) filter (facility_id in ({_IN})) as times from inc group by 1, 2)"
_CURVE = "with curve as (select o_orderpriority as method, month(o_orderdate) as budget, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as objective from orders group by 1, 2)"
_POOL = _STEPS.replace("from candidates f join", f"from (select * from candidates where facility_id in ({', '.join(map(str, SOLUTION[:5]))})) f join")

ORACLE_SQL = {
    "coverage_lists": f"{_NEAR} select facility_id, cast(count(*) as int) as n, string_agg(demand_id, ',' order by demand_id) as demand from inc group by 1",
    "coverage_transpose": f"{_NEAR} select demand_id, string_agg(facility_id, ',' order by facility_id) as facilities from inc group by 1",
    "residual_gain": f"{_INC} select facility_id, cast(sum(weight) as bigint) as gain from inc where weight > 0 and demand_id not in (select d.demand_id from existing e join demand d on {_D} <= 0.5) group by 1",
    "coverage_counts": f"{_TIMES} select * from times",
    "add_deltas": f"{_TIMES} select facility_id, cast(sum(case when times = 0 then inc.weight else 0 end) as bigint) as delta from inc join times using (demand_id) where facility_id not in ({_IN}) group by 1",
    "drop_deltas": f"{_TIMES} select facility_id, cast(-sum(case when times = 1 then inc.weight else 0 end) as bigint) as delta from inc join times using (demand_id) where facility_id in ({_IN}) group by 1",
    "swap_deltas": f"""{_TIMES}, pairs as (select distinct a.facility_id as out_id, b.facility_id as in_id from inc a join times t on t.demand_id = a.demand_id and times = 1 join inc b on b.demand_id = a.demand_id where a.facility_id in ({_IN}) and b.facility_id not in ({_IN})),
        plus as (select p.out_id, p.in_id, sum(i.weight) as w from pairs p join inc i on i.facility_id = p.in_id join times t on t.demand_id = i.demand_id where times = 0 or (times = 1 and i.demand_id in (select demand_id from inc x where x.facility_id = p.out_id)) group by 1, 2),
        less as (select facility_id, sum(inc.weight) as w from inc join times using (demand_id) where times = 1 and facility_id in ({_IN}) group by 1)
        select out_id, in_id, cast(plus.w - less.w as bigint) as delta from plus join less on less.facility_id = out_id""",
    "deployment_order": f"{_V}{_POOL}, steps as ({' union all '.join(f'select {i} as step, facility_id, gain from best{i} where gain > 0' for i in range(1, 6))}) select step, facility_id, gain, cast(sum(gain) over (order by step) as bigint) as covered from steps",
    "budget_curve": f"{_V}{_STEPS}, steps as ({' union all '.join(f'select {i} as step, gain from best{i}' for i in range(1, 6))}) select cast(p as int) as position, cast(b as int) as budget, cast(coalesce((select sum(gain) from steps where step <= b), 0) as bigint) as objective from (values (0, 3), (1, 1), (2, 5), (3, 0)) v(p, b)",
    "best_by_budget": f"{_CURVE}, r as (select *, row_number() over (partition by budget order by objective desc, method) as k from curve) select cast(budget as int) as budget, method, objective from r where k = 1",
    "marginal_gains": f"{_CURVE} select method, cast(budget as int) as budget, objective, objective - lag(objective, 1, 0) over w as gain, max(objective) over w as best from curve window w as (partition by method order by budget)",
    "saturation": f"{_CURVE}, t as (select *, max(objective) over (partition by method) as top from curve) select method, cast(min(budget) as int) as budget, max(top) as top from t where objective >= 0.95::double * top group by 1",
    "curve_difference": f"{_CURVE} select cast(a.budget as int) as budget, b.objective - a.objective as delta from curve a join curve b on a.budget = b.budget and a.method like '1%' and b.method like '2%'",
    "falling_steps": f"{_CURVE}, l as (select method, cast(budget as int) as budget, objective, lag(objective) over (partition by method order by budget) as was from curve) select * from l where objective < was",
    "location_table": f"""{_V}, m as (select e.facility_id // 6 as district, dense_rank() over (partition by e.facility_id // 6 order by e.facility_id) - 1 as bit, d.demand_id, d.weight, cast(floor({_D} * 1000) as bigint) as dist from existing e join demand d on d.demand_id // 90 = e.facility_id // 6),
        sizes as (select district, max(bit) + 1 as n from m group by 1),
        near as (select district, mask, demand_id, any_value(weight) * min(dist) as cost from m join sizes using (district), range(1, 64) r(mask) where mask < (1 << cast(n as int)) and mask & (1 << cast(bit as int)) > 0 group by 1, 2, 3)
        select district, cast(mask as int) as mask, cast(bit_count(mask) as int) as n_open, sum(cost) + bit_count(mask) * 1e6::double as cost from near group by district, mask""",
}
