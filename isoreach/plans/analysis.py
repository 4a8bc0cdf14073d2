"""Queries on ranks, bins, errors, timetables, readers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, spatial, timetable
from ..sources import points
from ..streaming import coverage
from . import views
from .queries import _D, _V

COSTS = {"a": 1000.0, "b": 50.0, "c": 20.0, "d": 8.0, "e": 4.0, "f": 2.0, "g": 1.0}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 100).cast("long").alias("x"))


def average_rank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.average_rank_share(_customers(spark, sf_dir), "c_nationkey", "x").select("c_custkey", F.round("rank_share", 9).alias("rank_share"))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.quantile_bins(_customers(spark, sf_dir), "c_nationkey", "x", 4).select("c_custkey", "bin")


def fixed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("c_custkey", analytics.fixed_bins(F.col("x"), [0, 10, 25, 60]).alias("bin"))


def pivot_with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.pivot_with_totals(views.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def error_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("p"))
    out = analytics.error_measures(rows, "l_returnflag", "l_quantity", "p")
    return out.select("l_returnflag", "n", *[F.round(c, 5).alias(c) for c in ("mae", "rmse", "mape")])


def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.trend(views.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "r2")])


def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weighted_sample(views.demand(spark, sf_dir), "demand_id", "weight", 25).select("demand_id", "weight")


def sample_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sample_share(views.demand(spark, sf_dir), "demand_id", 0.1, cap=100).select("demand_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines two courses share an order in, the courses being the remainders of the parts by 40."""
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("c")).distinct()
    a, b = lines.withColumnRenamed("c", "a"), lines.withColumnRenamed("c", "b")
    return a.join(b, "l_orderkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _placed(spark: SparkSession) -> DataFrame:
    return spark.range(38).select(F.col("id").alias("course"), (F.col("id") * 7 % 9).alias("day"), (F.col("id") % 2).alias("slot"))


def timetable_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.pair_costs(_placed(spark), _pairs(spark, sf_dir), COSTS)


def timetable_costs_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.pair_costs(_placed(spark), _pairs(spark, sf_dir), COSTS, formal=False)


def timetable_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetable.clashes(_placed(spark), _pairs(spark, sf_dir))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3).cast("string").alias("c"), (F.col("l_suppkey") % 3).alias("s"))
    wide = lines.groupBy("c").agg(*[F.count(F.when(F.col("s") == i, 1)).alias(str(i)) for i in range(3)])
    return timetable.conflict_pairs(wide, "c", ["0", "1", "2"])


def normalised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.demand(spark, sf_dir).select("demand_id", F.col("lon").cast("string").alias("Longitude"), F.col("lat").alias("LAT"), F.col("weight").alias("headcount"))
    return points.normalised_points(rows, "demand_id")


def distinct_amenities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rows = part.select(key.alias("id"), F.when(key % 3 == 0, "node").otherwise("way").alias("element"), F.col("p_brand").alias("amenity"), F.when(key % 4 != 0, F.concat(F.lit(" N  "), (key % 4).cast("string"))).alias("name"), ((key % 10).cast("double") + 0.5).alias("lon"), F.lit(0.5).alias("lat"))
    return points.distinct_amenities(rows, 1.0).select("id", "amenity", "name")


def flattened_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return points.flattened(events)


def streamed_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = coverage.file_stream(spark, f"{sf_dir}/events.parquet")
    counts = coverage.drained(coverage.window_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "2 days"), "windows")
    return counts.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


def streamed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving = coverage.file_stream(spark, f"{sf_dir}/customer.parquet")
    return coverage.drained_pairs(views.placed_demand(arriving), views.existing(spark, sf_dir), 0.5).select("facility_id", "demand_id")


def catchment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.nearest_join(views.demand(spark, sf_dir), views.existing(spark, sf_dir), "demand_id", "facility_id", 2.0)
    rows = near.join(views.demand(spark, sf_dir).select("demand_id", "weight"), "demand_id")
    out = rows.groupBy("facility_id").agg(F.sum("weight").alias("population"), F.count(F.lit(1)).alias("n"), (F.sum(F.col("weight") * F.col("distance")) / F.sum("weight")).alias("mean"), F.max("distance").alias("far"))
    return out.select("facility_id", "population", "n", F.round("mean", 6).alias("mean"), F.round("far", 6).alias("far"))


QUERIES = {f.__name__: f for f in (
    average_rank_share, quantile_bins, fixed_bins, pivot_with_totals, error_measures, trend, weighted_sample, sample_share, timetable_costs, timetable_costs_joint,
    timetable_clashes, conflict_pairs, normalised_points, distinct_amenities, flattened_events, streamed_window_counts, streamed_pairs, catchment_summary)}

_X = "with c as (select c_custkey, c_nationkey, cast(floor(c_acctbal / 100) as bigint) as x from customer)"
_N = """with l as (select distinct l_orderkey, l_partkey % 40 as c from lineitem), pairs as (select p.c as a, q.c as b, count(*) as n from l p join l q on p.l_orderkey = q.l_orderkey and p.c < q.c group by 1, 2),
placed as (select i as course, i * 7 % 9 as day, i % 2 as slot from range(38) r(i)),
met as (select a, b, n, abs(x.day - y.day) as gap, x.slot = y.slot as same, x.day, x.slot from pairs join placed x on x.course = a join placed y on y.course = b)"""
_GAP = "case gap when 1 then 20 when 2 then 8 when 3 then 4 when 4 then 2 when 5 then {} when 0 then 50 else 0 end"

ORACLE_SQL = {
    "average_rank_share": f"{_X} select c_custkey, round((rank() over (partition by c_nationkey order by x) + (count(*) over (partition by c_nationkey, x) - 1) / 2.0::double) / count(*) over (partition by c_nationkey), 9) as rank_share from c",
    "quantile_bins": f"{_X}, q as (select c_nationkey, quantile_cont(x, 0.25) as a, quantile_cont(x, 0.5) as b, quantile_cont(x, 0.75) as d from c group by 1) select c_custkey, (case when x > a then 1 else 0 end + case when x > b then 1 else 0 end + case when x > d then 1 else 0 end)::int as bin from c join q using (c_nationkey)",
    "fixed_bins": f"{_X} select c_custkey, (case when x > 0 and x <= 10 then 0 when x > 10 and x <= 25 then 1 when x > 25 and x <= 60 then 2 end)::int as bin from c",
    "pivot_with_totals": """select coalesce(o_orderpriority, 'All') as o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P", count(*) as n_all from orders group by rollup (o_orderpriority)""",
    "error_measures": "select l_returnflag, count(*) as n, round(avg(abs(l_extendedprice / 1000 - l_quantity)), 5) as mae, round(sqrt(avg(pow(l_extendedprice / 1000 - l_quantity, 2))), 5) as rmse, round(100 * avg(abs((l_extendedprice / 1000 - l_quantity) / nullif(l_quantity, 0))), 5) as mape from lineitem group by 1",
    "trend": "select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 4) as r2 from lineitem group by 1",
    "timetable_costs": f"{_N} select a, b, gap, n * cast(case when gap = 0 and same then 1000 else {_GAP.format(1)} end as double) as cost from met",
    "timetable_costs_joint": f"{_N} select a, b, gap, n * cast(case when gap = 0 and same then 1000 else 0 end + {_GAP.format(20)} as double) as cost from met",
    "timetable_clashes": f"{_N} select a, b, n, day, slot from met where gap = 0 and same",
    "conflict_pairs": "select cast(l_partkey % 3 as varchar) as a, cast(l_suppkey % 3 as varchar) as b, count(*) as n from lineitem where l_partkey % 3 < l_suppkey % 3 group by 1, 2",
    "normalised_points": f"{_V} select cast(demand_id as varchar) as id, lon, lat, cast(weight as double) as weight from demand",
    "distinct_amenities": "with r as (select p_partkey as id, p_brand as amenity, case when p_partkey % 4 <> 0 then ' N  ' || (p_partkey % 4) end as name, row_number() over (partition by p_brand, p_partkey % 4, p_partkey % 10 order by case when p_partkey % 3 = 0 then 0 else 1 end, p_partkey) as k from part) select id, amenity, name from r where k = 1",
    "flattened_events": "select event_id, cast(json_extract(props, '$.k') as int) as props_k from events",
    "streamed_window_counts": "with e as (select cast(floor(epoch(ts) / 86400) as bigint) * 86400 as start, event_type from events) select start, event_type, count(*) as n from e where start + 86400 <= (select epoch(max(ts)) - 172800 from events) group by 1, 2",
    "streamed_pairs": f"{_V} select e.facility_id, d.demand_id from existing e join demand d on {_D} <= 0.5",
    "catchment_summary": f"{_V}, r as (select d.demand_id, d.weight, e.facility_id, {_D} as dist, row_number() over (partition by d.demand_id order by {_D}, e.facility_id) as k from existing e join demand d on {_D} <= 2.0) select facility_id, cast(sum(weight) as bigint) as population, count(*) as n, round(sum(weight * dist) / sum(weight), 6) as mean, round(max(dist), 6) as far from r where k = 1 group by 1",
}
