"""Registered queries over the domain views, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cover, discs, network, polygons, population, spatial
from . import views

RING = [(1.0, 1.0), (9.0, 2.0), (7.5, 5.0), (9.0, 9.0), (4.0, 6.5), (1.0, 8.0)]


def _pairs(spark: SparkSession, sf_dir: str, radius: float = 1.0) -> DataFrame:
    return spatial.range_join(views.existing(spark, sf_dir), views.demand(spark, sf_dir), radius)


def served_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.served_population(views.existing(spark, sf_dir), views.demand(spark, sf_dir), 1.0)


def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 0.5).select("facility_id", "demand_id")


def nearest_facility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.nearest_join(views.demand(spark, sf_dir), views.existing(spark, sf_dir), "demand_id", "facility_id", 16.0)
    return out.select("demand_id", "facility_id", F.round("distance", 6).alias("distance"))


def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _pairs(spark, sf_dir, 0.5)
    km = spatial.haversine_km(F.col("lon"), F.col("lat"), F.col("right_lon"), F.col("right_lat"))
    return near.select("facility_id", "demand_id", F.round(km, 4).alias("km"))


def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.filter_bbox(views.demand(spark, sf_dir), 2.0, 3.0, 6.0, 7.0).select("demand_id")


def within_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.demand(spark, sf_dir).where(spatial.strictly_within(F.col("lon"), F.col("lat"), RING)).select("demand_id")


def group_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.group_population(views.demand(spark, sf_dir), 0)


def block_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.demand(spark, sf_dir).select((F.col("demand_id") % 37).alias("row"), (F.col("demand_id") % 41).alias("col"), F.col("weight").alias("value"))
    return population.block_sum(cells, 4, 37, 41)


def access_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.nearest_join(views.demand(spark, sf_dir), views.existing(spark, sf_dir), "demand_id", "facility_id", 2.0)
    rows = views.demand(spark, sf_dir).join(near, "demand_id", "left")
    return population.access_summary(rows, [0.25, 0.5, 1.0, 2.0])


def weighted_median_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", (1 + F.col("c_custkey") % 7).alias("w"))
    return population.weighted_quantile(rows, "c_nationkey", "c_acctbal", "w", 0.5)


def cumulative_catchment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, 0.5).withColumn("distance", F.ceil(F.col("distance") * 10).cast("long"))
    return cover.catchment_cumulative(pairs)


def max_cover_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.greedy_max_cover(views.candidates(spark, sf_dir), views.demand(spark, sf_dir), 1.0, 5)


def _diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rings about each facility; no place of the tables lies on one."""
    rings = F.explode(F.array(*[F.struct(F.lit(d).alias("distance_id"), F.lit(r).alias("r")) for d, r in (("near", 0.2505), ("far", 0.7505))])).alias("k")
    at = views.existing(spark, sf_dir).select("facility_id", "lon", "lat", rings)
    corner = lambda dx, dy: F.struct((F.col("lon") + dx * F.col("k.r")).alias("x"), (F.col("lat") + dy * F.col("k.r")).alias("y"))
    return at.select("facility_id", "k.distance_id", F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1)).alias("ring"))


def served_by_isopolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.demand(spark, sf_dir).withColumnRenamed("demand_id", "point_id")
    out = polygons.served_by_isopolygons(points, _diamonds(spark, sf_dir), 1.0)
    return out.select("facility_id", "distance_id", F.array_join("point_ids", ",").alias("point_ids"))


def clipped_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.clip(views.demand(spark, sf_dir), _diamonds(spark, sf_dir), 1.0).select("demand_id", "weight")


def road_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.connected_components(views.edges(spark, sf_dir))


def road_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.existing(spark, sf_dir).where("facility_id % 17 <> 0").select(F.col("facility_id").alias("source"))
    return network.bounded_distances(views.edges(spark, sf_dir), sources, 20.0)


QUERIES = {f.__name__: f for f in (
    served_population, range_pairs, nearest_facility, haversine_pairs, bbox_filter, within_polygon, group_population, block_sum,
    access_summary, weighted_median_balance, cumulative_catchment, max_cover_greedy, road_components, road_distances, served_by_isopolygons, clipped_demand)}

_V = "with recursive " + views.SQL
_D = "sqrt((e.lon - d.lon) * (e.lon - d.lon) + (e.lat - d.lat) * (e.lat - d.lat))"
_EDGES = """,
nodes as (select c_custkey as n from customer where c_custkey % 17 <> 0),
half as (select n as u, n + s as v, cast(1 + n * 37 % 11 as double) as length from nodes, (values (1), (50)) t(s) where n + s in (select n from nodes)),
edges as (select u, v, length from half union all select v, u, length from half)"""
_STEPS = "".join(
    f""",
left{i} as materialized ({'select distinct f.facility_id, d.demand_id, d.weight from candidates f join demand d on sqrt((f.lon - d.lon) * (f.lon - d.lon) + (f.lat - d.lat) * (f.lat - d.lat)) <= 1.0' if i == 1 else f'select * from left{i - 1} where demand_id not in (select l.demand_id from left{i - 1} l join best{i - 1} b using (facility_id))'}),
best{i} as materialized (select facility_id, cast(sum(weight) as bigint) as gain from left{i} group by 1 order by 2 desc, 1 limit 1)"""
    for i in range(1, 6))
_CROSS = " + ".join(
    f"(case when ({y1} > lat) <> ({y2} > lat) and {x2 - x1} * (lat - {y1}) - {y2 - y1} * (lon - {x1}) {'>' if y2 > y1 else '<'} 0 then 1 else 0 end)"
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))
_ON = " or ".join(
    f"({x2 - x1} * (lat - {y1}) - {y2 - y1} * (lon - {x1}) = 0 and lon between {min(x1, x2)} and {max(x1, x2)} and lat between {min(y1, y2)} and {max(y1, y2)})"
    for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))

ORACLE_SQL = {
    "served_population": f"{_V} select e.facility_id, cast(sum(d.weight) as bigint) as served, count(*) as n_demand, 100.0::double * sum(d.weight) / (select sum(weight) from demand) as percent from existing e join demand d on {_D} <= 1.0 group by 1",
    "range_pairs": f"{_V} select e.facility_id, d.demand_id from existing e join demand d on {_D} <= 0.5",
    "nearest_facility": f"{_V}, r as (select d.demand_id, e.facility_id, {_D} as dist, row_number() over (partition by d.demand_id order by {_D}, e.facility_id) as k from existing e join demand d on {_D} <= 16.0) select demand_id, facility_id, round(dist, 6) as distance from r where k = 1",
    "haversine_pairs": f"{_V} select e.facility_id, d.demand_id, round(2 * {spatial.EARTH_KM}::double * asin(sqrt(least(1.0::double, sin(radians(d.lat - e.lat) / 2) * sin(radians(d.lat - e.lat) / 2) + cos(radians(e.lat)) * cos(radians(d.lat)) * sin(radians(d.lon - e.lon) / 2) * sin(radians(d.lon - e.lon) / 2)))), 4) as km from existing e join demand d on {_D} <= 0.5",
    "bbox_filter": f"{_V} select demand_id from demand where lon between 2 and 6 and lat between 3 and 7",
    "within_polygon": f"{_V} select demand_id from demand where ({_CROSS}) % 2 = 1 and not ({_ON})",
    "group_population": f"{_V} select round_even(lon, 0) as lon, round_even(lat, 0) as lat, cast(sum(weight) as bigint) as weight from demand group by 1, 2",
    "block_sum": f"{_V} select demand_id % 37 // 4 as row, demand_id % 41 // 4 as col, cast(sum(weight) as bigint) as value from demand where demand_id % 37 < 36 and demand_id % 41 < 40 group by 1, 2",
    "access_summary": f"{_V}, near as (select d.demand_id, min({_D}) as dist from existing e join demand d on {_D} <= 2.0 group by 1), r as (select d.weight, n.dist from demand d left join near n using (demand_id)) select cast(t as double) as threshold, cast(sum(case when dist <= t then weight else 0 end) as bigint) as within, 100.0::double * sum(case when dist <= t then weight else 0 end) / sum(weight) as percent from r, (values (0.25), (0.5), (1.0), (2.0)) v(t) group by t",
    "weighted_median_balance": """with s as (select c_nationkey, c_acctbal as x, sum(1 + c_custkey % 7) as w from customer where c_acctbal is not null group by 1, 2),
        p as (select *, sum(w) over (partition by c_nationkey order by x) as cum, sum(w) over (partition by c_nationkey) as t from s),
        a as (select c_nationkey, x, (cum - w / 2.0::double) / t as mid from p),
        n as (select *, lead(mid) over z as nat, lead(x) over z as nx from a window z as (partition by c_nationkey order by x))
        select c_nationkey, coalesce(max(case when mid <= 0.5 and nat > 0.5 then x + (nx - x) * (0.5::double - mid) / (nat - mid) when mid <= 0.5 and nat is null then x end), min(x)) as quantile from n group by 1""",
    "cumulative_catchment": f"{_V}, b as (select e.facility_id, cast(ceil({_D} * 10) as bigint) as distance, sum(d.weight) as w from existing e join demand d on {_D} <= 0.5 group by 1, 2) select facility_id, distance, cast(sum(w) over (partition by facility_id order by distance) as bigint) as cumulative from b",
    "max_cover_greedy": f"{_V}{_STEPS}, steps as ({' union all '.join(f'select {i} as step, facility_id, gain from best{i} where gain > 0' for i in range(1, 6))}) select step, facility_id, gain, cast(sum(gain) over (order by step) as bigint) as covered from steps",
    "road_components": f"{_V}{_EDGES}, reach(node, low) as (select u, u from edges union select k.v, r.low from reach r join edges k on k.u = r.node) select node, min(low) as component from reach group by 1",
    "road_distances": f"{_V}{_EDGES}, reach(source, node, distance) as (select facility_id, facility_id, 0.0::double from existing where facility_id % 17 <> 0 union select r.source, e.v, r.distance + e.length from reach r join edges e on e.u = r.node where r.distance + e.length <= 20) select source, node, min(distance) as distance from reach group by 1, 2",
}

_RINGS = "rings as (select facility_id, distance_id, r, lon, lat from existing, (values ('near', 0.2505::double), ('far', 0.7505::double)) t(distance_id, r))"
ORACLE_SQL["served_by_isopolygons"] = f"""with {views.SQL}, {_RINGS}
select r.facility_id, r.distance_id, coalesce(string_agg(cast(d.demand_id as varchar), ',' order by d.demand_id), '') as point_ids
from rings r left join demand d on abs(d.lon - r.lon) + abs(d.lat - r.lat) < r.r group by 1, 2"""
ORACLE_SQL["clipped_demand"] = f"""with {views.SQL}, {_RINGS}
select demand_id, weight from demand d where exists (select 1 from rings r where abs(d.lon - r.lon) + abs(d.lat - r.lat) <= r.r)"""
