"""Queries on roads and distance matrices."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cover, matrix, network, solve
from . import views
from .queries import _D, _EDGES, _V

SPEEDS = {"residential": 30.0, "primary": 80.0}
SURFACES = {"gravel": 0.5}


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 25 customer keys and columns of every 25th; a seventh is one-way, some against their nodes."""
    keys = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    rows = keys.where("k % 25 = 0").select(F.col("k").alias("way_id"), F.sequence("k", F.col("k") + 24).alias("nodes"))
    cols = keys.where("k % 100 < 4 and k % 100 > 0").select((-F.col("k")).alias("way_id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("k") + i * 25).alias("nodes"))
    tag = F.when(F.col("way_id") % 7 == 0, "Yes").when(F.col("way_id") % 7 == 1, "-1")
    return rows.union(cols).withColumns({"oneway": tag, "junction": F.when(F.col("way_id") % 11 == 0, "roundabout")})


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.demand(spark, sf_dir).where("demand_id % 17 <> 0").select(F.col("demand_id").alias("node_id"), "lon", "lat")


def way_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.way_edges(_ways(spark, sf_dir), _nodes(spark, sf_dir)).withColumn("length", F.round("length", 2))


def simplified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.simplified_edges(_ways(spark, sf_dir), _nodes(spark, sf_dir)).withColumn("length", F.round("length", 2))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("u")
    return views.edges(spark, sf_dir).withColumns({
        "maxspeed": F.when(u % 5 == 0, F.concat((20 + u % 60).cast("string"), F.when(u % 2 == 0, F.lit(" mph")).otherwise(F.lit("")))),
        "highway": F.when(u % 3 == 0, "residential").when(u % 3 == 1, "primary"), "surface": F.when(u % 4 == 0, "gravel")})


def edge_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.edge_speeds(_tagged(spark, sf_dir), SPEEDS, 50.0, SURFACES, 0.8)
    return out.select("u", "v", F.round("speed_kph", 6).alias("speed_kph"), F.round("travel_time_s", 6).alias("travel_time_s"))


def density_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.density_factor(views.existing(spark, sf_dir).withColumnRenamed("facility_id", "edge_id"), views.demand(spark, sf_dir), 1.0, 3.0, 10000.0, 0.5)


def ranked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.ranked_components(views.edges(spark, sf_dir))


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.existing(spark, sf_dir).where("facility_id % 17 <> 0").select(F.col("facility_id").alias("source"))
    return network.bounded_distances(views.edges(spark, sf_dir), sources, 15.0)


def reachable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.reachable_edges(views.edges(spark, sf_dir), _reached(spark, sf_dir))


def predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.predecessors(views.edges(spark, sf_dir), _reached(spark, sf_dir))


def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    via = network.predecessors(views.edges(spark, sf_dir), _reached(spark, sf_dir))
    return network.routes(via, via).select("source", "node", F.array_join("path", ",").alias("path"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, float]:
    """Targets and sources with their nodes, and the threshold in km."""
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        k = F.col(key)
        return df.select(k.alias(name), "lon", "lat", (k % 50).alias("node"), ((k % 7).cast("double") / 2).alias("snap"), (k % 3 - 1).alias("component"))

    return side(views.demand(spark, sf_dir), "demand_id", "target_id"), side(views.existing(spark, sf_dir), "facility_id", "source_id"), 100.0


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.candidate_pairs(*_sides(spark, sf_dir), 5.0)


def _roads(pairs: DataFrame) -> DataFrame:
    """Stands for a router: the path between two nodes is as long as their numbers are apart; some have none."""
    return pairs.withColumn("road", F.abs(F.col("target_node") - F.col("source_node")).cast("double")).where("(target_node + source_node) % 10 <> 0")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("target_id", "source_id")


def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _sides(spark, sf_dir)
    return matrix.distances(*sides, _roads(matrix.asked_pairs(*sides, 5.0)), 20.0, 5.0, 1.5)


def cached_node_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node pairs that a cache misses once those of even target nodes are in it, twice."""
    cache = matrix.NodePairCache(spark, f"{cover.shared_folder(spark)}/node-pairs-{uuid.uuid4().hex}")
    pairs = cover.written(matrix.node_pairs(_candidates(spark, sf_dir)), "node-pairs")
    known = _roads(pairs).where("target_node % 2 = 0")
    for _ in range(2):
        cache.put(known)
    cache.compact()
    hits, misses = cache.split(pairs)
    return hits.select("target_node", "source_node", "road").union(misses.select("target_node", "source_node", F.lit(None).cast("double")))


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "lineitem")
    met = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.floor("l_extendedprice").cast("long").alias("cost")).join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    return met.select((F.col("o_custkey") % 120).alias("origin"), (F.col("l_suppkey") % 120).alias("destination"), "cost")


def symmetric_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.symmetric_costs(_legs(spark, sf_dir))


def directed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.directed_costs(_legs(spark, sf_dir))


def dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legs(spark, sf_dir).select(F.col("origin").alias("target_id"), F.col("destination").alias("source_id"), F.col("cost").alias("total"))
    return matrix.dense(rows, [0, 1, 2, 5, 9])


def closest_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _legs(spark, sf_dir).select(F.col("origin").alias("target_id"), F.col("destination").alias("source_id"), (F.col("destination") % 3).alias("layer"), F.col("cost").alias("total"))
    return matrix.closest_by_layer(rows)


def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = matrix.directed_costs(_legs(spark, sf_dir)).select("origin", "destination", F.col("cost").alias("length"), (F.col("cost") % 97).alias("time"))
    return matrix.compare_routes(legs.where("origin % 4 <> 0"), legs.where("origin % 4 <> 1").withColumn("time", F.col("time") + 1))


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suppliers, a tour for every 9 whose keys follow one another."""
    return views.existing(spark, sf_dir).select(F.floor(F.col("facility_id") / 9).cast("long").alias("tour_id"), F.col("facility_id").alias("stop_id"), "lon", "lat")


def tour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = matrix.directed_costs(_legs(spark, sf_dir)).select(F.col("origin").alias("from_id"), F.col("destination").alias("to_id"), F.col("cost").cast("double").alias("road"))
    return matrix.tour_distances(_stops(spark, sf_dir), legs).withColumn("distance_m", F.round("distance_m", 2))


def tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = _stops(spark, sf_dir)
    table = matrix.tour_distances(stops, spark.createDataFrame([], "from_id long, to_id long, road double"))
    depots = stops.groupBy("tour_id").agg(F.min("stop_id").alias("depot_id"))
    return solve.tours(table, depots, "exact").withColumn("length", F.round("length", 2))


QUERIES = {f.__name__: f for f in (
    way_edges, simplified_edges, edge_speeds, density_factors, ranked_components, reachable_edges, predecessors, shortest_routes, candidate_pairs, distance_matrix,
    cached_node_pairs, symmetric_costs, directed_costs, dense_matrix, closest_by_layer, route_comparison, tour_distances, tours)}


def _km(a: str, b: str) -> str:
    """The haversine in SQL between places a and b."""
    x, y = f"radians({b}lat - {a}lat) / 2", f"radians({b}lon - {a}lon) / 2"
    return f"2 * 6371.0088::double * asin(sqrt(least(1.0::double, sin({x}) * sin({x}) + cos(radians({a}lat)) * cos(radians({b}lat)) * sin({y}) * sin({y}))))"


_WAYS = _V + f""",
ways as (select c_custkey as way_id, range(c_custkey, c_custkey + 25) as nodes from customer where c_custkey % 25 = 0
  union all select -c_custkey, [c_custkey, c_custkey + 25, c_custkey + 50, c_custkey + 75] from customer where c_custkey % 100 between 1 and 3),
dirs as (select way_id, way_id % 7 <> 1 as fwd, way_id % 7 = 1 or not (way_id % 7 = 0 or way_id % 11 = 0) as bwd from ways),
refs as (select way_id, unnest(range(len(nodes))) as pos, unnest(nodes) as node_id from ways),
placed as (select way_id, pos, node_id, lon, lat from refs join demand on demand_id = node_id where demand_id % 17 <> 0),
pairs as (select *, lead(node_id) over z as v, lead(lon) over z as nlon, lead(lat) over z as nlat from placed window z as (partition by way_id order by pos)),
steps as (select way_id, pos, node_id as u, v, 1000 * {_km('', 'n')} as length from pairs where v is not null and v <> node_id),
uses as (select node_id as u, count(*) as n from refs group by 1),
cut as (select s.*, sum(case when n > 1 then 1 else 0 end) over (partition by way_id order by pos) as run from steps s join uses using (u) where length > 0),
runs as (select way_id, arg_min(u, pos) as u, arg_max(v, pos) as v, sum(length) as length from cut group by way_id, run)"""
_BOTH = "select way_id, u, v, round(length, 2) as length from {0} join dirs using (way_id) where fwd and u <> v union all select way_id, v, u, round(length, 2) from {0} join dirs using (way_id) where bwd and u <> v"
_REACH = f"""{_V}{_EDGES}, reach(source, node, distance) as (select facility_id, facility_id, 0.0::double from existing where facility_id % 17 <> 0 union select r.source, e.v, r.distance + e.length from reach r join edges e on e.u = r.node where r.distance + e.length <= 15),
near as (select source, node, min(distance) as distance from reach group by 1, 2),
pred as (select n.source, n.node, n.distance, min(b.node) as via from near n left join edges e on e.v = n.node and n.node <> n.source left join near b on b.source = n.source and b.node = e.u and b.distance + e.length = n.distance group by 1, 2, 3)"""
_CAND = f"""{_V}, cand as (select d.demand_id as t, e.facility_id as s, d.demand_id % 50 as tn, e.facility_id % 50 as sn, (d.demand_id % 7) / 2.0::double as ts, (e.facility_id % 7) / 2.0::double as ss from existing e join demand d
  on {_D} <= degrees(100.0::double / 6367.0::double) and (d.demand_id % 3 = 0 or e.facility_id % 3 = 0 or d.demand_id % 3 = e.facility_id % 3) where ts + ss <= 5)"""
_LEGS = "with legs as (select o_custkey % 120 as origin, l_suppkey % 120 as destination, cast(floor(l_extendedprice) as bigint) as cost from lineitem join orders on o_orderkey = l_orderkey), directed as (select origin, destination, min(cost) as cost from legs group by 1, 2)"
_SPEED = "case when u % 5 = 0 then (20 + u % 60) * (case when u % 2 = 0 then 1.609344::double else 1 end) when u % 3 = 0 then 30 when u % 3 = 1 then 80 else 50 end * 0.8::double * case when u % 4 = 0 then 0.5::double else 1 end"

ORACLE_SQL = {
    "way_edges": f"{_WAYS} {_BOTH.format('(select * from steps where length > 0)')}",
    "simplified_edges": f"{_WAYS} {_BOTH.format('runs')}",
    "edge_speeds": f"{_V}{_EDGES} select u, v, round({_SPEED}, 6) as speed_kph, round(length / (({_SPEED}) / 3.6::double), 6) as travel_time_s from edges",
    "density_factors": f"{_V}, w as (select e.facility_id as edge_id, coalesce(sum(d.weight), 0) / 3.0::double as density from existing e left join demand d on {_D} <= 1.0 group by 1) select *, case when density >= 10000 then 0.5::double else 1.0::double end as density_factor from w",
    "ranked_components": f"{_V}{_EDGES}, reach(node, low) as (select u, u from edges union select k.v, r.low from reach r join edges k on k.u = r.node), c as (select node, min(low) as c from reach group by 1), s as (select c, row_number() over (order by count(*) desc, c) - 1 as component_id from c group by c) select node, component_id from c join s using (c)",
    "reachable_edges": f"{_REACH} select a.source, e.u, e.v, e.length from edges e join near a on a.node = e.u join near b on b.node = e.v and b.source = a.source",
    "predecessors": f"{_REACH} select * from pred",
    "shortest_routes": f"{_REACH}, back(source, node, here, path) as (select source, node, node, cast(node as varchar) from pred union all select b.source, b.node, p.via, p.via || ',' || b.path from back b join pred p on p.source = b.source and p.node = b.here where b.here <> b.source) select source, node, path from back where here = source",
    "candidate_pairs": f"{_CAND} select t as target_id, s as source_id from cand",
    "distance_matrix": f"{_CAND} select t as target_id, s as source_id, ts * 1.5::double + abs(tn - sn) + ss * 1.5::double as total from cand where (tn + sn) % 10 <> 0 and ts * 1.5::double + abs(tn - sn) + ss * 1.5::double <= 20",
    "cached_node_pairs": f"{_CAND} select distinct tn as target_node, sn as source_node, case when tn % 2 = 0 and (tn + sn) % 10 <> 0 then cast(abs(tn - sn) as double) end as road from cand",
    "symmetric_costs": f"{_LEGS} select least(origin, destination) as a, greatest(origin, destination) as b, min(cost) as cost from legs where origin <> destination group by 1, 2",
    "directed_costs": f"{_LEGS} select * from directed",
    "dense_matrix": f"{_LEGS} select origin as target_id, {', '.join(f'min(case when destination = {s} then cost end) as s{s}' for s in (0, 1, 2, 5, 9))} from legs group by 1",
    "closest_by_layer": f"{_LEGS}, r as (select origin as target_id, destination % 3 as layer, destination as source_id, cost as total, row_number() over (partition by origin, destination % 3 order by cost, destination) as k from legs) select target_id, layer, source_id, total from r where k = 1",
    "route_comparison": f"{_LEGS}, a as (select origin, destination, cost as length_a, cost % 97 as time_a from directed where origin % 4 <> 0), b as (select origin, destination, cost as length_b, cost % 97 + 1 as time_b from directed where origin % 4 <> 1) select *, case when time_b is null then 'left' when time_a is null then 'right' else 'both' end as state from a full join b using (origin, destination)",
    "tour_distances": f"{_LEGS}, {views.SQL}, stops as (select facility_id // 9 as tour_id, facility_id as id, lon, lat from existing) select a.tour_id, a.id as from_id, b.id as to_id, case when a.id = b.id then 0.0::double else round(coalesce(cost, {_km('a.', 'b.')} * 1350.0::double), 2) end as distance_m, case when a.id = b.id then 'identity' when cost is not null then 'road' else 'fallback' end as distance_source from stops a join stops b using (tour_id) left join directed on origin = a.id and destination = b.id",
}
