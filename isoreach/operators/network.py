"""Road network operators: ways, speeds, components and bounded shortest paths as joins and aggregations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import dense_ids
from .cover import written
from .spatial import haversine_km, range_join


def parse_maxspeed(text: Column) -> Column:
    """Km/h of a maxspeed tag: its first number, times 1.609344 if it says mph anywhere."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1)
    return F.when(number != "", number.cast("double") * F.when(F.lower(text).contains("mph"), 1.609344).otherwise(1.0))


def least_parallel_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (u, v): the shortest."""
    return edges.groupBy("u", "v").agg(F.min("length").alias("length"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable along edges in either direction. Least labels of
    the neighbours, then of the label's own label, until none falls; rounds are written tables."""
    both = written(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("low"))
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = written(labels.join(near, "node").join(far, "component", "left").select("node", F.least("low", "component", "far").alias("new"), "component"), "labels")
        labels = step.select("node", F.col("new").alias("component"))
        if not step.where("new < component").limit(1).count():
            return labels


def bounded_distances(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """(source, node, distance) for all nodes within limit of each source (column source), inclusive.
    The frontier holds only what got nearer in the last round, for all sources at once."""
    best = least_parallel_edges(edges).where(F.col("length") <= limit)
    roads = written(best, "roads")
    known = written(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")).distinct(), "known")
    while True:
        fresh = known.where("fresh").drop("fresh")
        reached = fresh.join(roads, fresh["node"] == roads["u"]).select("source", F.col("v").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), F.lit(True).alias("fresh")).where(F.col("distance") <= limit)
        # of equal distances the known one stands, and is not fresh
        both = known.withColumn("fresh", F.lit(False)).union(reached)
        known = written(both.groupBy("source", "node").agg(F.min(F.struct("distance", "fresh")).alias("b")).select("source", "node", "b.distance", "b.fresh"), "known")
        if not known.where("fresh").limit(1).count():
            return known.drop("fresh")


# Spellings of the oneway tag.
ONEWAY_FORWARD = ["yes", "true", "1"]
ONEWAY_REVERSE = ["-1", "reverse"]


def directions(ways: DataFrame) -> DataFrame:
    """Adds forward and backward: whether a way (oneway, junction) is passable along and against its nodes."""
    tag = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    against = tag("oneway").isin(ONEWAY_REVERSE)
    single = tag("oneway").isin(ONEWAY_FORWARD) | (tag("junction") == "roundabout")
    return ways.withColumns({"forward": ~against, "backward": against | ~single})


def _steps(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """A way's consecutive nodes that have a place: way_id, at, u, v, length in metres. A node without
    a place is left out before pairing, so its neighbours are joined."""
    refs = ways.select("way_id", F.posexplode("nodes").alias("at", "node_id"))
    placed = refs.join(nodes.select("node_id", "lon", "lat").dropDuplicates(["node_id"]), "node_id")
    w = Window.partitionBy("way_id").orderBy("at")
    pairs = placed.select("way_id", "at", F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v"), "lon", "lat", F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2"))
    metres = 1000 * haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    return pairs.where("v is not null").select("way_id", "at", "u", "v", metres.alias("length")).where("u <> v and length > 0")


def _directed(found: DataFrame, ways: DataFrame) -> DataFrame:
    tagged = found.join(directions(ways).drop("nodes"), "way_id")
    return tagged.where("forward").select("way_id", "u", "v", "length").union(tagged.where("backward").select("way_id", F.col("v").alias("u"), F.col("u").alias("v"), "length"))


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges between consecutive nodes of ways (way_id, nodes, oneway, junction)."""
    return _directed(_steps(ways, nodes).drop("at"), ways)


def simplified_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Directed edges between the ends of ways and nodes that are used more than once, with the shape
    nodes between summed into length; a run that ends where it began gives no edge."""
    used = ways.select(F.explode("nodes").alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("uses"))
    w = Window.partitionBy("way_id").orderBy("at")
    cut = _steps(ways, nodes).join(used, "u").withColumn("run", F.sum((F.col("uses") > 1).cast("int")).over(w))
    runs = cut.groupBy("way_id", "run").agg(F.min_by("u", "at").alias("u"), F.max_by("v", "at").alias("v"), F.sum("length").alias("length"))
    return _directed(runs.where("u <> v").drop("run"), ways)


def edge_speeds(edges: DataFrame, by_highway: Mapping[str, float], fallback: float, by_surface: Mapping[str, float] | None = None, general: float = 1.0) -> DataFrame:
    """Adds speed_kph and travel_time_s to edges (length, maxspeed, highway, surface): the tag's speed,
    else the highway class's, else the fallback; times the general and the surface factor, and times
    density_factor where edges have it."""
    if fallback <= 0 or general <= 0:
        raise ValueError("speeds and factors must be positive")
    of = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.coalesce(F.col(c), F.lit(""))).cast("double") if m else F.lit(None).cast("double")
    speed = F.coalesce(parse_maxspeed(F.col("maxspeed")), of(by_highway, "highway"), F.lit(float(fallback))) * F.lit(float(general)) * F.coalesce(of(by_surface, "surface"), F.lit(1.0))
    if "density_factor" in edges.columns:
        speed = speed * F.coalesce("density_factor", F.lit(1.0))
    return edges.withColumn("speed_kph", speed).withColumn("travel_time_s", F.col("length") / (F.col("speed_kph") / 3.6))


def density_factor(midpoints: DataFrame, population: DataFrame, radius: float, area_km2: float, threshold: float, factor: float) -> DataFrame:
    """(edge_id, density, density_factor) of midpoints (edge_id, lon, lat): the weight within radius, per
    km2; dense places get the factor, the others 1."""
    if min(radius, area_km2, threshold, factor) <= 0:
        raise ValueError("density parameters must be positive")
    near = range_join(midpoints.select("edge_id", "lon", "lat"), population.select("lon", "lat", "weight"), radius).groupBy("edge_id").agg(F.sum("weight").alias("w"))
    density = (F.coalesce("w", F.lit(0)) / F.lit(float(area_km2))).alias("density")
    out = midpoints.select("edge_id").join(near, "edge_id", "left").select("edge_id", density)
    return out.withColumn("density_factor", F.when(F.col("density") >= threshold, float(factor)).otherwise(1.0))


def ranked_components(edges: DataFrame) -> DataFrame:
    """(node, component_id): components numbered from 0 by descending number of nodes, ties to the
    smaller least node. Only one row of each component is ranked."""
    labels = connected_components(edges)
    ranks = dense_ids(labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("component")], "component_id")
    return labels.join(ranks.select("component", "component_id"), "component").select("node", "component_id")


def reachable_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(source, u, v, length): the edges with both ends among the reached (source, node) of a source."""
    from_ = reached.select("source", F.col("node").alias("u"))
    return least_parallel_edges(edges).join(from_, "u").join(reached.select("source", F.col("node").alias("v")), ["source", "v"], "left_semi").select("source", "u", "v", "length")


def predecessors(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Adds via to (source, node, distance): the smallest node before it on a shortest path, null at the
    source. It is read off the finished distances, so no path is carried while they are found."""
    before = reached.select("source", F.col("node").alias("u"), F.col("distance").alias("d"))
    tight = least_parallel_edges(edges).join(before, "u").select("source", F.col("v").alias("node"), "u", (F.col("d") + F.col("length")).alias("distance"))
    via = reached.join(tight, ["source", "node", "distance"]).where("node <> source").groupBy("source", "node").agg(F.min("u").alias("via"))
    return reached.join(via, ["source", "node"], "left")


def routes(via: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, node, path): the nodes from source to each wanted (source, node), by the via column of
    predecessors. All routes go back by one edge a round; unreached ones are left out."""
    back = written(via.select("source", F.col("node").alias("at"), "via"), "via")
    open_ = written(wanted.select("source", "node", F.col("node").alias("at"), F.array("node").alias("path")).join(back.select("source", "at"), ["source", "at"], "left_semi").select("source", "node", "at", "path"), "routes")
    done = open_.where("at = source")
    while open_.where("at <> source").limit(1).count():
        moved = open_.where("at <> source").join(back, ["source", "at"])
        open_ = written(moved.select("source", "node", F.col("via").alias("at"), F.concat(F.array("via"), "path").alias("path")), "routes")
        done = done.union(open_.where("at = source"))
    return done.select("source", "node", "path")
