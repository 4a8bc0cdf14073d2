"""Sparse distance matrices: candidate pairs, assembly from node distances, a cache of node pairs, costs."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spatial import cell_parts, dealt_parts, haversine_km, range_join, read_parts, squares
from .tables import written

#: Radius of the flat prefilter; degrees of longitude count as much as degrees of latitude.
PREFILTER_KM = 6367.0
#: Files of the cache are dealt by target node modulo this.
CACHE_BUCKETS = 256
#: Roads of so many node pairs are broadcast.
MANY_ROADS = 1 << 18


def candidate_pairs(targets: DataFrame, sources: DataFrame, threshold_km: float, max_total: float | None = None) -> DataFrame:
    """(target_id, source_id) within the flat prefilter. targets: target_id, lon, lat, node, snap and
    perhaps component; sources alike. Pairs whose snaps alone exceed max_total go, and so do those of
    different components where both are known (0 or more)."""
    side = lambda df, x: df.select(F.col(f"{x}_id"), "lon", "lat", F.col("node").alias(f"{x}_node"), F.col("snap").alias(f"{x}_snap"), (F.col("component") if "component" in df.columns else F.lit(-1)).alias(f"{x}_component"))
    met = range_join(side(sources, "source"), side(targets, "target"), math.degrees(threshold_km / PREFILTER_KM))
    same = (F.col("source_component") < 0) | (F.col("target_component") < 0) | (F.col("source_component") == F.col("target_component"))
    met = met.where(F.coalesce(same, F.lit(True)))
    if max_total is not None:
        met = met.where(F.col("source_snap") + F.col("target_snap") <= max_total)
    return met.select("target_id", "source_id", "target_node", "source_node", "target_snap", "source_snap")


def node_pairs(candidates: DataFrame) -> DataFrame:
    """The distinct (target_node, source_node) that a router is asked for."""
    return candidates.select("target_node", "source_node").distinct()


def assemble(candidates: DataFrame, roads: DataFrame, max_total: float, snap_factor: float = 1.0) -> DataFrame:
    """(target_id, source_id, total): both snaps times the factor, and the road between the nodes;
    pairs without a road or beyond max_total (inclusive bound) are left out. Up to MANY_ROADS node pairs are
    sent to the candidates, which then are not shuffled."""
    held = written(roads, "roads")
    if held.limit(MANY_ROADS + 1).count() <= MANY_ROADS:
        held = F.broadcast(held)
    total = F.col("target_snap") * snap_factor + F.col("road") + F.col("source_snap") * snap_factor
    return candidates.join(held, ["target_node", "source_node"]).select("target_id", "source_id", total.alias("total")).where(F.col("total") <= max_total)


def _parts(targets: DataFrame, sources: DataFrame, threshold_km: float) -> tuple[DataFrame, float]:
    """Targets and the sources about them by part of a cell, and the radius; rows without a node or snap reach nothing."""
    radius = math.degrees(threshold_km / PREFILTER_KM)
    if not (radius > 0 and math.isfinite(radius)):
        raise ValueError("the threshold must be positive and finite")

    def side(df: DataFrame, x: str) -> DataFrame:
        component = F.coalesce(F.col("component").cast("long"), F.lit(-1)) if "component" in df.columns else F.lit(-1)
        return df.where("node is not null and snap is not null").select(
            F.col(f"{x}_id").cast("long").alias("id"), "lon", "lat", F.col("node").cast("long").alias("node"), F.col("snap").cast("double").alias("snap"), component.cast("long").alias("component"))

    return cell_parts(side(targets, "target"), side(sources, "source"), radius), radius


def _met(a: list[np.ndarray], b: list[np.ndarray], radius: float, max_snaps: float | None) -> np.ndarray:
    """Which of the targets a (x, y, snap, component) and sources b meet as in candidate_pairs."""
    u, v = a[0][:, None] - b[0], a[1][:, None] - b[1]
    met = np.sqrt(u * u + v * v) <= radius
    if max_snaps is not None:
        met &= a[2][:, None] + b[2] <= max_snaps
    if (a[3] >= 0).any() and (b[3] >= 0).any():
        met &= (a[3][:, None] == b[3]) | (a[3] < 0)[:, None] | (b[3] < 0)
    return met


def _blocks(part: dict[int, list[np.ndarray]], radius: float, most: int) -> Iterator[tuple]:
    """The targets of a part by groups that have at most about most node pairs with its sources: the different nodes of both
    sides, and an iterator over blocks of targets and the sources about them (their ids, numbers of nodes, and x, y, snap and component)."""
    (ids, x, y, node, snap, component), (jds, px, py, pnode, psnap, pcomponent) = part[1], part[0]
    pnodes, pcode = np.unique(pnode, return_inverse=True)
    n = max(1, most // len(pnodes))
    for at in range(0, len(ids), n):
        nodes, code = np.unique(node[at:at + n], return_inverse=True)
        sides = [c[at:at + n] for c in (ids, x, y, snap, component)]

        def blocks(sides=sides, code=code) -> Iterator[tuple]:
            for square, close in squares(sides[1], sides[2], px, py, radius):
                b = [c[close] for c in (jds, pcode, px, py, psnap, pcomponent)]
                step = max(1, (1 << 16) // max(1, len(b[0])))
                for rows in (square[i:i + step] for i in range(0, len(square) if len(b[0]) else 0, step)):
                    a = [c[rows] for c in sides]
                    yield a[0], code[rows], a[1:], b[0], b[1], b[2:]

        yield nodes, pnodes, blocks()


def asked_pairs(targets: DataFrame, sources: DataFrame, threshold_km: float, max_snaps: float | None = None, most: int = 1 << 22) -> DataFrame:
    """node_pairs of the candidate_pairs, ids long, which are not made: a task holds the targets of a part of a cell and the
    sources about it, and which of their node pairs it has met; pairs of places whose nodes have met are not measured."""
    rows, radius = _parts(targets, sources, threshold_km)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in read_parts(batches):
            for nodes, pnodes, blocks in _blocks(part, radius, most) if len(part) == 2 else ():
                seen = np.zeros((len(nodes), len(pnodes)), bool)
                for _, code, a, _, pcode, b in blocks:
                    new = ~seen[code][:, pcode]
                    if new.any():
                        i, j = np.nonzero(new & _met(a, b, radius, max_snaps))
                        seen[code[i], pcode[j]] = True
                i, j = np.nonzero(seen)
                for at in range(0, len(i), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i[at:at + (1 << 16)]]), pa.array(pnodes[j[at:at + (1 << 16)]])], ["target_node", "source_node"])

    return dealt_parts(rows).mapInArrow(work, "target_node long, source_node long").distinct()


def distances(targets: DataFrame, sources: DataFrame, threshold_km: float, roads: DataFrame, max_total: float, max_snaps: float | None = None, snap_factor: float = 1.0, most: int = 1 << 21) -> DataFrame:
    """assemble of the candidate_pairs, ids long, of which only those within max_total are rows. Of several roads of a node pair the least counts.

    The roads go to the parts of cells that have their target nodes, up to MANY_ROADS of them by a broadcast.
    """
    rows, radius = _parts(targets, sources, threshold_km)
    held = written(roads.groupBy("target_node", "source_node").agg(F.min("road").alias("road")), "roads")
    if held.limit(MANY_ROADS + 1).count() <= MANY_ROADS:
        held = F.broadcast(held)
    at = ["cell_x", "cell_y", "part"]
    here = rows.where("kind = 1").select(*at, F.col("node").alias("target_node")).distinct().join(held.where("road is not null"), "target_node")
    none = F.lit(0.0)
    here = here.select(*at, F.lit(-1).alias("kind"), F.col("source_node").cast("long").alias("id"), none.alias("lon"), none.alias("lat"), "target_node", F.col("road").cast("double").alias("snap"), F.lit(-1).cast("long").alias("component"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for part in read_parts(batches):
            for nodes, pnodes, blocks in _blocks(part, radius, most) if len(part) == 3 else ():
                table, (source, _, _, target, length, _) = np.full((len(nodes), len(pnodes)), np.nan), part[-1]
                i, j = (np.minimum(np.searchsorted(of, x), len(of) - 1) for of, x in ((nodes, target), (pnodes, source)))
                known = (nodes[i] == target) & (pnodes[j] == source)
                table[i[known], j[known]] = length[known]
                for ids, code, a, jds, pcode, b in blocks:
                    total = (a[2] * snap_factor)[:, None] + table[code][:, pcode] + b[2] * snap_factor
                    i, j = np.nonzero((total <= max_total) & _met(a, b, radius, max_snaps))
                    out.append((ids[i], jds[j], total[i, j]))
                    size += len(i)
                    if size >= 1 << 17:
                        yield _batch(out)
                        out, size = [], 0
        if size:
            yield _batch(out)

    return dealt_parts(rows.union(here)).mapInArrow(work, "target_id long, source_id long, total double")


def _batch(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["target_id", "source_id", "total"])


class NodePairCache:
    """Road distances of node pairs as Parquet by bucket of the target node, under a folder all executors share.

    put appends; compact writes one row a pair into the next generation. A null road says that there is no path.
    """

    SCHEMA = "target_node long, source_node long, road double, bucket int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.generation = spark, path.rstrip("/"), 0
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            made = [x.getPath().getName() for x in fs.listStatus(at)]
            whole = [n for n in made if n.startswith("g") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
            self.generation = max((int(n[1:]) for n in whole), default=0)
        self._fs, self._at = fs, spark._jvm.org.apache.hadoop.fs.Path

    def _folder(self) -> str:
        return f"{self.path}/g{self.generation}"

    def rows(self) -> DataFrame:
        if not self._fs.exists(self._at(self._folder())):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._folder())

    def split(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What the cache has of the wanted node pairs, and what it misses."""
        keyed = wanted.withColumn("bucket", F.pmod("target_node", F.lit(CACHE_BUCKETS)).cast("int"))
        on = ["bucket", "target_node", "source_node"]
        known = self.rows().dropDuplicates(on)
        return keyed.join(known, on).drop("bucket"), keyed.join(known, on, "left_anti").drop("bucket")

    def put(self, roads: DataFrame) -> None:
        rows = roads.select("target_node", "source_node", F.col("road").cast("double"), F.pmod("target_node", F.lit(CACHE_BUCKETS)).cast("int").alias("bucket"))
        rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._folder())

    def compact(self) -> None:
        """One row a pair, the smaller road of several; readers of the old generation are not disturbed."""
        rows = self.rows().groupBy("bucket", "target_node", "source_node").agg(F.min("road").alias("road"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/g{self.generation + 1}")
        self.generation += 1


def symmetric_costs(matrix: DataFrame) -> DataFrame:
    """Least cost of each unordered pair (a < b) of (origin, destination, cost), without self pairs."""
    return matrix.where("origin <> destination").groupBy(F.least("origin", "destination").alias("a"), F.greatest("origin", "destination").alias("b")).agg(F.min("cost").alias("cost"))


def directed_costs(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("origin", "destination").agg(F.min("cost").alias("cost"))


def dense(matrix: DataFrame, sources: Sequence[int]) -> DataFrame:
    """A row for each target_id of the matrix and a column s<id> for each source given, null where there is no pair."""
    return matrix.groupBy("target_id").agg(*[F.min(F.when(F.col("source_id") == s, F.col("total"))).alias(f"s{s}") for s in sources])


def closest_by_layer(matrix: DataFrame) -> DataFrame:
    """Of (target_id, source_id, layer, total): the nearest source of each layer, ties to the smaller id."""
    best = matrix.groupBy("target_id", "layer").agg(F.min(F.struct("total", "source_id")).alias("b"))
    return best.select("target_id", "layer", "b.source_id", "b.total")


def tour_distances(stops: DataFrame, roads: DataFrame, detour: float = 1.35) -> DataFrame:
    """All ordered pairs within each tour of stops (tour_id, stop_id, lon, lat): the road distance
    (from_id, to_id, road), else the great circle times detour, and 0 to itself, with where it came
    from. The rows grow with the square of a tour's stops, as a distance table must; tours are short."""
    a = stops.select("tour_id", F.col("stop_id").alias("from_id"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    b = stops.select("tour_id", F.col("stop_id").alias("to_id"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
    far = haversine_km(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) * (1000.0 * detour)
    self_ = F.col("from_id") == F.col("to_id")
    met = a.join(b, "tour_id").join(roads.select("from_id", "to_id", "road"), ["from_id", "to_id"], "left")
    kind = F.when(self_, "identity").when(F.col("road").isNotNull(), "road").otherwise("fallback")
    return met.select("tour_id", "from_id", "to_id", F.when(self_, 0.0).otherwise(F.coalesce("road", far)).alias("distance_m"), kind.alias("distance_source"))


def compare_routes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Legs (origin, destination, length, time) of two route layers side by side, with state both, left or right."""
    on = ["origin", "destination"]
    a, b = left.select(*on, F.col("length").alias("length_a"), F.col("time").alias("time_a")), right.select(*on, F.col("length").alias("length_b"), F.col("time").alias("time_b"))
    state = F.when(F.col("time_b").isNull(), "left").when(F.col("time_a").isNull(), "right").otherwise("both")
    return a.join(b, on, "full").withColumn("state", state)
