"""Polygon tables: points within them, and the population that isochrone polygons serve."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import cell, located


def ring_place(x: Column, y: Column, ring: Column) -> Column:
    """1 inside the ring (array of struct x, y; closed or not), 0 on it, -1 outside: even-odd crossings."""
    after = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))

    def edge(a: Column, i: Column) -> Column:
        b = after(i)
        side = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        on = (side == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        crossed = ((a["y"] > y) != (b["y"] > y)) & F.when(b["y"] > a["y"], side > 0).otherwise(side < 0)
        return F.struct(on.alias("on"), crossed.alias("crossed"))

    edges = F.transform(ring, edge)
    odd = F.size(F.filter(edges, lambda e: e["crossed"])) % 2 == 1
    return F.when(F.exists(edges, lambda e: e["on"]), 0).when(odd, 1).otherwise(-1)


def within_join(points: DataFrame, polygons: DataFrame, size: float, boundary: bool = False) -> DataFrame:
    """Rows of points (lon, lat and others) with the rows of polygons (ring and others) that they lie within.

    A polygon is copied to the cells of the given size that its box meets, and met by the points of the
    same cell; the ring itself is then tested. Points on the ring count with boundary only. A null ring holds nothing.
    """
    named = polygons.where("ring is not null and size(ring) > 2")
    of = lambda c: F.transform("ring", lambda p: p[c])
    bounds = {f"p_min_{c}": F.array_min(of(c)) for c in ("x", "y")} | {f"p_max_{c}": F.array_max(of(c)) for c in ("x", "y")}
    cells = lambda c: F.explode(F.sequence(cell(F.col(f"p_min_{c}"), size), cell(F.col(f"p_max_{c}"), size)))
    spread = named.withColumns(bounds).withColumn("cell_x", cells("x")).withColumn("cell_y", cells("y")).drop(*bounds)
    placed = points.withColumns({"cell_x": cell(F.col("lon"), size), "cell_y": cell(F.col("lat"), size)})
    met = placed.join(spread, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    place = ring_place(F.col("lon"), F.col("lat"), F.col("ring"))
    return met.where(place >= 0 if boundary else place == 1).drop("ring")


def _rings(polygons: DataFrame, size: float) -> DataFrame:
    """Polygons with the coordinates of their rings as arrays, copied to the cells that their boxes meet."""
    of = lambda c: F.transform("ring", lambda p: p[c].cast("double")).alias(f"ring_{c}")
    named = polygons.where("ring is not null and size(ring) > 2").select("*", of("x"), of("y")).drop("ring")
    cells = lambda c: F.explode(F.sequence(cell(F.array_min(f"ring_{c}"), size), cell(F.array_max(f"ring_{c}"), size)))
    return named.withColumn("cell_x", cells("x")).withColumn("cell_y", cells("y"))


def _ring_places(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray) -> np.ndarray:
    """ring_place of many points and one ring."""
    on, odd = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for ax, ay, bx, by in zip(rx.tolist(), ry.tolist(), np.roll(rx, -1).tolist(), np.roll(ry, -1).tolist()):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        on |= (side == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        odd ^= ((ay > y) != (by > y)) & (side > 0 if by > ay else side < 0)
    return np.where(on, 0, np.where(odd, 1, -1))


def _met(points: DataFrame, rings: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], size: float, schema: str) -> DataFrame:
    """work on the points and the rings of each cell; a task holds these."""
    at = located(points).withColumns({"cell_x": cell(F.col("lon"), size), "cell_y": cell(F.col("lat"), size)})
    n = 2 * points.sparkSession.sparkContext.defaultParallelism
    dealt = lambda df: df.repartition(n, "cell_x", "cell_y").groupBy("cell_x", "cell_y")
    return dealt(at).cogroup(dealt(rings)).applyInPandas(work, schema)


def _inside(points: pd.DataFrame, rings: pd.DataFrame, boundary: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Of each ring the positions of the points within it, or on it with boundary; points are in the order of lon."""
    x, y = points["lon"].to_numpy(float), points["lat"].to_numpy(float)
    for i, (rx, ry) in enumerate(zip(rings["ring_x"], rings["ring_y"])):
        lo, hi = np.searchsorted(x, np.nanmin(rx), "left"), np.searchsorted(x, np.nanmax(rx), "right")
        at = lo + np.flatnonzero((y[lo:hi] >= np.nanmin(ry)) & (y[lo:hi] <= np.nanmax(ry)))
        if len(at):
            yield i, at[_ring_places(x[at], y[at], rx, ry) >= (0 if boundary else 1)]


def clip(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """The points that lie within or on any polygon, each row once as often as it stands.

    Places are tested until a polygon holds them, the larger polygons of a cell first."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rest, hits = a[["lon", "lat"]].sort_values("lon"), []
        spans = [np.ptp(rx) * np.ptp(ry) for rx, ry in zip(b["ring_x"], b["ring_y"])]
        order = np.argsort(spans, kind="stable")[::-1] if len(b) else []
        for at in range(0, len(order), 16):
            if not len(rest):
                break
            found = [k for _, k in _inside(rest, b.iloc[order[at : at + 16]], True)]
            held = np.zeros(len(rest), bool)
            for k in found:
                held[k] = True
            hits.append(rest[held])
            rest = rest[~held]
        return pd.concat(hits) if hits else a[["lon", "lat"]].iloc[:0]

    inside = _met(points.select("lon", "lat").distinct(), _rings(polygons.select("ring").distinct(), size), work, size, "lon double, lat double")
    return points.join(inside, ["lon", "lat"], "left_semi").select(*points.columns)


def served_by_isopolygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Per facility_id and distance_id of polygons (ring), the sorted point_ids strictly within it.

    Every polygon has a row: one without points, or with a null ring, an empty list. Either table being
    empty is an error."""
    if points.isEmpty() or polygons.isEmpty():
        raise ValueError("Input dataframes cannot be empty.")
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *polygons.schema]}

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("lon")
        ids = a["point_id"].to_numpy()
        found = [(i, ids[at]) for i, at in _inside(a, b, False) if len(at)]
        out = b[["facility_id", "distance_id"]].iloc[[i for i, _ in found]].reset_index(drop=True)
        return out.assign(point_ids=pd.Series([x for _, x in found], dtype=object))

    rows = points.select("point_id", "lon", "lat").where("point_id is not null")
    schema = f"facility_id {kinds['facility_id']}, distance_id {kinds['distance_id']}, point_ids array<{kinds['point_id']}>"
    found = _met(rows, _rings(polygons.select("facility_id", "distance_id", "ring"), size), work, size, schema)
    lists = found.groupBy("facility_id", "distance_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("point_ids")))).alias("point_ids"))
    keys = polygons.select("facility_id", "distance_id").distinct()
    none = F.array().cast(lists.schema["point_ids"].dataType)
    return keys.join(lists, ["facility_id", "distance_id"], "left").withColumn("point_ids", F.coalesce("point_ids", none))
