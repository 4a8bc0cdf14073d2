import pytest

from isoreach.functions import validation as v
from isoreach.operators import polygons

RING = "array<struct<x:double,y:double>>"


def square(a, b):
    return [(a, a), (b, a), (b, b), (a, b), (a, a)]


def test_served_by_isopolygons(spark):
    """Strictly within: a corner is outside; a polygon without points keeps its row."""
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.5), (2, 2.0, 2.0), (3, 0.5, 1.5), (4, 5.0, 5.0)], "point_id long, lon double, lat double")
    rows = [("i0", "ID_10", square(0.0, 1.0)), ("i1", "ID_10", square(1.0, 2.0)), ("i0", "ID_20", square(0.0, 2.0)), ("i1", "ID_20", None)]
    table = spark.createDataFrame(rows, f"facility_id string, distance_id string, ring {RING}")
    for size in (0.3, 1.0, 10.0):
        out = {(r.facility_id, r.distance_id): r.point_ids for r in polygons.served_by_isopolygons(points, table, size).collect()}
        assert out == {("i0", "ID_10"): [0], ("i1", "ID_10"): [1], ("i0", "ID_20"): [0, 1, 3], ("i1", "ID_20"): []}
    with pytest.raises(ValueError, match="Input dataframes cannot be empty."):
        polygons.served_by_isopolygons(points.limit(0), table, 1.0)


def test_clip_keeps_the_boundary_and_repeated_rows(spark):
    points = spark.createDataFrame([(0, 2.0, 2.0), (0, 2.0, 2.0), (1, 1.0, 0.0), (2, 2.1, 2.0), (3, None, 1.0)], "point_id long, lon double, lat double")
    table = spark.createDataFrame([(square(0.0, 2.0),), (square(1.0, 2.0),)], f"ring {RING}")
    assert sorted(r.point_id for r in polygons.clip(points, table, 0.7).collect()) == [0, 0, 1]


def test_validation():
    assert v.distance_type("LeNgTh ") == "length" and v.travel_mode("WaLkInG ") == "walking"
    assert [v.travel_speed(s, m) for s, m in [(None, "bike"), (10, "drive"), (10, "walk"), (10, "bike"), (60, "drive"), (30.5, "drive")]] == [None, 10, 10, 10, 60, 30.5]
    for bad in [(-4, "drive"), ("walk", "walk"), (1000, "bike"), (60, "walk"), (60, "bike")]:
        with pytest.raises(ValueError):
            v.travel_speed(*bad)
    assert v.distance_values([20, 5, 10]) == [5, 10, 20] and v.distance_values(3) == [3]
    for call in (lambda: v.distance_type("lightyears"), lambda: v.travel_mode("horseback"), lambda: v.distance_values(range(1, 6), 4)):
        with pytest.raises(ValueError):
            call()
