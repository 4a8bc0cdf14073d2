import pytest

from isoreach.operators import cover, network, spatial
from isoreach.plans.registry import ORACLE_SQL, QUERIES
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], SF)


def test_polygon_corner_is_outside(spark):
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 1.5), (2, 2.0, 2.0), (3, 0.5, 1.5), (4, 5.0, 5.0)], "id int, x double, y double")
    inside = points.where(spatial.strictly_within(points.x, points.y, [(0, 0), (2, 0), (2, 2), (0, 2)]))
    assert sorted(r.id for r in inside.collect()) == [0, 1, 3]


def test_max_cover_toy(spark):
    weights, cover_of = [10, 7, 5, 4, 3], {0: [0, 1], 1: [0, 2], 2: [1, 2, 3], 3: [3, 4]}
    incidence = spark.createDataFrame([(f, d, weights[d]) for f, ds in cover_of.items() for d in ds], "facility_id long, demand_id long, weight long")
    assert cover.objective(incidence, [0, 2, 2]) == 26
    assert [tuple(r) for r in cover.greedy_max_cover(incidence, 9).collect()][0] == (1, 0, 17, 17)
    assert cover.greedy_max_cover(incidence, 9).agg({"gain": "sum"}).first()[0] == 29


def test_line_graph(spark):
    edges = spark.createDataFrame([(1, 2, 10.0), (2, 3, 15.0), (2, 3, 99.0)], "u long, v long, length double")
    out = network.bounded_distances(edges, spark.createDataFrame([(1,)], "source long"), 25.0)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 0.0), (1, 2, 10.0), (1, 3, 25.0)]


def test_grid(spark):
    box = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.0, 1.0, 2.0, 2.0)], "west double, south double, east double, north double")
    assert spatial.facility_grid(box, 0.5).count() == 17
