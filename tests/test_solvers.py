import itertools

import numpy as np
import pytest

from isoreach.operators import analytics, cover, matrix, network, solve
from isoreach.sources import points, sinks

WEIGHTS = [10, 7, 5, 4, 3]
COVERS = {0: [0, 1], 1: [0, 2], 2: [1, 2, 3], 3: [3, 4]}


@pytest.fixture
def toy(spark):
    return spark.createDataFrame([(f, d, WEIGHTS[d]) for f, ds in COVERS.items() for d in ds], "facility_id long, demand_id long, weight long")


def worth(covers, weights, chosen):
    return sum(weights[d] for d in set().union(*[covers[f] for f in chosen], set()))


def test_marginal_changes(toy):
    assert {r[0]: r[1] for r in cover.add_deltas(toy, [0, 2]).collect()}[3] == 3
    assert {r[0]: r[1] for r in cover.drop_deltas(toy, [0, 2]).collect()}[0] == -10
    assert {(r[0], r[1]): r[2] for r in cover.swap_deltas(toy, [0, 2]).collect()}[(2, 3)] == worth(COVERS, WEIGHTS, [0, 3]) - 26


def test_redundant_facilities_are_dropped_in_order(toy):
    assert cover.drop_redundant(toy, [0, 1, 2, 3]) == [1, 2, 3]
    assert cover.drop_redundant(toy, [99, 0]) == [0]


def random_instance(seed):
    rng = np.random.default_rng(seed)
    weights = rng.integers(0, 25, 18).tolist()
    inc = rng.random((9, 18)) < 0.3
    return {f: np.flatnonzero(inc[f]).tolist() for f in range(9)}, weights


def rows_of(spark, covers, weights):
    return spark.createDataFrame([(f, d, int(weights[d])) for f, ds in covers.items() for d in ds], "facility_id long, demand_id long, weight long")


def test_swaps_and_relinking_keep_exact_objectives(spark):
    covers, weights = random_instance(3)
    rows = rows_of(spark, covers, weights)
    for moves, now in ((cover.swap_search(rows, [0, 1, 2]).collect(), [0, 1, 2]), (cover.relink(rows, [0, 1, 2], [2, 5, 7]).collect(), [0, 1, 2])):
        for m in moves:
            if m["out_id"] is not None:
                now[now.index(m["out_id"])] = m["in_id"]
            assert m["objective"] == worth(covers, weights, now)
    assert set(now) == {2, 5, 7}


def test_exact_cover_equals_enumeration(spark):
    covers, weights = random_instance(5)
    rows = rows_of(spark, covers, weights).selectExpr("0L as instance_id", "*")
    got = {r["budget"]: r["objective"] for r in solve.exact_cover(rows, spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "instance_id long, budget int")).collect()}
    assert got == {b: max(worth(covers, weights, c) for c in itertools.combinations(range(9), b)) for b in (1, 2, 3)}


def test_tour_of_a_depot(spark):
    costs = [("f", "a", 10.0), ("a", "b", 5.0), ("b", "f", 10.0), ("f", "b", 100.0), ("b", "a", 5.0), ("a", "f", 100.0)]
    table = spark.createDataFrame([("t", *c) for c in costs], "tour_id string, from_id string, to_id string, distance_m double")
    out = solve.tours(table, spark.createDataFrame([("t", "f")], "tour_id string, depot_id string")).orderBy("position").collect()
    assert [r["stop_id"] for r in out] == ["f", "a", "b", "f"] and out[0]["length"] == 25.0


def test_exact_tours_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in (2, 5, 7):
        d = rng.random((n, n))
        best = min(sum(d[a, b] for a, b in zip((0, *p), (*p, 0))) for p in itertools.permutations(range(1, n)))
        assert solve.exact_tour(d)[1] == pytest.approx(best)
        assert solve.two_opt_tour(d)[1] >= best - 1e-9


def test_two_schools_open_both_sites(spark):
    rows = [("Tiny", s, d, 100, 0.0 if s == d else 111.0) for s in (0, 1) for d in (0, 1)]
    out = solve.facility_location(spark.createDataFrame(rows, "island string, site_id long, demand_id long, weight long, distance double"), 1.0).collect()
    assert sorted((r["demand_id"], r["site_id"]) for r in out) == [(0, 0), (1, 1)]


def test_speeds(spark):
    edges = spark.createDataFrame([(1, 1000.0, None, "residential", "gravel", 0.5)], "e long, length double, maxspeed string, highway string, surface string, density_factor double")
    r = network.edge_speeds(edges, {}, 50.0, {"gravel": 0.5}, 0.8).first()
    assert (r["speed_kph"], r["travel_time_s"]) == (pytest.approx(10.0), pytest.approx(360.0))


def test_candidates_of_one_component(spark):
    side = lambda x, rows: spark.createDataFrame(rows, f"{x}_id long, lon double, lat double, node long, snap double, component long")
    met = matrix.candidate_pairs(side("target", [(10, 0.0, 0.0, 100, 2.0, 0), (11, 0.0, 0.0, 200, 90.0, 1)]), side("source", [(20, 0.0, 0.0, 90, 3.0, 0), (21, 0.0, 0.0, 210, 20.0, 1)]), 100.0, 100.0)
    roads = matrix.node_pairs(met).selectExpr("*", "cast(abs(target_node - source_node) as double) as road")
    assert [tuple(r) for r in matrix.assemble(met, roads, 100.0).collect()] == [(10, 20, 15.0)]


def test_graphml_and_tables(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><key id="d1" for="node" attr.name="x"/><key id="d2" for="node" attr.name="y"/><key id="d3" for="edge" attr.name="length"/><graph><node id="1"><data key="d1">0.5</data><data key="d2">2</data></node><node id="2"><data key="d1">1</data><data key="d2">2</data></node><edge source="1" target="2"><data key="d3">15.5</data></edge></graph></graphml>')
    nodes, edges = points.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted(tuple(r) for r in nodes.collect()) == [(1, 0.5, 2.0), (2, 1.0, 2.0)]
    assert tuple(edges.first())[:3] == (1, 2, 15.5)
    (tmp_path / "p.csv").write_text("longitude,latitude,population_count\n6.13,49.61,0.5\n6.14,49.62,2.0\n6.15,49.63,3.0\n")
    assert sorted(r["weight"] for r in points.population_points(spark, str(tmp_path / "p.csv"), 1.0).collect()) == [2.0, 3.0]
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 10\ncellsize 1\nNODATA_value -9\n1 2\n-9 4\n")
    cells = {(r["lon"], r["lat"]): r["value"] for r in points.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert cells == {(0.5, 11.5): 1.0, (1.5, 11.5): 2.0, (1.5, 10.5): 4.0}


def test_tables_resume_by_fingerprint(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    build = lambda: built.append(1) or spark.range(0)
    for mark in ("a", "a", "b"):
        assert sinks.resumed(spark, path, mark, build).columns == ["id"]
    assert len(built) == 2


def test_dense_ids_are_contiguous(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 37) % 1000 as k").repartition(7)
    got = sorted((r["k"], r["n"]) for r in analytics.dense_ids(rows, [rows["k"].asc()], "n").collect())
    assert got == [(i, i) for i in range(1000)]
