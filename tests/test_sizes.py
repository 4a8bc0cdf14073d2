"""Queries on more places than the tables have: the rows of the SQL, and how much work they make."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoreach.operators import cover, discs, matrix, polygons, solve, spatial
from isoreach.plans import selection, views
from isoreach.plans.registry import ORACLE_SQL, QUERIES
from isoreach.sources import sinks
from oracle import compare


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """400 customers among 4000 suppliers and 3000 parts."""
    out = str(tmp_path_factory.mktemp("dense"))
    spark.range(400).selectExpr("id * 37 + 5 as c_custkey", "double(id * 13 % 997) - 300 as c_acctbal", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(f"{out}/parts-customer")
    spark.range(4000).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey").coalesce(1).write.parquet(f"{out}/parts-supplier")
    spark.range(3000).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{out}/parts-part")
    for name in ("customer", "supplier", "part"):
        spark.read.parquet(f"{out}/parts-{name}").toPandas().to_parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture
def pairs(monkeypatch):
    """The numbers of pairs that range_join makes."""
    made, real = [], spatial.range_join

    def counted(*args):
        out = real(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(spatial, "range_join", counted)
    return made


def nearest_work(spark, dense, pairs, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name], dense)
    assert sum(pairs) <= 12 * 400


def test_nearest_facility_makes_few_pairs(spark, dense, pairs):
    nearest_work(spark, dense, pairs, "nearest_facility")


def test_nearest_rows_of_equal_distance(spark):
    """Repeated places, several nearest, rows without a place and rows beyond the limit."""
    rng = np.random.default_rng(2)
    left = [(i, *map(float, rng.integers(0, 6, 2))) for i in range(40)] + [(40, None, 1.0), (41, float("nan"), 1.0), (42, 90.0, 90.0)]
    right = [(i, *map(float, rng.integers(0, 6, 2))) for i in range(60)] + [(60, None, None), (61, float("inf"), 1.0)]
    of = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lon double, lat double")
    got = {}
    for r in spatial.nearest_join(of(left, "a"), of(right, "b"), "a", "b", 2.5, 3).orderBy("a", "rank").collect():
        got.setdefault(r.a, []).append((r.distance, r.b))
    want = {a: sorted((float(np.hypot(x - u, y - v)), b) for b, u, v in right[:60] if np.hypot(x - u, y - v) <= 2.5)[:3] for a, x, y in left[:40]}
    assert {a: [(round(d, 9), b) for d, b in rows] for a, rows in got.items()} == {a: [(round(d, 9), b) for d, b in rows] for a, rows in want.items() if rows}


def test_access_summary_makes_few_pairs(spark, dense, pairs):
    nearest_work(spark, dense, pairs, "access_summary")


def test_catchment_summary_makes_few_pairs(spark, dense, pairs):
    nearest_work(spark, dense, pairs, "catchment_summary")


def few_pairs(spark, dense, pairs, name):
    """Before, a pair for each candidate and each customer about it."""
    compare(spark, QUERIES[name], ORACLE_SQL[name], dense)
    assert sum(pairs) <= 12 * 400


def incidence_work(spark, dense, pairs, got, want):
    pairs.clear()  # those of want
    rows = sorted(map(tuple, got(spark, dense).collect()), key=repr)
    assert sum(pairs) <= 12 * 400
    assert rows == sorted(map(tuple, want.collect()), key=repr)


def test_disc_sums_on_the_rim_and_of_odd_rows(spark):
    """Points at exactly the radius, repeated places, nulls, and centers without a place or without points."""
    rng = np.random.default_rng(4)
    pts = [(float(x), float(y), int(w)) for x, y, w in zip(rng.integers(0, 30, 400), rng.integers(0, 30, 400), rng.integers(-9, 99, 400))]
    odd = [(1.0, 1.0, None), (None, 2.0, 5), (2.0, float("nan"), 5), (float("inf"), 0.0, 5)]
    ctr = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-3, 33, (80, 2)))] + [(80, 500.0, 500.0), (81, None, 0.0), (82, float("nan"), 0.0)]
    points = spark.createDataFrame(pts + odd, "lon double, lat double, w long")
    centers = spark.createDataFrame(ctr, "id long, lon double, lat double")
    for radius in (5.0, 1.0, 70.0):
        got = {r.id: r.w for r in spatial.disc_sums(centers, points, radius, ["w"]).collect()}
        assert got == {i: sum(w for u, v, w in pts if np.sqrt((x - u) ** 2 + (y - v) ** 2) <= radius) for i, x, y in ctr[:81]}


def test_served_population_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "served_population")


def test_max_cover_greedy_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "max_cover_greedy")


def test_swap_deltas_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "swap_deltas")


def test_add_deltas_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "add_deltas")


def test_coverage_counts_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "coverage_counts")


def test_budget_curve_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "budget_curve")


def test_drop_deltas_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "drop_deltas")


def test_coverage_lists_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "coverage_lists")


def test_coverage_transpose_makes_few_pairs(spark, dense, pairs):
    few_pairs(spark, dense, pairs, "coverage_transpose")


def test_lists_of_odd_rows(spark):
    """Points at exactly the radius, repeated rows and places, ids of many lengths, rows without a place; a cell in several batches."""
    rng = np.random.default_rng(6)
    ids = [*range(-12, 13), *(10 ** k + j for k in range(2, 19) for j in (-1, 0, 1)), -(2 ** 63), 2 ** 63 - 1, *range(5000, 5300)]
    demand = [(i, float(x), float(y)) for i, (x, y) in zip(ids, rng.integers(0, 30, (len(ids), 2)))]
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-3, 33, (90, 2)))] + [(90, 500.0, 500.0)]
    odd = [(1000, None, 2.0), (1001, 2.0, float("nan")), (1002, float("inf"), 0.0)]
    of = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lon double, lat double")
    a, b = of(sites + odd + sites[:5], "facility_id"), of(demand + odd + demand[:7], "demand_id").withColumn("weight", F.lit(1).cast("long"))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(rows)
    try:
        for radius, batch in ((5.0, was), (5.0, "7"), (1.0, "50"), (70.0, "64")):
            spark.conf.set(rows, batch)
            lists = {f: sorted(d for d, u, v in demand if np.sqrt((x - u) ** 2 + (y - v) ** 2) <= radius) for f, x, y in sites}
            back = {d: sorted(f for f, x, y in sites if np.sqrt((x - u) ** 2 + (y - v) ** 2) <= radius) for d, u, v in demand}
            lists, back = ({k: x for k, x in of.items() if x} for of in (lists, back))
            text = lambda of: sorted((k, len(x), ",".join(map(str, x))) for k, x in of.items())
            assert sorted(map(tuple, discs.demand_lists(a, b, radius).collect())) == text(lists)
            assert sorted(map(tuple, discs.facility_lists(a, b, radius).collect())) == text(back)
            pairs = cover.demand_lists(spatial.range_join(spatial.located(a), spatial.located(b), radius))
            assert {r.facility_id: r.demand for r in pairs.collect()} == lists
            assert {r.demand_id: r.facilities for r in cover.facility_lists(pairs).collect()} == back
    finally:
        spark.conf.set(rows, was)
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert not discs.demand_lists(x, y, 1.0).collect() and not discs.facility_lists(x, y, 1.0).collect()


def test_lists_of_a_cell_with_many_places(spark):
    """3000 sites and 2000 customers in one cell: squares of it, and several batches of lists."""
    place = lambda key, n, x, y: spark.range(n).selectExpr(f"id * 3 as {key}", f"double(id * {x} % 997) / 1000 as lon", f"double(id * {y} % 991) / 1000 as lat", "1L as weight")
    sites, demand = place("facility_id", 3000, 389, 577).drop("weight"), place("demand_id", 2000, 211, 733)
    f, d = sites.toPandas(), demand.toPandas()
    near = np.sqrt((f["lon"].to_numpy()[:, None] - d["lon"].to_numpy()) ** 2 + (f["lat"].to_numpy()[:, None] - d["lat"].to_numpy()) ** 2) <= 0.4
    got = {r.facility_id: (r.n, r.demand) for r in discs.demand_lists(sites, demand, 0.4).collect()}
    want = {i: (int(row.sum()), ",".join(map(str, d["demand_id"][row]))) for i, row in zip(f["facility_id"].tolist(), near) if row.any()}
    assert got == want
    # and dealt in parts, over several tasks where one held the cell
    lists = spatial.disc_lists(sites, demand, 2.0, "facility_id", "demand_id", most=100).withColumn("task", F.spark_partition_id())
    rows = lists.collect()
    assert len({r.facility_id for r in rows}) == len(rows) == 3000 and len({r.task for r in rows}) > 8
    assert {(r.n, r.demand_id) for r in rows} == {(2000, ",".join(map(str, d["demand_id"])))}


@pytest.mark.parametrize("lists", [discs.demand_lists, discs.facility_lists])
def test_lists_take_little_disk(spark, tmp_path, lists):
    """Before, three fifths of their text; the lists of neighbours, which follow one another, are nearly equal."""
    place = lambda key, n, x, y: spark.range(n).selectExpr(f"id * 3 as {key}", f"double(id * {x} % 9973) / 10000 as lon", f"double(id * {y} % 9967) / 10000 as lat", "1L as weight")
    out = lists(place("facility_id", 4000, 3889, 5779).drop("weight"), place("demand_id", 4000, 2111, 7333), 0.4)
    rows = {r[0]: r[2] for r in out.collect()}
    assert sinks.write_table(out, str(tmp_path / "lists"))["rows"] == len(rows) == 4000
    assert sum(f.stat().st_size for f in (tmp_path / "lists").glob("*.parquet")) < sum(map(len, rows.values())) / 8
    assert {r[0]: r[2] for r in spark.read.parquet(str(tmp_path / "lists")).collect()} == rows


def test_set_cover_makes_few_pairs(spark, dense, pairs):
    incidence_work(spark, dense, pairs, selection.set_cover, cover.greedy_set_cover(selection._incidence(spark, dense, 4.0)))


def test_swap_search_makes_few_pairs(spark, dense, pairs):
    incidence_work(spark, dense, pairs, selection.swap_search, cover.swap_search(selection._incidence(spark, dense, 2.0), selection.SOLUTION[:3]))


def test_exact_cover_makes_few_pairs(spark, dense, pairs):
    """The objectives and solutions of the pairs themselves."""
    rows = selection._incidence(spark, dense).withColumn("instance_id", F.floor(F.col("facility_id") / 12).cast("long"))
    budgets = rows.select("instance_id").distinct().withColumn("budget", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    want = solve.exact_cover(rows, budgets).withColumn("solution", F.array_join("solution", ","))
    incidence_work(spark, dense, pairs, selection.exact_cover, want)


def test_facility_location_of_a_large_island(spark):
    """220 sites and 3600 customers, nearly all sites opened: over a minute when each move was summed anew."""
    rows = spark.range(220 * 3600).selectExpr("0L as island", "id div 3600 as site_id", "id % 3600 as demand_id")
    rows = rows.selectExpr("*", "1 + demand_id * 7919 % 97 as weight", "floor(sqrt(pow((site_id * 37 % 221) - (demand_id * 61 % 223), 2) + pow((site_id * 91 % 223) - (demand_id * 17 % 221), 2)) * 20) as far")
    rows = rows.selectExpr("island", "site_id", "demand_id", "weight", "cast(far as double) as distance")
    start = time.time()
    got = solve.facility_location(rows, 300.0).collect()
    assert time.time() - start < 30
    table = rows.toPandas()
    m = table.pivot(index="site_id", columns="demand_id", values="distance").to_numpy()
    w = table.drop_duplicates("demand_id").sort_values("demand_id")["weight"].to_numpy(float)
    setup, opened = 300.0 * w.sum() / len(w), sorted({r.site_id for r in got})
    cost = lambda sites: setup * len(sites) + (m[sites].min(axis=0) * w).sum()
    assert {r.demand_id: r.distance for r in got} == dict(enumerate(m[opened].min(axis=0)))
    now = cost(opened)
    assert all(cost([*opened, i]) >= now for i in set(range(220)) - set(opened)) and all(cost([x for x in opened if x != i]) >= now for i in opened)


def test_facility_location_makes_no_matrix(spark, dense):
    """Before, a row for each site and each customer of an island was shuffled to one task, which held them."""
    plan = QUERIES["facility_location"](spark, dense)._jdf.queryExecution().sparkPlan().toString()
    assert not any("Join" in line and "island" in line for line in plan.splitlines())


def test_facility_location_of_places_as_of_their_matrix(spark):
    """Islands of few and many open sites, equal distances, repeated rows and places, no weight, rows without a place, one site, no site, no demand."""
    rng = np.random.default_rng(8)
    sites, demand = [(90, 1, 2.0, 2.0), (91, 1, 0.0, 0.0), (0, 1000, None, 1.0)], [(90, 5, 1.0, 1.0, 4), (90, 6, 2.0, 0.0, 0), (92, 1, 0.0, 0.0, 3), (0, 1000, 1.0, float("nan"), 7)]
    for island in range(12):
        wide, n, m = (12, 40, 150) if island % 2 else (1000, 25, 60)
        sites += [(island, 7 * i % 41, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, wide, (n, 2)))]
        demand += [(island, i, float(x), float(y), int(w)) for i, (x, y, w) in enumerate(zip(rng.integers(0, wide, m), rng.integers(0, wide, m), rng.integers(0, 9, m)))]
    a = spark.createDataFrame(sites + sites[9:12], "island long, site_id long, lon double, lat double")
    b = spark.createDataFrame(demand + demand[9:12], "island long, demand_id long, lon double, lat double, weight long")
    far = F.floor(spatial.planar(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")) * 3).cast("double").alias("distance")
    met = spatial.located(a).withColumnsRenamed({"lon": "x", "lat": "y"}).join(spatial.located(b), "island").select("island", "site_id", "demand_id", "weight", far)
    for setup in (1.0, 20.0, 300.0):
        want = sorted(map(tuple, solve.facility_location(met, setup).collect()))
        assert sorted(map(tuple, solve.facility_location_of_places(a, b, setup, 3.0).collect())) == want and len(want) == 12 * 105 + 2


@pytest.fixture
def no_pairs(monkeypatch):
    """Fails where a polygon meets each point of its cells as a row of a join."""
    monkeypatch.setattr(polygons, "within_join", lambda *args, **kwargs: pytest.fail("a row for each pair"))


def test_clipped_demand_makes_no_pairs(spark, dense, no_pairs):
    compare(spark, QUERIES["clipped_demand"], ORACLE_SQL["clipped_demand"], dense)


def test_served_by_isopolygons_makes_no_pairs(spark, dense, no_pairs):
    compare(spark, QUERIES["served_by_isopolygons"], ORACLE_SQL["served_by_isopolygons"], dense)


def test_cached_node_pairs_finds_candidates_once(spark, dense, monkeypatch):
    """Before, each write to the cache and each look into it joined all candidates anew."""
    seen, real = spark.sparkContext.accumulator(0), matrix.range_join
    counted = F.udf(lambda x: seen.add(1) or True, "boolean")
    monkeypatch.setattr(matrix, "range_join", lambda *args: real(*args).where(counted("distance")))
    rows = QUERIES["cached_node_pairs"](spark, dense).count()
    assert rows and seen.value <= real(views.existing(spark, dense), views.demand(spark, dense), np.degrees(100.0 / matrix.PREFILTER_KM)).count()
    compare(spark, QUERIES["cached_node_pairs"], ORACLE_SQL["cached_node_pairs"], dense)


def test_distance_matrix_does_not_shuffle_candidates(spark, dense):
    """Before, all candidates were shuffled to the roads of 2500 node pairs."""
    plan = QUERIES["distance_matrix"](spark, dense)._jdf.queryExecution().sparkPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line and "target_node" in line)
    assert "BroadcastHashJoin" in join


def test_distance_matrix_makes_no_candidate_rows(spark, dense, monkeypatch):
    """Before, all candidates were rows of a join, once for the node pairs and once for the distances."""
    monkeypatch.setattr(matrix, "range_join", lambda *args: pytest.fail("a row for each candidate"))
    compare(spark, QUERIES["distance_matrix"], ORACLE_SQL["distance_matrix"], dense)


def test_distances_of_odd_rows(spark):
    """As of the candidates: places at exactly the radius and repeated, nodes of few and of many places, missing nodes, snaps,
    components, places and roads, a road that is NaN, and groups of nodes that fill more than one table."""
    rng = np.random.default_rng(9)
    km = np.radians(5.0) * matrix.PREFILTER_KM
    assert np.degrees(km / matrix.PREFILTER_KM) == 5.0  # whole places lie at exactly this

    def side(name, n, nodes, components=True):
        rows = [(i * 3, float(x), float(y), int(k), float(s) / 2, int(c)) for i, (x, y, k, s, c) in enumerate(zip(rng.integers(-2, 22, n), rng.integers(-2, 22, n), rng.integers(0, nodes, n), rng.integers(0, 9, n), rng.integers(-1, 3, n)))]
        rows += rows[:4] + [(-1, None, 1.0, 1, 1.0, 0), (-2, 3.0, float("nan"), 1, 1.0, 0), (-3, 5.0, 5.0, None, 1.0, 0), (-4, 5.0, 5.0, 1, None, 0), (-5, 5.0, 5.0, 1, float("nan"), 0), (-6, 5.0, 5.0, 1, 0.5, None)]
        out = spark.createDataFrame(rows, f"{name}_id long, lon double, lat double, node long, snap double, component long")
        return out if components else out.drop("component")

    for nodes, snaps, total, components, most in ((7, 5.0, 9.0, True, 1 << 20), (500, None, 60.0, True, 40), (40, 6.0, 25.0, False, 200)):
        targets, sources = side("target", 230, nodes), side("source", 170, nodes, components)
        met = matrix.candidate_pairs(targets, sources, km, snaps).where("target_node is not null and source_node is not null and target_snap is not null and source_snap is not null").cache()
        asked = sorted(map(tuple, matrix.node_pairs(met).collect()))
        assert sorted(map(tuple, matrix.asked_pairs(targets, sources, km, snaps, most).collect())) == asked and asked
        road = F.when(F.expr("(target_node + source_node) % 10 = 0"), F.lit(float("nan"))).when(F.expr("target_node % 5 <> 1"), F.abs(F.col("target_node") - F.col("source_node")) / 3.0)
        roads = matrix.node_pairs(met).where("source_node % 6 <> 2").withColumn("road", road)
        want = sorted(map(tuple, matrix.assemble(met, roads, total, 1.5).collect()))
        more = roads.union(roads.selectExpr("target_node", "source_node", "road + 1")).union(roads.selectExpr("source_node + 1000", "target_node", "1.0"))
        assert sorted(map(tuple, matrix.distances(targets, sources, km, more, total, snaps, 1.5, most).collect())) == want and want
