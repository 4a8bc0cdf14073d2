"""Queries that take whole tables, against brute force over the same views."""

import collections
import itertools

import numpy as np

from isoreach.operators import network, solve, spatial
from isoreach.plans import queries, routing, selection, views

SF = "/root/testdata/sf0.001"
SF_100 = "/root/testdata/sf0.01"


def test_tours_of_all_suppliers(spark):
    ids = {r.facility_id for r in views.existing(spark, SF_100).collect()}
    got = collections.defaultdict(list)
    for r in routing.tours(spark, SF_100).orderBy("tour_id", "position").collect():
        got[r.tour_id].append(r)
    assert {r.stop_id for rows in got.values() for r in rows} == ids
    table = {(r.from_id, r.to_id): r for r in routing.tour_distances(spark, SF_100).collect()}
    assert set(table) == {(a, b) for a in ids for b in ids if a // 9 == b // 9}
    assert any(r.distance_source == "road" and r.from_id % 2 for r in table.values())
    place = {r.facility_id: r for r in views.existing(spark, SF_100).collect()}

    def metres(a, b):
        x, y = np.radians([place[a].lon, place[a].lat]), np.radians([place[b].lon, place[b].lat])
        h = np.sin((y[1] - x[1]) / 2) ** 2 + np.cos(x[1]) * np.cos(y[1]) * np.sin((y[0] - x[0]) / 2) ** 2
        return 2 * spatial.EARTH_KM * np.arcsin(np.sqrt(h)) * 1350

    for rows in got.values():
        stops = [r.stop_id for r in rows]
        assert stops[0] == stops[-1] == min(stops) and len(set(stops)) == len(stops) - 1
        assert abs(sum(itertools.starmap(metres, itertools.pairwise(stops))) - rows[0].length) < 0.01


def test_exact_cover_of_all_candidates(spark):
    pairs = collections.defaultdict(dict)
    for r in selection._incidence(spark, SF).collect():
        pairs[r.facility_id][r.demand_id] = r.weight
    got = {(r.instance_id, r.budget): r.objective for r in selection.exact_cover(spark, SF).collect()}
    assert {i for i, _ in got} == {f // 12 for f in pairs}
    for (i, budget), objective in got.items():
        inside = [f for f in pairs if f // 12 == i]
        chosen = itertools.combinations(inside, min(budget, len(inside)))
        assert objective == max(sum({d: w for f in c for d, w in pairs[f].items()}.values()) for c in chosen)


def test_facility_location_of_all_sites(spark):
    sites, demand = (views.table(spark, SF, t).collect() for t in ("supplier", "customer"))
    place = {r.facility_id: (r.lon, r.lat) for r in views.existing(spark, SF).collect()}
    at = {r.demand_id: (r.lon, r.lat) for r in views.demand(spark, SF).collect()}
    nation = {r.s_suppkey: r.s_nationkey for r in sites}
    rows = selection.facility_location(spark, SF).collect()
    assert sorted(r.demand_id for r in rows) == sorted(c.c_custkey for c in demand if c.c_nationkey in nation.values())
    opened = collections.defaultdict(set)
    for r in rows:
        opened[r.island].add(r.site_id)
    assert max(s for open_ in opened.values() for s in open_) >= 6
    away = lambda s, d: float(np.floor(np.hypot(place[s][0] - at[d][0], place[s][1] - at[d][1]) * 1000))
    for r in rows:
        assert nation[r.site_id] == r.island and abs(r.distance - min(away(s, r.demand_id) for s in opened[r.island])) <= 1


def brute_components(pairs):
    label, beside = {}, collections.defaultdict(set)
    for u, v in pairs:
        beside[u].add(v)
        beside[v].add(u)
    for start in sorted(beside):
        todo = [] if start in label else [start]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = start
                todo.extend(beside[x])
    return label


def test_components_of_all_edges(spark):
    pairs = [(r.u, r.v) for r in views.edges(spark, SF_100).collect()]
    want = brute_components(pairs)
    assert {r.node: r.component for r in queries.road_components(spark, SF_100).collect()} == want
    sizes = collections.Counter(want.values())
    rank = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], c)))}
    assert {r.node: r.component_id for r in routing.ranked_components(spark, SF_100).collect()} == {n: rank[c] for n, c in want.items()}


def test_several_components(spark):
    """A ring, a chain, a star, two pairs and nodes whose numbers divide by 5."""
    pairs = [(i, (i + 1) % 9) for i in range(9)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 212)] + [(305, 310), (7000, 401)]
    want = brute_components(pairs)
    assert len(set(want.values())) == 5
    both = spark.createDataFrame([(u, v, 1.0) for a, b in pairs for u, v in ((a, b), (b, a))], "u long, v long, length double")
    assert {r.node: r.component for r in network.connected_components(both).collect()} == want


def test_routes_to_every_reached_node(spark):
    length = {(r.u, r.v): r.length for r in views.edges(spark, SF).collect()}
    want = {(r.source, r.node): r.distance for r in routing._reached(spark, SF).collect()}
    got = {(r.source, r.node): [int(x) for x in r.path.split(",")] for r in routing.shortest_routes(spark, SF).collect()}
    assert set(got) == set(want) and any(n % 3 for _, n in got)
    for (source, node), path in got.items():
        assert path[0] == source and path[-1] == node
        assert sum(length[e] for e in zip(path, path[1:])) == want[source, node]


def test_location_table_by_enumeration(spark):
    """Two districts of different sizes; one demand that a single site reaches, a site that nobody needs."""
    rows = [(1, 10, 0, 2, 5), (1, 11, 0, 2, 3), (1, 10, 1, 4, 1), (1, 12, 0, 2, 9), (2, 7, 5, 3, 2), (2, 9, 5, 3, 2), (2, 9, 6, 0, 8), (2, 7, 6, 0, 8)]
    got = {(r.district, r.mask): r.cost for r in solve.location_table(spark.createDataFrame(rows, "district long, site_id long, demand_id long, weight long, distance long"), 100.0).collect()}
    want = {}
    for district in (1, 2):
        mine = [r for r in rows if r[0] == district]
        sites = sorted({r[1] for r in mine})
        for mask in range(1, 1 << len(sites)):
            open_ = {s for i, s in enumerate(sites) if mask >> i & 1}
            best = {d: min((r[4] * r[3] for r in mine if r[2] == d and r[1] in open_), default=None) for d in {r[2] for r in mine}}
            if None not in best.values():
                want[district, mask] = 100.0 * len(open_) + sum(best.values())
    assert got == want and len(want) == 7
