import heapq
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from waywright.functions import costs, paths
from waywright.operators import graph, network, portal, reports, via
from waywright.sources import lattice, text_files
from waywright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    return lattice.edges(spark, SF).cache()


def rows(edges):
    return [tuple(r) for r in edges.select("u", "v", "length", "edge_id").collect()]


def dijkstra(links, root):
    out, heap = {}, [(0.0, root)]
    near = {}
    for u, v, l, _ in links:
        near.setdefault(u, []).append((v, l))
    while heap:
        d, x = heapq.heappop(heap)
        if x in out:
            continue
        out[x] = d
        for y, l in near.get(x, ()):
            if y not in out:
                heapq.heappush(heap, (d + l, y))
    return out


def frame(spark, links):
    return spark.createDataFrame([(k, u, v, float(l), 0.0, 1.0, 1.0, k % 3) for k, (u, v, l) in enumerate(links)], "edge_id long, u long, v long, length double, gain double, popularity double, width double, road_id long")


def node(spark, x):
    return spark.createDataFrame([(x,)], "node long")


def test_tiny_triangle(spark):
    e = frame(spark, [(0, 1, 1), (1, 2, 2), (2, 0, 10)])
    assert dict(graph.distances(e, node(spark, 2)).collect())[0] == 10
    assert dict(graph.distances(e, node(spark, 2), reverse=True).collect()) == {0: 3.0, 1: 2.0, 2: 0.0}


def test_kernel_relaxation_and_heap_agree(spark, edges):
    want = dijkstra(rows(edges), 0)
    assert dict(graph.distances(edges, node(spark, 0)).collect()) == want
    small = frame(spark, [(random.Random(7).randrange(12) if k % 2 else k % 12, (k * 7) % 12, 1 + k % 5) for k in range(40)])
    assert dict(graph.relaxed_distances(small, node(spark, 0), hops=2).collect()) == dict(graph.distances(small, node(spark, 0)).collect())


def test_hop_partition_is_a_first_come_search(spark, edges):
    near = {}
    for u, v, *_ in sorted(rows(edges)):
        near.setdefault(u, []).append(v)
    seeds = lattice.seeds(spark, SF).collect()
    want, queue = {r["node"]: (r["cell"], 0) for r in seeds}, deque(r["node"] for r in seeds)
    while queue:
        x = queue.popleft()
        for y in near.get(x, ()):
            if y not in want:
                want[y] = (want[x][0], want[x][1] + 1)
                queue.append(y)
    got = {r["node"]: (r["cell"], r["hop"]) for r in graph.hop_partition(edges, lattice.seeds(spark, SF)).collect()}
    assert got == want


def test_relaxed_hop_partition(spark):
    e = frame(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1), (5, 5, 1)])
    seeds = spark.createDataFrame([(0, 0), (1, 4)], "cell long, node long")
    assert sorted(map(tuple, graph.relaxed_hop_partition(e, seeds, hops=2).collect())) == sorted(map(tuple, graph.hop_partition(e, seeds).collect()))


def test_parallel_edges_self_loops_and_unreachable_nodes(spark):
    e = frame(spark, [(0, 1, 5), (0, 1, 3), (1, 1, 1), (2, 0, 1)])
    box = costs.Box("b", 0, 1, 0, 100, 0, 100, 0, 100)
    got = graph.trees(via.priced(e, costs.portfolio(box)[:1], box)).collect()
    assert {(r["node"], r["dist"], r["parent_edge"]) for r in got} == {(0, 0.0, None), (1, 3.0, 1)}


def test_via_routes_are_connected_and_exact(spark):
    got = catalog.g_reconstruct(spark, SF).collect()
    assert got and all(r["connected"] and r["length"] == r["x_length"] and r["gain"] == r["x_gain"] for r in got)


def test_certified_corridor_keeps_all_short_routes(spark, edges):
    ahead, back = graph.distances(edges, node(spark, 0)), graph.distances(edges, node(spark, 150), reverse=True)
    kept = network.certified(edges, ahead, back, 2600.0)
    assert 0 < kept.count() < edges.count()
    assert dict(graph.distances(kept, node(spark, 0)).collect())[150] == dict(ahead.collect())[150]


def test_costs_refuse_negative_and_infinite(spark):
    bad = spark.createDataFrame([("hinge", {"L": -1.0}, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "family string, params map<string,double>, length double, gain double, popularity double, width double, rho double, pstar double")
    with pytest.raises(Exception, match="edge cost"):
        bad.select(costs.cost()).collect()


def test_paths(spark):
    one = spark.createDataFrame([([1, 2, 2, 3, 1], [5, None, 5, 6, -1]), ([], [])], "p array<long>, r array<long>")
    got = one.select(paths.runs(F.col("p")), paths.repeated_vertices(F.col("p")), paths.road_changes(F.col("r")), paths.loop_erase("p")).collect()
    assert [list(map(lambda x: list(x) if isinstance(x, list) else x, r)) for r in got] == [[[1, 2, 3, 1], 2, 1, [1]], [[], 0, 0, []]]


def test_xy_round_trip_and_unknown_tag(spark, edges):
    n = lattice.nodes(spark, SF).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "elev")
    v, e = text_files.parse_xy(text_files.xy_lines(n, edges))
    assert v.count() == n.count() and {(r["edge_id"], r["u"], r["v"]) for r in e.collect()} == {(r["edge_id"], r["u"], r["v"]) for r in edges.collect()}
    with pytest.raises(Exception, match="unknown tag"):
        text_files.parse_xy(spark.createDataFrame([(0, "q 1 2")], "line long, value string"))[0].collect()


def test_archive_has_no_near_twins(spark):
    r = spark.createDataFrame([("q", k, list(range(k % 3, k % 3 + 10)), float(k), 0) for k in range(9)], "query string, route long, path array<long>, score double, road_changes int")
    kept = {x["route"] for x in portal.archive(r, alike=0.95).collect()}
    assert kept == {0, 1, 2}


def test_archive_reads_past_many_alike_routes(spark):
    kind = "query string, route long, path array<long>, score double, road_changes int"
    r = [("q", k, list(range(20)), float(k), 0) for k in range(1500)] + [("q", 2000 + k, list(range(100 * k, 100 * k + 20)), 5000.0 + k, 0) for k in range(1, 6)] + [("p", 1, [1], 0.0, 0), ("p", 2, [], 1.0, 0), ("p", 3, [], 2.0, 0)]
    kept = sorted((x["query"], x["route"]) for x in portal.archive(spark.createDataFrame(r, kind)).collect())
    assert kept == [("p", 1), ("p", 2), ("q", 0), ("q", 2001), ("q", 2002), ("q", 2003), ("q", 2004)]


def test_archive_holds_routes_of_one_corridor_further_apart(spark):
    kind = "query long, route long, path array<long>, score double, road_changes int, corridors array<array<long>>"
    r = [(1, 0, list(range(10)), 0.0, 0, [[3, 4]]), (1, 1, list(range(1, 11)), 1.0, 0, [[8, 9], [3, 4]]), (1, 2, list(range(1, 11)), 2.0, 0, [[4, 3]]), (1, 3, list(range(10, 20)), 3.0, 0, [[3, 4]])]
    assert {x["route"] for x in portal.archive(spark.createDataFrame(r, kind)).collect()} == {0, 2, 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "method string, box long, solved boolean, elapsed double, item long")
    assert reports.success(none, "method").count() == 0 and reports.ranked_times(none, "method").count() == 0
    e = frame(spark, [(0, 1, 1)]).where("false")
    assert network.hub_scores(e).count() == 0 and network.metric_constants(e).first()["usable"] == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30


def test_walks_are_found_at_any_depth_and_checked(spark):
    import json

    from waywright.sources import text_files

    sound = {"query_id": "a", "path_node_ids": [1, 2, 3], "csr_edge_ids": [10, 11], "query": {"source": 1, "target": 3}}
    texts = {
        "top": sound,
        "deep": {"x": [{"y": {"z": [[sound | {"query_id": "b", "inner": sound | {"query_id": "c", "edge_ids": [11], "csr_edge_ids": None}}]]}}, 7, "s"]},
        "bad": [sound | {"edge_ids": [10, 99], "csr_edge_ids": None}, sound | {"csr_edge_ids": [11, 10]}, sound | {"path_node_ids": [1, 2, 4]}, sound | {"query": {"source": 2}}, sound | {"csr_edge_ids": []}, {"path_node_ids": [1]}, {"path_node_ids": "x", "edge_ids": [1]}],
        "none": 5,
    }
    raw = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [("broken", "{oops"), ("null", None)], "file string, value string")
    edges = spark.createDataFrame([(10, 1, 2, 5.0, 1.0), (11, 2, 3, 7.0, 0.0)], "edge_id long, u long, v long, length double, gain double")
    rows = {(r["file"], r["json_path"]): r for r in text_files.witnessed(text_files.nested_walks(raw), edges).collect()}
    assert {k: r["reason"] for k, r in rows.items()} == {("top", "/"): None, ("deep", "/x[0]/y/z[0][0]"): None, ("deep", "/x[0]/y/z[0][0]/inner"): "other_nodes", ("bad", "[0]"): "unknown_edge", ("bad", "[1]"): "broken", ("bad", "[2]"): "other_nodes", ("bad", "[3]"): "wrong_ends", ("bad", "[4]"): "empty"}
    assert (rows["top", "/"]["length"], rows["top", "/"]["gain"], rows["deep", "/x[0]/y/z[0][0]"]["query_id"]) == (12.0, 1.0, "b")
