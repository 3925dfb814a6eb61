"""Portal search in rounds: LOCAL searches, bridges and repairs, many runs at once, events and status."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from waywright.functions.costs import Box
from waywright.operators import anytime, local, search

EDGE = "edge_id long, u long, v long, length double, gain double, popularity double, width double, road_id long"
CELL = "node long, cell long"


def town(spark, links, cells):
    """Edges (u, v, length) with other metrics from their ends; cells by node; nodes on a line."""
    rows = [(k, u, v, float(l), float((u + v) % 3), float(100 + (u * 7 + v) % 50), float(6 + (u + 2 * v) % 9), (u + v) % 4) for k, (u, v, l) in enumerate(links)]
    edges = spark.createDataFrame(rows, EDGE)
    partition = spark.createDataFrame(sorted(cells.items()), CELL)
    points = spark.createDataFrame([(n, float(n), 0.0) for n in cells], "node long, x double, y double")
    return edges, partition, points


def box(source, target, longest=100.0, name="b"):
    return Box(name, source, target, 0.0, longest, 0.0, 1000.0, 0.0, 100.0)


#: Two cells, 0-3 and 10-13. The least crossing leads back, so its ends are the only portals; the way ahead is from 3 to 13.
APART = [(0, 1, 2), (1, 2, 2), (2, 3, 2), (10, 11, 2), (11, 12, 2), (13, 12, 2), (13, 10, 2), (10, 1, 1), (3, 13, 5)]
HALVES = {n: int(n >= 10) for n in (0, 1, 2, 3, 10, 11, 12, 13)}


def test_bridges_join_cells_that_portals_leave_apart(spark):
    e, p, at = town(spark, APART, HALVES)
    g = anytime.ground(e, p, at, [0, 12])
    few = search.Config(portals=1)
    plain = anytime.Search(g, {"b": (box(0, 12), few)}, mend=False).go_on()
    assert plain.routes().count() == 0 and plain.statuses().first()["status"] == "exhausted"
    mended = anytime.Search(g, {"b": (box(0, 12), few)}).go_on()
    learnt = {(r["kind"], r["src"], r["dst"]) for r in mended.learnt.frame().collect()}
    assert any(kind == "bridge" for kind, _, _ in learnt)
    (route,) = mended.archive().collect()
    rows = {r["edge_id"]: r for r in e.collect()}
    way = [rows[k] for k in route["edges"]]
    assert [way[0]["u"], *[x["v"] for x in way]] == [0, 1, 2, 3, 13, 12] and route["length"] == 13.0 and route["corridors"] == ["0>1"]
    for r in mended.learnt.frame().where("kind = 'bridge'").collect():
        path = [rows[k] for k in r["edges"]]
        assert path[0]["u"] == r["src"] and path[-1]["v"] == r["dst"] and all(a["v"] == b["u"] for a, b in pairwise(path)) and sum(x["length"] for x in path) == r["length"]
    events = mended.events()
    steps = mended.steps.frame().groupBy("round", "run", "dir").count()
    counted = events.where(F.col("event").isin(*anytime.REASONS)).groupBy("round", "run", "dir").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, counted.collect()))
    early = anytime.Search(g, {"b": (box(0, 12), few)}).go_on(1)
    assert early.statuses().first()["status"] == "open" and early.round == 1
    assert anytime.Search(g, {"b": (box(0, 12), few)}).go_on(seconds=0.0).round == 0


def test_stuck_labels_get_repairs_a_cell(spark):
    """Cell 1 can be left for cell 2 only over a crossing whose ends are no portals; the labels stuck there call for it."""
    links = [(0, 1, 1), (1, 10, 1), (10, 11, 1), (11, 12, 1), (20, 10, 1), (12, 22, 2), (22, 21, 1), (21, 20, 3), (10, 1, 4), (13, 22, 9), (11, 13, 1)]
    cells = {0: 0, 1: 0, 10: 1, 11: 1, 12: 1, 13: 1, 20: 2, 21: 2, 22: 2}
    e, p, at = town(spark, links, cells)
    g = anytime.ground(e, p, at, [0, 21])
    limits = search.Config(portals=1, bridges=0, repairs=1)
    s = anytime.Search(g, {"b": (box(0, 21), limits)}).go_on()
    kinds = s.learnt.frame().groupBy("kind", "from_cell", "to_cell").count().collect()
    repairs = [r for r in kinds if r["kind"] in ("fwd_repair", "bwd_repair")]
    assert repairs and all(r["count"] <= 1 for r in repairs)
    assert s.stuck().count() > 0 and s.archive().count() == 1
    assert anytime.Search(g, {"b": (box(0, 21), search.Config(portals=1, bridges=0, repairs=0))}, mend=False).go_on().routes().count() == 0


def grid(seed, side=5, cut=3):
    """A side x side grid of streets, some one-way, in cells of cut columns."""
    rng = random.Random(seed)
    links = []
    for y in range(side):
        for x in range(side):
            for a, b in ((x + 1, y), (x, y + 1)):
                if a < side and b < side:
                    u, v = y * side + x, b * side + a
                    links += [(i, j, rng.randint(1, 5)) for i, j in ((u, v), (v, u)) if rng.random() < 0.9]
    return links, {y * side + x: x // cut + 2 * (y // cut) for y in range(side) for x in range(side)}


def labels_of(s, run):
    return sorted((r["dir"], r["portal"], tuple(r["edges"]), r["round"]) for r in s.labels.frame().where(F.col("run") == run).collect())


def test_many_runs_equal_single_ones(spark):
    links, cells = grid(5)
    g = anytime.ground(*town(spark, links, cells), [0, 24, 4])
    runs = {"a|BASE": (box(0, 24, 22.0, "a"), search.Config(labels=2)), "c|LABEL8": (box(4, 24, 14.0, "c"), search.Config(labels=3, portals=8))}
    together = anytime.Search(g, runs).go_on(2)
    for name, run in runs.items():
        alone = anytime.Search(g, {name: run}).go_on(2)
        assert labels_of(together, name) == labels_of(alone, name) and len(labels_of(alone, name)) > 5
    assert anytime.told(together).count() == 2
    assert together.snapshot().where("round = 2").count() > 0


def brute(links, cells, root, longest):
    """All simple ways from root inside its cell: node -> (length, gain, width, lack of popularity, edges)."""
    out = {}
    rows = [(k, u, v, float(l), float((u + v) % 3), float(100 + (u * 7 + v) % 50), float(6 + (u + 2 * v) % 9)) for k, (u, v, l) in enumerate(links)]
    top = max(r[5] for r in rows)

    def walk(node, seen, sums, path):
        out.setdefault(node, []).append((sums, path))
        for k, u, v, l, h, p, w in rows:
            if u == node and v not in seen and cells[v] == cells[root] and sums[0] + l <= longest:
                walk(v, seen | {v}, (sums[0] + l, sums[1] + h, sums[2] + l * w, sums[3] + l * (top - p)), (*path, k))

    walk(root, {root}, (0.0, 0.0, 0.0, 0.0), ())
    return out, top


def test_local_searches_equal_all_simple_ways(spark):
    links, cells = grid(8, 4, 2)
    e, p, _ = town(spark, links, cells)
    inside = search.in_cells(e, p).cache()
    roots = p.where("node IN (0, 5, 10, 11)")
    run = lambda **options: local.LocalSearch(inside, roots, local.folder(spark, "t"), **options)
    one = run(pops=2, hops=2).go_on().state.collect()
    many = run(pops=None, several=True, hops=2).go_on().state.collect()
    best = run(pops=None, several=True, keep="best", hops=2).go_on().state.collect()
    for root in (0, 5, 10, 11):
        ways, top = brute(links, cells, root, 1e9)
        got = {r["node"]: (r["length"], r["gain"]) for r in one if r["root"] == root}
        assert got == {n: min((s[0], s[1]) for s, _ in own) for n, own in ways.items()}
        for node, own in ways.items():
            sums = {s for s, _ in own}
            front = {s for s in sums if not any(o != s and all(a <= b for a, b in zip(o, s, strict=True)) for o in sums)}
            mine = [(r["length"], r["gain"], r["wid_len"], r["length"] * top - r["pop_len"]) for r in many if r["root"] == root and r["node"] == node]
            assert sorted(mine) == sorted(front)
            kept = [(r["length"], r["gain"], r["wid_len"], r["length"] * top - r["pop_len"]) for r in best if r["root"] == root and r["node"] == node]
            assert set(kept) <= front and min(s[0] for s in front) == min(s[0] for s in kept)
    back = run(pops=None, ahead=False, hops=4).go_on().state.collect()
    for r in back:
        assert r["length"] == min(s[0] for s, _ in brute(links, cells, r["node"], 1e9)[0][r["root"]])


def test_a_search_goes_on_from_its_folder(spark):
    links, cells = grid(3, 4, 4)
    e, p, _ = town(spark, links, cells)
    inside, roots = search.in_cells(e, p).cache(), p.where("node IN (0, 9)")
    folder = local.folder(spark, "resumed")
    first = local.LocalSearch(inside, roots, folder, pops=3).go_on(3)
    assert not first.done and first.progress().agg(F.max("popped")).first()[0] <= 3
    settled = {(r["root"], r["node"]): r["length"] for r in first.settled().collect()}
    again = local.LocalSearch(inside, roots, folder, pops=3)
    assert again.batch == 3
    whole = local.LocalSearch(inside, roots, local.folder(spark, "whole"), pops=None, hops=3).go_on()
    ends = {(r["root"], r["node"]): (r["length"], r["gain"], tuple(r["edges"])) for r in whole.state.collect()}
    assert {(r["root"], r["node"]): (r["length"], r["gain"], tuple(r["edges"])) for r in again.go_on().state.collect()} == ends
    assert settled and all(ends[k][0] == l for k, l in settled.items()) and whole.settled().count() == len(ends)


@pytest.mark.parametrize("most", [0, 200_000])
def test_ground_has_the_least_ways(spark, most):
    links, cells = grid(11, 4, 2)
    e, p, at = town(spark, links, cells)
    g = anytime.ground(e, p, at, [0], most=most)
    for r in g.ahead.collect():
        ways, _ = brute(links, cells, r["root"], 1e9)
        assert (r["length"], r["gain"]) == min((s[0], s[1]) for s, _ in ways[r["node"]])
    assert g.back.count() == g.ahead.count()
