"""Graphs that are searched block by block give what one worker finds."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waywright import storage
from waywright.functions import costs
from waywright.operators import anytime, blocks, graph, local, portal, search, via
from waywright.sources import lattice

SF = "/root/testdata/sf0.001"
BOX = costs.Box("b", 0, 150, 0.0, 9000.0, 0.0, 9000.0, 90.0, 18.0)


def tree_rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else -1 if x is None else x for x in r) for r in df.collect())


@pytest.fixture
def steps_forbidden(monkeypatch):
    """Searches edge by edge, which take a job for every few edges of a way."""
    def no(*_, **__):
        raise AssertionError("stepped edge by edge")

    for name in ("relaxed_distances", "relaxed_hop_partition", "relaxed_trees"):
        monkeypatch.setattr(graph, name, no)


def test_blocks_agree_with_one_worker(spark, monkeypatch, steps_forbidden):
    e, seeds = lattice.edges(spark, SF).cache(), lattice.seeds(spark, SF)
    root = spark.createDataFrame([(150,), (999,)], "node long")
    specs = [s for s in costs.portfolio(BOX) if s.name in ("shortest_length", "hinge_width_strong")]
    far, cells, trees = sorted(graph.distances(e, root, reverse=True).collect()), sorted(graph.hop_partition(e, seeds).collect()), tree_rows(via.forest(e, specs, BOX))
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    assert len(blocks.Blocks(e).cuts) == 5
    assert sorted(graph.distances(e, root, reverse=True).collect()) == far
    assert sorted(graph.distances(e, root, reverse=True, longest=700.0).collect()) == [r for r in far if r[1] <= 700.0]
    assert sorted(graph.hop_partition(e, seeds).collect()) == cells
    assert tree_rows(via.forest(e, specs, BOX)) == trees


def test_trees_over_edges_of_no_cost_are_whole(spark, monkeypatch, steps_forbidden):
    rng = random.Random(5)
    rows = [(k, rng.randrange(30), rng.randrange(30), float(rng.choice([0, 0, 1])), 0.0, 1.0, 5.0, rng.choice([None, 0, 1])) for k in range(140)]
    e = spark.createDataFrame(rows, "edge_id long, u long, v long, length double, gain double, popularity double, width double, road_id long").cache()
    box = costs.Box("b", 0, 5, 0.0, 100.0, 0.0, 100.0, 90.0, 18.0)
    want = {(r["dir"], r["node"]): r["dist"] for r in via.forest(e, costs.portfolio(box)[:1], box).collect()}
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 20)
    got = via.forest(e, costs.portfolio(box)[:1], box).collect()
    assert {(r["dir"], r["node"]): r["dist"] for r in got} == want and all(r["len"] == r["dist"] for r in got)
    up = {(r["dir"], r["node"]): r["parent_node"] for r in got}
    for d, x in want:
        steps = 0
        while x is not None:
            x, steps = up[d, x], steps + 1
            assert steps <= 31


def test_paths_follow_only_near_parents(spark, monkeypatch):
    e = lattice.edges(spark, SF)
    tree = via.forest(e, costs.portfolio(BOX)[:1], BOX, ("fwd",)).cache()
    end = tree.where("node = 21").select("query", "spec", "dir", "node")
    seen = []
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(df.count()) or df)
    (way,) = graph.paths(tree, end).collect()
    near = tree.where(F.col("dist") <= tree.where("node = 21").first()["dist"]).count() - 1
    assert seen[0] == near < tree.count() - 1
    assert e.where(F.col("edge_id").isin(way["edges"])).agg(F.sum("length")).first()[0] == tree.where("node = 21").first()["dist"]


def test_least_ways_in_cells_block_by_block(spark, monkeypatch, steps_forbidden):
    e = lattice.edges(spark, SF)
    cells = graph.hop_partition(e, lattice.seeds(spark, SF)).cache()
    inside = search.in_cells(e, cells).cache()
    goals = cells.where("node % 3 = 0").select("cell", "node")
    roots = cells.where("node % 25 = 0").select("cell", "node")
    want = sorted(search.shortcuts(inside, roots, goals=goals).select("cell", "src", "dst", "length", "gain").collect())
    turned = sorted(search.shortcuts(inside, goals, goals=roots, turned=True).select("cell", "src", "dst", "length", "gain").collect())
    assert want and want == turned
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 150)
    assert sorted(search.least_in_cells(inside, roots, goals).collect()) == want


def test_many_batches_a_job_are_those_of_the_tables(spark, tmp_path):
    e = lattice.edges(spark, SF)
    cells = graph.hop_partition(e, lattice.seeds(spark, SF)).cache()
    inside, roots = search.in_cells(e, cells).cache(), cells.where("node % 100 = 0").select("cell", "node")
    want = local.LocalSearch(inside, roots, str(tmp_path / "a"), pops=8, hops=2).go_on().progress()
    one = local.BatchSearch(inside, roots, str(tmp_path / "b"), pops=8, batches=2)
    one.go_on(1)
    assert not one.tables.done
    again = local.BatchSearch(inside, roots, str(tmp_path / "b"), pops=8, batches=2).go_on()
    assert sorted(again.progress().collect()) == sorted(want.collect())


def test_contenders_hold_the_representatives(spark, monkeypatch):
    monkeypatch.setattr(portal, "CHUNK", 64)
    rng = random.Random(2)
    rows = [(rng.choice(["fwd", "bwd"]), rng.randrange(3), k, float(rng.randrange(4)), float(rng.randrange(3)), float(rng.randrange(9)), float(rng.randrange(9)), rng.randrange(3), rng.randrange(5)) for k in range(4000)]
    labels = spark.createDataFrame(rows, "dir string, portal long, label long, length double, gain double, pop_len double, wid_len double, road_changes int, priority long").repartition(5).cache()
    few = portal.contenders(labels, 4, ["dir", "portal"]).cache()
    assert few.count() <= 10 * 6
    assert sorted(portal.representatives(few).collect()) == sorted(portal.representatives(labels).collect())


def test_ground_from_portals_is_that_of_all_boundary_nodes(spark, monkeypatch):
    e = lattice.edges(spark, SF)
    cells = graph.hop_partition(e, lattice.seeds(spark, SF)).cache()
    at = lattice.nodes(spark, SF).select(F.col("id").alias("node"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    runs = {"b": (BOX, search.Config())}
    ways = lambda g: [r[:7] for r in sorted(anytime.base_overlay(g, runs)[0].select("src", "dst", "kind", "from_cell", "to_cell", "length", "gain").collect())]
    want = ways(anytime.ground(e, cells, at, [0, 150]))
    own = anytime.ground(e, cells, at, [0, 150], budgets=[4])
    assert ways(own) == want and own.ahead.select("root").distinct().count() < cells.count() / 2
    assert ways(anytime.ground(e, cells, at, [0, 150], budgets=[4], most=0, longest=9000.0)) == want


def test_trees_of_a_large_graph_end_where_routes_do(spark, monkeypatch, steps_forbidden):
    e = lattice.edges(spark, SF).cache()
    specs = [s for s in costs.portfolio(BOX) if s.name in ("shortest_length", "hinge_width_strong")]
    top = graph.dearest(e, specs, via.constants(e))
    whole = via.forest(e, specs, BOX).collect()
    near = lambda r: r["dist"] <= 600.0 * top[r["spec"]]
    assert all(near(r) for r in whole if r["len"] <= 600.0)
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    got = via.forest(e, specs, BOX, longest=600.0)
    rows = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else -1 if v is None else v for v in r) for r in x)
    assert rows(got.collect()) == rows(r for r in whole if near(r))
    assert got.count() < len(whole)


def test_repairs_of_a_large_graph_are_those_of_one_worker(spark, monkeypatch, steps_forbidden):
    e = lattice.edges(spark, SF).cache()
    box = costs.Box("b", 0, 150, 0.0, 9000.0, 0.0, 9000.0, 0.0, 99.0)
    specs = [s for s in costs.portfolio(box) if s.name in ("shortest_length", "hinge_width_strong")]
    trees = via.forest(e, specs, box).cache()
    routes = via.reconstruct(trees, via.join_via(trees, box).where("via % 5 = 0")).select("query", "spec", "via", "f_edges", "b_edges").cache()
    rows = lambda df: sorted((r["spec"], r["via"], r["side"], r["edges"]) for r in df.collect())
    want = rows(via.repaired(routes, e, specs))
    assert len(want) > 20
    fits = graph.fits
    monkeypatch.setattr(graph, "fits", lambda edges: edges is not e and fits(edges))
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    monkeypatch.setattr(via, "REPAIR_EDGES", 1)
    rounds, own = [], via._rerouted
    monkeypatch.setattr(via, "_rerouted", lambda *a: rounds.append(1) or own(*a))
    assert rows(via.repaired(routes, e, specs)) == want
    assert len(rounds) > 1


def test_trees_take_no_rounds_of_their_own_and_blocks_are_made_once(spark, monkeypatch, steps_forbidden):
    e = storage.stored(lattice.made_edges(spark, SF), "twice")
    spec = [s for s in costs.portfolio(BOX) if s.name == "shortest_length"]
    want = tree_rows(via.forest(e, spec, BOX, ("fwd",)))
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    calls, made, own, store = [], [], blocks.Blocks._tasks, blocks.stored
    monkeypatch.setattr(blocks.Blocks, "_tasks", lambda *a: calls.append(1) or own(*a))
    monkeypatch.setattr(blocks, "stored", lambda df, name, **k: made.append(name) or store(df, name, **k))
    source = spark.createDataFrame([(0,)], "node long")
    graph.distances(e, source)
    rounds = len(calls)
    assert tree_rows(via.forest(e, spec, BOX, ("fwd",))) == want
    assert len(calls) - rounds <= rounds + 1
    graph.distances(e, source, reverse=True)
    assert made.count("blocks") == 2  # of lengths, and of all that trees need


@pytest.mark.parametrize("costs_of", ["long", "short", "none", "wide"])
def test_nodes_settled_at_once_are_those_of_a_heap(monkeypatch, costs_of):
    rng = np.random.default_rng(3)
    n, m = 400, 1600
    frame = pd.DataFrame({"u": rng.integers(0, n, m), "v": rng.integers(0, n, m), "edge_id": np.arange(m), "road_id": rng.integers(-1, 4, m), **{c: rng.random(m) for c in ("gain", "popularity", "width")}})
    frame["length"] = {"long": rng.integers(100, 161, m) * 1.0, "short": 1 + rng.random(m), "none": rng.integers(0, 3, m) * 1.0, "wide": 10.0 ** rng.integers(-9, 9, m)}[costs_of]
    columns = ["length", "gain", "popularity", "width", "edge_id", "road_id"]
    known = pd.DataFrame({"came": -1, "node": [7, 250, 7], "a": [0.0, 30.0, 2.0], "b": [0.0, 1.0, 0.0], **dict.fromkeys(blocks.STATE, 0)})
    block = lambda: blocks.Block(0, np.array([300]), blocks._packed(columns)((0,), frame[(frame["u"] < 300) | (frame["v"] < 300)]), known["node"].to_numpy())
    for side in (0, 1):
        got = []
        for few in (0, 10**9):
            monkeypatch.setattr(blocks, "FEW", few)
            b = block()
            cost = b.links["length"].to_numpy()
            first, second, state, order = blocks.grown(b, side, cost, np.ones(len(cost)), known, 7)
            got.append([first.tolist(), second.tolist(), order.tolist(), {c: v.tolist() for c, v in state.items()}])
        assert got[0] == got[1] and len(got[0][2]) > 200
        offsets, to, order = b.csr[side]
        start = {int(b.at(np.array([x]))[0]): label for x, label in ((7, (0.0, 0.0)), (250, (30.0, 1.0)))}
        least = np.full((2, len(b.names)), np.inf)
        for x, label in start.items():
            least[:, x] = label
        heap = b._heap(offsets.tolist(), to.tolist(), cost[order].tolist(), [1.0] * len(order), *least, list(start), np.inf)
        assert [x.tolist() for x in heap] == got[0][:2]
        assert sum(p != blocks.ABSENT for p in got[0][3]["parent_node"]) > 100


def test_edges_inside_cells_are_joined_once_for_a_search(spark, monkeypatch, steps_forbidden):
    from waywright.plans import catalog, extra

    want = sorted(catalog.QUERIES["g_in_cell_bfs"](spark, SF).collect())
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    inside, searched, store, own = [], [], extra.stored, graph.distances
    monkeypatch.setattr(extra, "stored", lambda df, name: inside.append(store(df, name)) or inside[-1])
    monkeypatch.setattr(graph, "distances", lambda edges, *a, **k: searched.append(edges) or own(edges, *a, **k))
    assert sorted(catalog.QUERIES["g_in_cell_bfs"](spark, SF).collect()) == want
    assert len(searched) == 1 and any(x is searched[0] for x in inside)


def test_lattice_is_made_block_by_block_without_joins(spark, monkeypatch, tmp_path):
    import duckdb

    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 11 <> 3")  # keys with gaps
    part.write.parquet(f"{tmp_path}/part.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = base.sql(f"WITH {lattice.SQL} SELECT edge_id, u, v, length, gain, popularity, width, road_id FROM edges ORDER BY 1").fetchall()
    for nodes in (65_536, 16):  # one block; blocks with less than a row of nodes beside them
        monkeypatch.setattr(lattice, "BLOCK_NODES", nodes, raising=False)
        made = lattice.made_edges(spark, str(tmp_path))
        assert [tuple(r) for r in made.orderBy("edge_id").collect()] == want
    assert len(want) > 300 and not any(x in made._jdf.queryExecution().optimizedPlan().toString() for x in ("Window", "Join Inner"))


@pytest.mark.parametrize("lengths", ["whole", "real", "none"])
@pytest.mark.parametrize("scan", [1, 2, 30, 256])
def test_ways_near_portals_are_those_from_all_ends(scan, lengths):
    rng = np.random.default_rng(scan)
    side = 60
    at = np.arange(side * side)
    u = np.concatenate([at[at % side < side - 1], at[: -side], at[at % side > 0], at[side:]])
    v = np.concatenate([at[at % side < side - 1] + 1, at[side:], at[at % side > 0] - 1, at[:-side]])
    kept = rng.random(len(u)) < 0.9
    m = kept.sum()
    edges = pd.DataFrame({"edge_id": rng.permutation(m), "u": u[kept], "v": v[kept], "length": {"whole": rng.integers(1, 4, m) * 1.0, "real": 1 + rng.random(m), "none": rng.integers(0, 2, m) * 1.0}[lengths], "gain": rng.integers(0, 3, m) * 1.0})
    ends, portals = [int(x) for x in rng.choice(at, 1200, replace=False)], [5, 6, 1830]
    tails, heads = [*ends[:600], 5], [*ends[600:], 1830]
    marked = pd.DataFrame([*[(x, "portal") for x in portals], *[(x, "tail") for x in tails], *[(x, "head") for x in heads]], columns=["node", "kind"])
    ordered = edges.sort_values("edge_id", ignore_index=True)
    ways = lambda found: [(s, d, ordered["edge_id"][way].tolist()) for s, d, way in found]
    out = ways(search.search_cell(ordered, portals, set(tails), scan)) + [(x, x, []) for x in portals if x in tails]
    into = ways(search.search_cell(ordered, sorted(set(heads)), set(portals), scan)) + [(x, x, []) for x in portals if x in heads]
    got = search._near(scan)((0,), edges, marked)
    own = lambda ahead: sorted((r["src"], r["dst"], r["edges"]) for r in got[got["ahead"] == ahead].to_dict("records"))
    assert (own(True), own(False)) == (sorted(out), sorted(into))
    assert scan < 256 or len(into) > 20
    links = search.Links(ordered["u"], ordered["v"], ordered)
    search.search_to(ordered, set(heads), portals, min(scan, 30), links)
    assert len(links) < len(at) / 3  # what lies about the portals


def test_edges_are_dealt_to_blocks_as_few_rows(monkeypatch):
    rng = np.random.default_rng(8)
    m, cuts = 900, [100, 250]
    frame = pd.DataFrame({"u": rng.integers(0, 300, m), "v": rng.integers(0, 300, m), "length": rng.random(m), "edge_id": np.arange(m)})
    monkeypatch.setattr(blocks, "DEALT_EDGES", 200)
    dealt = pd.concat(blocks._dealt(cuts, list(frame.columns))(frame[k : k + 90] for k in range(0, m, 90)))
    assert len(dealt) == 4 * 3  # for each 270 edges a row a block
    place = lambda c: np.searchsorted(cuts, frame[c], side="right")
    for k, own in dealt.groupby("block"):
        want = blocks._packed(["length", "edge_id"])((k,), frame[(place("u") == k) | (place("v") == k)])
        got = blocks._whole(["length", "edge_id"])((k,), own)
        order = lambda b: sorted(zip(b.names[b.ends[0]], b.names[b.ends[1]], b.links["length"], b.links["edge_id"], strict=True))
        assert order(blocks.Block(k, np.array(cuts), got, np.array([], int))) == order(blocks.Block(k, np.array(cuts), want, np.array([], int)))


def test_direct_ways_leave_blocks_beyond_the_target(spark, monkeypatch, steps_forbidden):
    e = lattice.edges(spark, SF)
    specs = {s.name: s for s in costs.portfolio(BOX)}
    mixed = [costs.Mix(f"k{k}", specs["pop_width_reference"], specs["shortest_length"], k / 4) for k in range(5)]
    fixed = via.constants(e)
    for m in mixed:
        frame = e.select("*", costs.spec_cost(m, *fixed).alias("cost")).toPandas()
        assert np.allclose(frame["cost"], costs.price(m, {c: frame[c].to_numpy(float) for c in graph.METRICS}, *fixed), rtol=1e-12)
    boxes = [BOX, costs.Box("near", 0, 3, 0.0, 9000.0, 0.0, 9000.0, 90.0, 18.0), costs.Box("self", 7, 7, 0.0, 9000.0, 0.0, 9000.0, 90.0, 18.0), costs.Box("none", 0, 99_999, 0.0, 9000.0, 0.0, 9000.0, 90.0, 18.0)]
    own = [*list(specs.values())[::4], *mixed]
    want = [tree_rows(via.direct(e, own, b)) for b in boxes]
    assert [len(rows) for rows in want] == [13, 13, 13, 0]
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    assert [tree_rows(via.direct(e, own, b)) for b in boxes] == want
    searched, tasks = [], blocks.Blocks._tasks
    monkeypatch.setattr(blocks.Blocks, "_tasks", lambda self, rows, run, schema, todo: searched.append(set(todo)) or tasks(self, rows, run, schema, todo))
    assert tree_rows(via.direct(e, mixed, boxes[1])) == [r for r in want[1] if r[1].startswith("k")]
    assert max(set.union(*searched)) < 3


def test_probe_takes_no_step_a_job(spark, monkeypatch, steps_forbidden):
    from waywright.plans import catalog

    want = sorted(catalog.QUERIES["probe_interpolation"](spark, SF).collect())
    assert [r["spec"] for r in want] == ["k0", "k1", "k2", "k3", "k4"]
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 200)
    assert sorted(catalog.QUERIES["probe_interpolation"](spark, SF).collect()) == want


def test_records_leave_blocks_beyond_the_target(spark, monkeypatch, steps_forbidden):
    e = lattice.edges(spark, SF)
    hard = costs.Box("hard", 0, 3, 0.0, 9000.0, 0.0, 9000.0, 254.0, 18.0)
    want = sorted(via.adaptive(e, costs.portfolio(hard)[:4], hard, 2).collect())
    assert len(want) == 6
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 120)
    searched, tasks = set(), blocks.Blocks._tasks
    monkeypatch.setattr(blocks.Blocks, "_tasks", lambda self, rows, run, schema, todo: searched.update(todo) or tasks(self, rows, run, schema, todo))
    assert sorted(via.adaptive(e, costs.portfolio(hard)[:4], hard, 2).collect()) == want
    assert max(searched) < len(blocks.Blocks(e).cuts)


def test_branch_sums_are_those_of_their_steps(spark, monkeypatch):
    monkeypatch.setattr(graph, "BRANCH_NODES", 25)
    rng = random.Random(4)
    ids = rng.sample(range(1000), 160)
    up = {x: ids[rng.randrange(max(0, k - 4), k)] for k, x in enumerate(ids) if k}
    steps = [(x, y, float(rng.randrange(9))) for x, y in up.items()]
    worth = {x: w for x, _, w in steps}

    def plain(x):
        return worth[x] + plain(up[x]) if x in up else 0.0

    want = sorted((x, ids[0], plain(x)) for x in up)
    assert sorted(map(tuple, graph.branch_sums(spark.createDataFrame(steps, "node long, up long, value double")).collect())) == want
    assert graph.branch_sums(spark.createDataFrame([], "node long, up long, value double")).count() == 0


def test_branches_are_summed_without_their_paths(spark, monkeypatch, steps_forbidden):
    from waywright.plans import catalog

    monkeypatch.setattr(graph, "paths", lambda *_, **__: pytest.fail("each branch is written with all its edges"))
    monkeypatch.setattr(graph, "BRANCH_NODES", 50)
    back = dict(catalog.QUERIES["g_sssp_rev"](spark, SF).collect())
    assert dict(catalog.QUERIES["val_bwd_samples"](spark, SF).collect()) == {n: d for n, d in back.items() if n != 150}
