"""Graph kernels against joins, portal search, seeds and workloads against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.operators import graph, network, portal, search, seeds, via, workloads
from waywright.plans import catalog, extra
from waywright.sources import lattice

SF = "/root/testdata/sf0.001"
BOX = catalog.BOX


def small(spark, n=14, m=50, seed=3):
    rng = random.Random(seed)
    rows = [(k, rng.randrange(n), rng.randrange(n), float(rng.randint(1, 4)), float(rng.randint(0, 3)), float(rng.randint(0, 255)), float(rng.randint(5, 25)), rng.choice([None, 0, 1, 2])) for k in range(m)]
    return spark.createDataFrame(rows, "edge_id long, u long, v long, length double, gain double, popularity double, width double, road_id long")


def plain(df):
    return {(r["spec"], r["dir"], r["node"]): tuple(round(x, 6) if isinstance(x, float) else x for x in r[4:]) for r in df.collect()}


def test_both_forms_of_the_trees_agree(spark, monkeypatch):
    e = small(spark).cache()
    box = costs.Box("b", 0, 5, 0.0, 100.0, 0.0, 100.0, 90.0, 18.0)
    specs = [s for s in costs.portfolio(box) if s.name in ("shortest_length", "hinge_width_strong", "slope_exp_beta_8")]
    want = plain(via.forest(e, specs, box))
    assert len(want) > 40 and want == plain(graph.trees(via.priced(e, specs, box, ("fwd", "bwd"))))
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    assert plain(via.forest(e, specs, box)) == want


def test_both_forms_take_several_sources(spark, monkeypatch):
    e = small(spark).cache()
    roots = spark.createDataFrame([(0,), (3,), (3,), (77,)], "node long")
    for reverse in (False, True):
        want = dict(graph.distances(e, roots, reverse=reverse).collect())
        assert want[0] == want[3] == want[77] == 0.0
        assert want == dict(graph.relaxed_distances(e, roots.distinct(), reverse=reverse).collect())
    monkeypatch.setattr(graph, "KERNEL_EDGES", 0)
    assert dict(graph.distances(e, roots).collect()) == dict(graph.relaxed_distances(e, roots.distinct()).collect())


def test_three_forms_of_a_cost_agree(spark):
    e = small(spark)
    rho, pstar = via.constants(e)
    rows = e.orderBy("edge_id").toPandas()
    arrays = {c: rows[c].to_numpy(float) for c in graph.METRICS}
    specs = costs.portfolio(BOX)
    by_map = e.crossJoin(costs.specs_frame(spark, specs)).withColumn("rho", F.lit(rho)).withColumn("pstar", F.lit(pstar)).select("edge_id", "spec", costs.cost().alias("c")).toPandas().pivot(index="edge_id", columns="spec", values="c")
    by_spec = via.priced(e, specs, BOX).select("edge_id", "spec", "cost").toPandas().pivot(index="edge_id", columns="spec", values="cost")
    for s in specs:
        own = costs.price(s, arrays, rho, pstar)
        assert np.allclose(own, by_map[s.name]) and np.allclose(own, by_spec[s.name])
    with pytest.raises(ValueError, match="edge cost"):
        costs.price(costs.Spec("x", "hinge", {"L": -1.0}), arrays, rho, pstar)


def test_portals_fill_up_with_far_ones():
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"cell": 1, "node": rng.permutation(30), "x": rng.integers(0, 50, 30), "y": rng.integers(0, 50, 30), "chosen": [k < 2 for k in range(30)], "budget": 6})
    got = set(search._fill(frame)["node"])
    at = {r.node: (r.x, r.y) for r in frame.itertuples()}
    want = {r.node for r in frame.itertuples() if r.chosen}
    while len(want) < 6:
        want.add(max(set(at) - want, key=lambda n: (min((at[n][0] - at[w][0]) ** 2 + (at[n][1] - at[w][1]) ** 2 for w in want), -n)))
    assert got == want


def test_portal_search_keeps_sound_diverse_routes(spark):
    got = catalog.QUERIES["ps_main"](spark, SF).collect()
    assert 0 < len(got) <= 5
    edges = {r["edge_id"]: r for r in lattice.edges(spark, SF).collect()}
    for r in got:
        way = [edges[x] for x in r["edges"]]
        assert way[0]["u"] == BOX.source and way[-1]["v"] == BOX.target and all(a["v"] == b["u"] for a, b in zip(way, way[1:]))
        assert abs(sum(x["length"] for x in way) - r["length"]) < 1e-6 and BOX.Lmin <= r["length"] <= BOX.Lmax and r["elementary"]
        roads = [x["road_id"] for x in way]
        assert r["road_changes"] == sum(a != b for a, b in zip(roads, roads[1:]))
    own = lattice.edges(spark, SF)
    d = lambda source, reverse: graph.distances(own, spark.createDataFrame([(source,)], "node long"), reverse=reverse)
    bounds = d(BOX.target, True).select(F.lit("fwd").alias("dir"), F.col("node").alias("portal"), F.col("dist").alias("rest")).union(d(BOX.source, False).select(F.lit("bwd"), "node", "dist")).cache()
    spots = lattice.nodes(spark, SF).select(F.col("id").alias("node"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    few = search.search(own, catalog.cells(spark, SF), spots, bounds, BOX, search.Config(labels=1, rounds=6)).collect()
    assert all(r["connected"] and r["elementary"] for r in few)
    emitted = catalog.QUERIES["ps_join_emit"](spark, SF).collect()
    assert len(emitted) >= len(got) and all(r["connected"] and r["length"] == r["x_length"] and r["gain"] == r["x_gain"] for r in emitted)


def test_bridges_are_connected_ways_over_one_crossing(spark):
    edges = {r["edge_id"]: r for r in lattice.edges(spark, SF).collect()}
    got = catalog.QUERIES["ps_bridge"](spark, SF).collect()
    assert got
    for r in got:
        way = [edges[x] for x in r["edges"]]
        assert way[0]["u"] == r["src"] and way[-1]["v"] == r["dst"] and all(a["v"] == b["u"] for a, b in zip(way, way[1:]))
        assert abs(sum(x["length"] for x in way) - r["length"]) < 1e-6


def test_via_records(spark):
    rows = {r["spec"]: r for r in catalog.QUERIES["rec_via"](spark, SF).collect()}
    hits = {r["spec"]: r["via"] for r in catalog.QUERIES["top_first_hit"](spark, SF).collect()}
    assert len(rows) == 3
    for spec, r in rows.items():
        assert r["rejected"] == 0 and r["exact"] + r["non_elementary"] == r["profile_feasible"] <= r["profiles"]
        assert r["first_hit"] == hits.get(spec)
    assert all(r["connected"] for r in catalog.QUERIES["rec_direct"](spark, SF).collect())
    mixed = catalog.QUERIES["via_mixed"](spark, SF).collect()
    assert len(mixed) == 9 and {r["fwd_spec"]: r["feasible"] for r in mixed if r["fwd_spec"] == r["bwd_spec"]} == {s: r["profile_feasible"] for s, r in rows.items()}


def spread(spark, at, score=None):
    rows = [(k, float(x), float(y), float(score[k]) if score is not None else 0.0) for k, (x, y) in enumerate(at)]
    return spark.createDataFrame(rows, "node long, x double, y double, score double").repartition(3)


def test_seeds(spark):
    rng = np.random.default_rng(0)
    at, score = rng.uniform(0, 100, (60, 2)), rng.integers(1, 5, 60).astype(float)
    points = spread(spark, at, score).cache()
    own = [r["node"] for r in seeds.spread_sample(points, 15, 0.25, 7)]
    assert len(set(own)) == 15 and own[0] == int(score.argmax()) and own == [r["node"] for r in seeds.spread_sample(points.repartition(5), 15, 0.25, 7)]
    assert sorted(r["node"] for r in seeds.spread_sample(spread(spark, np.zeros((5, 2))), 5)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        seeds.spread_sample(spread(spark, at[:3]), 4)
    filled = seeds.deduplicated([3, 3, 9], points, 16)
    assert filled[:2] == [3, 9] and len(set(filled)) == 16
    for k in range(2, 16):
        near = [min(((p - at[i]) ** 2).sum() for i in filled[:k]) for p in at]
        assert near[filled[k]] == max(near)
    assert sorted(seeds.deduplicated([], points, 70)) == list(range(60))
    centers = [tuple(at[k]) for k in own[:4]]
    moved = seeds.refined(centers, points, 1, 2, 60, 1)  # a batch of all points: one step of the plain rule, twice
    seen, want = np.zeros(4), np.array(centers)
    for _ in range(2):
        owner = ((at[:, None] - want[None]) ** 2).sum(-1).argmin(1)
        for j in range(4):
            mine = at[owner == j]
            seen[j] += len(mine)
            if len(mine):
                want[j] += len(mine) / seen[j] * (mine.mean(0) - want[j])
    assert np.allclose(moved, want) and seeds.refined(centers, points.limit(0)) == centers


def test_draws_follow_their_weights(spark):
    points = spark.range(4).select(F.col("id").alias("node"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    draws = points.crossJoin(spark.range(4000).select(F.col("id").alias("turn")))
    time = -F.log((F.pmod(F.xxhash64("node", F.lit(3), F.col("turn").cast("int")), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / (F.col("node") + 1)
    won = dict(draws.groupBy("turn").agg(F.min_by("node", time).alias("node")).groupBy("node").count().collect())
    assert all(abs(won[k] / 4000 - (k + 1) / 10) < 0.03 for k in range(4))
    assert seeds.raced(points, F.lit(0.0), 1, 1) is None and seeds.raced(points, F.when(F.col("node") == 2, 1.0).otherwise(0.0), 1, 1)["node"] == 2


def test_nearest_sites_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    sites = np.concatenate([rng.integers(0, 40, (60, 2)), [[5000, 7000], [5000, 7001]], [[3, 3], [3, 3]]])
    at = np.concatenate([rng.integers(-30, 90, (400, 2)), rng.integers(0, 8000, (60, 2)), [[5000, 7000]]])
    frame = lambda rows, key: spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rows)], f"{key} long, x double, y double")
    from waywright.operators.nearest import nearest

    got = {r["node"]: (r["cell"], r["d2"]) for r in nearest(frame(at, "node"), frame(sites, "cell")).collect()}
    far = ((at[:, None] - sites[None]) ** 2).sum(-1)
    assert got == {k: (int(d.argmin()), float(d.min())) for k, d in enumerate(far)}
    assert nearest(frame(at, "node"), frame(sites, "cell").limit(0)).count() == 0
    assert nearest(frame(at, "node"), frame(sites[:1], "cell")).count() == len(at)


def test_blobs_have_bounded_radius(spark):
    links = [(x, y) for x in range(30) for y in (x - 1, x + 1) if 0 <= y < 30] + [(40, 41)]
    edges = spark.createDataFrame(links, "u long, v long")
    nodes = spark.createDataFrame([(x,) for x in [*range(30), 40, 41, 50]], "node long")
    first = spark.createDataFrame([(10,), (11,), (20,)], "node long")
    rows = {r["node"]: (r["root"], r["hop"]) for r in seeds.blobs(edges, nodes, 3, first).collect()}
    assert len(rows) == 33 and rows[10] == (10, 0) and rows[9] == (10, 1) and rows[12] == (11, 1) and rows[50] == (50, 0)
    for x, (root, hop) in rows.items():
        assert hop == abs(x - root) <= 2 and all(rows[y][0] == root for y in range(min(x, root), max(x, root) + 1))


def test_random_costs_are_those_of_one_generator(spark):
    e = small(spark, m=200).repartition(7)
    want = np.random.default_rng(42).random(200)
    got = {r["edge_id"]: r["cost"] for r in extra.random_costs(e, 42).collect()}
    rows = {r["edge_id"]: r["length"] for r in e.collect()}
    assert all(abs(got[k] - rows[k] * (0.2 + 3 * want[k])) < 1e-12 for k in rows)


def test_boxes_hold_their_witness(spark):
    r = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 30000.0, 420.0, 180.0, 14.0), (3, 50.0, 2.0, 1.0, 300.0)], "route long, L double, H double, P double, W double")
    got = workloads.boxes(r).join(r, "route").collect()
    assert len(got) == 24
    for x in got:
        assert max(0.0, x["Lmin"]) <= x["L"] <= x["Lmax"] and x["Hmin"] <= x["H"] <= x["Hmax"] and x["Pmin"] <= x["P"] and x["W"] <= x["Wmax"]


def test_representatives_take_winners_first(spark):
    rows = [("fwd", 1, k, p, l, g, 0.0 if l == 0 else w * l, 10.0 * l, c) for k, (p, l, g, w, c) in enumerate([(5, 10.0, 3.0, 9.0, 2), (1, 20.0, 3.0, 9.0, 2), (7, 30.0, 0.0, 9.0, 2), (8, 40.0, 3.0, 50.0, 2), (9, 50.0, 3.0, 9.0, 0), (2, 60.0, 3.0, 9.0, 2), (3, 0.0, 4.0, 0.0, 3)])]
    labels = spark.createDataFrame(rows, "dir string, portal long, label long, priority long, length double, gain double, pop_len double, wid_len double, road_changes long")
    got = {r["label"]: (r["wins"], r["place"]) for r in portal.representatives(labels, 6).collect()}
    assert got[1] == (2, 1) and got[6] == (1, 2) and got[2] == (1, 3) and got[3] == (1, 4) and got[4] == (1, 5) and got[5] == (0, 6) and 0 not in got


def test_rows_are_numbered_in_order(spark):
    df = spark.range(0, 1000, 3).repartition(5)
    got = [r["k"] for r in network.numbered(df, "id", "k").orderBy("id").collect()]
    assert got == list(range(334))


def test_config_sweep_changes_one_limit_at_a_time():
    own = search.sweep(search.Config())
    assert own["LABEL8"].labels == 8 and own["BASE"] == search.Config() and own["ALL"].bridges == 4


def test_label_setting_finds_a_feasible_simple_path(spark):
    from waywright.operators import labels

    e = small(spark, n=8, m=26, seed=5).cache()
    rows = [tuple(r) for r in e.orderBy("edge_id").collect()]

    def every(node, seen, l, g, p, w):
        if node == 5:
            yield l, g, p, w
            return
        for _, u, v, dl, dg, pop, wid, _ in rows:
            if u == node and v not in seen:
                yield from every(v, seen | {v}, l + dl, g + dg, p + dl * pop, w + dl * wid)

    routes = list(every(0, {0}, 0.0, 0.0, 0.0, 0.0))
    for lo, hi, pmin, wmax in ((0, 30, 0, 30), (5, 9, 80, 20), (8, 20, 120, 17), (1, 2, 250, 5), (6, 12, 100, 16)):
        box = costs.Box("b", 0, 5, float(lo), float(hi), 0.0, 40.0, float(pmin), float(wmax))
        fits = [r for r in routes if lo <= r[0] <= hi and r[1] <= 40 and r[2] >= pmin * r[0] and r[3] <= wmax * r[0]]
        got = labels.search(e, box).first()
        assert (got["status"] == "found") == bool(fits)
        if fits:
            way = {r[0]: r for r in rows}
            nodes = [0, *[way[k][2] for k in got["edges"]]]
            assert nodes == got["path"] and len(set(nodes)) == len(nodes)
            assert any(abs(got["length"] - r[0]) < 1e-9 and abs(got["pop_len"] - r[2]) < 1e-9 for r in fits)
        assert got["capped"] == 0
        narrow = labels.search(e, box, per_node=1, beam=2).first()
        assert narrow["status"] == "found" if narrow["capped"] == 0 and fits else narrow["status"] in ("found", "exhausted")
    assert labels.search(e, costs.Box("b", 0, 5, 0.0, 30.0, 0.0, 40.0, 0.0, 30.0), most=0).first()["status"] == "budget_reached"


def test_adaptive_specs_follow_what_is_broken_most(spark):
    one = via.adaptive_spec(BOX, "H_low", 0)
    assert (one.name, one.family, one.params["L"], one.params["H"]) == ("adaptive_high_elevation_r1", "high_elevation", 0.125, 6.0)
    assert via.adaptive_spec(BOX, "W_high", 9).params["w"] == 256.0 and via.adaptive_spec(BOX, None, 0) is None
    assert [via.adaptive_spec(BOX, "L_low", k).family for k in (0, 1)] == ["slope_inverse", "slope_exp"]
    e = lattice.edges(spark, SF)
    easy = costs.Box("easy", 0, 150, 0.0, 1e6, 0.0, 1e6, 0.0, 99.0)
    assert via.adaptive(e, costs.portfolio(easy)[:2], easy, 3).count() == 2
    hard = costs.Box("hard", 0, 150, 0.0, 1e6, 0.0, 1e6, 254.0, 99.0)
    rows = via.adaptive(e, costs.portfolio(hard)[:2], hard, 3).collect()
    assert sorted(r["spec"] for r in rows)[:3] == ["adaptive_popularity_r1", "adaptive_popularity_r2", "adaptive_popularity_r3"] and len(rows) == 5


def test_repair_keeps_one_half_and_avoids_its_nodes(spark):
    links = [(0, 1), (1, 2), (2, 3), (3, 1), (1, 4), (3, 5), (5, 4), (0, 6), (6, 3), (2, 7), (7, 2)]
    e = spark.createDataFrame([(k, u, v, 1.0, 0.0, 1.0, 1.0, None) for k, (u, v) in enumerate(links)], "edge_id long, u long, v long, length double, gain double, popularity double, width double, road_id long")
    specs = [costs.Spec("shortest_length", "physical_length")]
    routes = spark.createDataFrame([("q", "shortest_length", 3, [0, 1, 2], [3, 4]), ("q", "shortest_length", 7, [0, 1, 9], [10, 2, 3, 4])], "query string, spec string, via long, f_edges array<long>, b_edges array<long>")
    got = {(r["via"], r["side"]): r["edges"] for r in via.repaired(routes, e, specs).collect()}
    assert got == {(3, "A"): [0, 1, 2, 5, 6], (3, "B"): [7, 8, 3, 4]}


def test_repaired_routes_are_elementary(spark):
    rows = catalog.QUERIES["g_repair"](spark, SF).collect()
    assert rows and all(r["connected"] and r["elementary"] for r in rows)
    back = dict(catalog.QUERIES["g_sssp_rev"](spark, SF).collect())
    rebuilt = {r["node"]: r["length"] for r in catalog.QUERIES["val_bwd_samples"](spark, SF).collect()}
    assert rebuilt == {n: d for n, d in back.items() if n != BOX.target}


def test_ranked_times_by_buckets(spark):
    from waywright.operators import reports

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.5, rng.uniform(0, 9), 100.0])) for _ in range(400)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "method string, elapsed double")
    for buckets in (1, 7, 1000):
        for r in reports.ranked_times(df, "method", buckets=buckets).collect():
            own = sorted(t for m, t in rows if m == r["method"])
            at = lambda q: own[max(1, int(np.ceil(q * len(own)))) - 1]  # noqa: E731, B023
            assert (r["n"], r["median"], r["p90"], r["p95"], r["most"]) == (len(own), at(0.5), at(0.9), at(0.95), own[-1])


def test_xy_headers_and_ends_are_checked(spark):
    from waywright.sources import text_files

    lines = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "line long, value string")
    good = ("nodes 2 edges 1 attributes 5", "v 0 1 1 5", "v 1 2 2 6", "e 0 1 100 10 3 4 7")
    v, e = text_files.checked_xy(lines(*good))
    assert v.count() == 2 and e.count() == 1
    for bad, why in ((good[1:], "no header"), (("nodes 3 edges 1", *good[1:]), "says 3 nodes"), ((*good[:3], "e 0 9 100 10 3 4 7"), "node 9")):
        with pytest.raises(ValueError, match=why):
            text_files.checked_xy(lines(*bad))
