"""Via routes: forward trees joined with backward trees, boxes, validation and reports."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.functions.costs import Box, Spec
from waywright.operators import graph, network
from waywright.storage import dropped, stored


def constants(edges: DataFrame) -> tuple[float, float]:
    """Just over the steepest slope, and the highest popularity."""
    own = network.metric_constants(edges).first()
    return (math.nextafter(own["max_slope"], math.inf) if own["max_slope"] is not None else 0.0), own["pstar"] or 0.0


def priced(edges: DataFrame, specs: list[Spec], box: Box, directions: tuple[str, ...] = ("fwd",)) -> DataFrame:
    """Edges with the cost of every spec, once for each direction's root."""
    rho, pstar = constants(edges)
    roots = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(box.source if d == "fwd" else box.target).cast("long").alias("root")) for d in directions])
    each = edges.select("*", F.inline(costs.spec_rows(specs))).withColumn("cost", costs.row_cost(rho, pstar))
    return each.select(*edges.columns, "spec", costs.checked(F.col("cost")).alias("cost"), F.lit(box.name).alias("query"), F.inline(roots))


def forest(edges: DataFrame, specs: list[Spec], box: Box, directions: tuple[str, ...] = ("fwd", "bwd"), longest: float | None = None) -> DataFrame:
    """Trees of all specs from the box's source (fwd) and to its target (bwd); longest as in graph.forest."""
    roots = [(box.name, d, box.source if d == "fwd" else box.target) for d in directions]
    return graph.forest(edges, specs, roots, lambda: priced(edges, specs, box, directions), constants(edges), longest)


def direct(edges: DataFrame, specs: list[Spec], box: Box) -> DataFrame:
    """Of the trees of all specs from the box's source the target's row. A large graph is searched no further than the target costs."""
    roots = [(box.name, "fwd", box.source)]
    own = graph.forest(edges, specs, roots, lambda: priced(edges, specs, box), constants(edges), goals={"fwd": box.target})
    return own.where(F.col("node") == box.target)


def join_via(forest: DataFrame, box: Box) -> DataFrame:
    """(query, spec, via, cost, length, gain, pop_len, wid_len, road_changes): each node that both trees reach; routes of
    no length go unless source and target are one."""
    f, b = forest.where("dir = 'fwd'"), forest.where("dir = 'bwd'")
    keys = ["query", "spec", "node"]
    both = f.select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("dist", "len", "gain", "pop_len", "wid_len", "road_changes", "last_road")]).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("dist", "len", "gain", "pop_len", "wid_len", "road_changes", "first_road")]), keys)
    seam = F.coalesce((F.col("f_last_road") != F.col("b_first_road")).cast("int"), F.lit(0))
    total = both.select("query", "spec", F.col("node").alias("via"), (F.col("f_dist") + F.col("b_dist")).alias("cost"), *[(F.col(f"f_{c}") + F.col(f"b_{c}")).alias(n) for c, n in (("len", "length"), ("gain", "gain"), ("pop_len", "pop_len"), ("wid_len", "wid_len"))], (F.col("f_road_changes") + F.col("b_road_changes") + seam).alias("road_changes"))
    return total if box.source == box.target else total.where("length > 0")


def mixed(forest: DataFrame, box: Box) -> DataFrame:
    """(fwd_spec, bwd_spec, via, ..., feasible, violation): profiles of every ordered pair of specs, by node."""
    keep = ("len", "gain", "pop_len", "wid_len", "road_changes")
    f = forest.where("dir = 'fwd'").select("query", F.col("spec").alias("fwd_spec"), F.col("node").alias("via"), *[F.col(c).alias(f"f_{c}") for c in keep], F.col("last_road").alias("f_road"))
    b = forest.where("dir = 'bwd'").select("query", F.col("spec").alias("bwd_spec"), F.col("node").alias("via"), *[F.col(c).alias(f"b_{c}") for c in keep], F.col("first_road").alias("b_road"))
    seam = F.coalesce((F.col("f_road") != F.col("b_road")).cast("int"), F.lit(0))
    both = f.join(b, ["query", "via"]).select("query", "fwd_spec", "bwd_spec", "via", *[(F.col(f"f_{c}") + F.col(f"b_{c}")).alias("length" if c == "len" else c) for c in keep[:4]], (F.col("f_road_changes") + F.col("b_road_changes") + seam).alias("road_changes"))
    shaped = (both if box.source == box.target else both.where("length > 0")).select("*", *costs.route_vector())
    return shaped.withColumn("feasible", costs.feasible_mul(box)).withColumn("violation", costs.violation_score(box))


def best(profiles: DataFrame, box: Box, k: int = 5) -> DataFrame:
    """The k feasible profiles of each (query, spec) nearest to the box's centre."""
    shaped = profiles.select("query", "spec", "via", "cost", "length", "gain", "pop_len", "wid_len", "road_changes", *costs.route_vector()).where(costs.feasible_mul(box))
    own = Window.partitionBy("query", "spec").orderBy("score", "length", "cost", "via")
    return shaped.withColumn("score", costs.box_center(box)).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def adaptive_spec(box: Box, dominant: str | None, turn: int) -> Spec | None:
    """The spec that a portfolio without a feasible route tries next, for what its best record breaks most; each turn it is
    twice as strong, up to 64. Fixed values: families and parameters."""
    k, R = float(2 ** min(turn + 1, 6)), {"Wref": box.Wmax, "Pref": box.Pmin}
    bent = "slope_inverse" if turn % 2 == 0 else "slope_exp"
    rows = {
        "H_low": ("high_elevation", "high_elevation", {"L": max(0.03, 0.25 / k), "H": 3 * k, "w": 3, "p": 2}),
        "H_high": ("low_elevation", "low_elevation", {"L": 1, "h": 2 * k, "w": 2, "p": 2}),
        "W_high": ("width", "hinge", {"L": 1, "w": 4 * k, "p": 3}),
        "P_low": ("popularity", "hinge", {"L": 1, "w": 3, "p": 4 * k}),
        "L_high": ("length_high", "hinge", {"L": 1 + k, "w": 3, "p": 2}),
        "L_low": ("length_low_quality_detour", bent, {"beta": 6 * k, "w": 3, "p": 3}),
    }
    if dominant not in rows:
        return None
    name, family, params = rows[dominant]
    return Spec(f"adaptive_{name}_r{turn + 1}", family, {**params, **R})


def records(edges: DataFrame, specs: list[Spec], box: Box) -> DataFrame:
    """Each spec's direct route: (spec, L, H, P, W, road_changes, feasible, violation, dominant); no row if there is none."""
    at = direct(edges, specs, box).select("spec", F.col("len").alias("length"), "gain", "pop_len", "wid_len", "road_changes")
    shaped = at.select("*", *costs.route_vector())
    return shaped.select("spec", "L", "H", "P", "W", "road_changes", costs.feasible_mul(box).alias("feasible"), costs.violation_score(box).alias("violation"), costs.dominant_violation(box).alias("dominant"))


def adaptive(edges: DataFrame, specs: list[Spec], box: Box, turns: int) -> DataFrame:
    """records of the specs and, as long as none is feasible, of up to turns further specs, each made for the best record so
    far by violation, length, climb and name. A record a spec comes to the driver."""
    own = stored(records(edges, specs, box))
    for turn in range(turns):
        rows = own.collect()
        if not rows or any(r["feasible"] for r in rows):
            break
        near = min(rows, key=lambda r: (r["violation"], r["L"], r["H"], r["spec"]))
        spec = adaptive_spec(box, near["dominant"], turn)
        if spec is None:
            break
        own = stored(own.union(records(edges, [spec], box)))
    return own


REPAIR_EDGES = 32  # of a large graph, around routes at first, in a line
REPAIRED = "query string, spec string, via long, side string, edges array<long>"


def repaired(routes: DataFrame, edges: DataFrame, specs: list[Spec]) -> DataFrame:
    """REPAIRED of routes (query, spec, via, f_edges, b_edges) whose halves meet again: side A keeps the half before via and
    goes on to the end without its nodes, side B the other way round. No row where there is no such way.

    A graph of more than KERNEL_EDGES edges is searched around the routes, and further around those whose search has met the rim,
    until none has."""
    own = routes.where((F.size("f_edges") > 0) & (F.size("b_edges") > 0)).select("query", "spec", "via", "f_edges", "b_edges")
    if graph.fits(edges):
        return _rerouted(own, edges, None, specs, constants(edges)).where("edges IS NOT NULL")
    own, fixed, out = stored(own, "repair"), constants(edges), None
    reach = REPAIR_EDGES * (edges.agg(F.max("length")).first()[0] or 1.0)
    while not own.isEmpty():
        steps = own.select(F.explode(F.concat("f_edges", "b_edges")).alias("edge_id")).distinct().join(edges, "edge_id")
        ball = stored(graph.distances(edges, steps.select(F.explode(F.array("u", "v")).alias("node")).distinct(), longest=reach).select("node"), "ball")
        near = stored(network.within(edges, ball), "near")
        if not graph.fits(near):
            raise ValueError(f"a repair meets more than {graph.KERNEL_EDGES} edges; restrict them to a corridor")
        rim = lambda end, other: edges.join(ball.select(F.col("node").alias(end)), end, "left_semi").join(ball.select(F.col("node").alias(other)), other, "left_anti").select(F.col(end).alias("node"))
        rims = tuple([r["node"] for r in rim(*ends).distinct().collect()] for ends in (("u", "v"), ("v", "u")))  # of at most KERNEL_EDGES edges
        made = stored(_rerouted(own, near, rims, specs, fixed), "repaired")
        whole = made.where("edges IS NOT NULL")
        out = whole if out is None else out.unionByName(whole)
        own = own.join(made.where("side = 'open'").select("query", "spec", "via"), ["query", "spec", "via"], "left_semi").select(*own.columns)
        dropped(near, ball)
        reach *= 4
    return own.sparkSession.createDataFrame([], REPAIRED) if out is None else out


def _rerouted(routes: DataFrame, edges: DataFrame, rims: tuple[list[int], list[int]] | None, specs: list[Spec], fixed: tuple[float, float]) -> DataFrame:
    """REPAIRED over edges, which are sent to every worker; a row of side `open` and no edges, and no other, for a route whose search
    has met the rims: nodes with edges that go out of these, and come into them."""
    known, (rho, pstar) = {s.name: s for s in specs}, fixed
    shared = edges.sparkSession.sparkContext.broadcast((graph.Network(edges), rims))

    def run(frames):
        net, rims = shared.value
        where = {int(e): k for k, e in enumerate(net.ids)}
        if rims is not None:
            marks = tuple(bytearray(len(net.names)) for _ in rims)
            for mark, nodes in zip(marks, rims, strict=True):
                for n in nodes:
                    if (i := net.at(n)) is not None:
                        mark[i] = 1
            rims = marks
        price = {}
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.spec not in price:
                    price[r.spec] = costs.price(known[r.spec], net.metrics, rho, pstar).tolist()
                node = lambda e, side: int(net.names[net.ends[side][where[int(e)]]])
                source, target = node(r.f_edges[0], 0), node(r.b_edges[-1], 1)
                before, after = {source, *(node(e, 1) for e in r.f_edges)}, {target, *(node(e, 0) for e in r.b_edges)}
                ways = {side: net.path(price[r.spec], int(a), int(b), barred, rims) for side, a, b, barred in (("A", r.via, target, before - {r.via}), ("B", source, r.via, after - {r.via}))}
                if False in ways.values():
                    out.append((r.query, r.spec, r.via, "open", None))
                    continue
                for side, way in ways.items():
                    if way is not None:
                        out.append((r.query, r.spec, r.via, side, [*map(int, r.f_edges), *way] if side == "A" else [*way, *map(int, r.b_edges)]))
            yield pd.DataFrame(out, columns=["query", "spec", "via", "side", "edges"])

    spread = routes if rims is None else routes.repartition(edges.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, REPAIRED)


def reconstruct(forest: DataFrame, profiles: DataFrame) -> DataFrame:
    """profiles with edges, the ids of the whole route through via, and f_edges and b_edges, its halves."""
    f = graph.paths(forest, profiles.select("query", "spec", F.lit("fwd").alias("dir"), F.col("via").alias("node")).distinct())
    b = graph.paths(forest, profiles.select("query", "spec", F.lit("bwd").alias("dir"), F.col("via").alias("node")).distinct())
    f, b = f.select("query", "spec", F.col("node").alias("via"), F.col("edges").alias("_f")), b.select("query", "spec", F.col("node").alias("via"), F.col("edges").alias("_b"))
    return profiles.join(f, ["query", "spec", "via"]).join(b, ["query", "spec", "via"]).withColumn("edges", F.concat("_f", "_b")).withColumnsRenamed({"_f": "f_edges", "_b": "b_edges"})


def validated(routes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """routes with what their edges say: connected, elementary, exact sums. A route of unknown edges is not connected."""
    each = routes.select(*keys, F.posexplode("edges").alias("pos", "edge_id"))
    known = each.join(edges, "edge_id", "left")
    w = Window.partitionBy(*keys).orderBy("pos")
    linked = known.withColumn("ok", F.col("u").isNotNull() & F.coalesce(F.lag("v").over(w) == F.col("u"), F.col("pos") == 0))
    sums = linked.groupBy(*keys).agg(
        F.min("ok").alias("connected"), F.sum("length").alias("x_length"), F.sum("gain").alias("x_gain"), F.sum(F.col("length") * F.col("popularity")).alias("x_pop_len"), F.sum(F.col("length") * F.col("width")).alias("x_wid_len"),
        (F.count_distinct("v") == F.count("*")).alias("_apart"), F.max(F.when(F.col("pos") == 0, F.col("u"))).alias("_start"), F.collect_set("v").alias("_ends"),
    )
    sums = sums.withColumn("elementary", F.col("_apart") & ~F.array_contains("_ends", F.col("_start"))).drop("_apart", "_start", "_ends")
    return routes.join(sums, keys, "left")
