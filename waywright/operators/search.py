"""Portal search in rounds that treat all labels of a front at once.

Portals are boundary nodes of cells, with source and target. Shortcuts between the portals of one cell are searched cell by
cell; with the crossings between cells they are the overlay. From both ends, labels (partial routes) move over overlay edges
by a join a round. Labels that can't be completed within the bounds go, each portal keeps few representatives, and only those
that are new move on. Labels that meet at a portal, or over one more edge, make routes; an archive keeps diverse ones.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.functions.costs import Box
from waywright.operators import blocks, network, portal, via
from waywright.storage import dropped, ship, stored


@dataclass(frozen=True)
class Config:
    """Limits of a search. The defaults."""

    portals: int = 4
    labels: int = 4
    shortcuts: int = 2
    cell_visits: int = 2
    scan: int = 256
    repairs: int = 2
    bridges: int = 2
    rounds: int = 64
    archive: int = 5


def sweep(base: Config) -> dict[str, Config]:
    """base and variants that change one limit, then two that change several. Names and limits."""
    one = {"LABEL8": {"labels": 8}, "LABEL16": {"labels": 16}, "PORTAL8": {"portals": 8}, "SHORTCUT4": {"shortcuts": 4}, "BRIDGE4": {"bridges": 4}}
    more = {"LABEL8_PORTAL8": {"labels": 8, "portals": 8}, "ALL": {"labels": 16, "portals": 8, "shortcuts": 4, "bridges": 4}}
    return {"BASE": base} | {name: Config(**{**base.__dict__, **change}) for name, change in {**one, **more}.items()}


# ---- portals and overlay ---------------------------------------------------------------------------------------------


def mandatory(crossing: DataFrame) -> DataFrame:
    """(cell, node): the ends of each pair of neighbouring cells' least crossing."""
    own = network.mandatory_portals(crossing)
    return own.select(F.col("low").alias("cell"), F.col("u").alias("node")).union(own.select("high", "v")).distinct()


def _fill(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one cell's boundary nodes those chosen, up to budget, each as far as can be from those before."""
    frame = frame.sort_values("node").reset_index(drop=True)
    at = frame[["x", "y"]].to_numpy(float)
    chosen, near = frame["chosen"].to_numpy(bool).copy(), np.full(len(frame), np.inf)
    for k in np.nonzero(chosen)[0]:
        near = np.minimum(near, ((at - at[k]) ** 2).sum(1))
    while chosen.sum() < min(int(frame["budget"].iloc[0]), len(frame)):
        k = int(np.argmax(np.where(chosen, -1.0, near)))  # of equals the first, which has the least id
        chosen[k] = True
        near = np.minimum(near, ((at - at[k]) ** 2).sum(1))
    return frame.loc[chosen, ["cell", "node"]]


def active_portals(crossing: DataFrame, partition: DataFrame, points: DataFrame, ends: list[int], budget: int) -> DataFrame:
    """(cell, node): mandatory portals, then boundary nodes far from them up to budget or the number of neighbouring cells,
    and the ends. points: (node, x, y). A task holds the boundary nodes of one cell."""
    ship(crossing.sparkSession)
    needed = mandatory(crossing).withColumn("chosen", F.lit(True))
    beside = crossing.select(F.col("from_cell").alias("cell"), "to_cell").union(crossing.select("to_cell", "from_cell")).groupBy("cell").agg(F.greatest(F.count_distinct("to_cell"), F.lit(budget)).alias("budget"))
    edge = network.boundary_nodes(crossing).join(partition.select("node", "cell"), "node").join(points, "node")
    marked = edge.join(needed, ["cell", "node"], "left").join(beside, "cell").select("cell", "node", "x", "y", F.coalesce("chosen", F.lit(False)).alias("chosen"), "budget")
    filled = marked.groupBy("cell").applyInPandas(_fill, "cell long, node long")
    return filled.union(partition.where(F.col("node").isin(ends)).select("cell", "node")).distinct()


def in_cells(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges both of whose ends are in one cell, with it."""
    a, b = (partition.select(F.col("node").alias(end), F.col("cell").alias(name)) for end, name in (("u", "cell"), ("v", "_other")))
    return edges.join(a, "u").join(b, "v").where("cell = _other").drop("_other")


SHORTCUT = "cell long, src long, dst long, length double, gain double, pop_len double, wid_len double, road_changes int, first_road long, last_road long, edges array<long>"


class Links(dict):
    """(head, length, gain, edge row) of each edge from a node, looked up when a search first comes to it."""

    def __init__(self, tails: pd.Series, heads: pd.Series, edges: pd.DataFrame):
        super().__init__()
        tails = tails.to_numpy()
        self.rows = np.argsort(tails, kind="stable")
        self.tails = tails[self.rows]
        self.columns = [c.to_numpy() for c in (heads, edges["length"], edges["gain"])]

    def __missing__(self, x: int) -> list[tuple]:
        rows = self.rows[np.searchsorted(self.tails, x) : np.searchsorted(self.tails, x, side="right")]
        self[x] = out = list(zip(*(c[rows].tolist() for c in self.columns), rows.tolist(), strict=True))
        return out


def nearest(links: Links, root: int, most: int | None = None, longest: float | None = None) -> tuple[dict[int, tuple], set[int]]:
    """The node and edge row before each node on the least (length, gain) way to it, and the nodes expanded, which are the first most."""
    best, came, heap, done = {root: (0.0, 0.0)}, {}, [(0.0, 0.0, root)], set()
    while heap and (most is None or len(done) < most):
        l, g, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for y, dl, dg, row in links[x]:
            key = (l + dl, g + dg)
            if longest is not None and key[0] > longest:
                continue
            if y not in done and key < best.get(y, (float("inf"), 0.0)):
                best[y], came[y] = key, (x, row)
                heapq.heappush(heap, (*key, y))
    return came, done


def _way(came: dict[int, tuple], root: int, goal: int) -> list[int]:
    way, x = [], goal
    while x != root:
        x, row = came[x]
        way.append(row)
    return way[::-1]


def search_cell(edges: pd.DataFrame, roots: list[int], goals: set[int], most: int | None = None, longest: float | None = None, links: Links | None = None) -> list[tuple]:
    """From each root the least (length, gain) ways to goals over edges, as (src, dst, edge rows). most: nodes to expand;
    longest: of a way."""
    links = Links(edges["u"], edges["v"], edges) if links is None else links
    found = []
    for root in roots:
        came, done = nearest(links, root, most, longest)
        found += [(root, goal, _way(came, root, goal)) for goal in sorted(goals & done - {root})]
    return found


TESTED = 4  # hops after which a node is tested


def search_to(edges: pd.DataFrame, roots: set[int], goals: list[int], most: int, links: Links) -> list[tuple]:
    """search_cell from those roots that come to a goal, found from the goals on.

    If a goal is among the first most nodes from a root, it is from every node of the way to it: what is nearer to that node than the
    goal is so from the root. So a walk back from a goal ends at nodes that don't come to it; those that are no roots are tested every
    few hops."""
    back, found = Links(edges["v"], edges["u"], edges), []
    for goal in goals:
        seen, front, depth = {goal}, [goal], 0
        while front:
            ahead, depth = [], depth + 1
            for x in front:
                for y, *_ in back[x]:
                    if y in seen:
                        continue
                    seen.add(y)
                    if y in roots or depth % TESTED == 0:
                        came, done = nearest(links, y, most)
                        if goal not in done:
                            continue
                        if y in roots:
                            found.append((y, goal, _way(came, y, goal)))
                    ahead.append(y)
            front = ahead
    return found


def _shortcuts(most, longest, turned):
    def run(key, edges: pd.DataFrame, portals: pd.DataFrame) -> pd.DataFrame:
        own = sorted(map(int, portals.loc[portals["root"], "node"]))
        edges = edges.sort_values("edge_id").reset_index(drop=True)
        length, gain, pop, wid = (edges[c].to_numpy(float) for c in ("length", "gain", "popularity", "width"))
        roads, ids = edges["road_id"].fillna(-1).astype("int64").to_numpy(), edges["edge_id"].to_numpy()
        rows = []
        links = edges.rename(columns={"u": "v", "v": "u"}) if turned else edges
        for src, dst, way in search_cell(links, own, set(map(int, portals.loc[portals["goal"], "node"])), most, longest):
            if turned:
                src, dst, way = dst, src, way[::-1]
            known = [int(r) for r in roads[way] if r >= 0]
            changes = sum(a != b for a, b in zip(known, known[1:], strict=False))
            rows.append((key[0], src, dst, length[way].sum(), gain[way].sum(), (length[way] * pop[way]).sum(), (length[way] * wid[way]).sum(), changes, known[0] if known else None, known[-1] if known else None, ids[way].tolist()))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in SHORTCUT.split(", ")])
        return out.astype({"first_road": "Int64", "last_road": "Int64"})

    return run


def shortcuts(inside: DataFrame, portals: DataFrame, most: int | None = None, *, goals: DataFrame | None = None, turned: bool = False, longest: float | None = None) -> DataFrame:
    """The least (length, gain) way inside its cell from every portal to every other, or to every goal (cell, node); turned: from
    every goal to every portal. A task holds one cell."""
    ship(inside.sparkSession)
    marked = portals.select("cell", "node", F.lit(True).alias("root"), F.lit(goals is None).alias("goal"))
    if goals is not None:
        marked = marked.union(goals.select("cell", "node", F.lit(False), F.lit(True)))
    return inside.groupBy("cell").cogroup(marked.groupBy("cell")).applyInPandas(_shortcuts(most, longest, turned), SHORTCUT)


NEAR = "cell long, src long, dst long, ahead boolean, length double, gain double, edges array<long>"


def _near(scan):
    def run(key, edges, marked):
        edges = edges.sort_values("edge_id", ignore_index=True)
        ends, tails, heads = (set(map(int, marked.loc[marked["kind"] == kind, "node"])) for kind in ("portal", "tail", "head"))
        portals = sorted(ends)
        links = Links(edges["u"], edges["v"], edges)
        still = [[(x, x, []) for x in sorted(ends & own)] for own in (tails, heads)]
        found = [*still[0], *search_cell(edges, portals, tails, scan, links=links)], [*still[1], *search_to(edges, heads, portals, scan, links)]
        length, gain, ids = edges["length"].to_numpy(float), edges["gain"].to_numpy(float), edges["edge_id"].to_numpy()
        rows = [(key[0], src, dst, ahead, length[way].sum(), gain[way].sum(), ids[way].tolist()) for ahead, own in zip((True, False), found, strict=True) for src, dst, way in own]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in NEAR.split(", ")])

    return run


def ways_near(inside: DataFrame, portals: DataFrame, scan: int, tails: DataFrame | None = None, heads: DataFrame | None = None) -> DataFrame:
    """The least (length, gain) ways inside a cell, ahead from portals to tails and else from heads to portals, all (cell, node), that come
    to their end among the first scan nodes; a node that is both has a way of no edges. Searched around portals; a task holds one cell's
    edges as arrays."""
    ship(inside.sparkSession)
    kinds = [(portals, "portal"), (tails, "tail"), (heads, "head")]
    first, *rest = [df.select("cell", "node", F.lit(kind).alias("kind")) for df, kind in kinds if df is not None]
    for df in rest:
        first = first.union(df)
    own = inside.select("cell", "edge_id", "u", "v", "length", "gain")
    return own.groupBy("cell").cogroup(first.distinct().groupBy("cell")).applyInPandas(_near(scan), NEAR)


def least_in_cells(inside: DataFrame, portals: DataFrame, goals: DataFrame) -> DataFrame:
    """(cell, src, node, length, gain): of every portal and goal (cell, node) of its cell the least ways inside it, block by block;
    a cell may be of any size."""
    numbers = stored(network.numbered(portals.select("cell", F.col("node").alias("src")).distinct(), "src", "key"), "keys")
    start = numbers.select("key", F.col("src").alias("node"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    price = lambda _, links: (0, links["length"].to_numpy(float), links["gain"].to_numpy(float))
    own = blocks.Blocks(inside, ["length", "gain"], numbers.count()).labels(start, price, at=goals)
    return own.join(numbers, "key").where("node <> src").select("cell", "src", "node", F.col("a").alias("length"), F.col("b").alias("gain"))


def overlay(crossing_edges: DataFrame, portals: DataFrame, local: DataFrame, most: int) -> DataFrame:
    """Crossings between active portals, and shortcuts: at most `most` for each (src, dst, kind).

    crossing_edges: edges with from_cell and to_cell."""
    ends = portals.select("node").distinct()
    l = F.col("length")
    inter = crossing_edges.join(ends.withColumnRenamed("node", "u"), "u", "left_semi").join(ends.withColumnRenamed("node", "v"), "v", "left_semi")
    road = F.when(F.col("road_id") >= 0, F.col("road_id"))
    inter = inter.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit("inter").alias("kind"), "from_cell", "to_cell", "length", "gain", (l * F.col("popularity")).alias("pop_len"), (l * F.col("width")).alias("wid_len"), F.lit(0).alias("road_changes"), road.alias("first_road"), road.alias("last_road"), F.array("edge_id").alias("edges"))
    local = local.select("src", "dst", F.lit("local").alias("kind"), F.col("cell").alias("from_cell"), F.col("cell").alias("to_cell"), "length", "gain", "pop_len", "wid_len", "road_changes", "first_road", "last_road", "edges")
    return network.overlay(inter.union(local).withColumn("seq", F.element_at("edges", 1)), most).drop("rank", "seq")


# ---- labels ----------------------------------------------------------------------------------------------------------

SUMS = ["length", "gain", "pop_len", "wid_len"]


def roots(partition: DataFrame, box: Box) -> DataFrame:
    """The two empty labels, at source and target."""
    ends = F.when(F.col("node") == box.source, F.lit("fwd")).when(F.col("node") == box.target, F.lit("bwd"))
    both = F.when((F.col("node") == box.source) & (F.col("node") == box.target), F.array(F.lit("fwd"), F.lit("bwd"))).otherwise(F.array(ends))
    none = F.lit(None).cast("long")
    own = partition.where(F.col("node").isin(box.source, box.target)).select(F.explode(both).alias("dir"), F.col("node").alias("portal"), F.array("cell").alias("cells"))
    return own.select("dir", "portal", "cells", *[F.lit(0.0).alias(c) for c in SUMS], F.lit(0).alias("road_changes"), none.alias("first_road"), none.alias("last_road"), F.array().cast("array<bigint>").alias("edges"), F.lit(0.0).alias("priority"), F.xxhash64("dir", "portal").alias("label"), F.lit(False).alias("leak"))


def seam(before: Column, after: Column) -> Column:
    """One change of road if both are known and differ."""
    return F.coalesce((before != after).cast("int"), F.lit(0))


def continuity(label_road: Column, first: Column, last: Column, changes: Column, ahead: Column) -> Column:
    """(whether the road does not go on, changes with the seam): what extensions of equal length are ordered by."""
    beside = F.when(ahead, first).otherwise(last)
    goes_on = F.coalesce(label_road == beside, F.lit(False))
    return F.struct((~goes_on).alias("turns"), (changes + seam(label_road, beside)).alias("changes"))


def expand(labels: DataFrame, over: DataFrame, bounds: DataFrame, box: Box, at: dict[int, int], visits: int) -> DataFrame:
    """Children of labels over overlay edges, both ways at once. bounds: (dir, portal, rest), the least length that a label at
    a portal still needs; at: the cells of the box's ends. leak marks labels that enter the cell of the opposite end elsewhere than at it."""
    ahead = F.col("dir") == "fwd"
    fwd = over.select(F.lit("fwd").alias("dir"), F.col("src").alias("portal"), F.col("dst").alias("_to"), F.col("to_cell").alias("_cell"), *_edge())
    bwd = over.select(F.lit("bwd").alias("dir"), F.col("dst").alias("portal"), F.col("src").alias("_to"), F.col("from_cell").alias("_cell"), *_edge())
    joined = labels.where("not leak").join(fwd.union(bwd), ["dir", "portal"])
    seen = F.when(F.element_at("cells", -1) == F.col("_cell"), F.col("cells")).otherwise(F.concat("cells", F.array("_cell")))
    road = F.when(ahead, F.col("last_road")).otherwise(F.col("first_road"))
    beside = F.when(ahead, F.col("_first")).otherwise(F.col("_last"))
    first = F.when(ahead, F.coalesce("first_road", "_first")).otherwise(F.coalesce("_first", "first_road"))
    last = F.when(ahead, F.coalesce("_last", "last_road")).otherwise(F.coalesce("last_road", "_last"))
    path = F.when(ahead, F.concat("edges", "_edges")).otherwise(F.concat("_edges", "edges"))
    opposite = F.when(ahead, F.lit(box.target)).otherwise(F.lit(box.source))
    home = F.when(ahead, F.lit(at.get(box.target))).otherwise(F.lit(at.get(box.source)))
    made = joined.select("dir", F.col("_to").alias("portal"), seen.alias("cells"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS], (F.col("road_changes") + F.col("_changes") + seam(road, beside)).alias("road_changes"), first.alias("first_road"), last.alias("last_road"), path.alias("edges"), F.coalesce((F.col("_cell") == home) & (F.col("_to") != opposite), F.lit(False)).alias("leak"))
    entered = F.size(F.filter("cells", lambda x: x == F.element_at("cells", -1)))
    fits = made.where(~costs.hopeless(box, "length", "gain") & (entered <= visits)).join(bounds, ["dir", "portal"]).where(F.col("length") + F.col("rest") <= box.Lmax + 1e-6)
    return fits.select("dir", "portal", "cells", *SUMS, "road_changes", "first_road", "last_road", "edges", F.abs(F.col("length") + F.col("rest") - (box.Lmin + box.Lmax) / 2).alias("priority"), F.xxhash64("dir", "portal", "edges").alias("label"), "leak")


def _edge() -> list[Column]:
    return [*[F.col(c).alias(f"_{c}") for c in SUMS], F.col("road_changes").alias("_changes"), F.col("first_road").alias("_first"), F.col("last_road").alias("_last"), F.col("edges").alias("_edges")]


def grow(start: DataFrame, over: DataFrame, bounds: DataFrame, box: Box, cells: DataFrame, config: Config) -> DataFrame:
    """All labels that were representatives of their portal in some round, and those that leak: rounds end when none is new."""
    columns = start.columns
    at = {r["node"]: r["cell"] for r in cells.where(F.col("node").isin(box.source, box.target)).collect()}  # two rows
    kept, front, seen, picked = start, start, start.select("label"), start
    for _ in range(config.rounds):
        fresh = stored(expand(front, over, bounds, box, at, config.cell_visits).dropDuplicates(["label"]).join(seen, "label", "left_anti").select(*columns))
        if fresh.isEmpty():
            break
        now = stored(portal.representatives(kept.union(fresh.where("not leak")), config.labels).select(*columns))
        front = fresh.where("not leak").join(now.select("label"), "label", "left_semi").select(*columns)
        picked = picked.union(front).union(fresh.where("leak"))
        seen = seen.union(fresh.select("label"))
        kept = now
    return picked


# ---- joins and routes ------------------------------------------------------------------------------------------------


def _sides(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = ["portal", "label", "cells", *SUMS, "road_changes", "first_road", "last_road", "edges"]
    return tuple(labels.where(F.col("dir") == d).select(*[F.col(c).alias(f"{d[0]}_{c}") for c in keep]) for d in ("fwd", "bwd"))


def same_portal(labels: DataFrame) -> DataFrame:
    """Routes of forward and backward labels at one portal; labels at an end make routes with the empty label there."""
    f, b = _sides(labels)
    both = f.join(b, F.col("f_portal") == F.col("b_portal"))
    return both.select("f_label", "b_label", F.lit("portal").alias("join"), *[(F.col(f"f_{c}") + F.col(f"b_{c}")).alias(c) for c in SUMS], (F.col("f_road_changes") + F.col("b_road_changes") + seam(F.col("f_last_road"), F.col("b_first_road"))).alias("road_changes"), F.concat("f_edges", "b_edges").alias("edges"), _cells().alias("cells"))


def one_edge(labels: DataFrame, over: DataFrame) -> DataFrame:
    """Routes of a forward label, one overlay edge and a backward label."""
    f, b = _sides(labels)
    e = over.select("src", "dst", *_edge())
    three = f.join(e, F.col("f_portal") == F.col("src")).join(b, F.col("dst") == F.col("b_portal"))
    near = F.coalesce("f_last_road", "_last")
    far = F.coalesce("_last", "f_last_road")
    seams = seam(F.col("f_last_road"), F.col("_first")) + F.when(F.col("_first").isNull() & F.col("_last").isNull(), seam(near, F.col("b_first_road"))).otherwise(seam(far, F.col("b_first_road")))
    return three.select("f_label", "b_label", F.lit("edge").alias("join"), *[(F.col(f"f_{c}") + F.col(f"_{c}") + F.col(f"b_{c}")).alias(c) for c in SUMS], (F.col("f_road_changes") + F.col("_changes") + F.col("b_road_changes") + seams).alias("road_changes"), F.concat("f_edges", "_edges", "b_edges").alias("edges"), _cells().alias("cells"))


def _cells() -> Column:
    """Cells of both labels in order; the one where they meet counts once."""
    same = F.element_at("f_cells", -1) == F.element_at("b_cells", -1)
    return F.concat("f_cells", F.reverse(F.when(same, F.slice("b_cells", 1, F.size("b_cells") - 1)).otherwise(F.col("b_cells"))))


def terminal(labels: DataFrame, box: Box) -> DataFrame:
    """Routes of labels that have come to the opposite end."""
    f = labels.where((F.col("dir") == "fwd") & (F.col("portal") == box.target) | (F.col("dir") == "bwd") & (F.col("portal") == box.source))
    return f.where(F.size("edges") > 0).select("label", "dir", *SUMS, "road_changes", "edges")


def feasible_routes(joined: DataFrame, box: Box, visits: int) -> DataFrame:
    """Routes of a box, each edge sequence once, that enter no cell more than visits times."""
    often = F.array_max(F.transform(F.array_distinct("cells"), lambda c: F.size(F.filter("cells", lambda x: x == c))))
    shaped = joined.where(costs.feasible_mul(box) & (F.size("edges") > 0) & (often <= visits)).select("*", *costs.route_vector())
    scored = shaped.withColumn("score", costs.box_center(box))
    return scored.groupBy("edges").agg(F.min(F.struct("score", "road_changes", *SUMS)).alias("m")).select("edges", F.xxhash64("edges").alias("route"), "m.*")


def search(edges: DataFrame, partition: DataFrame, points: DataFrame, bounds: DataFrame, box: Box, config: Config = Config()) -> DataFrame:
    """(route, score, length, gain, pop_len, wid_len, road_changes, edges, connected, elementary): the archive of a box.

    partition: (node, cell); points: (node, x, y); bounds: (dir, portal, rest)."""
    crossing = stored(network.crossings(edges, partition))
    portals = stored(active_portals(crossing, partition, points, [box.source, box.target], config.portals))
    local = shortcuts(in_cells(edges, partition), portals)
    over = stored(overlay(edges.join(crossing.select("edge_id", "from_cell", "to_cell"), "edge_id"), portals, local, config.shortcuts))
    labels = grow(stored(roots(partition, box)), over, bounds, box, partition, config)
    return finish(labels, over, edges, box, config)


def finish(labels: DataFrame, over: DataFrame, edges: DataFrame, box: Box, config: Config = Config()) -> DataFrame:
    """The archive of the routes that labels make: feasible ones, checked edge by edge, elementary and diverse."""
    found = stored(feasible_routes(same_portal(labels).union(one_edge(labels, over)), box, config.cell_visits))
    sound = stored(via.validated(found, edges, ["route"]).where("connected and elementary"))
    starts = edges.select(F.col("edge_id").alias("_e"), F.col("u").alias("_n"))
    nodes = sound.select("route", F.posexplode("edges").alias("pos", "_e")).join(starts, "_e").groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_n"))), lambda x: x["_n"]).alias("path"))
    kept = portal.archive(sound.join(nodes, "route").select(F.lit(box.name).alias("query"), "route", "score", "road_changes", "path"), config.archive)
    return sound.join(kept.select("route"), "route", "left_semi").select("route", "score", *SUMS, "road_changes", "edges", "connected", "elementary")


# ---- bridges and repairs ---------------------------------------------------------------------------------------------


def covered(labels: DataFrame, partition: DataFrame) -> DataFrame:
    """(cell, fwd, bwd): labels of each direction at the portals of every cell that has any."""
    own = labels.join(partition.select(F.col("node").alias("portal"), "cell"), "portal")
    return own.groupBy("cell").agg(F.count_if(F.col("dir") == "fwd").alias("fwd"), F.count_if(F.col("dir") == "bwd").alias("bwd"))


def bridge_pairs(cover: DataFrame, crossing: DataFrame, tried: DataFrame) -> DataFrame:
    """(from_cell, to_cell): neighbours, the first reached from the source, the second from the target, that weren't tried and
    aren't both reached from both ends."""
    a = cover.where("fwd > 0").select(F.col("cell").alias("from_cell"), F.col("bwd").alias("_a"))
    b = cover.where("bwd > 0").select(F.col("cell").alias("to_cell"), F.col("fwd").alias("_b"))
    pairs = crossing.select("from_cell", "to_cell").distinct().join(a, "from_cell").join(b, "to_cell")
    return pairs.where(~((F.col("_a") > 0) & (F.col("_b") > 0))).select("from_cell", "to_cell").join(tried, ["from_cell", "to_cell"], "left_anti")


def bridges(pairs: DataFrame, crossing_edges: DataFrame, inside: DataFrame, portals: DataFrame, most: int, scan: int) -> DataFrame:
    """(src, dst, from_cell, to_cell, length, gain, edges): for each pair of cells the most shortest ways from a portal of the
    first over a crossing to a portal of the second. Ways inside a cell expand at most scan nodes; crossings that are no
    portals are reached by them."""
    edge = crossing_edges.join(pairs, ["from_cell", "to_cell"], "left_semi")
    l = stored(edge.select("edge_id", "u", "v", "from_cell", "to_cell", "length", "gain"))
    tails, heads = l.select(F.col("from_cell").alias("cell"), F.col("u").alias("node")), l.select(F.col("to_cell").alias("cell"), F.col("v").alias("node"))
    ways = stored(ways_near(inside, portals, scan, tails, heads))
    before = ways.where("ahead").select("src", F.col("dst").alias("u"), F.col("length").alias("_l0"), F.col("gain").alias("_g0"), F.col("edges").alias("_e0"))
    after = ways.where("not ahead").select(F.col("src").alias("v"), "dst", F.col("length").alias("_l1"), F.col("gain").alias("_g1"), F.col("edges").alias("_e1"))
    whole = l.join(before, "u").join(after, "v").select("src", "dst", "from_cell", "to_cell", (F.col("_l0") + F.col("length") + F.col("_l1")).alias("length"), (F.col("_g0") + F.col("gain") + F.col("_g1")).alias("gain"), F.concat("_e0", F.array("edge_id"), "_e1").alias("edges"))
    rank = Window.partitionBy("from_cell", "to_cell").orderBy("length", "gain", "src", "dst", "edges")
    return whole.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= most).drop("_r")


def directional_repairs(crossing_edges: DataFrame, inside: DataFrame, portals: DataFrame, over: DataFrame, most: int, scan: int, ahead: bool) -> DataFrame:
    """(cell, src, dst, length, gain, edges): up to most further overlay edges a cell, for pairs of neighbours that no overlay
    edge leads between: from a portal to a crossing and over it if ahead, else over a crossing and on to a portal."""
    known = over.where("kind = 'inter'").select("from_cell", "to_cell").distinct()
    open_ = stored(crossing_edges.join(known, ["from_cell", "to_cell"], "left_anti").select("edge_id", "u", "v", "from_cell", "to_cell", "length", "gain"))
    home, near = ("from_cell", "u") if ahead else ("to_cell", "v")
    ends = open_.select(F.col(home).alias("cell"), F.col(near).alias("node"))
    ways = ways_near(inside, portals, scan, ends if ahead else None, None if ahead else ends)
    end, meet = ("src", "dst") if ahead else ("dst", "src")
    ways = ways.select("cell", F.col(end).alias("_portal"), F.col(meet).alias(near), F.col("length").alias("_l"), F.col("gain").alias("_g"), F.col("edges").alias("_e"))
    whole = open_.join(ways, near)
    path = F.concat("_e", F.array("edge_id")) if ahead else F.concat(F.array("edge_id"), "_e")
    src, dst = (F.col("_portal"), F.col("v")) if ahead else (F.col("u"), F.col("_portal"))
    made = whole.select("cell", src.alias("src"), dst.alias("dst"), (F.col("length") + F.col("_l")).alias("length"), (F.col("gain") + F.col("_g")).alias("gain"), path.alias("edges"))
    rank = Window.partitionBy("cell").orderBy("length", "gain", "src", "dst", "edges")
    return made.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= most).drop("_r")


def dead_repairs(crossing_edges: DataFrame, portals: DataFrame, over: DataFrame) -> DataFrame:
    """(edge_id, src, dst): raw crossings into portals that no overlay edge leads to, so that backward labels can leave them."""
    dead = portals.select(F.col("node").alias("dst")).distinct().join(over.select("dst"), "dst", "left_anti")
    return crossing_edges.select("edge_id", F.col("u").alias("src"), F.col("v").alias("dst")).join(dead, "dst", "left_semi").select("edge_id", "src", "dst")
