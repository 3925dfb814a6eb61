"""Anytime portal search of many runs at once: rounds with bridges, repairs, a status and a record of events.

A run is a box with limits (Config). All runs share each round's joins, told apart by their name; a run that has nothing left to
do takes no part. A round moves the labels of the front over the overlay, keeps the representatives of each portal, mends
what the round has shown to be missing, and remembers everything it has counted:

* a portal whose labels found no edge to leave by is stuck: its cell gets further edges over crossings to neighbours that the
  overlay doesn't lead to, a few a cell and direction in the whole search; a portal that no overlay edge enters gets the
  raw crossings into it;
* neighbouring cells, one reached from the source and one from the target, get bridges: ways from a portal over a crossing to a
  portal. Only pairs with a cell that this round has reached anew are looked at, so a pair is tried once. It takes its
  best bridge, and further ones over crossings that it hasn't used;
* what the search has learnt is a layer of the overlay that belongs to the run. Labels that were kept before move over
  new edges only.

A search ends when no run has a front, or at the caller's deadline or number of rounds, which its status says."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.functions.costs import Box
from waywright.operators import graph, local, network, portal, search, via
from waywright.operators.search import SUMS, Config
from waywright.storage import owned, shared_folder, stored

LABEL = ["run", "dir", "portal", "stops", "cells", *SUMS, "road_changes", "first_road", "last_road", "edges", "priority", "label", "leak"]
EDGE = ["layer", "src", "dst", "kind", "from_cell", "to_cell", *SUMS, "road_changes", "first_road", "last_road", "edges"]
#: What becomes of a step, in the order in which it is asked.
REASONS = ("met", "too_long", "too_high", "no_way", "visits", "over_bound", "repeated", "leaked", "capped", "kept")


class Log:
    """A table to which rounds append; one folder, read whole."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", None
        owned(spark, self.path)

    def append(self, df: DataFrame) -> None:
        self.schema = self.schema or df.schema
        df.write.mode("append").parquet(self.path)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


@dataclass
class Ground:
    """What all runs search on: edges, (node, cell), (node, x, y), crossings with their metrics, and the ways between
    boundary nodes inside their cells, from each root (ahead) and to it (back). Roots are all boundary nodes, or the portals of
    all runs and their ends."""

    edges: DataFrame
    partition: DataFrame
    points: DataFrame
    crossing: DataFrame
    ahead: DataFrame
    back: DataFrame


CELL_EDGES = 200_000  # of the largest cell, up to which one task searches a cell


def ground(edges: DataFrame, partition: DataFrame, points: DataFrame, ends: list[int], *, longest: float | None = None, most: int = CELL_EDGES, budgets: list[int] | None = None) -> Ground:
    """Crossings, and the least ways between the boundary nodes and ends of each cell, inside it.

    budgets: the numbers of portals a cell of all runs to come; then only ways from and to portals and ends are searched, which are
    all that rounds use. Where the largest cell has at most `most` edges, a task searches one cell; else only what lies within longest
    of a root, or where there is no longest, LocalSearch searches all by joins. Lengths and climbs are the same; of equal ways
    either may be taken."""
    spark = edges.sparkSession
    crossing = stored(edges.join(network.crossings(edges, partition).select("edge_id", "from_cell", "to_cell"), "edge_id"), "crossing")
    inside = stored(search.in_cells(edges, partition), "inside")
    rims = stored(network.boundary_nodes(crossing).union(spark.createDataFrame([(int(n),) for n in ends], "node long")).distinct().join(partition.select("node", "cell"), "node").select("cell", "node"), "roots")
    roots = rims
    for budget in budgets or []:
        own = search.active_portals(crossing, partition, points, ends, budget)
        roots = own if roots is rims else roots.union(own)
    roots = roots if roots is rims else stored(roots.distinct(), "roots")
    small = local.largest(inside) <= most

    def ways(turned: bool) -> DataFrame:
        if small:
            return search.shortcuts(inside, roots, goals=rims, turned=turned)
        if longest is None:
            return local.shortcuts(local.LocalSearch(inside, roots, local.folder(spark, "local"), pops=None, hops=4, ahead=not turned).go_on().state, rims, ahead=not turned)
        near = graph.distances(inside, roots.select("node"), reverse=turned, longest=longest)
        return search.shortcuts(stored(network.within(inside, near), "near"), roots, goals=rims, turned=turned, longest=longest)

    none, columns = F.lit(None).cast("long"), [*SUMS, "road_changes", "first_road", "last_road", "edges"]
    still = roots.select("cell", F.col("node").alias("src"), F.col("node").alias("dst"), *[F.lit(0.0).alias(c) for c in SUMS], F.lit(0).alias("road_changes"), none.alias("first_road"), none.alias("last_road"), F.array().cast("array<bigint>").alias("edges"))
    both = lambda turned: stored(ways(turned).select("cell", "src", "dst", *columns).unionByName(still), "ways")
    out = both(False)
    into = both(True) if budgets else out
    ahead = out.select("cell", F.col("src").alias("root"), F.col("dst").alias("node"), *columns)
    return Ground(edges, partition, points, crossing, ahead, into.select("cell", F.col("dst").alias("root"), F.col("src").alias("node"), *columns))


def runs_frame(spark: SparkSession, runs: dict[str, tuple[Box, Config]], partition: DataFrame) -> DataFrame:
    """A row for each run of the call: its box, limits and layer, and the cells of its ends."""
    rows = [(name, b.name, b.source, b.target, *map(float, (b.Lmin, b.Lmax, b.Hmin, b.Hmax, b.Pmin, b.Wmax)), c.labels, c.cell_visits, c.repairs, c.bridges, c.scan, layer(b, c)) for name, (b, c) in runs.items()]
    own = spark.createDataFrame(rows, "run string, query string, source long, target long, Lmin double, Lmax double, Hmin double, Hmax double, Pmin double, Wmax double, max_labels int, visits int, repairs int, bridges int, scan int, layer string")
    at = partition.select("node", "cell")
    return stored(own.join(at.withColumnsRenamed({"node": "source", "cell": "source_cell"}), "source", "left").join(at.withColumnsRenamed({"node": "target", "cell": "target_cell"}), "target", "left"), "runs")


def layer(b: Box, c: Config) -> str:
    """Runs of one layer have the same portals, which the ends of their box are among, and the same overlay to begin with."""
    return f"portals={c.portals},shortcuts={c.shortcuts},ends={b.source}-{b.target}"


def bounds_of(edges: DataFrame, runs: dict[str, tuple[Box, Config]]) -> DataFrame:
    """(dir, end, portal, rest): least length to each target, and from each source, of the call."""
    spark, parts = edges.sparkSession, []
    for d, ends in (("fwd", {b.target for b, _ in runs.values()}), ("bwd", {b.source for b, _ in runs.values()})):
        for end in sorted(ends):
            far = graph.distances(edges, spark.range(1).select(F.lit(end).cast("long").alias("node")), reverse=d == "fwd")
            parts.append(far.select(F.lit(d).alias("dir"), F.lit(end).cast("long").alias("end"), F.col("node").alias("portal"), F.col("dist").alias("rest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return stored(out, "bounds")


def base_overlay(g: Ground, runs: dict[str, tuple[Box, Config]]) -> tuple[DataFrame, DataFrame]:
    """The overlay of each layer, and its portals (layer, cell, node)."""
    edges, portals, chosen = None, None, {}
    for name, (b, c) in {layer(b, c): (b, c) for b, c in runs.values()}.items():
        if c.portals not in chosen:
            chosen[c.portals] = stored(search.active_portals(g.crossing, g.partition, g.points, [], c.portals), "portals")
        own = chosen[c.portals].union(g.partition.where(F.col("node").isin(b.source, b.target)).select("cell", "node")).distinct()
        into = g.back.join(own.select("cell", F.col("node").alias("root")), ["cell", "root"], "left_semi").where("root <> node").select("cell", F.col("node").alias("src"), F.col("root").alias("dst"), *SUMS, "road_changes", "first_road", "last_road", "edges")
        over = search.overlay(g.crossing, own, into, c.shortcuts).withColumn("layer", F.lit(name)).select(*EDGE)
        own = own.select(F.lit(name).alias("layer"), "cell", "node")
        edges, portals = (over, own) if edges is None else (edges.unionByName(over), portals.unionByName(own))
    return stored(edges, "overlay"), stored(portals, "portals")


def start(runs: DataFrame) -> DataFrame:
    """The two empty labels of each run."""
    none = F.lit(None).cast("long")
    both = F.array(F.struct(F.lit("fwd").alias("dir"), F.col("source").alias("portal"), F.col("source_cell").alias("cell")), F.struct(F.lit("bwd").alias("dir"), F.col("target").alias("portal"), F.col("target_cell").alias("cell")))
    own = runs.select("run", F.explode(both).alias("e")).select("run", "e.*").where("cell IS NOT NULL")
    return own.select("run", "dir", "portal", F.array("portal").alias("stops"), F.array("cell").alias("cells"), *[F.lit(0.0).alias(c) for c in SUMS], F.lit(0).alias("road_changes"), none.alias("first_road"), none.alias("last_road"), F.array().cast("array<bigint>").alias("edges"), F.lit(0.0).alias("priority"), F.xxhash64("run", "dir", "portal").alias("label"), F.lit(False).alias("leak"))


def move(labels: DataFrame, over: DataFrame, runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """What labels (parent) become over edges of their layer and of their run, and why they go (null: they stay)."""
    ahead = F.col("dir") == "fwd"
    box = runs.select("run", F.col("layer").alias("_base"), "source", "target", "Lmin", "Lmax", "Hmax", "visits", "source_cell", "target_cell")
    own = labels.join(F.broadcast(box), "run").withColumn("layer", F.explode(F.array("_base", "run")))  # a row for each run of the call
    fwd = over.select(F.lit("fwd").alias("dir"), "layer", F.col("src").alias("portal"), F.col("dst").alias("_to"), F.col("to_cell").alias("_cell"), *search._edge())
    bwd = over.select(F.lit("bwd").alias("dir"), "layer", F.col("dst").alias("portal"), F.col("src").alias("_to"), F.col("from_cell").alias("_cell"), *search._edge())
    joined = own.join(fwd.union(bwd), ["dir", "layer", "portal"])
    seen = F.when(F.element_at("cells", -1) == F.col("_cell"), F.col("cells")).otherwise(F.concat("cells", F.array("_cell")))
    road, beside = F.when(ahead, F.col("last_road")).otherwise(F.col("first_road")), F.when(ahead, F.col("_first")).otherwise(F.col("_last"))
    first = F.when(ahead, F.coalesce("first_road", "_first")).otherwise(F.coalesce("_first", "first_road"))
    last = F.when(ahead, F.coalesce("_last", "last_road")).otherwise(F.coalesce("last_road", "_last"))
    path = F.when(ahead, F.concat("edges", "_edges")).otherwise(F.concat("_edges", "edges"))
    end, home = F.when(ahead, F.col("target")).otherwise(F.col("source")), F.when(ahead, F.col("target_cell")).otherwise(F.col("source_cell"))
    leak = F.coalesce((F.col("_cell") == home) & (F.col("_to") != end), F.lit(False))
    made = joined.select("run", "dir", F.col("label").alias("parent"), F.col("_to").alias("portal"), F.array_contains("stops", F.col("_to")).alias("met"), F.concat("stops", F.array("_to")).alias("stops"), seen.alias("cells"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS], (F.col("road_changes") + F.col("_changes") + search.seam(road, beside)).alias("road_changes"), first.alias("first_road"), last.alias("last_road"), path.alias("edges"), leak.alias("leak"), end.alias("end"), "Lmin", "Lmax", "Hmax", "visits")
    far = made.join(bounds, ["dir", "end", "portal"], "left")
    entered = F.size(F.filter("cells", lambda x: x == F.element_at("cells", -1)))
    why = F.when(F.col("met"), "met").when(F.col("length") > F.col("Lmax"), "too_long").when(F.col("gain") > F.col("Hmax"), "too_high").when(F.col("rest").isNull(), "no_way").when(entered > F.col("visits"), "visits").when(F.col("length") + F.col("rest") > F.col("Lmax") + 1e-6, "over_bound")
    return far.select("run", "dir", "parent", "portal", "stops", "cells", *SUMS, "road_changes", "first_road", "last_road", "edges", F.abs(F.col("length") + F.col("rest") - (F.col("Lmin") + F.col("Lmax")) / 2).alias("priority"), F.xxhash64("run", "dir", "portal", "edges").alias("label"), "leak", why.alias("why"))


# ---- what a round learns ---------------------------------------------------------------------------------------------


def over_crossings(g: Ground, before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Ways before a crossing (keys, u, _b_*), over it, and after it (keys, v, _a_*), as overlay edges with their crossing."""
    l = F.col("length")
    road = F.when(F.col("road_id") >= 0, F.col("road_id"))
    x = g.crossing.select("edge_id", "u", "v", "from_cell", "to_cell", *[c.alias(n) for n, c in zip((f"_x_{s}" for s in SUMS), (l, F.col("gain"), l * F.col("popularity"), l * F.col("width")), strict=True)], road.alias("_road"))
    whole = x.join(before, [*keys[:0], "from_cell", "u"]).join(after, [*keys, "to_cell", "v"])
    last = F.coalesce("_road", "_b_last")
    changes = F.col("_b_changes") + search.seam(F.col("_b_last"), F.col("_road")) + F.col("_a_changes") + search.seam(last, F.col("_a_first"))
    return whole.select(*keys, "edge_id", "src", "dst", "from_cell", "to_cell", *[(F.col(f"_b_{s}") + F.col(f"_x_{s}") + F.col(f"_a_{s}")).alias(s) for s in SUMS], changes.alias("road_changes"), F.coalesce("_b_first", "_road", "_a_first").alias("first_road"), F.coalesce("_a_last", "_road", "_b_last").alias("last_road"), F.concat("_b_edges", F.array("edge_id"), "_a_edges").alias("edges"))


def _part(ways: DataFrame, side: str, scan: Column) -> DataFrame:
    """Ways from portals to crossings (side b) or from crossings to portals (a), the scan shortest of each portal.

    ways: (run, scan, cell, root, node, ...)."""
    own = Window.partitionBy("run", "root").orderBy("length", "gain", "node")
    near = ways.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= scan)
    cell, end, meet = ("from_cell", "src", "u") if side == "b" else ("to_cell", "dst", "v")
    return near.select("run", F.col("cell").alias(cell), F.col("root").alias(end), F.col("node").alias(meet), *[F.col(s).alias(f"_{side}_{s}") for s in SUMS], F.col("road_changes").alias(f"_{side}_changes"), F.col("first_road").alias(f"_{side}_first"), F.col("last_road").alias(f"_{side}_last"), F.col("edges").alias(f"_{side}_edges"))


def _none(cells: DataFrame, side: str) -> DataFrame:
    """The empty way at every end of a crossing, for repairs that stop there. cells: (run, cell, node)."""
    cell, end, meet = ("from_cell", "src", "u") if side == "b" else ("to_cell", "dst", "v")
    none = F.lit(None).cast("long")
    return cells.select("run", F.col("cell").alias(cell), F.col("node").alias(end), F.col("node").alias(meet), *[F.lit(0.0).alias(f"_{side}_{s}") for s in SUMS], F.lit(0).alias(f"_{side}_changes"), none.alias(f"_{side}_first"), none.alias(f"_{side}_last"), F.array().cast("array<bigint>").alias(f"_{side}_edges"))


def directional_repairs(g: Ground, stuck: DataFrame, portals: DataFrame, over: DataFrame, runs: DataFrame, spent: DataFrame, ahead: bool) -> DataFrame:
    """Further overlay edges for the cells of stuck portals: ahead from a portal over a crossing, else over a crossing to a
    portal, to neighbouring cells that the run's overlay doesn't lead to (or from). A cell gets its repairs, less those spent
    (run, dir, cell), the shortest first. stuck: (run, dir, cell); portals: (run, cell, node); over: with run."""
    d, home, away = ("fwd", "from_cell", "to_cell") if ahead else ("bwd", "to_cell", "from_cell")
    cells = stuck.where(F.col("dir") == d).select("run", "cell").distinct()
    led = over.where("from_cell <> to_cell").select("run", "from_cell", "to_cell").distinct()
    open_ = g.crossing.join(F.broadcast(runs.select("run")), F.lit(True)).join(cells.withColumnRenamed("cell", home), ["run", home], "left_semi").join(led, ["run", "from_cell", "to_cell"], "left_anti")
    own = portals.join(cells, ["run", "cell"], "left_semi")
    ways = (g.ahead if ahead else g.back).withColumnRenamed("cell", "_cell").join(own, (F.col("root") == own["node"]) & (F.col("_cell") == own["cell"])).select("run", "cell", "root", F.col("_cell"), g.ahead["node"] if ahead else g.back["node"], *SUMS, "road_changes", "first_road", "last_road", "edges").drop("_cell")
    ways = ways.join(F.broadcast(runs.select("run", "scan")), "run")
    near = _part(ways, "b" if ahead else "a", F.col("scan"))
    still = _none(open_.select("run", F.col(away).alias("cell"), F.col("v" if ahead else "u").alias("node")).distinct(), "a" if ahead else "b")
    made = over_crossings(g, *((near, still) if ahead else (still, near)), ["run"])
    made = made.join(open_.select("run", "edge_id"), ["run", "edge_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("run", home).orderBy("length", "gain", "src", "dst", "edge_id"))
    left = F.col("repairs") - F.coalesce("spent", F.lit(0))
    ranked = made.withColumn("_r", place).join(spent.where(F.col("dir") == d).select("run", F.col("cell").alias(home), "spent"), ["run", home], "left").join(F.broadcast(runs.select("run", "repairs")), "run")
    return ranked.where(F.col("_r") <= left).select(F.col("run").alias("layer"), "src", "dst", F.lit(f"{d}_repair").alias("kind"), *EDGE[4:])


def dead_repairs(g: Ground, portals: DataFrame, over: DataFrame, stuck: DataFrame) -> DataFrame:
    """Raw crossings into stuck backward portals that no overlay edge of their run enters. stuck: (run, dir, portal)."""
    dead = stuck.where("dir = 'bwd'").select("run", F.col("portal").alias("dst")).distinct().join(over.select("run", "dst"), ["run", "dst"], "left_anti")
    l, road = F.col("length"), F.when(F.col("road_id") >= 0, F.col("road_id"))
    raw = g.crossing.join(dead, F.col("v") == F.col("dst"))
    return raw.select(F.col("run").alias("layer"), F.col("u").alias("src"), "dst", F.lit("dead_repair").alias("kind"), "from_cell", "to_cell", "length", "gain", (l * F.col("popularity")).alias("pop_len"), (l * F.col("width")).alias("wid_len"), F.lit(0).alias("road_changes"), road.alias("first_road"), road.alias("last_road"), F.array("edge_id").alias("edges"))


def bridge_pairs(since: DataFrame, beside: DataFrame, turn: int) -> DataFrame:
    """(run, from_cell, to_cell): neighbours of which the first was reached from the source and the second from the target, the later
    of the two in this round, and which weren't both reached from both ends. since: (run, dir, cell, since); beside:
    (from_cell, to_cell). A pair comes up in one round only. The first round has all that was reached so far."""
    at = lambda d, name, when: since.where(F.col("dir") == d).select("run", F.col("cell").alias(name), F.col("since").alias(when))
    met = beside.join(at("fwd", "from_cell", "_a"), "from_cell").join(at("bwd", "to_cell", "_b"), ["run", "to_cell"])
    new = met.where(F.greatest("_a", "_b") == turn) if turn > 1 else met
    both = new.join(at("bwd", "from_cell", "_c"), ["run", "from_cell"], "left").join(at("fwd", "to_cell", "_d"), ["run", "to_cell"], "left")
    return both.where("_c IS NULL OR _d IS NULL").select("run", "from_cell", "to_cell")


def bridges(g: Ground, pairs: DataFrame, portals: DataFrame, runs: DataFrame) -> DataFrame:
    """The bridges of pairs (run, from_cell, to_cell): of the shortest way over each crossing a run's number a pair, stage 1
    the best of the pair, stage 2 the next ones, which have other crossings."""
    def side(ways: DataFrame, cell: str, name: str) -> DataFrame:
        own = portals.join(pairs.select("run", F.col(cell).alias("cell")).distinct(), ["run", "cell"], "left_semi").select("run", F.col("node").alias("root"))
        return _part(ways.join(own, "root").join(F.broadcast(runs.select("run", "scan")), "run"), name, F.col("scan"))

    made = over_crossings(g, side(g.ahead, "from_cell", "b"), side(g.back, "to_cell", "a"), ["run"]).join(pairs, ["run", "from_cell", "to_cell"], "left_semi").where("src <> dst")
    shortest = made.withColumn("_c", F.row_number().over(Window.partitionBy("run", "from_cell", "to_cell", "edge_id").orderBy("length", "gain", "src", "dst"))).where("_c = 1")
    ranked = shortest.withColumn("stage", F.row_number().over(Window.partitionBy("run", "from_cell", "to_cell").orderBy("length", "gain", "src", "dst", "edge_id"))).join(F.broadcast(runs.select("run", "bridges")), "run")
    return ranked.where(F.col("stage") <= F.col("bridges")).select(F.col("run").alias("layer"), "src", "dst", F.lit("bridge").alias("kind"), *EDGE[4:])


# ---- rounds ----------------------------------------------------------------------------------------------------------


class Search:
    """The state of a search; go_on() may be called again. Tables: steps (all that rounds have made and why it went), labels,
    learnt (overlay edges), events and statuses."""

    def __init__(self, g: Ground, runs: dict[str, tuple[Box, Config]], *, mend: bool = True):
        self.spark, self.ground, self.mend, self.boxes = g.edges.sparkSession, g, mend, runs
        self.runs = runs_frame(self.spark, runs, g.partition)
        self.bounds = bounds_of(g.edges, runs)
        self.base, self.portals = base_overlay(g, runs)
        self.beside = stored(g.crossing.select("from_cell", "to_cell").distinct(), "beside")
        self.steps, self.labels, self.learnt = (Log(self.spark, n) for n in ("steps", "labels", "learnt"))
        self.kept = stored(start(self.runs).withColumn("round", F.lit(0)), "kept")
        self.labels.append(self.kept)
        self.learnt.append(self.base.where("false").withColumn("round", F.lit(0)))
        self.fresh_edges, self.round, self.mended = None, 0, Log(self.spark, "mended")
        self.status, self.last = dict.fromkeys(runs, "open"), dict.fromkeys(runs, 0)

    def overlay(self) -> DataFrame:
        return self.base.unionByName(self.learnt.frame().select(*EDGE))

    def own_overlay(self) -> DataFrame:
        """Overlay edges with each run that may use them."""
        return self.base.join(F.broadcast(self.runs.select("run", "layer")), "layer").select("run", *EDGE).unionByName(self.learnt.frame().select(F.col("layer").alias("run"), *EDGE))

    def own_portals(self) -> DataFrame:
        return self.portals.join(F.broadcast(self.runs.select("run", "layer")), "layer").select("run", "cell", "node")

    def advance(self) -> bool:
        """One round; whether anything is left for another."""
        before = self.kept.where("not leak")
        made = move(before.where(F.col("round") == self.round), self.overlay(), self.runs, self.bounds)
        if self.fresh_edges is not None:  # labels kept before have moved over all but the new edges
            made = made.unionByName(move(before.where(F.col("round") < self.round), self.fresh_edges, self.runs, self.bounds))
        self.round += 1
        again = F.row_number().over(Window.partitionBy("run", "label").orderBy("parent")) > 1
        told = made.withColumn("_again", F.col("why").isNull() & again)
        known = F.lit(False)
        if self.steps.schema is not None:
            told = told.join(self.steps.frame().where("why IS NULL OR why = 'leaked'").select("run", "label", F.lit(True).alias("_known")).distinct(), ["run", "label"], "left")
            known = F.coalesce("_known", F.lit(False))
        why = F.coalesce("why", F.when(F.col("_again") | known, "repeated"), F.when(F.col("leak"), "leaked"))
        told = told.withColumn("why", why)
        lists = [F.when(F.col("why").isNull() | (F.col("why") == "leaked"), F.col(c)).alias(c) if c in ("stops", "cells", "edges") else F.col(c) for c in LABEL]
        self.steps.append(told.select(*lists, "parent", "why", F.lit(self.round).alias("round")))
        fresh = self.steps.frame().where((F.col("round") == self.round) & F.col("why").isNull()).select(*LABEL, "round")
        limit = before.select(*LABEL, "round").unionByName(fresh).join(F.broadcast(self.runs.select("run", "max_labels")), "run")
        self.kept = stored(portal.representatives(limit, F.col("max_labels"), ["run", "dir", "portal"]).select(*LABEL, "round"), "kept")
        leaked = self.steps.frame().where((F.col("round") == self.round) & (F.col("why") == "leaked")).select(*LABEL, "round")
        self.labels.append(self.kept.where(F.col("round") == self.round).unionByName(leaked))
        self.fresh_edges = self._learn() if self.mend else None
        alive = self.kept.where(F.col("round") == self.round).select("run")
        if self.fresh_edges is not None:
            alive = alive.union(self.fresh_edges.select("layer"))
        left = {r["run"] for r in alive.distinct().collect()}  # at most a row a run
        for name in self.boxes:
            if self.status[name] == "open" and name not in left:
                self.status[name], self.last[name] = "exhausted", self.round
        return bool(left)

    def stuck(self, since: int | None = None) -> DataFrame:
        """(run, dir, portal, cell, round): portals of kept labels that no step left within the bounds, by the round after; since: of
        this round only."""
        own = self.labels.frame().where("not leak").withColumn("round", F.col("round") + 1).where(F.col("round") <= self.round)
        moved = self.steps.frame().where("why IS NULL OR why IN ('leaked', 'repeated')").select("run", F.col("parent").alias("label"), "round").distinct()
        if since is not None:
            own, moved = own.where(F.col("round") == since), moved.where(F.col("round") == since)
        at = self.ground.partition.select(F.col("node").alias("portal"), "cell")
        return own.join(moved, ["run", "label", "round"], "left_anti").join(at, "portal").select("run", "dir", "portal", "cell", "round").distinct()

    def _learn(self) -> DataFrame | None:
        """New overlay edges after a round, None if there are none."""
        g, at = self.ground, self.ground.partition.select(F.col("node").alias("portal"), "cell")
        over, own, parts = self.own_overlay(), self.own_portals(), []
        since = stored(self.labels.frame().join(at, "portal").groupBy("run", "dir", "cell").agg(F.min("round").alias("since")), "cover")
        pairs = stored(bridge_pairs(since, self.beside, self.round), "pairs")
        if not pairs.isEmpty():
            parts.append(bridges(g, pairs, own, self.runs))
        stuck = self.stuck(self.round)
        if self.mended.schema is not None:  # what can be done for a portal is done the first time
            stuck = stuck.join(self.mended.frame(), ["run", "dir", "portal"], "left_anti")
        stuck = stored(stuck, "stuck")
        if not stuck.isEmpty():
            self.mended.append(stuck.select("run", "dir", "portal"))
            spent = self.learnt.frame().where("kind IN ('fwd_repair', 'bwd_repair')").select(F.col("layer").alias("run"), F.substring("kind", 1, 3).alias("dir"), F.when(F.col("kind") == "fwd_repair", F.col("from_cell")).otherwise(F.col("to_cell")).alias("cell")).groupBy("run", "dir", "cell").agg(F.count("*").alias("spent"))
            parts += [directional_repairs(g, stuck, own, over, self.runs, spent, True), directional_repairs(g, stuck, own, over, self.runs, spent, False), dead_repairs(g, own, over, stuck)]
        if not parts:
            return None
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        known = over.select(F.col("run").alias("layer"), "src", "dst", "edges")
        new = stored(found.dropDuplicates(["layer", "src", "dst", "edges"]).join(known, ["layer", "src", "dst", "edges"], "left_anti").select(*EDGE), "new")
        if new.isEmpty():
            return None
        self.learnt.append(new.withColumn("round", F.lit(self.round)))
        return new

    def events(self) -> DataFrame:
        """(round, run, dir, event, n): steps by what became of them (REASONS), edges learnt by kind, stuck portals."""
        own = self.labels.frame().select("run", "label", F.lit("kept").alias("_kept"))
        steps = self.steps.frame().join(own, ["run", "label"], "left").select("round", "run", "dir", F.coalesce("why", "_kept", F.lit("capped")).alias("event"))
        learnt = self.learnt.frame().select("round", F.col("layer").alias("run"), F.when(F.substring("kind", 1, 3).isin("fwd", "bwd"), F.substring("kind", 1, 3)).when(F.col("kind") == "dead_repair", "bwd").otherwise("both").alias("dir"), F.col("kind").alias("event"))
        stuck = self.stuck().select("round", "run", "dir", F.lit("stuck").alias("event"))
        return steps.unionByName(learnt).unionByName(stuck).groupBy("round", "run", "dir", "event").agg(F.count("*").alias("n"))

    def go_on(self, rounds: int | None = None, seconds: float | None = None) -> Search:
        """Rounds until nothing is left, or a number of them, or until seconds are over; status tells which."""
        began = time.monotonic()
        while "open" in self.status.values():
            if (rounds is not None and self.round >= rounds) or (seconds is not None and time.monotonic() - began >= seconds):
                break
            self.advance()
        return self

    def snapshot(self, most: int = 20) -> DataFrame:
        """(round, dir, portal, n, place): of every round and direction the portals with most labels kept so far."""
        kept = self.labels.frame().where("not leak").select(F.explode(F.sequence("round", F.lit(self.round))).alias("round"), "run", "dir", "portal")
        n = kept.groupBy("round", "run", "dir", "portal").agg(F.count("*").alias("n"))
        return n.withColumn("place", F.row_number().over(Window.partitionBy("round", "run", "dir").orderBy(F.desc("n"), "portal"))).where(F.col("place") <= most)

    def statuses(self) -> DataFrame:
        """(run, status, rounds): `exhausted`, or `open` if labels were left when the search was stopped."""
        return self.spark.createDataFrame([(n, s, self.last[n] or self.round) for n, s in self.status.items()], "run string, status string, rounds int")

    def routes(self) -> DataFrame:
        """Feasible routes of every run, each edge sequence once, by the join that made them first."""
        own = self.labels.frame()
        joined = same_portal(own).unionByName(one_edge(own, self.own_overlay()))
        box = F.broadcast(self.runs.select("run", "query", "Lmin", "Lmax", "Hmin", "Hmax", "Pmin", "Wmax", "visits"))
        often = F.array_max(F.transform(F.array_distinct("cells"), lambda c: F.size(F.filter("cells", lambda x: x == c))))
        l = F.col("length")
        fits = l.between(F.col("Lmin"), F.col("Lmax")) & F.col("gain").between(F.col("Hmin"), F.col("Hmax")) & (F.col("pop_len") >= F.col("Pmin") * l) & (F.col("wid_len") <= F.col("Wmax") * l)
        shaped = joined.join(box, "run").where(fits & (F.size("edges") > 0) & (often <= F.col("visits"))).select("*", *costs.route_vector())
        half = lambda c, lo, hi: F.abs(F.col(c) - (lo + hi) / 2) / F.greatest((hi - lo) / 2, F.lit(1.0))
        score = F.greatest(half("L", F.col("Lmin"), F.col("Lmax")), half("H", F.col("Hmin"), F.col("Hmax")), half("P", F.col("Pmin"), F.greatest(F.lit(255.0), F.col("Pmin") + 1)), half("W", F.least(F.lit(5.0), F.col("Wmax") - 1), F.col("Wmax")))
        best = shaped.withColumn("score", score).groupBy("run", "edges").agg(F.min(F.struct("score", "road_changes", *SUMS, "join")).alias("m"))
        return best.select("run", "edges", F.xxhash64("run", "edges").alias("route"), "m.*")

    def archive(self, size: int = 5) -> DataFrame:
        """Of every run the checked, elementary and diverse routes. A route's corridors are the bridges that lie on it whole."""
        found = stored(self.routes(), "routes")
        sound = stored(via.validated(found, self.ground.edges, ["route"]).where("connected and elementary"), "sound")
        starts = self.ground.edges.select(F.col("edge_id").alias("_e"), F.col("u").alias("_n"))
        steps = sound.select("route", F.posexplode("edges").alias("pos", "_e"))
        nodes = steps.join(starts, "_e").groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_n"))), lambda x: x["_n"]).alias("path"))
        bridge = self.learnt.frame().where("kind = 'bridge'").select(F.col("layer").alias("run"), "from_cell", "to_cell", F.col("edges").alias("_b")).distinct()
        ways = sound.select("route", "run", "edges").join(bridge, "run").where(F.expr("contains(concat(',', array_join(edges, ','), ','), concat(',', array_join(_b, ','), ','))")).groupBy("route").agg(F.sort_array(F.collect_set(F.concat_ws(">", "from_cell", "to_cell"))).alias("corridors"))
        own = sound.join(nodes, "route").join(ways, "route", "left").select(F.col("run").alias("query"), "route", "score", "road_changes", "path", F.coalesce("corridors", F.array().cast("array<string>")).alias("corridors"))
        kept = portal.archive(own, size)
        return sound.join(kept.select("route"), "route", "left_semi").join(own.select("route", "corridors"), "route").select("run", "route", "score", *SUMS, "road_changes", "edges", "join", "corridors", "connected", "elementary")


def _sides(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    keep = ["portal", "label", "cells", *SUMS, "road_changes", "first_road", "last_road", "edges"]
    return tuple(labels.where(F.col("dir") == d).select("run", *[F.col(c).alias(f"{d[0]}_{c}") for c in keep]) for d in ("fwd", "bwd"))


def same_portal(labels: DataFrame) -> DataFrame:
    """Routes of a run's forward and backward labels at one portal."""
    f, b = _sides(labels)
    both = f.join(b.withColumnRenamed("b_portal", "f_portal"), ["run", "f_portal"])
    changes = F.col("f_road_changes") + F.col("b_road_changes") + search.seam(F.col("f_last_road"), F.col("b_first_road"))
    return both.select("run", "f_label", "b_label", F.lit("portal").alias("join"), *[(F.col(f"f_{c}") + F.col(f"b_{c}")).alias(c) for c in SUMS], changes.alias("road_changes"), F.concat("f_edges", "b_edges").alias("edges"), search._cells().alias("cells"))


def one_edge(labels: DataFrame, over: DataFrame) -> DataFrame:
    """Routes of a forward label, one overlay edge of the run and a backward label."""
    f, b = _sides(labels)
    e = over.select("run", F.col("src").alias("f_portal"), F.col("dst").alias("b_portal"), *search._edge())
    three = f.join(e, ["run", "f_portal"]).join(b, ["run", "b_portal"])
    far = F.coalesce("_last", "f_last_road")
    seams = search.seam(F.col("f_last_road"), F.col("_first")) + search.seam(far, F.col("b_first_road"))
    return three.select("run", "f_label", "b_label", F.lit("edge").alias("join"), *[(F.col(f"f_{c}") + F.col(f"_{c}") + F.col(f"b_{c}")).alias(c) for c in SUMS], (F.col("f_road_changes") + F.col("_changes") + F.col("b_road_changes") + seams).alias("road_changes"), F.concat("f_edges", "_edges", "b_edges").alias("edges"), search._cells().alias("cells"))


# ---- sweeps ----------------------------------------------------------------------------------------------------------


def sweep(g: Ground, boxes: list[Box], variants: dict[str, Config], **stop) -> tuple[list[Search], DataFrame]:
    """Every box with BASE and the variants that change one limit, in one search; then with the combined ones, if a variant found
    more routes for some box than BASE, nearer ones, or more that meet. Returns the searches and (query, variant, routes,
    least score, joined, status, rounds)."""
    single = {n: c for n, c in variants.items() if n != "ALL" and "_" not in n}
    done = [Search(g, {f"{b.name}|{n}": (b, c) for b in boxes for n, c in single.items()}).go_on(**stop)]
    out = stored(told(done[0]), "sweep")
    base = out.where("variant = 'BASE'").select("query", F.col("routes").alias("_r"), F.col("best").alias("_b"), F.col("joined").alias("_j"))
    better = out.where("variant <> 'BASE'").join(base, "query").where("routes > _r OR best < _b OR joined > _j")
    rest = {n: c for n, c in variants.items() if n not in single}
    if rest and not better.isEmpty():
        done.append(Search(g, {f"{b.name}|{n}": (b, c) for b in boxes for n, c in rest.items()}).go_on(**stop))
        out = out.unionByName(stored(told(done[1]), "sweep"))
    return done, out


def told(s: Search) -> DataFrame:
    """A row for each run: (query, variant, routes, best, joined, status, rounds)."""
    own = s.labels.frame()
    meets = own.where("dir = 'fwd'").select("run", "portal").join(own.where("dir = 'bwd'").select("run", "portal"), ["run", "portal"]).groupBy("run").agg(F.count("*").alias("joined"))
    found = s.routes().groupBy("run").agg(F.count("*").alias("routes"), F.min("score").alias("best"))
    name = F.split("run", r"\|")
    return s.statuses().join(meets, "run", "left").join(found, "run", "left").select(name[0].alias("query"), name[1].alias("variant"), F.coalesce("routes", F.lit(0)).alias("routes"), "best", F.coalesce("joined", F.lit(0)).alias("joined"), "status", "rounds")
