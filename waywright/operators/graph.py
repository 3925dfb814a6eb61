"""Shortest paths, partitions by hops and other iteration over edges.

A graph of at most KERNEL_EDGES edges (the count is checked) is sent to every worker once, and each task runs searches of its
own over it: one for each query, spec and direction. Larger graphs are searched block by block (blocks.py); the answer is the
same. The relaxed_ forms step edge by edge, by joins, a round written to shared storage at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.functions.costs import Spec
from waywright.operators import blocks
from waywright.storage import dropped, ship, stored

KERNEL_EDGES = 2_000_000  # of nine columns: 144 MB
EPS = 1e-9
KEYS = ["query", "spec", "dir"]
TREE = "query string, spec string, dir string, node long, dist double, parent_node long, parent_edge long, len double, gain double, pop_len double, wid_len double, road_changes int, first_road long, last_road long"
METRICS = ["length", "gain", "popularity", "width"]


class Network:
    """Edges as arrays, with the out-edges of each node together, in the order of edge ids, and the in-edges likewise."""

    def __init__(self, edges: DataFrame):
        table = edges.select("edge_id", "u", "v", *[F.col(c).cast("double") for c in METRICS], F.coalesce("road_id", F.lit(-1)).cast("long").alias("road_id")).toArrow()  # at most KERNEL_EDGES rows
        self.ids, u, v, self.road = (table.column(c).to_numpy() for c in ("edge_id", "u", "v", "road_id"))
        self.metrics = {c: table.column(c).to_numpy() for c in METRICS}
        self.arrange(u, v)

    def arrange(self, u: np.ndarray, v: np.ndarray) -> None:
        self.names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.ends = codes[: len(u)], codes[len(u) :]
        self.csr, self.steps = [], {}
        for side in (0, 1):
            order = np.lexsort((self.ids, self.ends[side]))
            self.csr.append((np.searchsorted(self.ends[side][order], np.arange(len(self.names) + 1)), order))

    def at(self, node: int) -> int | None:
        """The place of a node, None for one without edges."""
        i = int(np.searchsorted(self.names, node))
        return i if i < len(self.names) and self.names[i] == node else None

    def search(self, cost: np.ndarray, roots: list[int], side: int) -> tuple[np.ndarray, list[int]]:
        """Least costs from the nearest of roots (places) along edges, or to it with side 1, and nodes in that order."""
        offsets, order = self.csr[side]
        starts, to, price = offsets.tolist(), self.ends[1 - side][order].tolist(), cost[order].tolist()
        dist = [float("inf")] * len(self.names)
        heap, done, out = [], bytearray(len(self.names)), []
        for r in roots:
            dist[r] = 0.0
            heap.append((0.0, r))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            d, x = pop(heap)
            if done[x]:
                continue
            done[x] = 1
            out.append(x)
            for e in range(starts[x], starts[x + 1]):
                fresh = d + price[e]
                y = to[e]
                if fresh < dist[y] - EPS:
                    dist[y] = fresh
                    push(heap, (fresh, y))
        return np.array(dist), out

    def way(self, price: list[float], start: int, goal: int, shut: bytearray, side: int = 0) -> tuple[dict[int, float], list[int]]:
        """Least costs by place, and places in that order, of a search over what isn't shut that ends when goal is settled."""
        if side not in self.steps:
            offsets, order = self.csr[side]
            self.steps[side] = offsets.tolist(), self.ends[1 - side][order].tolist(), order.tolist()
        starts, to, order = self.steps[side]
        dist, out, heap = {start: 0.0}, [], [(0.0, start)]
        done = bytearray(shut)
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = 1
            out.append(x)
            if x == goal:
                break
            for e in range(starts[x], starts[x + 1]):
                y, fresh = to[e], d + price[order[e]]
                if not done[y] and fresh < dist.get(y, float("inf")) - EPS:
                    dist[y] = fresh
                    heapq.heappush(heap, (fresh, y))
        return dist, out

    def path(self, price: list[float], root: int, goal: int, barred: set[int], rims: tuple[bytearray, bytearray] | None = None) -> list[int] | None | bool:
        """Edge ids of a least way from root to goal that meets no barred node; None without one or if an end is barred. rims: places
        with edges out of the graph, and into it, that it lacks; False if the answer may depend on them."""
        first, last = self.at(root), self.at(goal)
        if root in barred or goal in barred:
            return None
        if first is None or last is None:
            return None if rims is None else False
        shut = bytearray(len(self.names))
        for b in barred:
            if (i := self.at(b)) is not None:
                shut[i] = 1
        dist, order = self.way(price, first, last, shut)
        if order[-1] != last:
            if rims is None or not any(rims[0][x] for x in order):
                return None
            _, back = self.way(price, last, first, shut, 1)
            return False if back[-1] == first or any(rims[1][x] for x in back) else None
        if rims is not None and any(rims[0][x] for x in order[:-1]):
            return False
        offsets, into = self.csr[1]
        way, at, place = [], last, {x: k for k, x in enumerate(order)}
        while at != first:
            tight = []
            for e in into[offsets[at] : offsets[at + 1]].tolist():
                t = int(self.ends[0][e])
                if place.get(t, place[at]) < place[at] and abs(dist[t] + price[e] - dist[at]) <= EPS:
                    tight.append((t, e))
            at, e = min(tight, key=lambda x: (self.names[x[0]], self.ids[x[1]]))
            way.append(int(self.ids[e]))
        return way[::-1]

    def tree(self, cost: np.ndarray, root: int, side: int) -> pd.DataFrame:
        """The tree from root, or to it: parents over tight edges, by fewest road changes, then road, parent and edge."""
        first = self.at(root)
        if first is None:
            return self.rows([root], np.zeros(1), np.full((1, 2), -1), np.zeros((1, 4)), np.zeros(1, int), np.full((1, 2), -1))
        dist, order = self.search(cost, [first], side)
        tail, head = self.ends[side], self.ends[1 - side]
        with np.errstate(invalid="ignore"):
            tight = np.nonzero((np.abs(dist[tail] + cost - dist[head]) <= EPS) & (head != first))[0]
        tight = tight[np.argsort(head[tight], kind="stable")]
        cuts = np.searchsorted(head[tight], np.arange(len(self.names) + 1)).tolist()
        tight = tight.tolist()
        tails, roads, ids, names = tail.tolist(), self.road.tolist(), self.ids.tolist(), self.names.tolist()
        length, gain, pop, wid = (self.metrics[c].tolist() for c in METRICS)
        state: list[tuple | None] = [None] * len(names)
        state[first] = (-1, -1, 0.0, 0.0, 0.0, 0.0, 0, -1, -1)
        for x in order:
            if x == first:
                continue
            best, chosen = None, -1
            for k in range(cuts[x], cuts[x + 1]):
                e = tight[k]
                own = state[tails[e]]
                if own is None:
                    continue
                near, road = own[8 - side], roads[e]
                rank = (own[6] + (near >= 0 and road >= 0 and near != road), road, names[tails[e]], ids[e])
                if best is None or rank < best:
                    best, chosen = rank, e
            if best is None:
                continue
            e = chosen
            _, _, l, g, p, w, _, begin, end = state[tails[e]]
            road = roads[e]
            if side == 0:
                begin, end = begin if begin >= 0 else road, road if road >= 0 else end
            else:
                begin, end = road if road >= 0 else begin, end if end >= 0 else road
            state[x] = (best[2], ids[e], l + length[e], g + gain[e], p + length[e] * pop[e], w + length[e] * wid[e], best[0], begin, end)
        kept = [x for x in order if state[x] is not None]
        own = list(zip(*(state[x] for x in kept), strict=True))
        pair = lambda a, b: np.stack([np.array(own[a]), np.array(own[b])], 1)
        return self.rows([names[x] for x in kept], dist[kept], pair(0, 1), np.stack([np.array(c) for c in own[2:6]], 1), np.array(own[6]), pair(7, 8))

    def rows(self, nodes, dist, parents, sums, changes, ends) -> pd.DataFrame:
        known = lambda a: pd.array(a, "Int64") if (a >= 0).all() else pd.Series(a).astype("Int64").mask(a < 0)
        return pd.DataFrame({"node": nodes, "dist": dist, "parent_node": known(parents[:, 0]), "parent_edge": known(parents[:, 1]), **{c: sums[:, k] for k, c in enumerate(("len", "gain", "pop_len", "wid_len"))}, "road_changes": changes, "first_road": known(ends[:, 0]), "last_road": known(ends[:, 1])})


def fits(edges: DataFrame) -> bool:
    """Whether the graph has few enough edges to be sent to every worker."""
    ship(edges.sparkSession)
    return edges.count() <= KERNEL_EDGES


def forest(edges: DataFrame, specs: list[Spec], roots: list[tuple[str, str, int]], priced: Callable[[], DataFrame], constants: tuple[float, float], longest: float | None = None, goals: dict[str, int] | None = None) -> DataFrame:
    """Trees of all specs from or to all roots (query, dir, node). constants: just over the steepest slope, and the highest
    popularity; priced(): the edges with all costs, as relaxed_trees takes them. longest: nodes that a tree's ways reach only over
    a longer length may lack; goals: a node by dir, of whose trees only its row is wanted, others may lack."""
    tasks = [(q, s, d, root) for s in specs for q, d, root in roots]
    if not fits(edges):
        return block_trees(edges, tasks, constants, longest, goals)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(Network(edges))

    def run(frames):
        network = shared.value
        for frame in frames:
            for k in frame["id"]:
                query, spec, direction, root = tasks[k]
                out = network.tree(costs.price(spec, network.metrics, *constants), root, int(direction == "bwd"))
                out.insert(0, "query", query)
                out.insert(1, "spec", spec.name)
                out.insert(2, "dir", direction)
                yield out

    return spark.range(0, len(tasks), 1, max(1, min(len(tasks), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, TREE)


def dearest(edges: DataFrame, specs: list[Spec], constants: tuple[float, float]) -> dict[str, float | None]:
    """By spec the highest cost of an edge for each unit of its length; None where an edge of no length costs something."""
    own = [costs.spec_cost(s, *constants) for s in specs]
    row = edges.agg(*[F.max(F.when(F.col("length") > 0, x / F.col("length"))).alias(f"m{k}") for k, x in enumerate(own)], *[F.bool_or((F.col("length") <= 0) & ~(x <= 0)).alias(f"z{k}") for k, x in enumerate(own)]).first()
    return {s.name: None if row[f"z{k}"] or row[f"m{k}"] is None else row[f"m{k}"] for k, s in enumerate(specs)}


def block_trees(edges: DataFrame, tasks: list[tuple[str, Spec, str, int]], constants: tuple[float, float], longest: float | None = None, goals: dict[str, int] | None = None) -> DataFrame:
    """Trees of tasks (query, spec, dir, root) block by block. longest: ways of at most this length cost at most it times the
    dearest edge's cost for a unit, and a way that costs no more has only nodes that cost no more; so the rest isn't searched."""
    most = None
    if longest is not None:
        top = dearest(edges, list({t[1].name: t[1] for t in tasks}.values()), constants)
        most = [None if top[t[1].name] is None else longest * top[t[1].name] * (1 + 1e-9) + 1e-6 for t in tasks]

    def price(k, links):
        _, spec, direction, _ = tasks[k]
        cost = costs.price(spec, {c: links[c].to_numpy(float) for c in METRICS}, *constants)
        return int(direction == "bwd"), cost, np.ones(len(links))

    start = edges.sparkSession.createDataFrame([(k, int(root), 0.0, 0.0) for k, (*_, root) in enumerate(tasks)], blocks.ENTRY)
    named = lambda k: {"query": tasks[k][0], "spec": tasks[k][1].name, "dir": tasks[k][2]}
    own = blocks.Blocks(edges, ["edge_id", *METRICS, "road_id"], len(tasks))
    return own.trees(start, price, [int(t[3]) for t in tasks], TREE, named, most, goals and [int(goals[t[2]]) for t in tasks])


def block_distances(edges: DataFrame, source: DataFrame, cost: str, reverse: bool, longest: float | None) -> DataFrame:
    side = int(reverse)
    price = lambda _, links: (side, links[cost].to_numpy(float), np.zeros(len(links)))
    start = source.select(F.lit(0).alias("key"), "node", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return blocks.Blocks(edges, [cost]).labels(start, price, longest).select("node", F.col("a").alias("dist"))


def distances(edges: DataFrame, source: DataFrame, *, cost: str = "length", reverse: bool = False, longest: float | None = None) -> DataFrame:
    """(node, dist): least cost from the nearest of source (node) along edges, or to it in reverse. Unreached nodes, and those
    further than longest, have no row. A graph of at most KERNEL_EDGES edges is searched in one task, a larger one block by
    block."""
    if not fits(edges):
        return block_distances(edges, source, cost, reverse, longest)
    if longest is not None:
        return distances(edges, source, cost=cost, reverse=reverse).where(F.col("dist") <= longest)
    spark = edges.sparkSession
    own = edges.select("edge_id", "u", "v", F.col(cost).alias("length"), *[F.lit(0.0).alias(c) for c in METRICS[1:]], F.lit(None).alias("road_id"))
    shared = spark.sparkContext.broadcast(Network(own))

    def run(frames):
        network, roots = shared.value, sorted({int(x) for frame in frames for x in frame["node"]})
        if roots:
            known = [network.at(r) for r in roots]
            dist, order = network.search(network.metrics["length"], [k for k in known if k is not None], int(reverse))
            alone = [r for r, k in zip(roots, known, strict=True) if k is None]
            yield pd.DataFrame({"node": [*network.names[order].tolist(), *alone], "dist": [*dist[order].tolist(), *[0.0] * len(alone)]})

    return source.select(F.col("node").cast("long").alias("node")).distinct().coalesce(1).mapInPandas(run, "node long, dist double")


def relaxed_distances(edges: DataFrame, source: DataFrame, *, cost: str = "length", reverse: bool = False, max_rounds: int = 100_000, hops: int = 4) -> DataFrame:
    """distances by joins: only nodes that got closer in the last step are joined with edges in the next; hops steps go
    into one job."""
    tail, head = ("v", "u") if reverse else ("u", "v")
    links = edges.select(F.col(tail).alias("_from"), F.col(head).alias("_to"), F.col(cost).alias("_cost"))
    best = source.select("node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    for _ in range(max_rounds):
        for _ in range(hops):
            moved = best.where("fresh").join(links, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), (F.col("dist") + F.col("_cost")).alias("dist"), F.lit(True).alias("fresh"))
            merged = best.select("node", "dist", F.lit(False).alias("fresh")).union(moved)
            best = merged.groupBy("node").agg(F.min("dist").alias("dist"), F.min(F.struct("dist", "fresh")).alias("m")).select("node", "dist", F.col("m.fresh").alias("fresh"))
        best = stored(best)
        if best.where("fresh").isEmpty():
            return best.select("node", "dist")
    raise RuntimeError("no fixpoint within max_rounds")


def _spread(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    names, codes = np.unique(np.concatenate([edges["u"], edges["v"], seeds["node"]]), return_inverse=True)
    m = len(edges)
    order = np.argsort(codes[:m], kind="stable")
    offsets, to = np.searchsorted(codes[:m][order], np.arange(len(names) + 1)), codes[m : 2 * m][order]
    cell, hop = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), -1)
    np.minimum.at(cell, codes[2 * m :], seeds["cell"].to_numpy())
    front, depth = np.unique(codes[2 * m :]), 0
    hop[front] = 0
    while len(front):
        depth += 1
        counts = offsets[front + 1] - offsets[front]
        at = np.repeat(offsets[front] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        reached, owner = to[at], np.repeat(cell[front], counts)
        fresh = hop[reached] < 0
        np.minimum.at(cell, reached[fresh], owner[fresh])
        front = np.unique(reached[fresh])
        hop[front] = depth
    seen = hop >= 0
    return pd.DataFrame({"node": names[seen], "cell": cell[seen], "hop": hop[seen]})


def hop_partition(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, cell, hop): the seed that reaches a node in the fewest hops, of equals the first; unreached nodes have no row.

    A graph of at most KERNEL_EDGES edges is searched in one task, a larger one block by block.
    """
    if not fits(edges):
        price = lambda _, links: (0, np.ones(len(links)), np.zeros(len(links)))
        start = seeds.select(F.lit(0).alias("key"), "node", F.lit(0.0).alias("a"), F.col("cell").alias("b"))
        return blocks.Blocks(edges, []).labels(start, price).select("node", F.col("b").cast("long").alias("cell"), F.col("a").cast("long").alias("hop"))
    one = edges.select("u", "v", F.lit(0).alias("k")).groupBy("k").cogroup(seeds.select(F.col("node").cast("long").alias("node"), F.col("cell").cast("long").alias("cell"), F.lit(0).alias("k")).groupBy("k"))
    return one.applyInPandas(_spread, "node long, cell long, hop long")


def relaxed_hop_partition(edges: DataFrame, seeds: DataFrame, max_rounds: int = 100_000, hops: int = 4) -> DataFrame:
    """hop_partition by joins, as relaxed_distances."""
    links = edges.select(F.col("u").alias("_from"), F.col("v").alias("_to"))
    best = seeds.select("node", F.struct(F.lit(0).cast("long").alias("hop"), F.col("cell").cast("long").alias("cell")).alias("own")).groupBy("node").agg(F.min("own").alias("own")).withColumn("fresh", F.lit(True))
    for _ in range(max_rounds):
        for _ in range(hops):
            moved = best.where("fresh").join(links, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), F.struct((F.col("own.hop") + 1).alias("hop"), F.col("own.cell").alias("cell")).alias("own"), F.lit(True).alias("fresh"))
            merged = best.select("node", "own", F.lit(False).alias("fresh")).union(moved)
            best = merged.groupBy("node").agg(F.min("own").alias("own"), F.min(F.struct("own", "fresh")).alias("m")).select("node", "own", F.col("m.fresh").alias("fresh"))
        best = stored(best)
        if best.where("fresh").isEmpty():
            return best.select("node", "own.cell", "own.hop")
    raise RuntimeError("no fixpoint within max_rounds")


def hop_expand(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node): start and what lies within k hops along edges."""
    seen = start.select("node").distinct()
    for _ in range(k):
        seen = seen.union(seen.join(edges.select(F.col("u").alias("node"), "v"), "node").select(F.col("v").alias("node"))).distinct()
    return seen


def relaxed_trees(priced: DataFrame, max_rounds: int = 100_000, hops: int = 4) -> DataFrame:
    """Shortest-path trees by joins, one for each (query, spec, dir) of priced: (query, spec, dir, root, edge_id, u, v, cost,
    length, gain, popularity, width, road_id). dir `fwd` leads from root, `bwd` to it. First the distances, then parents from
    the root on: a node is settled when all nodes before it on tight edges are, so rounds are as many as such edges follow
    each other."""
    ahead = F.col("dir") == "fwd"
    l = F.col("length")
    links = stored(priced.select(*KEYS, "root", "edge_id", F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("tail"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("node"), "cost", "length", "gain", (l * F.col("popularity")).alias("pop_len"), (l * F.col("width")).alias("wid_len"), F.when(F.col("road_id") >= 0, F.col("road_id")).alias("road")))
    roots = links.select(*KEYS, F.col("root").alias("node")).distinct()
    best = roots.select(*KEYS, "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh"))
    steps = links.select(*KEYS, F.col("tail").alias("_tail"), F.col("node").alias("_node"), "cost")
    for _ in range(max_rounds):
        before = best
        for _ in range(hops):
            moved = best.where("fresh").withColumnRenamed("node", "_tail").join(steps, [*KEYS, "_tail"]).select(*KEYS, F.col("_node").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.lit(True).alias("fresh"))
            merged = best.select(*KEYS, "node", "dist", F.lit(False).alias("fresh")).union(moved)
            best = merged.groupBy(*KEYS, "node").agg(F.min(F.struct("dist", "fresh")).alias("m")).select(*KEYS, "node", "m.dist", "m.fresh")
        best = stored(best)
        dropped(before)
        if best.where("fresh").isEmpty():
            break
    far = best.select(*KEYS, "node", "dist")
    tight = links.join(far, [*KEYS, "node"]).join(far.withColumnsRenamed({"node": "tail", "dist": "tail_dist"}), [*KEYS, "tail"])
    tight = stored(tight.where((F.abs(F.col("tail_dist") + F.col("cost") - F.col("dist")) <= EPS) & (F.col("node") != F.col("root"))).drop("root", "cost"))
    none = F.lit(None).cast("long")
    zero = [F.lit(0.0).alias(c) for c in ("len", "sum_gain", "sum_pop", "sum_wid")]
    state = stored(roots.select(*KEYS, "node", F.lit(0.0).alias("dist"), none.alias("parent_node"), none.alias("parent_edge"), *zero, F.lit(0).alias("changes"), none.alias("first_road"), none.alias("last_road")))
    size = state.count()
    for _ in range(max_rounds):
        own = state.select(*KEYS, F.col("node").alias("tail"), F.col("len").alias("_len"), F.col("sum_gain").alias("_gain"), F.col("sum_pop").alias("_pop"), F.col("sum_wid").alias("_wid"), F.col("changes").alias("_changes"), F.col("first_road").alias("_first"), F.col("last_road").alias("_last"), F.lit(True).alias("_known"))
        open_ = tight.join(state.select(*KEYS, "node"), [*KEYS, "node"], "left_anti").join(own, [*KEYS, "tail"], "left")
        near = F.when(ahead, F.col("_last")).otherwise(F.col("_first"))
        changes = F.col("_changes") + F.coalesce((near != F.col("road")).cast("int"), F.lit(0))
        rank = F.struct(changes.alias("changes"), F.coalesce("road", F.lit(-1)).alias("_road"), F.col("tail").alias("parent_node"), F.col("edge_id").alias("parent_edge"), "dist", (F.col("_len") + l).alias("len"), (F.col("_gain") + F.col("gain")).alias("sum_gain"), (F.col("_pop") + F.col("pop_len")).alias("sum_pop"), (F.col("_wid") + F.col("wid_len")).alias("sum_wid"), F.when(ahead, F.coalesce("_first", "road")).otherwise(F.coalesce("road", "_first")).alias("first_road"), F.when(ahead, F.coalesce("road", "_last")).otherwise(F.coalesce("_last", "road")).alias("last_road"))
        each = open_.groupBy(*KEYS, "node").agg(F.min(F.when(F.col("_known"), rank)).alias("m"), F.every(F.coalesce("_known", F.lit(False))).alias("ready")).where("m is not null")
        each = stored(each)
        ready = each.where("ready") if not each.where("ready").isEmpty() else each  # edges of no cost may wait for each other
        made = ready.select(*KEYS, "node", "m.dist", "m.parent_node", "m.parent_edge", "m.len", "m.sum_gain", "m.sum_pop", "m.sum_wid", "m.changes", "m.first_road", "m.last_road")
        before, state = state, stored(state.union(made))
        dropped(before, each)
        if (grown := state.count()) == size:
            break
        size = grown
    dropped(links, tight)
    return state.select(*KEYS, "node", "dist", "parent_node", "parent_edge", "len", F.col("sum_gain").alias("gain"), F.col("sum_pop").alias("pop_len"), F.col("sum_wid").alias("wid_len"), F.col("changes").alias("road_changes"), "first_road", "last_road")


def trees(priced: DataFrame) -> DataFrame:
    """relaxed_trees, or where every tree has few enough edges one task for each tree."""
    most = priced.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most > KERNEL_EDGES:
        return relaxed_trees(priced)

    def run(keys, frame):
        frame = frame.reset_index(drop=True)
        network = Network.__new__(Network)
        network.ids, network.road = frame["edge_id"].to_numpy(), frame["road_id"].fillna(-1).astype("int64").to_numpy()
        network.metrics = {c: frame[c].to_numpy(float) for c in METRICS}
        network.arrange(frame["u"].to_numpy(), frame["v"].to_numpy())
        out = network.tree(frame["cost"].to_numpy(float), int(frame["root"].iloc[0]), int(keys[2] == "bwd"))
        for k, c in enumerate(KEYS):
            out.insert(k, c, keys[k])
        return out

    names = [*KEYS, "root", "edge_id", "u", "v", "cost", *METRICS, "road_id"]
    return priced.select(*names).groupBy(*KEYS).applyInPandas(run, TREE)


BRANCH_NODES = 500_000  # of a tree, that a task follows at once, about


def _led_out(frame: pd.DataFrame) -> pd.DataFrame:
    """Each step (node, up, value) led on to the first node that has no step in frame."""
    frame = frame.sort_values("node", ignore_index=True)
    names, up, value = (frame[c].to_numpy() for c in ("node", "up", "value"))
    at = np.minimum(np.searchsorted(names, up), len(names) - 1)
    inside = names[at] == up
    jump, total = np.where(inside, at, np.arange(len(names))), np.where(inside, value, 0.0)
    while (jump != jump[jump]).any():
        total, jump = total + total[jump], jump[jump]
    return pd.DataFrame({"node": names, "up": up[jump], "value": total + value[jump]})


def branch_sums(steps: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root, value): of a tree's steps (node, up, value), none from its root, the sums of value over each node's branch, and
    where that ends. Ranges of ids are followed a task each as far as the first node beyond; then such nodes, which are few where
    ids say something about places, are followed with doubling steps. Nothing grows with the length of branches."""
    ship(steps.sparkSession)
    steps = stored(steps.select("node", "up", F.col("value").cast("double").alias("value")), "steps")
    parts = -(-steps.count() // BRANCH_NODES)
    cuts = steps.select(F.col("node").cast("double").alias("node")).approxQuantile("node", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    dealt = steps.withColumn("block", blocks.block_of(F.col("node"), sorted({int(x) for x in cuts})))
    out = stored(dealt.groupBy("block").applyInPandas(_led_out, "node long, up long, value double"), "branches")
    dropped(steps)
    rim = stored(out.join(out.select(F.col("up").alias("node")).distinct(), "node", "left_semi").withColumn("moved", F.lit(True)), "rim")
    for _ in range(max_rounds):
        if rim.where("moved").isEmpty():
            return out.join(rim.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("value").alias("_value")), "up", "left").select("node", F.coalesce("_up", "up").alias("root"), (F.col("value") + F.coalesce("_value", F.lit(0.0))).alias("value"))
        far = rim.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("value").alias("_value"))
        before, rim = rim, stored(rim.join(far, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("value") + F.coalesce("_value", F.lit(0.0))).alias("value"), F.col("_up").isNotNull().alias("moved")), "rim")
        dropped(before)
    raise RuntimeError("a branch is longer than 2 ** max_rounds")


def paths(tree: DataFrame, ends: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(query, spec, dir, node, edges): edge ids from the root to each node of ends (query, spec, dir, node), or from it in
    a backward tree. Parents are followed with doubling steps; none is further from the root than its child, so only nodes as near
    as the furthest end of their tree take part."""
    key = ["query", "spec", "dir"]
    far = tree.join(ends.select(*key, "node").distinct(), [*key, "node"], "left_semi").groupBy(*key).agg(F.max("dist").alias("_far"))
    near = tree.join(far, key).where(F.col("dist") <= F.col("_far") + EPS)
    step = stored(near.where("parent_node is not null").select(*key, "node", F.col("parent_node").alias("up"), F.array("parent_edge").alias("edges")))
    out = ends.select(*key, "node", F.col("node").alias("at"), F.array().cast("array<bigint>").alias("edges"))
    for _ in range(max_rounds):
        hop = step.select(*key, F.col("node").alias("at"), F.col("up").alias("_up"), F.col("edges").alias("_more"))
        joined = out.join(hop, [*key, "at"], "left")
        more = F.coalesce(F.col("_more"), F.array().cast("array<bigint>"))
        grown = F.when(F.col("dir") == "fwd", F.concat(more, "edges")).otherwise(F.concat("edges", more))
        out = stored(joined.select(*key, "node", F.coalesce("_up", "at").alias("at"), grown.alias("edges"), F.col("_up").isNotNull().alias("moved")))
        if out.where("moved").isEmpty():
            return out.select(*key, "node", "edges")
        out = out.drop("moved")
        far = step.select(*key, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("edges").alias("_more"))
        doubled = step.join(far, [*key, "up"], "left")
        both = F.when(F.col("dir") == "fwd", F.concat(F.coalesce("_more", F.array().cast("array<bigint>")), "edges")).otherwise(F.concat("edges", F.coalesce("_more", F.array().cast("array<bigint>"))))
        step = stored(doubled.select(*key, "node", F.coalesce("_up", "up").alias("up"), both.alias("edges")))
    raise RuntimeError("a parent chain is longer than 2 ** max_rounds")
