"""Searches of a graph that is too large for one worker, block by block.

Nodes are dealt to blocks by ranges of their ids, so that about as many edges start in each. A round searches the blocks that were
told something new, a task a block, from all they know; labels of nodes at a block's rim that have changed are told to the blocks
beyond, which search in the next round. So rounds are as many as blocks follow each other on a way, not as many as edges do. Only
what is told is written in a round; a block's edges are stored once, as bytes of arrays in one row. Whole blocks are written at the end.

A label is a pair that grows along edges and of which the lesser counts: cost and edges, hops and cell, length and climb. Trees tell
states (parents' sums and roads) with the labels, so they take no rounds of their own."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywright.storage import dropped, owned, shared_folder, ship, stored

BLOCK_EDGES = 500_000  # that start in a block, about
EPS = 1e-9
LEAST = -1  # the block to which a goal's label is told
FEW = 8  # nodes that labels at once must settle, on the average, to be quicker than a heap
#: (key, frame of edges) to the side of the tails (0: u, 1: v) and both parts of each edge's label
Price = Callable[[int, pd.DataFrame], tuple[int, np.ndarray, np.ndarray]]
ENTRY = "key int, node long, a double, b double"
TOLD = "key int, block int, came int, node long, a double, b double"
SUMS = ["len", "gain", "pop_len", "wid_len"]
STATE = [*SUMS, "road_changes", "first_road", "last_road"]
STATES = "len double, gain double, pop_len double, wid_len double, road_changes long, first_road long, last_road long"


def bound(cost: float) -> float:
    """Just over a cost, so that rounding loses no way of this cost."""
    return cost * (1 + 1e-9) + 1e-6


def block_of(node: Column, cuts: list[int], low: int = 0) -> Column:
    """How many of cuts are at most node, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(node < cuts[mid], block_of(node, cuts[:mid], low)).otherwise(block_of(node, cuts[mid + 1 :], low + mid + 1))


KINDS = {"names": np.int64, "u": np.int32, "v": np.int32, "edge_id": np.int64, "road_id": np.int64}  # of a packed block's columns, else doubles


def _kind(column: str) -> type:
    return KINDS.get(column, np.float64)


def _packed(columns: list[str]):
    """A block's edges as one row: its nodes' ids, the places of both ends among them, and each column, all as bytes of an array."""

    def run(key, links):
        names, codes = np.unique(np.concatenate([links["u"], links["v"]]).astype(np.int64), return_inverse=True)
        row = {"names": names, "u": codes[: len(links)], "v": codes[len(links) :], **{c: links[c].to_numpy() for c in columns}}
        return pd.DataFrame({"block": [key[0]], **{c: [x.astype(_kind(c)).tobytes()] for c, x in row.items()}})

    return run


def _sent(column: str) -> type:
    return np.int64 if column in ("u", "v") else _kind(column)


DEALT_EDGES = 500_000  # that a task deals to blocks at once


def _dealt(cuts: list[int], names: list[str]):
    """Edges to their blocks, as bytes of arrays: a row for each block that some of those dealt at once touch."""
    cuts = np.array(cuts, np.int64)

    def deal(links):
        ends = [np.searchsorted(cuts, links[c].to_numpy(np.int64), side="right") for c in ("u", "v")]
        over = np.nonzero(ends[0] != ends[1])[0]
        block, edge = np.concatenate([ends[0], ends[1][over]]), np.concatenate([np.arange(len(links)), over])
        order = np.argsort(block, kind="stable")
        own, begin = np.unique(block[order], return_index=True)
        parts = np.split(edge[order], begin[1:])
        return pd.DataFrame({"block": own, **{c: [values[at].tobytes() for at in parts] for c in names for values in [links[c].to_numpy(_sent(c))]}})

    def run(frames):
        held, count = [], 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= DEALT_EDGES:
                yield deal(pd.concat(held, ignore_index=True))
                held, count = [], 0
        if count:
            yield deal(pd.concat(held, ignore_index=True))

    return run


def _whole(columns: list[str]):
    """_packed of what was dealt to a block."""
    pack = _packed(columns)
    return lambda key, dealt: pack(key, pd.DataFrame({c: np.frombuffer(b"".join(dealt[c]), _sent(c)) for c in ("u", "v", *columns)}))


class Block:
    """Edges that touch a block, as arrays; reach() is the search from known nodes over edges whose heads lie in the block."""

    def __init__(self, number: int, cuts: np.ndarray, packed: pd.DataFrame, extra: np.ndarray):
        row = {c: np.frombuffer(packed[c].iloc[0] if len(packed) else b"", _kind(c)) for c in packed.columns if c not in ("block", "part")}
        known, self.ends = row["names"], (row["u"].astype(np.int64), row["v"].astype(np.int64))
        self.names = np.union1d(known, extra.astype(np.int64))
        if len(self.names) > len(known):  # nodes without edges
            moved = np.searchsorted(self.names, known)
            self.ends = moved[self.ends[0]], moved[self.ends[1]]
        self.links = pd.DataFrame({c: x for c, x in row.items() if c not in ("names", "u", "v")}, index=range(len(self.ends[0])), copy=False)
        self.number, self.own = number, np.searchsorted(cuts, self.names, side="right") == number
        self.csr: dict[int, tuple] = {}

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.names, nodes)

    def place(self, node: int) -> int:
        """The place of a node of the block's own, else -1."""
        i = int(np.searchsorted(self.names, node))
        return i if i < len(self.names) and self.names[i] == node and self.own[i] else -1

    def reach(self, side: int, a: np.ndarray, b: np.ndarray, known: pd.DataFrame, longest: float | None, goal: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least labels by place, infinite where there are none, and places in that order. goal: a place; nodes that cost more than it
        have none.

        Nodes that cost less than the cheapest edge more than the nearest open one are settled at once; where these are few, or edges
        cost nothing, a heap goes on."""
        if side not in self.csr:
            tail = self.ends[side]
            order = np.argsort(tail, kind="stable")
            order = order[self.own[self.ends[1 - side][order]]]
            self.csr[side] = np.searchsorted(tail[order], np.arange(len(self.names) + 1)), self.ends[1 - side][order], order
        offsets, to, order = self.csr[side]
        cost, more = a[order], b[order]
        most = np.inf if longest is None else longest
        first, second = np.full(len(self.names), np.inf), np.full(len(self.names), np.inf)
        places, p, q = self.at(known["node"].to_numpy()), known["a"].to_numpy(), known["b"].to_numpy()
        best = np.lexsort((q, p, places))
        best = best[np.diff(places[best], prepend=-1) != 0]
        open_ = places[best]
        first[open_], second[open_] = p[best], q[best]
        width, rounds, settled = cost.min() if len(cost) else 0.0, 0, 0
        while len(open_) and width > 0 and (rounds % 256 or settled >= FEW * rounds):
            if goal >= 0:
                most = min(most, bound(first[goal]))
                open_ = open_[first[open_] <= most]
                if not len(open_):
                    break
            far = first[open_]
            near = far < far.min() + width
            nodes, open_ = open_[near], open_[~near]
            if not len(nodes):  # costs that vanish beside the distance
                break
            rounds, settled = rounds + 1, settled + len(nodes)
            begin = offsets[nodes]
            counts = offsets[nodes + 1] - begin
            ends = np.cumsum(counts)
            at = np.repeat(begin - ends + counts, counts) + np.arange(ends[-1])
            y, f, g = to[at], np.repeat(first[nodes], counts) + cost[at], np.repeat(second[nodes], counts) + more[at]
            old = first[y]
            better = np.nonzero((f <= most) & ((f < old) | ((f == old) & (g < second[y]))))[0]
            if not len(better):
                continue
            y, f, g = y[better], f[better], g[better]
            best = np.lexsort((g, f, y))
            best = best[np.diff(y[best], prepend=-1) != 0]
            y = y[best]
            fresh = np.isinf(first[y])
            first[y], second[y] = f[best], g[best]
            open_ = np.concatenate([open_, y[fresh]])
        if len(open_):
            first, second = self._heap(offsets.tolist(), to.tolist(), cost.tolist(), more.tolist(), first, second, open_.tolist(), most, goal)
        if goal >= 0:
            first[first > min(most, bound(first[goal]))] = np.inf
        out = np.nonzero(np.isfinite(first))[0]
        return first, second, out[np.lexsort((second[out], first[out]))]

    def _heap(self, starts, to, cost, more, first, second, open_, most, goal=-1) -> tuple[np.ndarray, np.ndarray]:
        first, second = first.tolist(), second.tolist()
        most = min(most, bound(first[goal])) if goal >= 0 else most
        heap = [(first[x], second[x], x) for x in open_]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            p, q, x = pop(heap)
            if p > most:
                break
            if p > first[x] or q > second[x]:
                continue
            for e in range(starts[x], starts[x + 1]):
                y, f = to[e], p + cost[e]
                if f > first[y] or f > most:
                    continue
                g = q + more[e]
                if f < first[y] or g < second[y]:
                    first[y], second[y] = f, g
                    push(heap, (f, g, y))
                    if y == goal:
                        most = min(most, bound(f))
        return np.array(first), np.array(second)


_packs: dict[tuple, tuple[list[int], DataFrame]] = {}


class Blocks:
    """A graph dealt to blocks, with columns besides (u, v). An edge between two blocks lies in both. The blocks of a stored frame
    are made once for all searches."""

    def __init__(self, edges: DataFrame, columns: tuple[str, ...] | list[str] = (), keys: int = 1):
        self.spark = edges.sparkSession
        ship(self.spark)
        path = getattr(edges, "stored_path", None)
        name = (self.spark.sparkContext.applicationId, path, tuple(columns), BLOCK_EDGES)
        self.kept = path is not None
        self.cuts, self.links = _packs[name] if name in _packs else self._pack(edges, list(columns))
        if self.kept:
            _packs[name] = self.cuts, self.links
        self.parts = max(1, min(keys, self.spark.sparkContext.defaultParallelism))

    def _pack(self, edges: DataFrame, columns: list[str]) -> tuple[list[int], DataFrame]:
        whole = {c for c in columns if c in ("edge_id", "road_id")}
        values = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) if c in whole else F.col(c).cast("double").alias(c) for c in columns]
        own = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *values)
        parts = max(1, -(-edges.count() // BLOCK_EDGES))
        ids = own.select(F.col("u").cast("double").alias("u")).approxQuantile("u", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
        cuts = sorted({int(x) for x in ids})
        values = "".join(f", {c} binary" for c in columns)
        dealt = own.mapInPandas(_dealt(cuts, own.columns), f"block int, u binary, v binary{values}")
        packed = dealt.groupBy("block").applyInPandas(_whole(columns), f"block int, names binary, u binary, v binary{values}")
        return cuts, stored(packed, "blocks", by="block")

    def done(self) -> None:
        if not self.kept:
            dropped(self.links)

    def _tasks(self, rows: DataFrame, run, schema: str, todo: dict[int, set[int]]) -> DataFrame:
        """run(Block, key, what the block was told about the key, what it has told) of each block and key of todo, tasks of several
        keys side by side."""
        cuts, parts = np.array(self.cuts, np.int64), self.parts
        names = [c.split()[0] for c in schema.split(", ")]
        links = self.links.where(F.col("block").isin(sorted(todo))).withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(parts)])))
        own = rows.withColumn("own", F.explode(F.array_distinct(F.array("block", "came")))).where(F.col("own").isin(sorted(todo))).withColumn("part", F.col("key") % parts)

        def each(group, links, rows):
            number, part = int(group[0]), int(group[1])
            keys = sorted(k for k in todo[number] if k % parts == part)
            if not keys:
                return pd.DataFrame(columns=names)
            last = rows.sort_values("round", kind="stable").drop_duplicates(["key", "block", "came", "node"], keep="last")
            told = last[last["block"] == number]
            block = Block(number, cuts, links, told["node"].to_numpy())
            made = [out for k in keys if len(out := run(block, k, told[told["key"] == k], last[(last["came"] == number) & (last["key"] == k)]))]
            return pd.concat(made, ignore_index=True)[names] if made else pd.DataFrame(columns=names)

        return links.groupBy("block", "part").cogroup(own.groupBy(F.col("own").alias("block"), "part")).applyInPandas(each, schema)

    def _spread(self, start: DataFrame, known, schema: str, goals: list[int] | None = None, most: list[float | None] | None = None) -> tuple[DataFrame, dict[int, set[int]]]:
        """What blocks were told, and told each other, until nothing changes, with the blocks and keys that were told something. start:
        (key, node, a, b). known(block, key, told): side, costs, labels and, by name, states of places that have labels. goals: a node for
        each key; what it has been found to cost lowers, in most, what the key's ways cost at most in the next rounds."""
        path = f"{shared_folder(self.spark)}/told-{uuid.uuid4().hex}"
        owned(self.spark, path)
        names = [c.split()[0] for c in schema.split(", ")]
        cuts = np.array(self.cuts, np.int64)

        def tell(block, key, told, said):
            side, cost, longest, first, second, more = known(block, key, told)
            tail, head = block.ends[side], block.ends[1 - side]
            goal = block.place(goals[key]) if goals else -1
            top = min(np.inf if longest is None else longest, bound(first[goal]) if goal >= 0 else np.inf)
            with np.errstate(invalid="ignore"):
                rim = np.nonzero(block.own[tail] & ~block.own[head] & np.isfinite(first[tail]) & (first[tail] + cost <= top))[0]
            to = np.searchsorted(cuts, block.names[head[rim]], side="right")
            pairs = np.unique(np.stack([to, tail[rim]], 1), axis=0).reshape(-1, 2)
            if goal >= 0 and np.isfinite(first[goal]):
                pairs = np.concatenate([pairs, [[LEAST, goal]]])
            x = pairs[:, 1]
            out = pd.DataFrame({"key": np.int32(key), "block": pairs[:, 0].astype(np.int32), "came": np.int32(block.number), "node": block.names[x], "a": first[x], "b": second[x], **{c: v[x] for c, v in more.items()}})
            return out.merge(said[names], how="left", indicator="_in").query("_in == 'left_only'")[names] if len(said) else out

        place = block_of(F.col("node"), self.cuts)
        begun = start.select(F.col("key").cast("int").alias("key"), place.alias("block"), F.lit(-1).alias("came"), F.col("node").cast("long").alias("node"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
        least = begun.groupBy("key", "block", "came", "node").agg(F.min(F.struct("a", "b")).alias("m")).select("key", "block", "came", "node", "m.*")
        absent = [F.lit(0).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")[6:]]
        made, number, every = least.select("*", *absent), 0, {}
        while True:
            made.write.parquet(f"{path}/round={number}")
            todo: dict[int, set[int]] = {}
            for r in self.spark.read.schema(schema).parquet(f"{path}/round={number}").groupBy("block", "key").agg(F.min("a").alias("a")).collect():  # at most a row for each block and key
                if r["block"] == LEAST:
                    most[r["key"]] = min(x for x in (most[r["key"]], bound(r["a"])) if x is not None)
                    continue
                todo.setdefault(r["block"], set()).add(r["key"])
                every.setdefault(r["block"], set()).add(r["key"])
            rows = self.spark.read.schema(f"{schema}, round int").parquet(path)
            rows.stored_path = path
            if not todo:
                return rows, every
            made, number = self._tasks(rows, tell, schema, todo), number + 1

    def labels(self, start: DataFrame, price: Price, longest: float | None = None, at: DataFrame | None = None) -> DataFrame:
        """(key, node, a, b): the least label of every node, or of those in at (node), that ways from start reach."""

        def known(block, key, told):
            side, a, b = price(key, block.links)
            first, second, _ = block.reach(side, a, b, told, longest)
            return side, a, longest, first, second, {}

        def run(block, key, told, _):
            side, a, b = price(key, block.links)
            first, second, out = block.reach(side, a, b, told, longest)
            own = out[block.own[out]]
            return pd.DataFrame({"key": np.full(len(own), key, np.int32), "node": block.names[own], "a": first[own], "b": second[own]})

        rows, every = self._spread(start, known, TOLD)
        found = self._tasks(rows, run, ENTRY, every)
        out = stored(found if at is None else found.join(at.select("node").distinct(), "node", "left_semi").select("key", "node", "a", "b"), "labels")
        dropped(rows)
        self.done()
        return out

    def trees(self, start: DataFrame, price: Price, roots: list[int], schema: str, named: Callable[[int], dict[str, str]], longest: list[float | None] | None = None, goals: list[int] | None = None) -> DataFrame:
        """Least-cost trees of all keys from their roots: parents over tight edges, by fewest road changes, then road, parent and
        edge. price: costs and ones; named: the columns of a key that go before the tree's; longest: what each key's ways cost at
        most, blocks further off aren't read. goals: a node for each key, of whose tree only its row is wanted; ways that cost more
        than the goal are left as soon as some way to it is known."""
        longest = list(longest or [None] * len(roots))

        def known(block, key, told):
            side, cost, ones = price(key, block.links)
            first, second, state, _ = grown(block, side, cost, ones, told, roots[key], longest[key], goals and goals[key])
            first = np.where(state["parent_node"] == ABSENT, np.inf, first)
            return side, cost, longest[key], first, second, {c: state[c] for c in STATE}

        def whole(block, key, told, _):
            side, cost, ones = price(key, block.links)
            first, _, state, order = grown(block, side, cost, ones, told, roots[key], longest[key], goals and goals[key])
            kept = order[block.own[order] & (state["parent_node"][order] != ABSENT)]
            if goals:
                kept = kept[kept == block.place(goals[key])]
            columns = {**named(key), "node": block.names[kept], "dist": first[kept]}
            for c in ("parent_node", "parent_edge", *STATE):
                own = state[c][kept]
                columns[c] = pd.arrays.IntegerArray(own, own < 0) if c in ("parent_node", "parent_edge", "first_road", "last_road") else own
            return pd.DataFrame(columns)

        rows, every = self._spread(start, known, f"{TOLD}, {STATES}", goals, longest)
        if goals:
            home = np.searchsorted(self.cuts, goals, side="right").tolist()
            every = {b: own for b, keys in every.items() if (own := {k for k in keys if home[k] == b})}
        out = stored(self._tasks(rows, whole, schema, every), "trees")
        dropped(rows)
        self.done()
        return out


ABSENT = -2  # parent of nodes without a state


def grown(block: Block, side: int, cost: np.ndarray, ones: np.ndarray, told: pd.DataFrame, root: int, longest: float | None = None, goal: int | None = None):
    """Labels of the block's nodes and, as far as they are known, states by place: parent (ABSENT where there is none), its edge,
    sums, changes, roads; and places by label.

    told: the start, and labels and states of nodes of other blocks. Of those an edge of no cost counts only towards more edges. goal:
    a node; what costs more has no label."""
    first, second, order = block.reach(side, cost, ones, told, longest, -1 if goal is None else block.place(goal))
    n, away = len(block.names), told[told["came"] >= 0]
    state = {c: np.zeros(n) for c in SUMS} | {"road_changes": np.zeros(n, np.int64)} | {c: np.full(n, -1, np.int64) for c in ("parent_edge", "first_road", "last_road")} | {"parent_node": np.full(n, ABSENT, np.int64)}
    at = block.at(away["node"].to_numpy())
    for c in STATE:
        state[c][at] = away[c].to_numpy(state[c].dtype)
    origin = block.place(root)
    state["parent_node"][[*at.tolist(), *([origin] if origin >= 0 else [])]] = -1
    tail, head = block.ends[side], block.ends[1 - side]
    with np.errstate(invalid="ignore"):
        fits = np.abs(first[tail] + cost - first[head]) <= EPS
    fits &= block.own[head] & (head != origin)
    fits &= block.own[tail] | (first[tail] < first[head]) | ((first[tail] == first[head]) & (second[tail] < second[head]))
    order_own = order[block.own[order] & (order != origin)]
    place = np.full(n, -1, np.int64)
    place[order_own] = np.arange(len(order_own))
    tight = np.nonzero(fits)[0]
    tight = tight[np.argsort(place[head[tight]], kind="stable")]
    heads, tails = place[head[tight]], tail[tight]
    used = block.links.iloc[tight]
    ids, roads = used["edge_id"].to_numpy(np.int64), used["road_id"].to_numpy(np.int64)
    length = used["length"].to_numpy(float)
    gains = length, used["gain"].to_numpy(float), length * used["popularity"].to_numpy(float), length * used["width"].to_numpy(float)
    starts = np.searchsorted(heads, np.arange(len(order_own) + 1))
    far = first[order_own]
    width = (cost[tight].min() if len(tight) else 0.0) - 2 * EPS  # no tight edge leads from a node to one nearer than this beyond it
    if len(far) and (width <= 0 or len(far) < FEW * len(np.unique((far - far[0]) // width))):
        _grown_singly(block, side, state, order_own, starts.tolist(), tails.tolist(), ids.tolist(), roads.tolist(), gains)
        return first, second, state, order
    near = state["last_road" if side == 0 else "first_road"]
    i = 0
    while i < len(order_own):
        j = max(i + 1, int(np.searchsorted(far, far[i] + width)))
        e = np.arange(starts[i], starts[j])
        e = e[state["parent_node"][tails[e]] != ABSENT]
        if len(e):
            road, before = roads[e], near[tails[e]]
            changes = state["road_changes"][tails[e]] + ((before >= 0) & (road >= 0) & (before != road))
            best = np.lexsort((ids[e], tails[e], road, changes, heads[e]))
            best = best[np.diff(heads[e][best], prepend=-1) != 0]
            e, road, changes = e[best], road[best], changes[best]
            x, t = order_own[heads[e]], tails[e]
            for c, more in zip(SUMS, gains, strict=True):
                state[c][x] = state[c][t] + more[e]
            begin, end = state["first_road"][t], state["last_road"][t]
            state["first_road"][x] = np.where(begin >= 0, begin, road) if side == 0 else np.where(road >= 0, road, begin)
            state["last_road"][x] = np.where(road >= 0, road, end) if side == 0 else np.where(end >= 0, end, road)
            state["road_changes"][x], state["parent_node"][x], state["parent_edge"][x] = changes, block.names[t], ids[e]
        i = j
    return first, second, state, order


def _grown_singly(block, side, state, order, starts, tails, ids, roads, gains) -> None:
    """grown's states node by node, where few nodes or none can be settled at once."""
    own = {c: v.tolist() for c, v in state.items()}
    parent, edge, changes, begin, end = (own[c] for c in ("parent_node", "parent_edge", "road_changes", "first_road", "last_road"))
    near, names, more = end if side == 0 else begin, block.names.tolist(), [(own[c], g.tolist()) for c, g in zip(SUMS, gains, strict=True)]
    for k, x in enumerate(order.tolist()):
        best, chosen = None, -1
        for e in range(starts[k], starts[k + 1]):
            t, road = tails[e], roads[e]
            if parent[t] == ABSENT:
                continue
            rank = (changes[t] + (near[t] >= 0 and road >= 0 and near[t] != road), road, t, ids[e])
            if best is None or rank < best:
                best, chosen = rank, e
        if best is None:
            continue
        _, road, t, edge[x] = best
        for sums, g in more:
            sums[x] = sums[t] + g[chosen]
        begin[x] = (begin[t] if begin[t] >= 0 else road) if side == 0 else (road if road >= 0 else begin[t])
        end[x] = (road if road >= 0 else end[t]) if side == 0 else (end[t] if end[t] >= 0 else road)
        changes[x], parent[x] = best[0], names[t]
    for c, v in own.items():
        state[c][:] = v
