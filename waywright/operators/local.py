"""Searches inside cells, in batches that a later round goes on with.

A search starts at a root (a portal) and stays in its cell; ways lead from the root, or to it on turned edges. Its state is a
table of labels: every way that is kept, and whether it is still open. A batch takes each root's next open labels, by length
and climb, over one edge each, all roots in one join; then labels that others dominate go. So no task holds a cell, and the
state after any batch, as it lies in the folder, is all that the next one needs.

LOCAL1 keeps the least way to a node by length, climb, number of edges and label. LOCAL2 (several) keeps all that no other way to
the node is at least as good as in length, climb, width and lack of popularity, summed over the way; or of these only the best
by length and by the means (keep="best")."""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waywright.storage import owned, shared_folder, ship

SUMS = ["length", "gain", "pop_len", "wid_len"]
STATE = ["cell", "root", "node", *SUMS, "road_changes", "first_road", "last_road", "edges", "label", "open", "popped"]


def begin(portals: DataFrame) -> DataFrame:
    """The empty ways at the portals (cell, node)."""
    none = F.lit(None).cast("long")
    return portals.select("cell", F.col("node").alias("root"), "node").distinct().select("cell", "root", "node", *[F.lit(0.0).alias(c) for c in SUMS], F.lit(0).alias("road_changes"), none.alias("first_road"), none.alias("last_road"), F.array().cast("array<bigint>").alias("edges"), F.xxhash64("root").alias("label"), F.lit(True).alias("open"), F.lit(0).alias("popped"))


def step(state: DataFrame, inside: DataFrame, pops: int | None, batch: int, ahead: bool, longest: float | None) -> DataFrame:
    """state with each root's next pops open labels (None: all) closed, and what they lead to. inside: edges with their cell."""
    if pops is None:
        marked = state.withColumn("_turn", F.col("open"))
    else:
        own = Window.partitionBy("root").orderBy(F.desc("open"), "length", "gain", "label")
        marked = state.withColumn("_turn", F.col("open") & (F.row_number().over(own) <= pops))
    tail, head = ("u", "v") if ahead else ("v", "u")
    l, road = F.col("length"), F.when(F.col("road_id") >= 0, F.col("road_id"))
    links = inside.select("cell", F.col(tail).alias("node"), F.col(head).alias("_to"), l.alias("_length"), F.col("gain").alias("_gain"), (l * F.col("popularity")).alias("_pop_len"), (l * F.col("width")).alias("_wid_len"), road.alias("_road"), F.col("edge_id").alias("_edge"))
    made = marked.where("_turn").join(links, ["cell", "node"]).where("_to <> root")
    if longest is not None:
        made = made.where(F.col("length") + F.col("_length") <= longest)
    near = F.col("last_road") if ahead else F.col("first_road")
    first = F.coalesce("first_road", "_road") if ahead else F.coalesce("_road", "first_road")
    last = F.coalesce("_road", "last_road") if ahead else F.coalesce("last_road", "_road")
    edges = F.concat("edges", F.array("_edge")) if ahead else F.concat(F.array("_edge"), "edges")
    changes = F.col("road_changes") + F.coalesce((near != F.col("_road")).cast("int"), F.lit(0))
    fresh = made.select("cell", "root", F.col("_to").alias("node"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in SUMS], changes.alias("road_changes"), first.alias("first_road"), last.alias("last_road"), edges.alias("edges"), F.xxhash64("root", edges).alias("label"), F.lit(True).alias("open"), F.lit(0).alias("popped"))
    closed = marked.select(*STATE[:-2], (F.col("open") & ~F.col("_turn")).alias("open"), F.when(F.col("_turn"), batch).otherwise(F.col("popped")).alias("popped"))
    return closed.unionByName(fresh)


def least(state: DataFrame) -> DataFrame:
    """Of each root and node the least way."""
    rest = [c for c in STATE if c not in ("cell", "root", "node", "length", "gain", "label")]
    best = state.groupBy("cell", "root", "node").agg(F.min(F.struct("length", "gain", F.size("edges").alias("_n"), "label", *rest)).alias("m"))
    return best.select("cell", "root", "node", *[F.col(f"m.{c}").alias(c) for c in STATE[3:]])


def undominated(state: DataFrame, top: float) -> DataFrame:
    """Of each root and node the ways that no other is as good as; of equal ways the one of fewest edges and least label.
    top: the highest popularity of an edge."""
    lack = lambda p: F.col(f"{p}length") * top - F.col(f"{p}pop_len")
    order = lambda p: F.struct(F.col(f"{p}length"), F.col(f"{p}gain"), F.col(f"{p}wid_len"), lack(p), F.size(f"{p}edges"), F.col(f"{p}label"))
    other = state.select("root", "node", *[F.col(c).alias(f"_{c}") for c in (*SUMS, "edges", "label")])
    good = [F.col(f"_{c}") <= F.col(c) for c in ("length", "gain", "wid_len")] + [lack("_") <= lack("")]
    beaten = order("_") < order("")
    for g in good:
        beaten = beaten & g
    return state.join(other, (state["root"] == other["root"]) & (state["node"] == other["node"]) & beaten, "left_anti")


def best_means(state: DataFrame) -> DataFrame:
    """Of each root and node the shortest way, the narrowest, the most popular and the flattest."""
    own = Window.partitionBy("root", "node")
    mean = lambda c: F.when(F.col("length") > 0, F.col(c) / F.col("length")).otherwise(F.lit(0.0))
    keys: list[Column] = [F.col("length"), mean("wid_len"), -mean("pop_len"), F.col("gain")]
    place = [F.row_number().over(own.orderBy(k, "length", "gain", F.size("edges"), "label")) for k in keys]
    return state.withColumn("_first", F.least(*place)).where("_first = 1").drop("_first")


class LocalSearch:
    """The searches of all portals, in a folder with one table for each batch done. Made anew over the same folder, it goes
    on after the last batch that was written whole."""

    def __init__(self, inside: DataFrame, portals: DataFrame, folder: str, *, pops: int | None = 64, several: bool = False, keep: str = "all", ahead: bool = True, longest: float | None = None, hops: int = 1):
        spark = inside.sparkSession
        ship(spark)
        self.spark, self.inside, self.folder, self.pops, self.several, self.keep, self.ahead, self.longest, self.hops = spark, inside, folder, pops, several, keep, ahead, longest, hops
        self.top = inside.agg(F.max("popularity")).first()[0] or 0.0 if several else 0.0
        self.batch = -1
        while self._exists(self.batch + 1):
            self.batch += 1
        if self.batch < 0:
            begin(portals).write.mode("overwrite").parquet(self._path(0))
            self.batch = 0

    def _path(self, batch: int) -> str:
        return f"{self.folder}/batch={batch:06d}"

    def _exists(self, batch: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(batch)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    @property
    def state(self) -> DataFrame:
        return self.spark.read.parquet(self._path(self.batch))

    @property
    def done(self) -> bool:
        return self.state.where("open").isEmpty()

    def go_on(self, batches: int | None = None) -> LocalSearch:
        """So many batches more (None: until nothing is open)."""
        while (batches is None or batches > 0) and not self.done:
            state = self.state
            for hop in range(self.hops):
                state = step(state, self.inside, self.pops, self.batch * self.hops + hop + 1, self.ahead, self.longest)
                state = undominated(state, self.top) if self.several else least(state)
                if self.several and self.keep == "best":
                    state = best_means(state)
            state.write.mode("overwrite").parquet(self._path(self.batch + 1))
            self.batch += 1
            batches = None if batches is None else batches - 1
        return self

    def settled(self) -> DataFrame:
        """Ways that no open label can make better: those before the root's first open one. Of a search to its end, all."""
        first = self.state.where("open").groupBy("root").agg(F.min(F.struct("length", "gain")).alias("_open"))
        return self.state.where("not open").join(first, "root", "left").where(F.col("_open").isNull() | (F.struct("length", "gain") <= F.col("_open"))).drop("_open")

    def progress(self) -> DataFrame:
        """(batch, root, popped): how many labels each batch has closed, of those that are still kept."""
        return self.state.where("popped > 0").groupBy(F.col("popped").alias("batch"), "root").agg(F.count("*").alias("popped"))


def folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name beside the checkpoints, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owned(spark, path)
    return path


def shortcuts(state: DataFrame, portals: DataFrame, ahead: bool = True) -> DataFrame:
    """Ways between two portals of a cell: (cell, src, dst, sums, road_changes, first_road, last_road, edges)."""
    ends = portals.select("cell", "node").distinct()
    found = state.where("root <> node").join(ends, ["cell", "node"], "left_semi")
    src, dst = ("root", "node") if ahead else ("node", "root")
    return found.select("cell", F.col(src).alias("src"), F.col(dst).alias("dst"), *SUMS, "road_changes", "first_road", "last_road", "edges")


def largest(inside: DataFrame) -> int:
    """Edges of the cell that has most."""
    return inside.groupBy("cell").count().agg(F.max("count")).first()[0] or 0


# ---- LOCAL1 by batches, many batches a job ---------------------------------------------------------------------------

KEPT = "cell long, root long, node long, length double, gain double, n_edges long, label long, open boolean, popped int"
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_ALL = (1 << 64) - 1


def hashed(value: int, seed: int) -> int:
    """xxhash64 of a long as Spark has it, signed. The hash of a row, or of an array, is that of its last value with the hash of those
    before as seed."""
    x = value * _P2 & _ALL
    h = (seed + _P5 + 8 & _ALL) ^ ((x << 31 | x >> 33) & _ALL) * _P1 & _ALL
    h = ((h << 27 | h >> 37) & _ALL) * _P1 + _P4 & _ALL
    h = (h ^ h >> 33) * _P2 & _ALL
    h = (h ^ h >> 29) * _P3 & _ALL
    h ^= h >> 32
    return h - (1 << 64) if h >> 63 else h


def _batches(pops: int, first: int, count: int):
    """count batches from number first of one root's search."""

    def run(key, state: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return state
        root = int(key[1])
        tails = edges["u"].to_numpy(np.int64)
        order = np.argsort(tails, kind="stable")
        known, starts = np.unique(tails[order], return_index=True)
        cut = dict(zip(known.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True)) if len(order) else {}
        to, length, gain, ids = (edges[c].to_numpy()[order].tolist() for c in ("v", "length", "gain", "edge_id"))
        names = [c.split()[0] for c in KEPT.split(", ")]
        best = {r[0]: r[1:5] for r in state[names[2:7]].itertuples(index=False)}
        closed = {int(x): int(p) for x, p, o in zip(state["node"], state["popped"], state["open"], strict=True) if not o}
        heap = [(b[0], b[1], b[3], x) for x, b in best.items() if x not in closed]
        heapq.heapify(heap)
        for batch in range(first, first + count):
            turn = []
            while heap and len(turn) < pops:
                l, g, label, x = heapq.heappop(heap)
                if x not in closed and best[x][3] == label:
                    closed[x] = batch
                    turn.append((x, best[x]))
            if not turn:
                break
            for x, (l, g, n, label) in turn:
                begin, end = cut.get(x, (0, 0))
                for e in range(begin, end):
                    y = to[e]
                    if y == root:
                        continue
                    old, a, b = best.get(y), l + length[e], g + gain[e]
                    if old is not None and (a, b, n + 1) > old[:3]:
                        continue
                    new = (a, b, n + 1, hashed(ids[e], label))
                    if old is None or new < old:
                        best[y] = new
                        closed.pop(y, None)
                        heapq.heappush(heap, (a, b, new[3], y))
        rows = [(int(key[0]), root, x, *b, x not in closed, closed.get(x, 0)) for x, b in best.items()]
        return pd.DataFrame(rows, columns=names)

    return run


class BatchSearch:
    """LOCAL1 of LocalSearch, with the same batches and ties, without the edges of ways: a task goes on with one root for `batches`
    batches, over its cell's edges, and the state after them is written to the folder. Made anew over the same folder, it goes on from
    there."""

    def __init__(self, inside: DataFrame, portals: DataFrame, folder: str, *, pops: int = 64, batches: int = 1024):
        ship(inside.sparkSession)
        self.tables = LocalSearch.__new__(LocalSearch)
        self.tables.spark, self.tables.folder, self.tables.batch = inside.sparkSession, folder, -1
        self.inside, self.pops, self.batches = inside, pops, batches
        while self.tables._exists(self.tables.batch + 1):
            self.tables.batch += 1
        if self.tables.batch < 0:
            start = begin(portals).select("cell", "root", "node", "length", "gain", F.lit(0).cast("long").alias("n_edges"), "label", "open", "popped")
            start.write.mode("overwrite").parquet(self.tables._path(0))
            self.tables.batch = 0

    @property
    def state(self) -> DataFrame:
        return self.tables.state

    def go_on(self, jobs: int | None = None) -> BatchSearch:
        """So many jobs more (None: until nothing is open)."""
        while (jobs is None or jobs > 0) and not self.tables.done:
            state = self.state
            roots = state.where("open").select("cell", (F.col("root") + 0).alias("root")).distinct()  # a column of its own
            links = self.inside.select("cell", "edge_id", "u", "v", F.col("length").cast("double").alias("length"), F.col("gain").cast("double").alias("gain")).join(roots, "cell")
            made = state.groupBy("cell", "root").cogroup(links.groupBy("cell", "root")).applyInPandas(_batches(self.pops, self.tables.batch * self.batches + 1, self.batches), KEPT)
            made.write.mode("overwrite").parquet(self.tables._path(self.tables.batch + 1))
            self.tables.batch += 1
            jobs = None if jobs is None else jobs - 1
        return self

    def progress(self) -> DataFrame:
        return self.tables.progress()
