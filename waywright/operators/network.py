"""Seeds, cells, boundaries, corridors and constants of a road graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.storage import stored


def crossings(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(edge_id, u, v, from_cell, to_cell): edges whose ends have different cells; ends without a cell drop out."""
    a = partition.select(F.col("node").alias("u"), F.col("cell").alias("from_cell"))
    b = partition.select(F.col("node").alias("v"), F.col("cell").alias("to_cell"))
    return edges.join(a, "u").join(b, "v").where("from_cell <> to_cell").select("edge_id", "u", "v", "from_cell", "to_cell")


def boundary_nodes(crossing: DataFrame) -> DataFrame:
    return crossing.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def hub_scores(edges: DataFrame) -> DataFrame:
    """(node, score): different roads at a node."""
    return edges.select(F.explode(F.array("u", "v")).alias("node"), "road_id").groupBy("node").agg(F.count_distinct("road_id").alias("score"))


def hub_candidates(edges: DataFrame, k: int, factor: int = 10) -> DataFrame:
    """The k * factor nodes of the highest hub score; of equals the lower ids."""
    return hub_scores(edges).orderBy(F.desc("score"), "node").limit(k * factor)


def canonical_ways(ways: DataFrame, key: str = "road", way: str = "way", weight: str = "weight") -> DataFrame:
    """(road, way, road_id): each road's heaviest way (the least of equals) and its number in the order of roads."""
    total = ways.groupBy(key, way).agg(F.sum(weight).alias("_w"))
    best = total.groupBy(key).agg(F.max_by(way, F.struct("_w", -F.col(way))).alias(way))
    return numbered(best, key, "road_id")


def completable(labels: DataFrame, rest: DataFrame, longest: float) -> DataFrame:
    """labels (node, length) with least, the shortest that they can end with, where that is at most longest. rest: (node, dist)
    to the target; labels at nodes without a row go."""
    own = labels.join(rest, "node").withColumn("least", F.col("length") + F.col("dist"))
    return own.where(F.col("least") <= longest + 1e-6).drop("dist")


def csr(edges: DataFrame, block: int = 1024) -> DataFrame:
    """(edge_id, u, position, offset_): an edge's place among those of its source, and the number of edges of lower sources."""
    own = edges.withColumn("_b", F.expr(f"u div {block}"))
    ranked = own.withColumn("position", F.row_number().over(Window.partitionBy("u").orderBy("v", "edge_id")) - 1)
    counts = own.groupBy("_b", "u").agg(F.count("*").alias("_n"))
    blocks = counts.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = blocks.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))  # a row for each block
    starts = counts.join(before, "_b").withColumn("offset_", F.col("_before") + F.sum("_n").over(Window.partitionBy("_b").orderBy("u")) - F.col("_n"))
    return ranked.join(starts.select("u", "offset_"), "u").select("edge_id", "u", "position", "offset_")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, whose key is unique, with name: rows counted from 0 in the order of key. Rows are dealt out by ranges of key, and
    numbered within their range after those of lower ranges."""
    ranges = stored(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranges.withColumn("_at", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_at") - 1).cast("int")).drop("_part", "_at", "_before")


def corridor_cells(seeds: DataFrame, points: DataFrame, source: DataFrame, target: DataFrame, slack: int) -> DataFrame:
    """(cell): cells whose seed makes a detour of at most slack whole metres. source, target: one row (node)."""
    at = lambda who, name: who.join(points, "node").select(F.col("x").cast("long").alias(f"{name}x"), F.col("y").cast("long").alias(f"{name}y"))
    ends = at(source, "s").crossJoin(at(target, "t"))
    d = lambda a, b: F.floor(F.sqrt(((F.col(f"{a}x") - F.col(f"{b}x")) * (F.col(f"{a}x") - F.col(f"{b}x")) + (F.col(f"{a}y") - F.col(f"{b}y")) * (F.col(f"{a}y") - F.col(f"{b}y"))).cast("double")))
    own = seeds.join(points, "node").select("cell", F.col("x").cast("long").alias("cx"), F.col("y").cast("long").alias("cy"))
    return own.crossJoin(F.broadcast(ends)).where(d("s", "c") + d("c", "t") <= d("s", "t") + slack).select("cell")  # one row


def kept_nodes(edges: DataFrame, partition: DataFrame, cells: DataFrame, hops: int) -> DataFrame:
    """(node): nodes of the cells, and what lies within hops of their boundary nodes along edges."""
    from waywright.operators.graph import hop_expand

    inside = partition.join(cells, "cell", "left_semi").select("node")
    edge = boundary_nodes(crossings(edges, partition)).join(inside, "node", "left_semi")
    return inside.union(hop_expand(edges, edge, hops)).distinct()


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among nodes."""
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select(*edges.columns)


def certified(edges: DataFrame, ahead: DataFrame, back: DataFrame, longest: float) -> DataFrame:
    """Edges that some route of at most longest can use. ahead, back: (node, dist) from the source and to the target."""
    a, b = ahead.select(F.col("node").alias("u"), F.col("dist").alias("_a")), back.select(F.col("node").alias("v"), F.col("dist").alias("_b"))
    return edges.join(a, "u").join(b, "v").where(F.col("_a") + F.col("length") + F.col("_b") <= longest + 1e-6).select(*edges.columns)


def metric_constants(edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """One row: steepest slope, highest popularity, edges of no length that climb, edges of some length."""
    usable = F.col("length") > eps
    return edges.agg(
        F.max(F.when(usable, F.col("gain") / F.col("length"))).alias("max_slope"), F.max("popularity").alias("pstar"),
        F.count_if(~usable & (F.col("gain") > 0)).alias("flat_climbs"), F.count_if(usable).alias("usable"),
        F.max_by("edge_id", F.when(usable, F.struct(F.col("gain") / F.col("length"), -F.col("edge_id")))).alias("steepest"),
    )


def mandatory_portals(crossing: DataFrame) -> DataFrame:
    """(low, high, u, v): for each pair of neighbouring cells the least crossing (node in the lower cell, other node)."""
    low, high = F.least("from_cell", "to_cell"), F.greatest("from_cell", "to_cell")
    ends = F.when(F.col("from_cell") < F.col("to_cell"), F.struct(F.col("u").alias("u"), F.col("v").alias("v"))).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return crossing.groupBy(low.alias("low"), high.alias("high")).agg(F.min(ends).alias("m")).select("low", "high", "m.u", "m.v")


def overlay(candidates: DataFrame, most: int = 2) -> DataFrame:
    """Per (src, dst, kind) the most best candidates by (length, gain, seq)."""
    own = Window.partitionBy("src", "dst", "kind").orderBy("length", "gain", "seq")
    return candidates.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
