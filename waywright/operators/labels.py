"""Bulk label setting: a feasible simple route of a box, found by rounds over tables of partial routes.

A label is a partial route from the source. Each round the most promising open labels, as many as the beam is wide, step over
all their edges in one join. Steps that meet the route again go, and those that can't end within the box's length or climb, as
the least remaining length and climb tell. Labels are ordered by how far the box is from what they would be, were they to end
over the shortest way with the means they have, then by the length that remains. A node keeps the per_node first open ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.functions.costs import Box
from waywright.operators import graph
from waywright.storage import dropped, stored

SUMS = ["length", "gain", "pop_len", "wid_len"]
LABEL = ["node", "path", "edges", *SUMS, "road", "road_changes", "miss", "rest", "label"]


def remaining(edges: DataFrame, target: int) -> DataFrame:
    """(node, rest, climb): least length and least climb from every node to target."""
    goal = edges.sparkSession.range(1).select(F.lit(target).cast("long").alias("node"))
    far = graph.distances(edges, goal, reverse=True).withColumnRenamed("dist", "rest")
    return far.join(graph.distances(edges, goal, cost="gain", reverse=True).withColumnRenamed("dist", "climb"), "node")


def miss(box: Box, length: Column, gain: Column, pop_len: Column, wid_len: Column, rest: Column) -> Column:
    """The largest scaled violation of a label that goes on over rest with its present means."""
    mean = lambda c, none: F.when(length > 0, c / length).otherwise(F.lit(none))
    values = {"L": length + rest, "H": gain, "P": mean(pop_len, box.Pmin), "W": mean(wid_len, box.Wmax)}
    low_l, high_l, low_h, high_h, low_p, high_w = costs.scales(box)
    return F.greatest(F.lit(0.0), (box.Lmin - values["L"]) / low_l, (values["L"] - box.Lmax) / high_l, (box.Hmin - values["H"]) / low_h, (values["H"] - box.Hmax) / high_h, (box.Pmin - values["P"]) / low_p, (values["W"] - box.Wmax) / high_w)


def step(front: DataFrame, links: DataFrame, box: Box) -> DataFrame:
    """Every edge out of every label of front: the new label, with why it goes (null: it stays)."""
    joined = front.select(*[F.col(c).alias(f"_{c}") for c in LABEL]).join(links, F.col("_node") == F.col("u"))
    length, gain = F.col("_length") + F.col("length"), F.col("_gain") + F.col("gain")
    pop_len, wid_len = F.col("_pop_len") + F.col("length") * F.col("popularity"), F.col("_wid_len") + F.col("length") * F.col("width")
    why = F.when(F.array_contains("_path", F.col("v")), "met").when(length + F.col("rest") > box.Lmax + graph.EPS, "too_long").when(gain + F.col("climb") > box.Hmax + graph.EPS, "too_high")
    changes = F.col("_road_changes") + F.coalesce((F.col("_road") != F.col("road_id")).cast("int"), F.lit(0))
    edges = F.concat("_edges", F.array("edge_id"))
    return joined.select(F.col("v").alias("node"), F.concat("_path", F.array("v")).alias("path"), edges.alias("edges"), length.alias("length"), gain.alias("gain"), pop_len.alias("pop_len"), wid_len.alias("wid_len"), F.coalesce("road_id", "_road").alias("road"), changes.alias("road_changes"), miss(box, length, gain, pop_len, wid_len, F.col("rest")).alias("miss"), "rest", F.xxhash64(edges).alias("label"), why.alias("why"))


def search(edges: DataFrame, box: Box, per_node: int = 80, most: int = 250_000, beam: int = 4096) -> DataFrame:
    """One row: query, status, path, edges, sums, road_changes, expanded, made, pruned, capped. most: labels to expand.

    status is `found`, `exhausted` (no label is left: no feasible route if capped is 0) or `budget_reached`."""
    spark = edges.sparkSession
    links = stored(edges.select("edge_id", "u", "v", *graph.METRICS, F.when(F.col("road_id") >= 0, F.col("road_id")).alias("road_id")).join(remaining(edges, box.target).withColumnRenamed("node", "v"), "v"), "links")
    none = F.lit(None).cast("long")
    open_ = stored(spark.range(1).select(F.lit(box.source).cast("long").alias("node"), F.array(F.lit(box.source).cast("long")).alias("path"), F.array().cast("array<bigint>").alias("edges"), *[F.lit(0.0).alias(c) for c in SUMS], none.alias("road"), F.lit(0).alias("road_changes"), F.lit(0.0).alias("miss"), F.lit(0.0).alias("rest"), F.lit(0).cast("long").alias("label")), "open")
    order, status, n = ["miss", "rest", "label"], "exhausted", dict.fromkeys(("expanded", "made", "pruned", "capped"), 0)
    won = open_.where((F.col("node") == box.target) & costs.feasible_mul(box))
    while won.isEmpty():
        if n["expanded"] >= most:
            status = "budget_reached" if not open_.isEmpty() else status
            break
        front = stored(open_.orderBy(*order).limit(min(beam, most - n["expanded"])), "front")
        taken = front.count()
        if not taken:
            break
        steps = stored(step(front.where(F.col("node") != box.target), links, box), "steps")
        made, pruned = steps.agg(F.count("*"), F.count("why")).first()
        fresh = steps.where("why IS NULL")
        won = fresh.where((F.col("node") == box.target) & costs.feasible_mul(box))
        rest = open_.join(front.select("label"), "label", "left_anti").select(*LABEL).unionByName(fresh.where(F.col("node") != box.target).select(*LABEL))
        placed = stored(rest.withColumn("_place", F.row_number().over(Window.partitionBy("node").orderBy(*order))), "open")
        over = placed.where(F.col("_place") > per_node).count()
        before, open_ = open_, placed.where(F.col("_place") <= per_node).drop("_place")
        for name, more in zip(n, (taken, made, pruned, over), strict=True):
            n[name] += more
        dropped(before, front)
    else:
        status = "found"
    best = won.withColumn("_score", costs.box_center_of_sums(box)).orderBy("_score", "label").limit(1).select("path", "edges", *SUMS, "road_changes")
    told = spark.range(1).select(F.lit(box.name).alias("query"), F.lit(status).alias("status"), *[F.lit(v).cast("long").alias(k) for k, v in n.items()])
    return told.join(best, F.lit(True), "left").select("query", "status", "path", "edges", *SUMS, "road_changes", *n)
