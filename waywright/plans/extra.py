"""Queries of portal search, labels, workloads, records and reports, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.functions import costs, paths
from waywright.operators import anytime, graph, network, search, seeds, via, workloads
from waywright.operators import local as local_search
from waywright.sources import lattice, text_files
from waywright.sources.lattice import SQL
from waywright.storage import shared_folder, ship, stored

#: labels of a search: a line of an order is a label at a portal; roads 0 to 5
LABELS_SQL = "labels AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'fwd' ELSE 'bwd' END AS dir, l_partkey % 500 AS portal, ((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS label, l_quantity * 10 AS length, CAST(l_suppkey % 50 AS DOUBLE) AS gain, l_quantity * 10 * (l_partkey % 256) AS pop_len, l_quantity * 10 * (5 + l_suppkey % 21) AS wid_len, CAST(l_orderkey % 9 AS INTEGER) AS road_changes, l_suppkey % 6 AS road, CAST(round(l_extendedprice * 100) AS BIGINT) % 977 AS priority FROM lineitem)"
#: edges between portals, one for each part
OVER_SQL = "overlay AS (SELECT p_partkey AS edge, p_partkey % 500 AS src, (p_partkey * 7 + 3) % 500 AS dst, CAST(p_size * 10 AS DOUBLE) AS length, CAST(p_size % 7 AS DOUBLE) AS gain, p_partkey % 6 AS first_road, p_size % 6 AS last_road, CAST(p_size % 4 AS INTEGER) AS changes FROM part)"
#: best label of each portal and direction
BEST_SQL = f"{LABELS_SQL}, {OVER_SQL}, best AS MATERIALIZED (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY dir, portal ORDER BY priority, length, label) = 1)"


def labels(spark, sf_dir) -> DataFrame:
    n = F.col("l_quantity")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") % 2 == 0, "fwd").otherwise("bwd").alias("dir"), (F.col("l_partkey") % 500).alias("portal"), F.expr("((l_orderkey * 20000 + l_partkey) * 1000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT)").alias("label"),
        (n * 10).alias("length"), (F.col("l_suppkey") % 50).cast("double").alias("gain"), (n * 10 * (F.col("l_partkey") % 256)).alias("pop_len"), (n * 10 * (5 + F.col("l_suppkey") % 21)).alias("wid_len"),
        (F.col("l_orderkey") % 9).cast("int").alias("road_changes"), (F.col("l_suppkey") % 6).alias("road"), (F.round(F.col("l_extendedprice") * 100).cast("long") % 977).alias("priority"),
    )


def overlay(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("edge"), (k % 500).alias("src"), ((k * 7 + 3) % 500).alias("dst"), (size * 10).cast("double").alias("length"), (size % 7).cast("double").alias("gain"), (k % 6).alias("first_road"), (size % 6).alias("last_road"), (size % 4).cast("int").alias("changes"))


def best(spark, sf_dir) -> DataFrame:
    own = Window.partitionBy("dir", "portal").orderBy("priority", "length", "label")
    return labels(spark, sf_dir).withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")


#: several edges between the same nodes 0 to 8, for walks
MULTI_SQL = "multi AS (SELECT s_suppkey AS edge_id, s_suppkey % 9 AS u, (s_suppkey * 5 + s_nationkey) % 9 AS v, CAST(100 + s_nationkey * 3 AS DOUBLE) AS length FROM supplier)"


def multi(spark, sf_dir) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("edge_id"), (k % 9).alias("u"), ((k * 5 + n) % 9).alias("v"), (100 + n * 3).cast("double").alias("length"))


def pair_edges(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """steps (u, v) with the edge between them by three policies: first, unique (none if there are several), shortest."""
    best = edges.groupBy("u", "v").agg(F.min("edge_id").alias("first"), F.when(F.count("*") == 1, F.min("edge_id")).alias("unique"), F.min_by("edge_id", F.struct("length", "edge_id")).alias("shortest"))
    return steps.join(best, ["u", "v"], "left")


def random_costs(edges: DataFrame, seed: int) -> DataFrame:
    """(edge_id, cost): length * (0.2 + 3 u), u being number edge_id of numpy's default generator. Edge ids are counted from
    0; a batch's numbers are reached by advancing the generator, so that any task makes its own."""

    def run(frames):
        for frame in frames:
            ids = frame["edge_id"].to_numpy()
            if len(ids):
                draws = np.empty(len(ids))
                order = np.argsort(ids)
                cuts = np.split(order, np.nonzero(np.diff(ids[order]) != 1)[0] + 1)
                for run_ in cuts:
                    own = np.random.PCG64(seed)
                    own.advance(int(ids[run_[0]]))
                    draws[run_] = np.random.Generator(own).random(len(run_))
                yield pd.DataFrame({"edge_id": ids, "cost": frame["length"].to_numpy() * (0.2 + 3 * draws)})

    ship(edges.sparkSession)
    return edges.select("edge_id", "length").mapInPandas(run, "edge_id long, cost double")


def retained(own: DataFrame, most: int = 80) -> DataFrame:
    """Per portal at most most labels. Selectors are taken in turn, but each gives its whole order; so the first decides."""
    return own.withColumn("place", F.row_number().over(Window.partitionBy("portal").orderBy("priority", "length", "label"))).where(F.col("place") <= most)


def diverse(entries: DataFrame, limit: int) -> DataFrame:
    """(query, route, place): of each query the best routes (score, road_changes, route) of every pair bucket, then of the
    rest the best of every corridor bucket, then the others, limit in all."""
    order = ["score", "road_changes", "route"]
    own = entries.withColumn("_pair", F.row_number().over(Window.partitionBy("query", "pair").orderBy(*order)) == 1)
    first = own.withColumn("_at", F.row_number().over(Window.partitionBy("query", "_pair").orderBy(*order)))
    taken = F.col("_pair") & (F.col("_at") <= limit)
    rest = first.withColumn("_taken", taken).withColumn("_way", (F.row_number().over(Window.partitionBy("query", "_taken", "corridor").orderBy(*order)) == 1) & ~F.col("_taken"))
    stage = F.when(F.col("_taken"), 0).when(F.col("_way"), 1).otherwise(2)
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(stage, *order))).where(F.col("place") <= limit).select("query", "route", "place")


_held: dict = {}


def held(spark, sf_dir: str, name: str, make):
    """What make() gives, once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def register(query, c) -> None:
    box = c.BOX
    edges = lattice.edges

    def own_cells(spark, sf_dir):
        return lattice.kept(spark, sf_dir, "cells", c.cells)

    def crossing(spark, sf_dir):
        return lattice.kept(spark, sf_dir, "crossing", lambda s, d: network.crossings(edges(s, d), own_cells(s, d)))

    def portals(spark, sf_dir):
        """Mandatory portals, source and target."""
        p = own_cells(spark, sf_dir)
        return search.mandatory(crossing(spark, sf_dir)).union(p.where(F.col("node").isin(box.source, box.target)).select("cell", "node")).distinct()

    def local(spark, sf_dir):
        return lattice.kept(spark, sf_dir, "shortcuts", lambda s, d: search.shortcuts(search.in_cells(edges(s, d), own_cells(s, d)), portals(s, d)))

    def crossing_edges(spark, sf_dir):
        return edges(spark, sf_dir).join(crossing(spark, sf_dir).select("edge_id", "from_cell", "to_cell"), "edge_id")

    def over(spark, sf_dir):
        return lattice.kept(spark, sf_dir, "overlay", lambda s, d: search.overlay(crossing_edges(s, d), portals(s, d), local(s, d), 2))

    def bounds(spark, sf_dir):
        ahead, back = c.g_sssp_fwd(spark, sf_dir), c.g_sssp_rev(spark, sf_dir)
        return stored(back.select(F.lit("fwd").alias("dir"), F.col("node").alias("portal"), F.col("dist").alias("rest")).union(ahead.select(F.lit("bwd"), "node", "dist")))

    def spots(spark, sf_dir):
        return lattice.nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))

    # ---- costs and labels

    grid = [("shortest_length", 0.0, 0.0), ("pop_width_reference", 3.0, 2.0)] + [(f"wp={w:g},pp={p:g}", w, p) for w in (1.0, 2.0, 3.0, 5.0, 8.0, 12.0) for p in (1.0, 2.0, 4.0, 8.0, 12.0)]
    values = ", ".join(f"('{n}', {w}, {p})" for n, w, p in grid)

    @query(f"WITH {SQL}, g(spec, wp, pp) AS (VALUES {values}) SELECT edge_id, spec, round(length * (1 + wp * greatest(0, width - {box.Wmax}) / {box.Wmax} + pp * greatest(0, {box.Pmin} - popularity) / {box.Pmin}), 6) AS cost FROM edges, g UNION ALL SELECT edge_id, 'low_width_linear', round(length * greatest(width / {box.Wmax}, 0.01), 6) FROM edges")
    def fn_cost_grid(spark, sf_dir):
        """Lengths weighed by pairs of penalties for width and popularity, and by width alone."""
        l = F.col("length")
        over_, under = F.greatest(F.lit(0.0), F.col("width") - box.Wmax) / box.Wmax, F.greatest(F.lit(0.0), box.Pmin - F.col("popularity")) / box.Pmin
        rows = [F.struct(F.lit(n).alias("spec"), F.round(l * (1 + w * over_ + p * under), 6).alias("cost")) for n, w, p in grid]
        rows.append(F.struct(F.lit("low_width_linear").alias("spec"), F.round(l * F.greatest(F.col("width") / box.Wmax, F.lit(0.01)), 6).alias("cost")))
        return edges(spark, sf_dir).select("edge_id", F.inline(F.array(*rows)))

    @query()
    def fn_cost_random(spark, sf_dir):
        return random_costs(edges(spark, sf_dir), 42)

    @query()
    def fn_exp_delay(spark, sf_dir):
        """A multiple of the length and an exponential delay, drawn by a seeded generator."""
        return edges(spark, sf_dir).select("edge_id", (1.5 * F.col("length") - F.log(F.lit(1.0) - F.rand(7)) / 0.01).alias("delay"))

    @query(f"WITH {c.ROUTES_SQL} SELECT route, 'L=' || CAST(round(L) AS BIGINT) || ' H=' || CAST(round(H) AS BIGINT) || ' P=' || CAST(floor(P) AS BIGINT) || ' W=' || CAST(floor(W) AS BIGINT) AS text FROM routes")
    def fn_format(spark, sf_dir):
        return c.routes(spark, sf_dir).select("route", F.concat(*[x for k, v in (("L=", F.round("L")), (" H=", F.round("H")), (" P=", F.floor("P")), (" W=", F.floor("W"))) for x in (F.lit(k), v.cast("long").cast("string"))]).alias("text"))

    @query(f"WITH {BEST_SQL} SELECT l.label, o.edge, NOT coalesce(l.road = CASE WHEN dir = 'fwd' THEN first_road ELSE last_road END, false) AS turns, CAST(changes + CASE WHEN l.road <> CASE WHEN dir = 'fwd' THEN first_road ELSE last_road END THEN 1 ELSE 0 END AS INTEGER) AS changes FROM best l JOIN overlay o ON l.portal = CASE WHEN dir = 'fwd' THEN o.src ELSE o.dst END")
    def fn_continuity_key(spark, sf_dir):
        """Of each label's extensions whether they leave its road, and the changes that they add."""
        b, o = best(spark, sf_dir), overlay(spark, sf_dir).drop("length", "gain")
        both = b.join(o, F.col("portal") == F.when(F.col("dir") == "fwd", F.col("src")).otherwise(F.col("dst")))
        key = search.continuity(F.col("road"), F.col("first_road"), F.col("last_road"), F.col("changes"), F.col("dir") == "fwd")
        return both.select("label", "edge", key.alias("k")).select("label", "edge", "k.turns", "k.changes")

    @query(f"WITH {LABELS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY priority, length, label) AS place FROM labels) SELECT portal, label, CAST(place AS INTEGER) AS place FROM o WHERE place <= 80")
    def win_retain_labels(spark, sf_dir):
        return retained(labels(spark, sf_dir)).select("portal", "label", "place")

    @query(f"WITH {LABELS_SQL} SELECT dir, portal, label, length FROM labels WHERE portal IN (3, 17, 99) AND dir = 'bwd' ORDER BY label LIMIT 500")
    def flt_trace(spark, sf_dir):
        """Events of chosen portals, the first 500."""
        return labels(spark, sf_dir).where(F.col("portal").isin(3, 17, 99) & (F.col("dir") == "bwd")).select("dir", "portal", "label", "length").orderBy("label").limit(500)

    @query(f"WITH {BEST_SQL} SELECT f.label AS f_label, o.edge, b.label AS b_label, f.length + o.length + b.length AS length, f.gain + o.gain + b.gain AS gain, CAST(f.road_changes + o.changes + b.road_changes + CASE WHEN f.road <> o.first_road THEN 1 ELSE 0 END + CASE WHEN o.last_road <> b.road THEN 1 ELSE 0 END AS INTEGER) AS road_changes FROM best f JOIN overlay o ON f.portal = o.src JOIN best b ON b.portal = o.dst WHERE f.dir = 'fwd' AND b.dir = 'bwd'")
    def join_one_edge(spark, sf_dir):
        b, o = best(spark, sf_dir), overlay(spark, sf_dir)
        side = lambda d: b.where(F.col("dir") == d).select(*[F.col(x).alias(f"{d[0]}_{x}") for x in ("portal", "label", "length", "gain", "road_changes", "road")])
        three = side("fwd").join(o, F.col("f_portal") == F.col("src")).join(side("bwd"), F.col("dst") == F.col("b_portal"))
        total = lambda x: F.col(f"f_{x}") + F.col(x) + F.col(f"b_{x}")
        return three.select("f_label", "edge", "b_label", total("length").alias("length"), total("gain").alias("gain"), (F.col("f_road_changes") + F.col("changes") + F.col("b_road_changes") + search.seam(F.col("f_road"), F.col("first_road")) + search.seam(F.col("last_road"), F.col("b_road"))).alias("road_changes"))

    @query(f"WITH {LABELS_SQL} SELECT dir, portal, label, length, gain, road_changes FROM labels WHERE dir = 'fwd' AND portal = 150 OR dir = 'bwd' AND portal = 0")
    def join_terminal(spark, sf_dir):
        """Labels that have come to the opposite end, joined with the empty label there."""
        ends = spark.range(1).select(F.inline(F.array(F.struct(F.lit("fwd").alias("dir"), F.lit(150).alias("portal")), F.struct(F.lit("bwd").alias("dir"), F.lit(0).alias("portal")))))
        return labels(spark, sf_dir).join(F.broadcast(ends), ["dir", "portal"]).select("dir", "portal", "label", "length", "gain", "road_changes")  # two rows

    @query(f"WITH {LABELS_SQL} SELECT dir, portal FROM labels GROUP BY 1, 2 HAVING count(*) FILTER (length <= 300) > 0")
    def agg_covered(spark, sf_dir):
        """Portals of each direction that some short label covers."""
        return labels(spark, sf_dir).where("length <= 300").select("dir", "portal").distinct()

    @query(f"WITH {LABELS_SQL}, c AS (SELECT portal % 20 AS cell, count(*) FILTER (dir = 'fwd' AND priority < 20) AS fwd, count(*) FILTER (dir = 'bwd' AND priority < 20) AS bwd FROM labels GROUP BY 1), a AS (SELECT CAST(p_size % 20 AS BIGINT) AS from_cell, p_partkey % 20 AS to_cell FROM part GROUP BY 1, 2), t AS (SELECT n_nationkey AS from_cell, (n_nationkey + 1) % 20 AS to_cell FROM nation) SELECT from_cell, to_cell FROM a JOIN c x ON x.cell = from_cell AND x.fwd > 0 JOIN c y ON y.cell = to_cell AND y.bwd > 0 WHERE NOT (x.bwd > 0 AND y.fwd > 0) AND (from_cell, to_cell) NOT IN (SELECT from_cell, to_cell FROM t)")
    def join_bridge_eligible(spark, sf_dir):
        own = labels(spark, sf_dir).where("priority < 20").groupBy((F.col("portal") % 20).alias("cell")).agg(F.count_if(F.col("dir") == "fwd").alias("fwd"), F.count_if(F.col("dir") == "bwd").alias("bwd"))
        beside = c.read(spark, sf_dir, "part").select((F.col("p_size") % 20).cast("long").alias("from_cell"), (F.col("p_partkey") % 20).alias("to_cell"))
        tried = c.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("from_cell"), ((F.col("n_nationkey") + 1) % 20).alias("to_cell"))
        return search.bridge_pairs(own, beside, tried)

    @query()
    def agg_audit(spark, sf_dir):
        """Counters of the search by round and direction: what became of every step, edges learnt, stuck portals."""
        return main(spark, sf_dir).events().select("round", "dir", "event", "n")

    @query(f"WITH {LABELS_SQL}, n AS (SELECT dir, portal, count(*) AS n FROM labels GROUP BY 1, 2) SELECT dir, n, count(*) AS portals, min(portal) AS example FROM n GROUP BY 1, 2")
    def agg_capacity_diag(spark, sf_dir):
        """How many portals hold how many labels, with one of each."""
        return labels(spark, sf_dir).groupBy("dir", "portal").agg(F.count("*").alias("n")).groupBy("dir", "n").agg(F.count("*").alias("portals"), F.min("portal").alias("example"))

    @query()
    def rep_snapshot(spark, sf_dir):
        """The twenty fullest portals of each direction after every round."""
        return main(spark, sf_dir).snapshot().select("round", "dir", "portal", "n", "place")

    @query(f"WITH {c.WALKS_SQL}, {MULTI_SQL}, s AS (SELECT walk, i - 1 AS pos, path[i] AS u, path[i + 1] AS v FROM walks, (SELECT unnest(range(1, 30)) AS i) WHERE i < len(path)), b AS (SELECT u, v, min(edge_id) AS first, CASE WHEN count(*) = 1 THEN min(edge_id) END AS \"unique\", arg_min(edge_id, {{'l': length, 'e': edge_id}}) AS shortest FROM multi GROUP BY 1, 2) SELECT walk, CAST(pos AS INTEGER) AS pos, s.u, s.v, first, \"unique\", shortest FROM s LEFT JOIN b ON s.u = b.u AND s.v = b.v")
    def join_path_edges(spark, sf_dir):
        """The edges of walks that are given by nodes, by three policies."""
        steps = c.walks(spark, sf_dir).where(F.size("path") > 1).select("walk", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("u"), F.get("path", i + 1).alias("v")))).alias("pos", "e")).select("walk", "pos", "e.u", "e.v")
        return pair_edges(steps, multi(spark, sf_dir)).select("walk", "pos", "u", "v", "first", "unique", "shortest")

    @query(f"WITH {c.WALKS_SQL}, {MULTI_SQL}, s AS (SELECT walk, len(path) AS n, i - 1 AS pos, path[i] AS u, path[i + 1] AS v FROM walks, (SELECT unnest(range(1, 30)) AS i) WHERE i < len(path)), b AS (SELECT u, v, min(length) AS length, count(*) AS n FROM multi GROUP BY 1, 2) SELECT walk, count(*) FILTER (b.u IS NULL) AS missing, count(*) FILTER (b.n > 1) AS ambiguous, coalesce(sum(b.length), 0) AS length, coalesce(abs(sum(b.length) - 100 * count(*)) <= 1e-4, false) AS agrees FROM s LEFT JOIN b ON s.u = b.u AND s.v = b.v GROUP BY 1")
    def val_archive_route(spark, sf_dir):
        """Walks recomputed from their nodes: steps without an edge, steps with several, and whether the length is as said."""
        steps = c.walks(spark, sf_dir).where(F.size("path") > 1).select("walk", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("u"), F.get("path", i + 1).alias("v")))).alias("e")).select("walk", "e.u", "e.v")
        known = multi(spark, sf_dir).groupBy("u", "v").agg(F.min("length").alias("length"), F.count("*").alias("n"))
        own = steps.join(known, ["u", "v"], "left").groupBy("walk").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"), F.coalesce(F.abs(F.sum("length") - 100 * F.count("*")) <= 1e-4, F.lit(False)).alias("agrees"))
        return own

    @query(f"{c._KEPT} SELECT edge_id, CAST(row_number() OVER (ORDER BY edge_id) - 1 AS INTEGER) AS compact_id FROM edges WHERE u IN (SELECT node FROM kept) AND v IN (SELECT node FROM kept)")
    def join_edge_map(spark, sf_dir):
        """Edges of the compact graph, numbered anew, with their ids in the full one."""
        return network.numbered(c.flt_geometric(spark, sf_dir), "edge_id", "compact_id").select("edge_id", "compact_id")

    @query(f"{c._KEPT} SELECT u AS node, edge_id FROM edges WHERE edge_id IN (SELECT edge_id FROM edges WHERE u IN (SELECT node FROM kept) AND v IN (SELECT node FROM kept))")
    def mask_out_edges(spark, sf_dir):
        return edges(spark, sf_dir).join(c.flt_geometric(spark, sf_dir), "edge_id", "left_semi").select(F.col("u").alias("node"), "edge_id")

    @query(f"WITH {SQL} SELECT edge_id, u AS source FROM edges")
    def edge_sources(spark, sf_dir):
        return edges(spark, sf_dir).select("edge_id", F.col("u").alias("source"))

    @query("SELECT o_custkey AS source, o_orderkey AS item FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
    def join_semi(spark, sf_dir):
        known = c.read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("source"))
        return c.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("item")).join(known, "source", "left_semi")

    @query("SELECT o_custkey AS source, o_orderkey AS item FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
    def join_anti(spark, sf_dir):
        known = c.read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("source"))
        return c.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("item")).join(known, "source", "left_anti")

    @query(f"WITH {c.WALKS_SQL}, x AS (SELECT walk, unnest(roads) AS road, unnest(range(len(roads))) AS pos FROM walks), k AS (SELECT * FROM x WHERE road IS NOT NULL), f AS (SELECT *, CASE WHEN lag(road) OVER (PARTITION BY walk ORDER BY pos) = road THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY walk ORDER BY pos) AS run FROM f), g AS (SELECT walk, CAST(run AS BIGINT) AS run, road, count(*) AS n FROM r GROUP BY ALL) SELECT walk, run, road, n, CAST(row_number() OVER (PARTITION BY walk ORDER BY n DESC, run) AS INTEGER) AS place FROM g QUALIFY place <= 8")
    def road_runs(spark, sf_dir):
        """The eight longest stretches of one road of each walk."""
        from waywright.operators import audit

        own = audit.road_runs(c.walks(spark, sf_dir))
        return own.withColumn("place", F.row_number().over(Window.partitionBy("walk").orderBy(F.desc("n"), "run"))).where("place <= 8")

    @query(f"WITH {c.WALKS_SQL}, k AS (SELECT walk, len(path) AS before, path FROM walks) SELECT walk, before, len(list_distinct(path)) AS distinct_nodes, before - len(list_distinct(path)) AS repeats, before > len(list_distinct(path)) AS looped FROM k")
    def loop_erasure_report(spark, sf_dir):
        own = c.walks(spark, sf_dir).select("walk", F.size("path").cast("long").alias("before"), F.size(F.array_distinct("path")).cast("long").alias("distinct_nodes"))
        return own.select("*", (F.col("before") - F.col("distinct_nodes")).alias("repeats"), (F.col("before") > F.col("distinct_nodes")).alias("looped"))

    # ---- graph

    IN = f"{c.VORONOI_SQL}, inside AS MATERIALIZED (SELECT e.*, a.cell FROM edges e JOIN cells a ON a.node = u JOIN cells b ON b.node = v WHERE a.cell = b.cell), pm AS (SELECT least(from_cell, to_cell) AS low, greatest(from_cell, to_cell) AS high, min(CASE WHEN from_cell < to_cell THEN {{'u': u, 'v': v}} ELSE {{'u': v, 'v': u}} END) AS e FROM crossing GROUP BY 1, 2), portal AS MATERIALIZED (SELECT low AS cell, e.u AS node FROM pm UNION SELECT high, e.v FROM pm UNION SELECT cell, node FROM cells WHERE node IN ({box.source}, {box.target}))"
    WAYS = f"{IN}, way(src, node, own) USING KEY (src, node) AS (SELECT node, node, {{'l': CAST(0 AS DOUBLE), 'g': CAST(0 AS DOUBLE)}} FROM portal UNION SELECT w.src, i.v, min({{'l': w.own.l + i.length, 'g': w.own.g + i.gain}}) FROM way w JOIN inside i ON i.u = w.node LEFT JOIN recurring.way o ON o.src = w.src AND o.node = i.v WHERE o.own IS NULL OR {{'l': w.own.l + i.length, 'g': w.own.g + i.gain}} < o.own GROUP BY w.src, i.v)"

    @query(f"{WAYS} SELECT p.cell, src, w.node AS dst, own.l AS length, own.g AS gain FROM way w JOIN portal p ON p.node = w.node WHERE src <> w.node")
    def ps_local_engine(spark, sf_dir):
        """Shortcuts between the portals of each cell."""
        return local(spark, sf_dir).select("cell", "src", "dst", "length", "gain")

    @query(f"{WAYS} SELECT s.cell, src, w.node, own.l AS length, own.g AS gain FROM way w JOIN portal s ON s.node = src WHERE w.node <> src AND w.node IN (SELECT u FROM crossing)")
    def g_in_cell_path(spark, sf_dir):
        """Least (length, gain) ways inside cells from portals to all nodes with an exit."""
        inside = stored(search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), "inside")
        exits = crossing(spark, sf_dir).select(F.col("from_cell").alias("cell"), F.col("u").alias("node")).distinct()
        if local_search.largest(inside) > anytime.CELL_EDGES:
            return search.least_in_cells(inside, portals(spark, sf_dir), exits)
        return search.shortcuts(inside, portals(spark, sf_dir), goals=exits).select("cell", "src", F.col("dst").alias("node"), "length", "gain")

    @query(f"{IN}, way_in(node) AS (SELECT v FROM crossing UNION SELECT i.v FROM way_in r JOIN inside i ON i.u = r.node) SELECT node FROM way_in")
    def g_in_cell_bfs(spark, sf_dir):
        """Nodes that some way into their cell reaches without leaving it."""
        inside = stored(search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)).select("edge_id", "u", "v", *graph.METRICS), "inside")
        return graph.distances(inside, crossing(spark, sf_dir).select(F.col("v").alias("node")).distinct()).select("node")

    @query(f"{IN}, way_in(node) AS (SELECT v FROM crossing UNION SELECT i.v FROM way_in r JOIN inside i ON i.u = r.node) SELECT edge_id FROM crossing WHERE u IN (SELECT node FROM way_in)")
    def flt_culdesac(spark, sf_dir):
        """Crossings that a backward label may take: into nodes from which a way leads back out of their cell."""
        return crossing(spark, sf_dir).join(g_in_cell_bfs(spark, sf_dir).select(F.col("node").alias("u")), "u", "left_semi").select("edge_id")

    @query(f"{IN} SELECT edge_id FROM crossing, (SELECT cell FROM cells WHERE node = {box.target}) t WHERE NOT (to_cell = t.cell AND v <> {box.target})")
    def flt_terminal_leak(spark, sf_dir):
        """Crossings after which a forward label moves on: not those into the target's cell elsewhere than at it."""
        home = own_cells(spark, sf_dir).where(F.col("node") == box.target).select(F.col("cell").alias("_home"))
        return crossing(spark, sf_dir).crossJoin(F.broadcast(home)).where(~((F.col("to_cell") == F.col("_home")) & (F.col("v") != box.target))).select("edge_id")  # one row

    @query(f"{IN} SELECT CASE WHEN node = {box.source} THEN 'fwd' ELSE 'bwd' END AS dir, node AS portal, cell FROM cells WHERE node IN ({box.source}, {box.target})")
    def ps_root_label(spark, sf_dir):
        return search.roots(own_cells(spark, sf_dir), box).select("dir", "portal", F.get("cells", F.lit(0)).alias("cell"))

    @query(f"{IN}, k AS (SELECT c.*, e.length, e.gain, row_number() OVER (PARTITION BY c.u, c.v ORDER BY e.length, e.gain, c.edge_id) AS r FROM crossing c JOIN edges e USING (edge_id) WHERE c.u IN (SELECT node FROM portal) AND c.v IN (SELECT node FROM portal)) SELECT u AS src, v AS dst, from_cell, to_cell, length, gain FROM k WHERE r <= 2")
    def ps_initial_overlay(spark, sf_dir):
        """Crossings whose both ends are active portals."""
        none = local(spark, sf_dir).where("false")
        return search.overlay(crossing_edges(spark, sf_dir), portals(spark, sf_dir), none, 2).select("src", "dst", "from_cell", "to_cell", "length", "gain")

    both = c.SSSP.split("ahead(node", 1)[1]  # the two distance tables
    step = f"{WAYS.replace('links AS MATERIALIZED (SELECT u, v FROM edges)', 'links AS MATERIALIZED (SELECT u, v, length FROM edges)')}, ahead(node{both}, o AS (SELECT src, w.node AS dst, own.l AS length, own.g AS gain FROM way w JOIN portal p ON p.node = w.node WHERE src <> w.node UNION ALL SELECT c.u, c.v, e.length, e.gain FROM crossing c JOIN edges e USING (edge_id) WHERE c.u IN (SELECT node FROM portal) AND c.v IN (SELECT node FROM portal))"

    @query(f"{step} SELECT 'fwd' AS dir, dst AS portal, length, gain FROM o JOIN back b ON b.node = dst WHERE src = {box.source} AND length + b.dist <= {box.Lmax} + 1e-6 AND length <= {box.Lmax} AND gain <= {box.Hmax} UNION ALL SELECT 'bwd', src, length, gain FROM o JOIN ahead a ON a.node = src WHERE dst = {box.target} AND length + a.dist <= {box.Lmax} + 1e-6 AND length <= {box.Lmax} AND gain <= {box.Hmax}")
    def ps_expand(spark, sf_dir):
        """The first round: children of the two empty labels."""
        p = own_cells(spark, sf_dir)
        at = {r["node"]: r["cell"] for r in p.where(F.col("node").isin(box.source, box.target)).collect()}
        return search.expand(search.roots(p, box), over(spark, sf_dir), bounds(spark, sf_dir), box, at, 2).select("dir", "portal", "length", "gain")

    def filled(spark, sf_dir):
        """The overlay of all active portals."""
        def make(s, d):
            p = search.active_portals(crossing(s, d), own_cells(s, d), spots(s, d), [box.source, box.target], 4)
            p = stored(p)
            return search.overlay(crossing_edges(s, d), p, search.shortcuts(search.in_cells(edges(s, d), own_cells(s, d)), p), 2)

        return lattice.kept(spark, sf_dir, "filled", make)

    def ground(spark, sf_dir):
        return held(spark, sf_dir, "ground", lambda: anytime.ground(edges(spark, sf_dir), own_cells(spark, sf_dir), spots(spark, sf_dir), [box.source, box.target], longest=box.Lmax, budgets=sorted({v.portals for v in search.sweep(search.Config()).values()})))

    def main(spark, sf_dir):
        """The box's search, with bridges and repairs, until nothing is left or for twelve rounds; its status tells which."""
        return held(spark, sf_dir, "main", lambda: anytime.Search(ground(spark, sf_dir), {box.name: (box, search.Config())}).go_on(12))

    def grown(spark, sf_dir):
        return main(spark, sf_dir).labels.frame()

    @query()
    def ps_advance(spark, sf_dir):
        """All labels that were kept in some round, and those that leak."""
        return grown(spark, sf_dir).select("dir", "portal", "label", *search.SUMS, "road_changes", "leak", F.size("cells").alias("n_cells"), F.size("edges").alias("n_edges"), "round")

    @query()
    def ps_join_emit(spark, sf_dir):
        """Routes of labels that meet, checked edge by edge."""
        return via.validated(main(spark, sf_dir).routes(), edges(spark, sf_dir), ["route"]).select("route", "join", "score", "length", "x_length", "gain", "x_gain", "road_changes", "connected", "elementary")

    @query()
    def ps_main(spark, sf_dir):
        """The archive of the box's portal search."""
        return main(spark, sf_dir).archive()

    @query()
    def ps_status(spark, sf_dir):
        """How the search ended: `exhausted`, or `open` with labels left."""
        return main(spark, sf_dir).statuses()

    @query()
    def ps_learnt(spark, sf_dir):
        """Overlay edges that rounds have added, with their kind: bridges, repairs for stuck portals, crossings into dead ones."""
        return main(spark, sf_dir).learnt.frame().select("round", "kind", "src", "dst", "from_cell", "to_cell", *search.SUMS, "road_changes", "edges")

    @query()
    def ps_bridge(spark, sf_dir):
        """Shortest ways over the crossings of neighbouring cells, two for each pair."""
        pairs = crossing(spark, sf_dir).select("from_cell", "to_cell").distinct()
        return search.bridges(pairs, crossing_edges(spark, sf_dir), search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), portals(spark, sf_dir), 2, 256)

    @query()
    def ps_fwd_repair(spark, sf_dir):
        """Further edges from portals over crossings between cells that no overlay edge leads between."""
        return search.directional_repairs(crossing_edges(spark, sf_dir), search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), portals(spark, sf_dir), over(spark, sf_dir), 2, 256, True)

    @query()
    def ps_bwd_repair(spark, sf_dir):
        return search.directional_repairs(crossing_edges(spark, sf_dir), search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), portals(spark, sf_dir), over(spark, sf_dir), 2, 256, False)

    @query(f"{IN}, o AS (SELECT c.u, c.v FROM crossing c WHERE c.u IN (SELECT node FROM portal) AND c.v IN (SELECT node FROM portal)) SELECT edge_id, u AS src, v AS dst FROM crossing WHERE v IN (SELECT node FROM portal) AND v NOT IN (SELECT v FROM o)")
    def ps_dead_repair(spark, sf_dir):
        """Raw crossings into portals that no crossing of the overlay leads to."""
        none = local(spark, sf_dir).where("false")
        return search.dead_repairs(crossing_edges(spark, sf_dir), portals(spark, sf_dir), search.overlay(crossing_edges(spark, sf_dir), portals(spark, sf_dir), none, 2))

    @query()
    def join_bridge(spark, sf_dir):
        """The shortest way over a crossing for each pair of neighbouring cells."""
        pairs = crossing(spark, sf_dir).select("from_cell", "to_cell").distinct()
        return search.bridges(pairs, crossing_edges(spark, sf_dir), search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), portals(spark, sf_dir), 1, 256).select("from_cell", "to_cell", "src", "dst", "length", "gain")

    @query()
    def ps_representatives(spark, sf_dir):
        """The labels that the portals of the finished search hold, by wins."""
        from waywright.operators import portal

        return main(spark, sf_dir).kept.transform(portal.representatives).select("dir", "portal", "label", "wins", "place", "length", "gain")

    @query()
    def ps_archive(spark, sf_dir):
        """How the archive's routes are alike: shared nodes of every two of them; an archive holds a few."""
        own = ps_main(spark, sf_dir).select("route", F.explode("edges").alias("edge_id")).join(edges(spark, sf_dir).select("edge_id", F.col("v").alias("node")), "edge_id").groupBy("route").agg(F.collect_set("node").alias("nodes"))
        own = stored(own)
        other = own.select(F.col("route").alias("other"), F.col("nodes").alias("_n"))
        return own.join(other, F.col("route") < F.col("other")).select("route", "other", F.round(paths.jaccard(F.col("nodes"), F.col("_n")), 6).alias("alike"))

    @query()
    def ps_resume(spark, sf_dir):
        """Labels that each batch of 64 of a portal's search in its cell has closed; many batches are written at a time, and a
        search goes on from what is written."""
        inside = stored(search.in_cells(edges(spark, sf_dir), own_cells(spark, sf_dir)), "inside")
        if local_search.largest(inside) <= graph.KERNEL_EDGES:
            return local_search.BatchSearch(inside, portals(spark, sf_dir), local_search.folder(spark, "resume"), pops=64).go_on().progress()
        own = local_search.LocalSearch(inside, portals(spark, sf_dir), local_search.folder(spark, "resume"), pops=64, hops=4)
        return own.go_on().progress()

    own_ways = f"""{IN}, walk(cell, root, node, length, gain, wid_len, lack, path) AS (SELECT cell, node, node, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), [node] FROM portal
 UNION ALL SELECT w.cell, w.root, e.v, w.length + e.length, w.gain + e.gain, w.wid_len + e.length * e.width, w.lack + e.length * (m.top - e.popularity), list_append(w.path, e.v) FROM walk w JOIN inside i ON i.u = w.node JOIN edges e ON e.u = i.u AND e.v = i.v, (SELECT max(popularity) AS top FROM edges) m WHERE NOT list_contains(w.path, e.v) AND w.length + e.length <= 650),
best AS MATERIALIZED (SELECT DISTINCT cell, root, node, length, gain, wid_len, lack FROM walk a WHERE NOT EXISTS (SELECT 1 FROM walk b WHERE b.root = a.root AND b.node = a.node AND b.length <= a.length AND b.gain <= a.gain AND b.wid_len <= a.wid_len AND b.lack <= a.lack AND (b.length < a.length OR b.gain < a.gain OR b.wid_len < a.wid_len OR b.lack < a.lack)))"""

    def pareto(spark, sf_dir):
        def make(s, d):
            inside = stored(search.in_cells(edges(s, d), own_cells(s, d)), "inside")
            return local_search.LocalSearch(inside, portals(s, d), local_search.folder(s, "local2"), several=True, longest=650.0, pops=None, hops=2).go_on().state

        return lattice.kept(spark, sf_dir, "local2", make)

    @query(f"{own_ways} SELECT cell, root, node, length, gain, wid_len, lack FROM best")
    def ps_local2(spark, sf_dir):
        """LOCAL2 of every portal, for ways of up to 650 metres in its cell: all that no other way to the node is as good as in length,
        climb, width and lack of popularity."""
        top = edges(spark, sf_dir).agg(F.max("popularity")).first()[0]
        return pareto(spark, sf_dir).select("cell", "root", "node", "length", "gain", "wid_len", (F.col("length") * top - F.col("pop_len")).alias("lack")).distinct()

    @query(f"{own_ways}, n AS (SELECT cell, root, node, count(*) AS n FROM best WHERE root <> node GROUP BY 1, 2, 3) SELECT cell, count(DISTINCT root) AS portals, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS ways, max(n) AS most, count(*) FILTER (n > 1) AS with_choice FROM n GROUP BY 1")
    def rep_local2(spark, sf_dir):
        """What LOCAL2 has beyond LOCAL1's one way for each pair of portal and node, by cell."""
        n = ps_local2(spark, sf_dir).where("root <> node").groupBy("cell", "root", "node").agg(F.count("*").alias("n"))
        return n.groupBy("cell").agg(F.count_distinct("root").alias("portals"), F.count("*").alias("pairs"), F.sum("n").alias("ways"), F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("with_choice"))

    @query(f"{IN}, d AS (SELECT u AS node, count(*) AS out_ FROM crossing GROUP BY 1) SELECT p.cell, p.node, coalesce(d.out_, 0) AS out_ FROM portal p LEFT JOIN d USING (node)")
    def ps_label_misc(spark, sf_dir):
        """Neighbours over one crossing of every portal."""
        out = crossing(spark, sf_dir).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("out_"))
        return portals(spark, sf_dir).join(out, "node", "left").select("cell", "node", F.coalesce("out_", F.lit(0)).alias("out_"))

    # ---- sources and sinks

    @query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) / 4 AS x, CAST(p_partkey AS DOUBLE) / 8 AS y, p_brand AS name FROM part")
    def src_graphml(spark, sf_dir):
        """Nodes of a GraphML file, their attributes by the names that the file's keys give."""
        p = c.read(spark, sf_dir, "part")
        element = F.format_string('<node id="%d"><data key="d0">%s</data><data key="d1">%s</data><data key="d2">%s</data></node>', "p_partkey", (F.col("p_size") / 4).cast("string"), (F.col("p_partkey") / 8).cast("string"), "p_brand")
        keys = spark.range(1).select(F.explode(F.array(*[F.lit(f'<key id="d{i}" for="node" attr.name="{n}" attr.type="string"/>') for i, n in enumerate(("x", "y", "name"))])).alias("value"))
        path = f"{shared_folder(spark)}/graphml-{uuid.uuid4().hex}"
        text_files.graphml_lines(keys, p.select(element.alias("value"))).write.text(path)
        nodes, _ = text_files.graphml(spark, path)
        return nodes.select(F.col("id").cast("long").alias("id"), F.col("data")["x"].cast("double").alias("x"), F.col("data")["y"].cast("double").alias("y"), F.col("data")["name"].alias("name"))

    @query("SELECT 'i' || o_orderkey AS item, o_orderpriority AS category, o_custkey AS source, o_custkey + 5 AS target, CAST(o_orderkey % 100 AS DOUBLE) AS Lmin, 500.0::DOUBLE AS Hmax FROM orders")
    def src_items(spark, sf_dir):
        """Benchmark items from JSON, a box within each; bounds that it lacks have defaults."""
        own = c.read(spark, sf_dir, "orders").select(F.to_json(F.struct(F.concat(F.lit("i"), "o_orderkey").alias("item"), F.col("o_orderpriority").alias("category"), F.struct(F.col("o_custkey").alias("source"), (F.col("o_custkey") + 5).alias("target"), (F.col("o_orderkey") % 100).alias("Lmin")).alias("query"))).alias("value"))
        return text_files.parse_items(own, {"Hmax": 500.0}).select("item", "category", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "Lmin", "Hmax")

    @query(f"WITH {c.WALKS_SQL} SELECT walk, len(path) AS n, path[1] AS first FROM walks")
    def src_walk_json(spark, sf_dir):
        """Walks from JSON texts, as an audit dumps them."""
        own = c.walks(spark, sf_dir).select(F.to_json(F.struct("walk", F.col("path").alias("nodes"))).alias("value"))
        return text_files.parse_walks(own).select("walk", F.size("nodes").cast("long").alias("n"), F.get("nodes", F.lit(0)).alias("first"))

    pairs = f"""WITH {SQL}, p AS (SELECT a.edge_id AS one, b.edge_id AS two, a.u AS first, a.v AS mid, b.v AS last, a.length + b.length AS length, a.gain + b.gain AS gain FROM edges a JOIN edges b ON b.u = a.v WHERE a.edge_id % 7 = b.edge_id % 7)"""

    def files(spark, sf_dir):
        """JSON texts with walks of two edges at three depths; some with a node, an edge or a query that isn't theirs, some no JSON."""
        e = edges(spark, sf_dir)
        a = e.select(F.col("edge_id").alias("one"), F.col("u").alias("first"), F.col("v").alias("mid"))
        p = a.join(e.select(F.col("edge_id").alias("two"), F.col("u").alias("mid"), F.col("v").alias("last")), "mid").where(F.col("one") % 7 == F.col("two") % 7)
        k = F.col("one") % 7
        walk = F.struct(F.concat(F.lit("q"), "one", F.lit("-"), "two").alias("query_id"), F.array("first", F.when(k == 2, F.col("mid") + 1).otherwise(F.col("mid")), "last").alias("path_node_ids"), F.when(k == 3, F.array(F.lit(-1).cast("long"), "two")).when(k == 4, F.array("two", "one")).otherwise(F.array("one", "two")).alias("edge_ids"), F.struct(F.col("first").alias("source"), F.when(k == 1, F.col("last") + 1).otherwise(F.col("last")).alias("target")).alias("query"))
        flat = F.to_json(walk)
        deep = F.concat(F.lit('{"runs": [{"x": 1}, {"best": '), flat, F.lit("}]}"))
        own = F.when(k % 3 == 0, flat).when(k % 3 == 1, deep).otherwise(F.concat(F.lit("[["), flat, F.lit("], 5]")))
        texts = p.select(F.concat("one", F.lit("-"), "two").alias("file"), own.alias("value"))
        return texts.union(p.where(k == 0).select(F.concat(F.lit("broken-"), "one", F.lit("-"), "two"), F.lit("{no json")))

    @query(f"{pairs} SELECT one || '-' || two AS file, CASE one % 7 % 3 WHEN 0 THEN '/' WHEN 1 THEN '/runs[1]/best' ELSE '[0][0]' END AS json_path, 'q' || one || '-' || two AS query_id, CASE one % 7 WHEN 1 THEN 'wrong_ends' WHEN 2 THEN 'other_nodes' WHEN 3 THEN 'unknown_edge' WHEN 4 THEN CASE WHEN first <> last THEN 'broken' WHEN first <> mid THEN 'other_nodes' END END AS reason FROM p")
    def src_walks_nested(spark, sf_dir):
        """Walks at any depth of JSON texts, validated against the edges: why each is refused, null for sound ones."""
        return text_files.witnessed(text_files.nested_walks(files(spark, sf_dir)), edges(spark, sf_dir)).select("file", "json_path", "query_id", "reason")

    @query("SELECT '{\"item\":' || o_orderkey || ',\"method\":\"' || o_orderpriority || '\",\"mode\":\"' || o_orderstatus || '\"}' AS value FROM orders")
    def sink_json(spark, sf_dir):
        return c.read(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("mode"))).alias("value"))

    @query("SELECT o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus AS value FROM orders")
    def sink_csv(spark, sf_dir):
        return c.read(spark, sf_dir, "orders").select(F.to_csv(F.struct(F.col("o_orderkey"), "o_orderpriority", "o_orderstatus")).alias("value"))

    @query("SELECT (s_suppkey + 1000) || ' ' || s_suppkey || ' ' || printf('%.2f', s_suppkey * 0.25) || ' ' || printf('%.1f', s_nationkey * 0.5) AS value FROM supplier")
    def sink_seeds_ll(spark, sf_dir):
        return c.read(spark, sf_dir, "supplier").select(F.format_string("%d %d %.2f %.1f", F.col("s_suppkey") + 1000, "s_suppkey", F.col("s_suppkey") * 0.25, F.col("s_nationkey") * 0.5).alias("value"))

    @query("SELECT 10 * s_suppkey AS line, s_name AS value FROM supplier")
    def src_lines(spark, sf_dir):
        """Data lines of a text with comments and blanks."""
        lines = c.read(spark, sf_dir, "supplier").select((10 * F.col("s_suppkey")).alias("line"), F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("value"))
        return text_files.data_lines(text_files.with_comments(lines))

    @query("SELECT s_suppkey AS line, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS node FROM supplier")
    def src_idmode(spark, sf_dir):
        """Ids of the old graph or of the compact one, as a line's tag says; untagged ids are of the compact one."""
        even = F.col("s_suppkey") % 2 == 0
        lines = c.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), F.when(even, F.format_string("old %d", F.col("s_suppkey") + 1000)).otherwise(F.format_string("%d", "s_suppkey")).alias("value"))
        return text_files.parse_ids(lines).select("line", F.coalesce("old_id", "xy_id").alias("node"))

    # ---- archive

    ENTRIES = f"{c.ROUTES_SQL}, entries AS (SELECT route % 20 AS query, route, CAST(L AS DOUBLE) AS score, CAST(H AS BIGINT) AS road_changes, route % 7 AS pair, route % 11 AS corridor FROM routes)"

    @query(f"WITH {ENTRIES}, a AS (SELECT *, row_number() OVER (PARTITION BY query, pair ORDER BY score, road_changes, route) = 1 AS w FROM entries), b AS (SELECT *, row_number() OVER (PARTITION BY query, w ORDER BY score, road_changes, route) AS k FROM a), t AS (SELECT *, w AND k <= 12 AS taken FROM b), v AS (SELECT *, NOT taken AND row_number() OVER (PARTITION BY query, taken, corridor ORDER BY score, road_changes, route) = 1 AS way FROM t) SELECT query, route, CAST(row_number() OVER (PARTITION BY query ORDER BY CASE WHEN taken THEN 0 WHEN way THEN 1 ELSE 2 END, score, road_changes, route) AS INTEGER) AS place FROM v QUALIFY place <= 12")
    def win_bucket_winner(spark, sf_dir):
        own = c.routes(spark, sf_dir).select((F.col("route") % 20).alias("query"), "route", F.col("L").cast("double").alias("score"), F.col("H").cast("long").alias("road_changes"), (F.col("route") % 7).alias("pair"), (F.col("route") % 11).alias("corridor"))
        return diverse(own, 12)

    @query(f"WITH {ENTRIES} SELECT query, corridor, count(*) AS routes, count(DISTINCT pair) AS pairs FROM entries GROUP BY 1, 2")
    def ps_archive_counters(spark, sf_dir):
        return c.routes(spark, sf_dir).groupBy((F.col("route") % 20).alias("query"), (F.col("route") % 11).alias("corridor")).agg(F.count("*").alias("routes"), F.count_distinct(F.col("route") % 7).alias("pairs"))

    @query(f"WITH {c.WALKS_SQL} SELECT a.walk AS left_, b.walk AS right_, round(CASE WHEN len(list_distinct(list_concat(a.path, b.path))) = 0 THEN 1 ELSE len(list_intersect(list_distinct(a.path), b.path)) / len(list_distinct(list_concat(a.path, b.path))) END, 6) AS alike FROM walks a JOIN walks b ON a.walk < b.walk AND b.walk < a.walk + 4")
    def rep_portal_run(spark, sf_dir):
        """How alike neighbouring routes of an archive are, in pairs of up to three apart."""
        w = c.walks(spark, sf_dir).select("walk", "path")
        near = w.select(F.col("walk").alias("left_"), F.col("path").alias("_p"), F.explode(F.array(*[F.col("walk") + k for k in (1, 2, 3)])).alias("walk"))
        return near.join(w, "walk").select("left_", F.col("walk").alias("right_"), F.round(paths.jaccard(F.col("_p"), F.col("path")), 6).alias("alike"))

    # ---- via

    def candidates(spark, sf_dir, specs=c.FEW):
        trees = lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, specs))
        shaped = via.join_via(trees, box).select("spec", "via", "cost", *search.SUMS, "road_changes", *costs.route_vector())
        return shaped.withColumn("center", costs.box_center(box)).withColumn("violation", costs.violation_score(box)).withColumn("feasible", costs.feasible_mul(box))

    @query()
    def top_profile_order(spark, sf_dir):
        """The first hundred profiles of each spec by centre, length, violation and node."""
        own = Window.partitionBy("spec").orderBy("center", "length", "violation", "via")
        return candidates(spark, sf_dir).withColumn("place", F.row_number().over(own)).where("place <= 100").select("spec", "via", "place", F.round("center", 9).alias("center"), "length")

    def exact(spark, sf_dir, profiles):
        trees = lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, c.FEW))
        found = via.reconstruct(trees, profiles.withColumn("query", F.lit(box.name)))
        return via.validated(found, edges(spark, sf_dir), ["query", "spec", "via"])

    @query()
    def top_first_hit(spark, sf_dir):
        """Of each spec the first feasible profile, in order, that rebuilds to an elementary route."""
        checked = exact(spark, sf_dir, candidates(spark, sf_dir).where("feasible")).where("connected and elementary")
        return checked.groupBy("spec").agg(F.min(F.struct("center", "length", "violation", "via")).alias("m")).select("spec", "m.via", F.round("m.center", 9).alias("center"), "m.length")

    @query()
    def rec_via(spark, sf_dir):
        """A record of each spec: profiles, feasible ones, exact routes, the first hit, the nearest, the most climb in time."""
        own = stored(candidates(spark, sf_dir))
        checked = stored(exact(spark, sf_dir, own.where("feasible")))
        counts = own.groupBy("spec").agg(F.count("*").alias("profiles"), F.count_if("feasible").alias("profile_feasible"), F.min(F.struct("violation", "length", "via")).alias("near"), F.max(F.when(F.col("length") <= box.Lmax + 1e-6, F.struct("gain", -F.col("length"), -F.col("via")))).alias("high"))
        found = checked.groupBy("spec").agg(F.count_if(F.col("connected") & F.col("elementary")).alias("exact"), F.count_if(F.col("connected") & ~F.col("elementary")).alias("non_elementary"), F.count_if(~F.col("connected")).alias("rejected"), F.min(F.when(F.col("connected") & F.col("elementary"), F.struct("center", "length", "violation", "via"))).alias("hit"))
        return counts.join(found, "spec", "left").select("spec", "profiles", "profile_feasible", F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("non_elementary", F.lit(0)).alias("non_elementary"), F.coalesce("rejected", F.lit(0)).alias("rejected"), F.col("hit.via").alias("first_hit"), F.col("near.via").alias("nearest"), F.round("near.violation", 9).alias("violation"), (-F.col("high.col3")).alias("highest"), F.col("high.gain").alias("hmax"))

    @query()
    def rec_direct(spark, sf_dir):
        """The direct route of every spec as a record; feasible only if it is elementary."""
        trees = lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, c.FEW))
        at = trees.where((F.col("dir") == "fwd") & (F.col("node") == box.target))
        ways = graph.paths(trees, at.select("query", "spec", "dir", "node"))
        checked = via.validated(at.select("query", "spec", F.col("len").alias("length"), "gain", "pop_len", "wid_len", "road_changes").join(ways.select("query", "spec", "edges"), ["query", "spec"]), edges(spark, sf_dir), ["query", "spec"])
        return checked.select("spec", "length", "gain", "road_changes", "connected", "elementary", (costs.feasible_mul(box) & F.col("elementary")).alias("feasible"), F.size("edges").alias("n_edges"))

    @query(f"{c.SSSP} SELECT count(*) AS profiles, min(a.dist + b.dist) AS least, count(*) FILTER (a.dist + b.dist BETWEEN {box.Lmin} AND {box.Lmax}) AS in_range FROM ahead a JOIN back b USING (node) WHERE a.dist + b.dist > 0")
    def via_pair_run(spark, sf_dir):
        """One forward and one backward spec: profiles of all nodes that both trees reach."""
        trees = lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, c.FEW)).where("spec = 'shortest_length'")
        own = via.join_via(trees, box)
        return own.agg(F.count("*").alias("profiles"), F.min("length").alias("least"), F.count_if(F.col("length").between(box.Lmin, box.Lmax)).alias("in_range"))

    @query()
    def via_mixed(spark, sf_dir):
        """Profiles of every ordered pair of three specs: the forward part by one, the backward part by the other."""
        trees = lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, c.FEW))
        return via.mixed(trees, box).groupBy("fwd_spec", "bwd_spec").agg(F.count("*").alias("profiles"), F.count_if("feasible").alias("feasible"), F.round(F.min("violation"), 9).alias("violation"))

    @query(f"WITH s(spec) AS (VALUES {', '.join(f'({chr(39)}{s.name}{chr(39)})' for s in c.SPECS)}) SELECT spec FROM s WHERE spec NOT IN ({', '.join(f'{chr(39)}{s.name}{chr(39)}' for s in c.FEW)})")
    def spec_independent(spark, sf_dir):
        """Specs of the portfolio that haven't been evaluated."""
        own = costs.specs_frame(spark, c.SPECS).select("spec")
        return own.join(costs.specs_frame(spark, c.FEW).select("spec"), "spec", "left_anti")

    @query(f"WITH s(spec, family) AS (VALUES {', '.join(f'({chr(39)}{s.name}{chr(39)}, {chr(39)}{s.family}{chr(39)})' for s in c.SPECS)}) SELECT spec, family FROM s WHERE spec IN ('pop_width_reference', 'hinge_width_strong', 'slope_exp_beta_150_width')")
    def spec_select(spark, sf_dir):
        """The benchmark's three specs; their references are those of the box."""
        own = [s for s in c.SPECS if s.name in ("pop_width_reference", "hinge_width_strong", "slope_exp_beta_150_width")]
        if any(s.params["Wref"] != box.Wmax or s.params["Pref"] != box.Pmin for s in own):
            raise ValueError("references of the specs aren't those of the box")
        return costs.specs_frame(spark, own).select("spec", "family")

    @query(f"WITH {c.ROUTES_SQL} SELECT route, round(greatest(0, L - greatest(1500, 0.25 * L)), 6) AS Lmin, round(L + greatest(1500, 0.25 * L), 6) AS Lmax, round(greatest(0, H - 150), 6) AS Hmin, round(H + 150, 6) AS Hmax FROM routes WHERE L > 0")
    def witness_probe_box(spark, sf_dir):
        """Loose boxes around shortest routes, in which witnesses are looked for."""
        pad = F.greatest(F.lit(1500.0), 0.25 * F.col("L"))
        r = lambda x: F.round(x, 6)
        return c.routes(spark, sf_dir).where("L > 0").select("route", r(F.greatest(F.lit(0.0), F.col("L") - pad)).alias("Lmin"), r(F.col("L") + pad).alias("Lmax"), r(F.greatest(F.lit(0.0), F.col("H") - 150)).alias("Hmin"), r(F.col("H") + 150).alias("Hmax"))

    # ---- workloads and reports

    @query(f"WITH {SQL} SELECT s.node AS source, n.id AS target, (n.x_m - a.x_m) * (n.x_m - a.x_m) + (n.y_m - a.y_m) * (n.y_m - a.y_m) AS d2 FROM seeds s JOIN nodes a ON a.id = s.node, nodes n WHERE n.id <> s.node QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY d2 DESC, n.id) <= 3")
    def gen_far_pairs(spark, sf_dir):
        """The three nodes that lie furthest from each of a few."""
        n = lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
        return workloads.far_pairs(n, [r["node"] for r in lattice.seeds(spark, sf_dir).collect()])

    @query(f"{c.SSSP} SELECT node AS target, dist FROM ahead WHERE dist BETWEEN 1500 AND 4000")
    def gen_pair_select(spark, sf_dir):
        """Targets whose shortest route from the source has a length in range; unreached ones go."""
        lengths = c.g_sssp_fwd(spark, sf_dir).select(F.lit(box.source).cast("long").alias("source"), F.col("node").alias("target"), "dist")
        pairs = lattice.nodes(spark, sf_dir).select(F.lit(box.source).cast("long").alias("source"), F.col("id").alias("target"))
        return workloads.pairs_in_range(pairs, lengths, 1500.0, 4000.0).select("target", "dist")

    ITEMS = "items AS (SELECT o_custkey AS pair, o_orderkey AS item, o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 'loose' ELSE 'tight' END AS tightness, o_totalprice > 100000 AS deliberate FROM orders)"

    @query(f"WITH {ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY pair, category ORDER BY item) AS turn, tightness = 'loose' AND row_number() OVER (PARTITION BY pair, tightness ORDER BY item) = 1 AS loose FROM items) SELECT pair, item, CAST(row_number() OVER (PARTITION BY pair ORDER BY loose DESC, deliberate DESC, turn, category, item) AS INTEGER) AS place FROM a QUALIFY place <= 6")
    def gen_item_select(spark, sf_dir):
        o = c.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "P", "loose").otherwise("tight").alias("tightness"), (F.col("o_totalprice") > 100000).alias("deliberate"))
        return workloads.choose_items(o, 6)

    @query()
    def g_kmeanspp(spark, sf_dir):
        return seeded(spark, seeds.build(edges(spark, sf_dir), spots(spark, sf_dir), 7, refine=False))

    @query()
    def g_build_seeds(spark, sf_dir):
        return seeded(spark, seeds.build(edges(spark, sf_dir), spots(spark, sf_dir), 7))

    def seeded(spark, rows):
        return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("cell"), F.lit(n).cast("long").alias("node")) for k, n in rows])))

    @query(f"WITH {c.RUNS_SQL} SELECT method, count(*) AS seen, count(*) FILTER (solved) AS feasible, max(elapsed) AS most, min(elapsed) AS least, arg_min(item, {{'e': elapsed, 'i': item}}) AS best FROM runs GROUP BY 1")
    def agg_complete_tracker(spark, sf_dir):
        return c.run_rows(spark, sf_dir).groupBy("method").agg(F.count("*").alias("seen"), F.count_if("solved").alias("feasible"), F.max("elapsed").alias("most"), F.min("elapsed").alias("least"), F.min_by("item", F.struct("elapsed", "item")).alias("best"))

    @query(f"WITH {c.ROUTES_SQL} SELECT route % 30 AS spec, max({{'h': H, 'l': -L, 'r': -route}}).h AS hmax, -max({{'h': H, 'l': -L, 'r': -route}}).r AS route FROM routes WHERE L <= 12000 + 1e-6 GROUP BY 1")
    def agg_hmax(spark, sf_dir):
        """Of each spec the most climb of a route that is short enough."""
        best_ = F.max(F.struct(F.col("H").alias("h"), (-F.col("L")).alias("l"), (-F.col("route")).alias("r"))).alias("m")
        return c.routes(spark, sf_dir).where("L <= 12000 + 1e-6").groupBy((F.col("route") % 30).alias("spec")).agg(best_).select("spec", F.col("m.h").alias("hmax"), (-F.col("m.r")).alias("route"))

    @query(f"WITH {c.RUNS_SQL}, m AS (SELECT method, mode, sum(elapsed) AS s FROM runs GROUP BY 1, 2) SELECT a.method, round(a.s / b.s, 9) AS ratio FROM m a JOIN m b ON a.method = b.method WHERE a.mode = 'F' AND b.mode = 'O'")
    def agg_slowdown(spark, sf_dir):
        """How much more time a method takes in one mode than in another."""
        own = c.run_rows(spark, sf_dir).groupBy("method").agg(F.sum(F.when(F.col("mode") == "F", F.col("elapsed"))).alias("a"), F.sum(F.when(F.col("mode") == "O", F.col("elapsed"))).alias("b"))
        return own.where("a is not null and b is not null").select("method", F.round(F.col("a") / F.col("b"), 9).alias("ratio"))

    @query(f"WITH {c.RUNS_SQL} SELECT item, method, mode, elapsed FROM runs WHERE NOT solved AND elapsed > 200000")
    def agg_failures(spark, sf_dir):
        return c.run_rows(spark, sf_dir).where("not solved and elapsed > 200000").select("item", "method", "mode", "elapsed")

    @query(f"WITH {c.RUNS_SQL}, b AS (SELECT box, bool_or(solved AND method = '1-URGENT') AS first, bool_or(solved AND method = '2-HIGH') AS second, bool_or(solved) AS any_ FROM runs GROUP BY 1) SELECT count(*) AS boxes, count(*) FILTER (first) AS by_first, count(*) FILTER (NOT first AND second) AS by_second, count(*) FILTER (any_ AND NOT first AND NOT second) AS by_others, count(*) FILTER (NOT any_) AS unsolved FROM b")
    def final_report(spark, sf_dir):
        """Boxes by the first of two methods in turn that solves them."""
        solved = lambda m: F.bool_or(F.col("solved") & (F.col("method") == m))
        b = c.run_rows(spark, sf_dir).groupBy("box").agg(solved("1-URGENT").alias("f"), solved("2-HIGH").alias("s"), F.bool_or("solved").alias("a"))
        return b.agg(F.count("*").alias("boxes"), F.count_if("f").alias("by_first"), F.count_if(~F.col("f") & F.col("s")).alias("by_second"), F.count_if(F.col("a") & ~F.col("f") & ~F.col("s")).alias("by_others"), F.count_if(~F.col("a")).alias("unsolved"))

    @query(f"WITH {c.RUNS_SQL}, k AS (SELECT item, box, CASE WHEN solved THEN 'normal' WHEN elapsed < 150000 THEN 'repaired' ELSE 'unsolved' END AS outcome, elapsed FROM runs) SELECT outcome, count(*) AS items, round(sum(elapsed), 2) AS spent, count(DISTINCT box) AS boxes FROM k GROUP BY 1")
    def rep_repair(spark, sf_dir):
        """What became of items: solved at once, by repair, or not."""
        outcome = F.when(F.col("solved"), "normal").when(F.col("elapsed") < 150000, "repaired").otherwise("unsolved")
        return c.run_rows(spark, sf_dir).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items"), F.round(F.sum("elapsed"), 2).alias("spent"), F.count_distinct("box").alias("boxes"))

    @query(f"WITH {c.RUNS_SQL}, d AS (SELECT box, bool_or(solved AND mode = 'F') AS a, bool_or(solved AND mode = 'O') AS b FROM runs GROUP BY 1) SELECT box, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' WHEN b THEN 'second' ELSE 'none' END AS who FROM d")
    def aud_material_diff(spark, sf_dir):
        """Boxes that only one of two modes solves."""
        d = c.run_rows(spark, sf_dir).groupBy("box").agg(F.bool_or(F.col("solved") & (F.col("mode") == "F")).alias("a"), F.bool_or(F.col("solved") & (F.col("mode") == "O")).alias("b"))
        return d.select("box", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("b"), "second").otherwise("none").alias("who"))

    @query(f"WITH {c.RUNS_SQL} SELECT method, count(*) FILTER (solved AND mode = 'F') AS f, count(*) FILTER (solved AND mode = 'O') AS o, count(*) FILTER (solved AND mode = 'P') AS p FROM runs GROUP BY 1")
    def aud_comparison(spark, sf_dir):
        """A row for each variant, a column for each mode."""
        own = c.run_rows(spark, sf_dir).where("solved").groupBy("method").pivot("mode", ["F", "O", "P"]).count()
        methods = c.run_rows(spark, sf_dir).select("method").distinct()
        return methods.join(own, "method", "left").select("method", *[F.coalesce(m, F.lit(0)).alias(m.lower()) for m in ("F", "O", "P")])

    @query(f"WITH {c.ROUTES_SQL} SELECT a.route, b.W - a.W <= -0.25 OR b.P - a.P >= 5 AS better FROM routes a JOIN routes b ON b.route = a.route + 1 WHERE a.L > 0 AND b.L > 0")
    def aud_local2(spark, sf_dir):
        """Whether the next route is materially better: narrower by a quarter, or more popular by five."""
        r = c.routes(spark, sf_dir).where("L > 0").select("route", "P", "W")
        n = r.select((F.col("route") - 1).alias("route"), F.col("P").alias("_p"), F.col("W").alias("_w"))
        return r.join(n, "route").select("route", ((F.col("_w") - F.col("W") <= -0.25) | (F.col("_p") - F.col("P") >= 5)).alias("better"))

    @query()
    def ps_debug(spark, sf_dir):
        """The search's state by round and direction: new labels, portals and cells they are at, shortest and longest of them."""
        own = grown(spark, sf_dir).withColumn("cell", F.element_at("cells", -1))
        return own.groupBy(F.col("round").alias("round_"), "dir").agg(F.count("*").alias("n"), F.count_distinct("portal").alias("portals"), F.count_distinct("cell").alias("cells"), F.min("length").alias("shortest"), F.max("length").alias("longest"))

    @query()
    def cfg_sweep(spark, sf_dir):
        """Two boxes with the variants of one limit in one search of three rounds, and with combined ones if a variant was better."""
        wide = costs.Box("wide", box.target, box.source, box.Lmin, box.Lmax, box.Hmin, box.Hmax, 60.0, 20.0)
        return anytime.sweep(ground(spark, sf_dir), [box, wide], search.sweep(search.Config()), rounds=3)[1]
