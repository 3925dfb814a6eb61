"""Further route queries: lookups, coverage, workloads, sinks, repairs, bounded label setting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.operators import graph, labels, network
from waywright.sources import lattice
from waywright.sources.lattice import SQL


def without_nodes(edges: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Edges that touch no forbidden node (node)."""
    return edges.join(forbidden.select(F.col("node").alias("u")), "u", "left_anti").join(forbidden.select(F.col("node").alias("v")), "v", "left_anti").select(*edges.columns)


def anchors(nodes: DataFrame) -> DataFrame:
    """(anchor, node): the nodes that lie furthest in eight directions; of equals the least."""
    ways = {"east": F.col("x"), "west": -F.col("x"), "north": F.col("y"), "south": -F.col("y"), "ne": F.col("x") + F.col("y"), "sw": -F.col("x") - F.col("y"), "nw": F.col("y") - F.col("x"), "se": F.col("x") - F.col("y")}
    one = nodes.agg(*[F.max_by("id", F.struct(w, -F.col("id"))).alias(k) for k, w in ways.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("anchor"), F.col(k).alias("node")) for k in ways])))


def register(query, c) -> None:
    """c: the catalogue module, for its derived tables."""

    @query(f"WITH {SQL} SELECT e.u, e.v, count(*) AS n, min(edge_id) AS first FROM edges e GROUP BY 1, 2")
    def edge_lookup_pair(spark, sf_dir):
        return lattice.edges(spark, sf_dir).groupBy("u", "v").agg(F.count("*").alias("n"), F.min("edge_id").alias("first"))

    @query(f"WITH {SQL} SELECT l_orderkey AS item, l_linenumber AS line, u, v FROM lineitem JOIN edges ON edge_id = l_partkey")
    def edge_endpoint(spark, sf_dir):
        e = lattice.edges(spark, sf_dir).select("edge_id", "u", "v")
        return c.read(spark, sf_dir, "lineitem").join(e, F.col("l_partkey") == F.col("edge_id")).select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), "u", "v")

    @query(f"{c.VORONOI_SQL}, front AS (SELECT u AS node FROM crossing UNION SELECT v FROM crossing) SELECT node, edge_id, e.v AS to_, length, gain FROM front JOIN edges e ON e.u = node")
    def join_neighbors(spark, sf_dir):
        """A frontier, here the boundary nodes of cells, joined with its out-edges."""
        e = lattice.edges(spark, sf_dir)
        front = network.boundary_nodes(network.crossings(e, c.cells(spark, sf_dir)))
        return front.join(e, F.col("node") == F.col("u")).select("node", "edge_id", F.col("v").alias("to_"), "length", "gain")

    @query(f"{c._KEPT} SELECT e.v AS node, e.edge_id, e.u AS from_ FROM edges e WHERE e.u IN (SELECT node FROM kept) AND e.v IN (SELECT node FROM kept)")
    def join_reverse_adj(spark, sf_dir):
        """In-edges of kept nodes that come from kept nodes."""
        return network.within(lattice.edges(spark, sf_dir), c.flt_kept_nodes(spark, sf_dir)).select(F.col("v").alias("node"), "edge_id", F.col("u").alias("from_"))

    @query(f"WITH {SQL}, n AS (SELECT u, count(*) AS n FROM edges GROUP BY 1), o AS (SELECT u, CAST(sum(n) OVER (ORDER BY u) - n AS BIGINT) AS offset_ FROM n) SELECT edge_id, u, CAST(row_number() OVER (PARTITION BY u ORDER BY v, edge_id) - 1 AS INTEGER) AS position, offset_ FROM edges JOIN o USING (u)")
    def win_csr_id(spark, sf_dir):
        """Each edge's place among its source's, and where the source's edges begin: counts by source, summed up by blocks."""
        return network.csr(lattice.edges(spark, sf_dir))

    @query(f"{c.VORONOI_SQL} SELECT cell, list(node ORDER BY node) AS nodes FROM cells GROUP BY 1")
    def agg_nodes_by_cell(spark, sf_dir):
        return c.cells(spark, sf_dir).groupBy("cell").agg(F.sort_array(F.collect_list("node")).alias("nodes"))

    @query(f"{c.VORONOI_SQL} SELECT cell || ' : ' || string_agg(node + 1000 || '(' || node || ')', ' ' ORDER BY node) AS value FROM cells GROUP BY cell")
    def sink_cells(spark, sf_dir):
        own = c.cells(spark, sf_dir).groupBy("cell").agg(F.sort_array(F.collect_list("node")).alias("n"))
        return own.select(F.concat("cell", F.lit(" : "), F.array_join(F.transform("n", lambda x: F.concat(x + 1000, F.lit("("), x, F.lit(")"))), " ")).alias("value"))

    @query(f"{c.VORONOI_SQL} SELECT node + 1000 || ' ' || node || ' ' || cell || ' ' || hop AS value FROM cells")
    def sink_voronoi(spark, sf_dir):
        return c.cells(spark, sf_dir).select(F.concat_ws(" ", F.col("node") + 1000, "node", "cell", "hop").alias("value"))

    @query(f"WITH {SQL} SELECT CAST(s.node AS VARCHAR) || ' ' || coalesce(CASE WHEN node % 2 = 0 THEN node END, -1) AS value FROM seeds s")
    def sink_seeds(spark, sf_dir):
        known = lattice.nodes(spark, sf_dir).where("id % 2 = 0").select(F.col("id").alias("node"), F.col("id").alias("xy"))
        return lattice.seeds(spark, sf_dir).join(known, "node", "left").select(F.concat_ws(" ", "node", F.coalesce("xy", F.lit(-1))).alias("value"))

    @query(f"{c.VORONOI_SQL} SELECT u + 1000 || ' ' || (v + 1000) || ' ' || u || ' ' || v AS value FROM crossing")
    def sink_bedges(spark, sf_dir):
        return network.crossings(lattice.edges(spark, sf_dir), c.cells(spark, sf_dir)).select(F.concat_ws(" ", F.col("u") + 1000, F.col("v") + 1000, "u", "v").alias("value"))

    @query(f"WITH {SQL} SELECT 'e ' || u || ' ' || v || ' ' || CAST(length AS BIGINT) || ' ' || CAST(10 * gain AS BIGINT) || ' ' || CAST(popularity AS BIGINT) || ' ' || CAST(width AS BIGINT) || ' ' || road_id AS value FROM edges")
    def sink_xy(spark, sf_dir):
        from waywright.sources import text_files

        n = lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "elev")
        return text_files.xy_lines(n, lattice.edges(spark, sf_dir)).where(F.col("value").startswith("e ")).select("value")

    @query(f"WITH {c.RUNS_SQL} SELECT method, sum(CASE WHEN solved THEN 1 ELSE 0 END) AS solved, CAST(min(CASE WHEN solved THEN item END) AS BIGINT) AS first, round(sum(elapsed), 2) AS spent, count(DISTINCT box) AS boxes, arg_min(item, {{'e': elapsed, 'i': item}}) AS quickest FROM runs GROUP BY 1")
    def agg_records_summary(spark, sf_dir):
        return c.run_rows(spark, sf_dir).groupBy("method").agg(F.sum(F.col("solved").cast("int")).cast("decimal(38,0)").alias("solved"), F.min(F.when(F.col("solved"), F.col("item"))).alias("first"), F.round(F.sum("elapsed"), 2).alias("spent"), F.count_distinct("box").alias("boxes"), F.min_by("item", F.struct("elapsed", "item")).alias("quickest"))

    @query(f"WITH {c.RUNS_SQL} SELECT DISTINCT box FROM runs a WHERE solved AND method = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM runs b WHERE b.box = a.box AND b.solved AND b.method = '2-HIGH' AND b.elapsed < 3000)")
    def aud_new_solved(spark, sf_dir):
        own = c.run_rows(spark, sf_dir).where("solved")
        return own.where("method = '1-URGENT'").join(own.where("method = '2-HIGH' AND elapsed < 3000").select("box"), "box", "left_anti").select("box").distinct()

    @query(f"WITH {c.RUNS_SQL} SELECT box, round(quantile_cont(elapsed, 0.5), 4) AS median, min(elapsed) AS least, max(elapsed) AS most, count(*) FILTER (mode = 'F') AS f, count(*) FILTER (mode = 'O') AS o FROM runs GROUP BY 1")
    def agg_delta_stats(spark, sf_dir):
        return c.run_rows(spark, sf_dir).groupBy("box").agg(F.round(F.percentile("elapsed", 0.5), 4).alias("median"), F.min("elapsed").alias("least"), F.max("elapsed").alias("most"), F.count_if(F.col("mode") == "F").alias("f"), F.count_if(F.col("mode") == "O").alias("o"))

    @query(f"WITH {c.RUNS_SQL}, k AS (SELECT method, count(*) AS n FROM runs GROUP BY 1) SELECT method, n FROM k ORDER BY n DESC, method LIMIT 3")
    def top_count_items(spark, sf_dir):
        return c.run_rows(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "method").limit(3)

    @query(f"WITH {c.ROUTES_SQL} SELECT route, L, H FROM routes WHERE L <= 12000 + 1e-6 ORDER BY H DESC, L, route LIMIT 1")
    def empirical_Hmax(spark, sf_dir):
        """The route of the most climb among those that are short enough."""
        return c.routes(spark, sf_dir).where("L <= 12000 + 1e-6").select("route", "L", "H").orderBy(F.desc("H"), "L", "route").limit(1)

    @query(f"WITH {c.ROUTES_SQL}, v AS (SELECT *, {c._VIOL} FROM routes) SELECT route, L, H, round(list_max({c._SCALED}), 9) AS violation FROM v ORDER BY violation, L, route LIMIT 1")
    def top_nearest_profile(spark, sf_dir):
        """The route that breaks the box least."""
        return c.routes(spark, sf_dir).select("route", "L", "H", F.round(costs.violation_score(c.ROUTE_BOX), 9).alias("violation")).orderBy("violation", "L", "route").limit(1)

    @query(f"WITH {c.ROUTES_SQL}, s AS (SELECT L AS l0, H AS h0, P AS p0, W AS w0 FROM routes ORDER BY route LIMIT 1) SELECT route, round(greatest(abs(L - l0) / greatest(abs(l0), 1), abs(H - h0) / greatest(abs(h0), 1), abs(P - p0) / greatest(abs(p0), 1), abs(W - w0) / greatest(abs(w0), 1)), 6) AS diff FROM routes, s")
    def fn_route_diff(spark, sf_dir):
        own = c.routes(spark, sf_dir)
        first = own.orderBy("route").limit(1).select(*[F.col(x).alias(f"{x}0") for x in "LHPW"])
        parts = [F.abs(F.col(x) - F.col(f"{x}0")) / F.greatest(F.abs(F.col(f"{x}0")), F.lit(1.0)) for x in "LHPW"]
        return own.crossJoin(F.broadcast(first)).select("route", F.round(F.greatest(*parts), 6).alias("diff"))  # one row

    @query(f"WITH {c.ROUTES_SQL} SELECT route, L, H FROM routes WHERE NOT (L > {c.ROUTE_BOX.Lmax} OR H > {c.ROUTE_BOX.Hmax})")
    def flt_upper_bound(spark, sf_dir):
        """Partial routes that may still fit: sums over their upper bounds can't fall again; means can, so they don't count."""
        return c.routes(spark, sf_dir).where(~costs.hopeless(c.ROUTE_BOX)).select("route", "L", "H")

    ways = {"east": "x_m", "west": "-x_m", "north": "y_m", "south": "-y_m", "ne": "x_m + y_m", "sw": "-x_m - y_m", "nw": "y_m - x_m", "se": "x_m - y_m"}
    picks = ", ".join(f"arg_max(id, {{'w': {w}, 'i': -id}}) AS {k}" for k, w in ways.items())

    @query(f"WITH {SQL}, a AS (SELECT {picks} FROM nodes), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS anchor, {k} AS node FROM a" for k in ways) + ") SELECT a.anchor AS from_, b.anchor AS to_, a.node AS source, b.node AS target FROM l a, l b WHERE a.node <> b.node")
    def gen_anchor_pairs(spark, sf_dir):
        a = anchors(lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y")))
        b = a.select(F.col("anchor").alias("to_"), F.col("node").alias("target"))
        return a.crossJoin(F.broadcast(b)).where("node <> target").select(F.col("anchor").alias("from_"), "to_", F.col("node").alias("source"), "target")  # eight rows

    barred = [1, 17, 30, 60]

    @query(f"WITH RECURSIVE {SQL}, links AS MATERIALIZED (SELECT u, v, length FROM edges WHERE u NOT IN (1, 17, 30, 60) AND v NOT IN (1, 17, 30, 60)), {c.sssp_sql('ahead', '0')} SELECT node, dist FROM ahead")
    def g_forbidden_path(spark, sf_dir):
        bad = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in barred])).alias("node"))
        return graph.distances(without_nodes(lattice.edges(spark, sf_dir), bad), spark.range(1).select(F.lit(0).cast("long").alias("node")))

    @query()
    def g_label_setting(spark, sf_dir):
        """A feasible route of the box by bounded label setting, on the edges of its certified corridor."""
        e = network.certified(lattice.edges(spark, sf_dir), c.near(spark, sf_dir, c.BOX.source), c.near(spark, sf_dir, c.BOX.target, reverse=True), c.BOX.Lmax)
        return labels.search(graph.stored(e), c.BOX)

    @query(f"{c.SSSP} SELECT l_orderkey AS label, l_linenumber AS line, l_partkey AS node, l_quantity * 100 + b.dist AS least FROM lineitem JOIN back b ON b.node = l_partkey WHERE l_quantity * 100 + b.dist <= 6000 + 1e-6")
    def flt_completion_lb(spark, sf_dir):
        """Labels, here an order's lines at the node of their part, that can reach the target in time; of nodes without a way
        to it none can."""
        labels = c.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("label"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("node"), (F.col("l_quantity") * 100).alias("length"))
        return network.completable(labels, c.near(spark, sf_dir, c.BOX.target, reverse=True), c.BOX.Lmax).select("label", "line", "node", "least")

    @query(f"WITH {SQL} SELECT a.edge_id AS first, b.edge_id AS second, CAST(CASE WHEN a.road_id <> b.road_id THEN 1 ELSE 0 END AS INTEGER) AS seam FROM edges a JOIN edges b ON a.v = b.u WHERE a.u <> b.v")
    def fn_join_road_changes(spark, sf_dir):
        e = lattice.edges(spark, sf_dir)
        a = e.select(F.col("edge_id").alias("first"), F.col("u").alias("from_"), F.col("v").alias("mid"), F.col("road_id").alias("road"))
        b = e.select(F.col("edge_id").alias("second"), F.col("u").alias("mid"), F.col("v").alias("to_"), F.col("road_id").alias("next"))
        return a.join(b, "mid").where("from_ <> to_").select("first", "second", (F.col("road") != F.col("next")).cast("int").alias("seam"))

    @query(f"{c.VORONOI_SQL}, p AS (SELECT DISTINCT from_cell, to_cell FROM crossing), two AS (SELECT a.from_cell AS cell, b.to_cell AS far FROM p a JOIN p b ON a.to_cell = b.from_cell WHERE a.from_cell <> b.to_cell) SELECT cell, count(DISTINCT far) AS escapes FROM two GROUP BY 1")
    def rep_structural_escape(spark, sf_dir):
        """Cells within two overlay hops of each cell."""
        p = network.crossings(lattice.edges(spark, sf_dir), c.cells(spark, sf_dir)).select("from_cell", "to_cell").distinct()
        p = graph.stored(p)
        q = p.select(F.col("from_cell").alias("to_cell"), F.col("to_cell").alias("far"))
        return p.join(q, "to_cell").where("from_cell <> far").groupBy(F.col("from_cell").alias("cell")).agg(F.count_distinct("far").alias("escapes"))
