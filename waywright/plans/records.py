"""Queries of validation, repair, witnesses, holdouts and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waywright.functions import costs
from waywright.operators import graph, search, seeds, via, workloads
from waywright.plans import extra
from waywright.sources import lattice
from waywright.storage import stored


def register(query, c) -> None:
    box, edges = c.BOX, lattice.edges
    names = {s.name: s for s in c.SPECS}

    def trees(spark, sf_dir):
        return lattice.kept(spark, sf_dir, "forest", lambda s, d: c.forest(s, d, c.FEW))

    def profiles(spark, sf_dir, longest: float = box.Lmax + 1e-6):
        """Profiles of at most longest; longer ones may lack."""
        shaped = via.join_via(c.near_forest(spark, sf_dir, longest), box).select("query", "spec", "via", "cost", *search.SUMS, "road_changes", *costs.route_vector())
        return shaped.withColumn("center", costs.box_center(box)).withColumn("violation", costs.violation_score(box)).withColumn("feasible", costs.feasible_mul(box))

    def exact(spark, sf_dir):
        def make(s, d):
            return via.validated(via.reconstruct(c.near_forest(s, d), profiles(s, d).where("feasible")), edges(s, d), ["query", "spec", "via"])

        return lattice.kept(spark, sf_dir, "exact", make)

    # ---- sums, keys and orders

    @query(f"WITH {c.ROUTES_SQL} SELECT a.route, a.length + b.length AS length, CAST(a.gain + b.gain AS DOUBLE) AS gain, a.pop_len + b.pop_len AS pop_len, a.wid_len + b.wid_len AS wid_len FROM routes a JOIN routes b ON b.route = a.route + 1")
    def fn_plus(spark, sf_dir):
        """Sums of a route and the next."""
        own = c.routes(spark, sf_dir).select("route", *search.SUMS)
        n = own.select((F.col("route") - 1).alias("route"), *[F.col(x).alias(f"_{x}") for x in search.SUMS])
        return own.join(n, "route").select("route", *[(F.col(x) + F.col(f"_{x}")).alias(x) for x in search.SUMS])

    @query(f"WITH {c.WALKS_SQL} SELECT walk FROM walks WHERE len(path) = len(list_distinct(path))")
    def flt_elementary(spark, sf_dir):
        return c.walks(spark, sf_dir).where(F.size("path") == F.size(F.array_distinct("path"))).select("walk")

    @query()
    def flt_validated(spark, sf_dir):
        """Feasible via routes whose edges follow each other and sum up to what their profile says."""
        close = lambda x: F.abs(F.col(x) - F.col(f"x_{x}")) <= 1e-6
        return exact(spark, sf_dir).where(F.col("connected") & close("length") & close("gain") & close("pop_len") & close("wid_len")).select("spec", "via", "length")

    @query(f"{c.SSSP}, p AS (SELECT a.node AS via, a.dist + b.dist AS length FROM ahead a JOIN back b ON a.node = b.node WHERE a.dist + b.dist > 0) SELECT via, length FROM p ORDER BY abs(length - 3250), length, via LIMIT 1")
    def top_best_near(spark, sf_dir):
        """Of the profiles of the shortest trees the one that lies nearest to the middle of the box's lengths."""
        return c.join_via(spark, sf_dir).orderBy(F.abs(F.col("length") - 3250), "length", "via").limit(1)

    @query(f"WITH {extra.BEST_SQL}, k AS (SELECT l.label, o.edge, o.length, o.gain, NOT coalesce(l.road = CASE WHEN dir = 'fwd' THEN first_road ELSE last_road END, false) AS turns, changes + CASE WHEN l.road <> CASE WHEN dir = 'fwd' THEN first_road ELSE last_road END THEN 1 ELSE 0 END AS more, changes, src, dst FROM best l JOIN overlay o ON l.portal = CASE WHEN dir = 'fwd' THEN o.src ELSE o.dst END) SELECT label, edge, CAST(row_number() OVER (PARTITION BY label ORDER BY length, gain, turns, more, changes, src, dst, edge) AS INTEGER) AS place FROM k")
    def top_local_order(spark, sf_dir):
        """The order in which a label's extensions are tried."""
        b, o = extra.best(spark, sf_dir).select("dir", "portal", "label", "road"), extra.overlay(spark, sf_dir)
        both = b.join(o, F.col("portal") == F.when(F.col("dir") == "fwd", F.col("src")).otherwise(F.col("dst")))
        key = search.continuity(F.col("road"), F.col("first_road"), F.col("last_road"), F.col("changes"), F.col("dir") == "fwd")
        own = Window.partitionBy("label").orderBy("length", "gain", "k.turns", "k.changes", "changes", "src", "dst", "edge")
        return both.withColumn("k", key).select("label", "edge", F.row_number().over(own).alias("place"))

    @query(f"WITH {extra.OVER_SQL}, k AS (SELECT *, src % 20 AS a, dst % 20 AS b FROM overlay) SELECT a, b, edge, CAST(row_number() OVER (PARTITION BY a, b ORDER BY length, gain, changes, src, dst, edge) AS INTEGER) AS place FROM k QUALIFY place <= 2")
    def top_bridge_order(spark, sf_dir):
        """The two best bridges of each pair of cells."""
        own = Window.partitionBy("a", "b").orderBy("length", "gain", "changes", "src", "dst", "edge")
        return extra.overlay(spark, sf_dir).withColumn("a", F.col("src") % 20).withColumn("b", F.col("dst") % 20).withColumn("place", F.row_number().over(own)).where("place <= 2").select("a", "b", "edge", "place")

    @query(f"WITH {extra.LABELS_SQL} SELECT dir, label, CAST(row_number() OVER (PARTITION BY dir ORDER BY priority, road_changes, label) AS INTEGER) AS place FROM labels QUALIFY place <= 64")
    def ps_enqueue(spark, sf_dir):
        """The next batch of both queues: by priority, road changes and age."""
        ranked = [extra.labels(spark, sf_dir).where(F.col("dir") == d).orderBy("priority", "road_changes", "label").limit(64) for d in ("fwd", "bwd")]
        own = Window.partitionBy("dir").orderBy("priority", "road_changes", "label")
        return ranked[0].union(ranked[1]).select("dir", "label", F.row_number().over(own).alias("place"))

    @query(f"{c.SSSP}, t AS (SELECT e.v AS node, e.edge_id, e.gain FROM edges e JOIN ahead a ON a.node = e.u JOIN ahead b ON b.node = e.v WHERE abs(a.dist + e.length - b.dist) <= 1e-9), k AS (SELECT node, count(*) AS n, count(DISTINCT gain) AS kinds FROM t GROUP BY 1) SELECT n AS parents, count(*) AS nodes, count(*) FILTER (kinds > 1) AS distinct_resources FROM k GROUP BY 1")
    def agg_tie_summary(spark, sf_dir):
        """Nodes by the number of their tight in-edges, and how often these differ in climb."""
        d = stored(c.g_sssp_fwd(spark, sf_dir))
        own = edges(spark, sf_dir).join(d.select(F.col("node").alias("u"), F.col("dist").alias("a")), "u").join(d.select(F.col("node").alias("v"), F.col("dist").alias("b")), "v").where(F.abs(F.col("a") + F.col("length") - F.col("b")) <= 1e-9)
        k = own.groupBy("v").agg(F.count("*").alias("parents"), F.count_distinct("gain").alias("kinds"))
        return k.groupBy("parents").agg(F.count("*").alias("nodes"), F.count_if(F.col("kinds") > 1).alias("distinct_resources"))

    @query(f"WITH {c.POINTS_SQL} SELECT p.id, round({c._HAV}, 3) AS m FROM points p, points t WHERE t.id = 17")
    def fn_haversine_m(spark, sf_dir):
        return c.fn_haversine(spark, sf_dir).select("id", "m")

    @query(f"WITH {c.POINTS_SQL} SELECT p.id, CAST(floor(10 * {c._HAV} + 1e-7) AS BIGINT) AS dm FROM points p, points t WHERE t.id = 17")
    def fn_haversine_dm(spark, sf_dir):
        return c.fn_haversine(spark, sf_dir).select("id", "dm")

    @query(f"WITH {c.POINTS_SQL}, pairs AS (SELECT u AS a, v AS b FROM edges) SELECT a, b, CAST(floor(10 * ({c._HAV}) + 1e-7) AS BIGINT) AS dm FROM pairs JOIN points p ON p.id = a JOIN points t ON t.id = b")
    def fn_h_target(spark, sf_dir):
        """Distances of pairs of nodes in whole decimetres: a lower bound of what is left."""
        from waywright.functions import geo

        p = c.points(spark, sf_dir).select("id", "x_udeg", "y_udeg")
        pairs = edges(spark, sf_dir).select(F.col("u").alias("a"), F.col("v").alias("b"))
        both = pairs.join(p.toDF("a", "ax", "ay"), "a").join(p.toDF("b", "bx", "by"), "b")
        return both.select("a", "b", F.floor(10 * geo.haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) + 1e-7).alias("dm"))

    @query(f"WITH {c.POINTS_SQL} SELECT p.id, CAST(floor(sqrt(CAST((p.x_m - t.x_m) * (p.x_m - t.x_m) + (p.y_m - t.y_m) * (p.y_m - t.y_m) AS DOUBLE))) AS BIGINT) AS whole FROM points p, points t WHERE t.id = 17")
    def fn_euclid_int(spark, sf_dir):
        return c.fn_euclid(spark, sf_dir).select("id", "whole")

    @query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_name ELSE '' END AS tag FROM part")
    def fn_norm_tag(spark, sf_dir):
        """The first of a list of tags, trimmed; empty for none."""
        from waywright.functions import paths

        tag = F.when(F.col("p_size") % 4 == 0, F.array(F.concat(F.lit(" "), "p_brand"), F.lit("x"))).when(F.col("p_size") % 4 == 1, F.array(F.concat("p_name", F.lit(" "))))
        return c.read(spark, sf_dir, "part").select("p_partkey", paths.norm_tag(tag).alias("tag"))

    @query(f"WITH {c.ROUTES_SQL}, v AS (SELECT route, {c._VIOL} FROM routes), s AS (SELECT route, {c._SCALED} AS a FROM v) SELECT route, CASE WHEN list_max(a) > 0 THEN {list(costs.KINDS)}[list_position(a, list_max(a))] END AS dominant FROM s")
    def fn_dominant_violation(spark, sf_dir):
        return c.routes(spark, sf_dir).select("route", costs.dominant_violation(c.ROUTE_BOX).alias("dominant"))

    @query("WITH s AS (SELECT l_orderkey AS route, l_quantity * 100 AS length, l_suppkey % 4 AS road, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey FROM lineitem), f AS (SELECT *, CASE WHEN lag(road) OVER (PARTITION BY route ORDER BY pos) <> road THEN 1 ELSE 0 END AS turn FROM s) SELECT route, sum(length) AS length, sum(length * (l_partkey % 256)) AS pop_len, CAST(sum(turn) AS BIGINT) AS changes, count(*) AS edges FROM f GROUP BY 1")
    def agg_path_metrics(spark, sf_dir):
        """Sums over a route's edges in order, and its changes of road."""
        li = c.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_quantity") * 100).alias("length"), (F.col("l_suppkey") % 4).alias("road"), "l_linenumber", "l_partkey", "l_suppkey")
        own = Window.partitionBy("route").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        turned = li.withColumn("turn", F.coalesce((F.lag("road").over(own) != F.col("road")).cast("int"), F.lit(0)))
        return turned.groupBy("route").agg(F.sum("length").alias("length"), F.sum(F.col("length") * (F.col("l_partkey") % 256)).alias("pop_len"), F.sum("turn").alias("changes"), F.count("*").alias("edges"))

    @query(c.ORACLE_SQL["fn_loop_erase"])
    def g_loop_erase(spark, sf_dir):
        return c.fn_loop_erase(spark, sf_dir)

    @query("SELECT dir, node, CAST(dist AS DOUBLE) AS dist FROM (VALUES ('fwd', 0, 0), ('fwd', 1, 1), ('fwd', 2, 3), ('bwd', 2, 0), ('bwd', 1, 2), ('bwd', 0, 3)) t(dir, node, dist)")
    def val_tiny_direction(spark, sf_dir):
        """Three nodes in a ring: distances ahead from the first, and to the last."""
        rows = F.array(*[F.struct(F.lit(k).cast("long").alias("edge_id"), F.lit(u).alias("u"), F.lit(v).alias("v"), F.lit(float(l)).alias("length")) for k, (u, v, l) in enumerate([(0, 1, 1), (1, 2, 2), (2, 0, 10)])])
        e = stored(spark.range(1).select(F.inline(rows)))
        at = lambda x: spark.range(1).select(F.lit(x).cast("long").alias("node"))
        return graph.distances(e, at(0)).select(F.lit("fwd").alias("dir"), F.col("node").cast("int").alias("node"), "dist").union(graph.distances(e, at(2), reverse=True).select(F.lit("bwd"), F.col("node").cast("int"), "dist"))

    KNOWN = "[x FOR x IN {} IF x IS NOT NULL]"
    CHANGES = "CAST(coalesce(list_sum([CASE WHEN {0}[i] <> {0}[i + 1] THEN 1 ELSE 0 END FOR i IN range(1, len({0}))]), 0) AS INTEGER)"

    @query(f"WITH {c.WALKS_SQL}, k AS (SELECT a.walk, {KNOWN.format('a.roads')} AS r, {KNOWN.format('list_concat(a.roads, b.roads)')} AS j FROM walks a JOIN walks b ON b.walk = a.walk + 1) SELECT walk, r[1] AS first, r[len(r)] AS last, {CHANGES.format('r')} AS appended, {CHANGES.format('r')} AS prepended, {CHANGES.format('j')} AS joined FROM k")
    def fn_road_fold(spark, sf_dir):
        """First and last road and changes of walks, folded from the front, from the back, and joined with the next walk's."""
        from waywright.functions import paths

        own = c.walks(spark, sf_dir).select("walk", paths.roads_of(F.col("roads")).alias("a"), F.aggregate(F.reverse("roads"), F.struct(F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("changes")), paths.prepend_road).alias("p"))
        n = own.select((F.col("walk") - 1).alias("walk"), F.col("a").alias("b"))
        return own.join(n, "walk").select("walk", "a.first", "a.last", F.col("a.changes").alias("appended"), F.col("p.changes").alias("prepended"), paths.join_roads(F.col("a"), F.col("b"))["changes"].alias("joined"))

    @query(f"WITH {c.ROUTES_SQL}, v AS (SELECT {c._VIOL} FROM routes) SELECT count(*) AS routes, count(*) FILTER (v1 > 0) AS L_low, count(*) FILTER (v2 > 0) AS L_high, count(*) FILTER (v3 > 0) AS H_low, count(*) FILTER (v4 > 0) AS H_high, count(*) FILTER (v5 > 0) AS P_low, count(*) FILTER (v6 > 0) AS W_high FROM v")
    def flt_box_counters(spark, sf_dir):
        """How many routes break each bound of the box."""
        own = dict(zip(costs.KINDS, costs.violations(c.ROUTE_BOX), strict=True))
        return c.routes(spark, sf_dir).agg(F.count("*").alias("routes"), *[F.count_if(v > 0).alias(k) for k, v in own.items()])

    RATE = "count(*) FILTER (solved) AS solved, count(*) AS attempted, round(100.0 * count(*) FILTER (solved) / count(*), 6) AS percent FROM runs GROUP BY ALL"

    @query(f"WITH {c.RUNS_SQL} SELECT 'mode' AS kind, mode AS key, {RATE} UNION ALL SELECT 'method', method, {RATE} UNION ALL SELECT 'box', CAST(box AS VARCHAR), {RATE} UNION ALL SELECT 'all', 'all', {RATE}")
    def agg_success_rates(spark, sf_dir):
        """Success by mode, by method, by box and over all: each run is read once."""
        keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("mode", F.col("mode")), ("method", F.col("method")), ("box", F.col("box").cast("string")), ("all", F.lit("all")))])
        return c.reports.success(c.run_rows(spark, sf_dir).select("solved", F.inline(keys)), "kind", "key")

    @query(f"WITH {c.RUNS_SQL}, f AS (SELECT method, min(item) FILTER (solved) AS first FROM runs GROUP BY 1) SELECT r.method, f.first, count(*) AS attempts, round(sum(elapsed), 2) AS spent FROM runs r JOIN f ON f.method = r.method WHERE r.item <= f.first GROUP BY 1, 2")
    def agg_records_to_first(spark, sf_dir):
        """Attempts and time of each method up to its first success."""
        own = c.reports.first_solved(c.run_rows(spark, sf_dir), "method")
        return own.select("method", F.col("item").alias("first"), F.col("tries").cast("long").alias("attempts"), "spent")

    @query(f"WITH {c.WALKS_SQL}, s AS (SELECT walk, path, unnest(range(1, len(path))) AS i FROM walks), e AS (SELECT walk, least(path[i], path[i + 1]) AS a, greatest(path[i], path[i + 1]) AS b, CASE WHEN path[i] = path[i + 2] THEN 1 ELSE 0 END AS back FROM s), n AS (SELECT walk, a, b, count(*) AS n, sum(back) AS back FROM e GROUP BY ALL) SELECT walk, CAST(sum(n - 1) AS BIGINT) AS repeated, CAST(sum(back) AS BIGINT) AS backtracks FROM n GROUP BY 1")
    def aud_backtracks(spark, sf_dir):
        """Edges of walks used again in either direction, and steps that are undone at once."""
        step = lambda i: F.struct(F.least(F.get("path", i), F.get("path", i + 1)).alias("a"), F.greatest(F.get("path", i), F.get("path", i + 1)).alias("b"), F.coalesce((F.get("path", i) == F.get("path", i + 2)).cast("int"), F.lit(0)).alias("back"))
        own = c.walks(spark, sf_dir).where(F.size("path") > 1).select("walk", F.inline(F.transform(F.sequence(F.lit(0), F.size("path") - 2), step)))
        return own.groupBy("walk", "a", "b").agg(F.count("*").alias("n"), F.sum("back").alias("back")).groupBy("walk").agg(F.sum(F.col("n") - 1).alias("repeated"), F.sum("back").alias("backtracks"))

    # ---- seeds

    def spots(spark, sf_dir):
        return lattice.nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))

    def candidates(spark, sf_dir):
        """The seventy nodes of the highest hub score."""
        from waywright.operators import network

        return stored(network.hub_candidates(edges(spark, sf_dir), 7).join(spots(spark, sf_dir), "node").select("node", "x", "y", "score"))

    @query()
    def g_bfs_blobs(spark, sf_dir):
        """Cells of radius 3: first those of the seeds, then of the nodes left over."""
        nodes = lattice.nodes(spark, sf_dir).select(F.col("id").alias("node"))
        return seeds.blobs(edges(spark, sf_dir), nodes, 4, lattice.seeds(spark, sf_dir).select("node"))

    @query()
    def agg_seeds_minibatch(spark, sf_dir):
        """Centers of seven seeds, moved by batches of all nodes."""
        own = candidates(spark, sf_dir)
        start = [(float(r["x"]), float(r["y"])) for r in seeds.spread_sample(own, 7)]
        moved = seeds.refined(start, spots(spark, sf_dir), 2, 5, 200)
        return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(moved)], "cell long, x double, y double")

    @query()
    def g_dedup_fill(spark, sf_dir):
        """Repeated seeds without repeats, filled up to seven."""
        own = candidates(spark, sf_dir)
        two = [r["node"] for r in own.orderBy("node").limit(2).collect()]
        return spark.createDataFrame(list(enumerate(seeds.deduplicated([two[0], two[0], two[1], two[0]], own, 7))), "cell long, node long")

    # ---- validation and repair

    @query()
    def val_path(spark, sf_dir):
        """Each feasible via route: whether its edges are real and follow each other, and how far its sums are off."""
        return exact(spark, sf_dir).select("spec", "via", "connected", "elementary", *[F.round(F.col(f"x_{x}") - F.col(x), 9).alias(f"d_{x}") for x in search.SUMS])

    @query()
    def val_profile_delta(spark, sf_dir):
        """The largest differences between routes and their profiles, by spec."""
        return exact(spark, sf_dir).groupBy("spec").agg(F.count("*").alias("routes"), *[F.round(F.max(F.abs(F.col(f"x_{x}") - F.col(x))), 9).alias(f"d_{x}") for x in search.SUMS])

    @query(f"{c.SSSP} SELECT node, dist AS length FROM back WHERE node <> {box.target}")
    def val_bwd_samples(spark, sf_dir):
        """All backward branches rebuilt from their tree: the length of their edges, which must be the distance to the target."""
        own = lattice.kept(spark, sf_dir, "back", lambda s, d: via.forest(edges(s, d), [names["shortest_length"]], box, ("bwd",)))
        step = own.where("parent_edge is not null").select("node", F.col("parent_node").alias("up"), F.col("parent_edge").alias("edge_id"))
        priced = step.join(edges(spark, sf_dir).select("edge_id", F.col("length").alias("value")), "edge_id")
        return graph.branch_sums(priced).where(F.col("root") == box.target).select("node", F.col("value").alias("length"))

    def mended(spark, sf_dir):
        own = exact(spark, sf_dir).where("connected and not elementary")
        made = via.repaired(own, edges(spark, sf_dir), c.FEW)
        return via.validated(made, edges(spark, sf_dir), ["query", "spec", "via", "side"])

    @query()
    def g_repair(spark, sf_dir):
        """Routes that met themselves, one half led anew: whether they are elementary now."""
        return mended(spark, sf_dir).select("spec", "via", "side", "connected", "elementary", "x_length", F.size("edges").alias("n_edges"))

    @query()
    def repair_candidate(spark, sf_dir):
        """Repaired routes that are elementary and within the box, both sides kept."""
        own = mended(spark, sf_dir).where("connected and elementary").select("spec", "via", "side", *[F.col(f"x_{x}").alias(x) for x in search.SUMS])
        return own.where(costs.feasible_mul(box)).select("spec", "via", "side", "length", "gain")

    # ---- records

    @query()
    def rec_search(spark, sf_dir):
        """The portfolio on a box that none of it meets, and the specs that are made from what is broken most."""
        hard = costs.Box("hard", box.source, box.target, 2500.0, 3400.0, 0.0, 60.0, 170.0, 11.0)
        own = via.adaptive(edges(spark, sf_dir), costs.portfolio(hard), hard, 4)
        return own.select("spec", "L", "H", F.round("P", 6).alias("P"), F.round("W", 6).alias("W"), "road_changes", "feasible", F.round("violation", 6).alias("violation"), "dominant")

    @query()
    def via_reconstruct(spark, sf_dir):
        """Feasible profiles rebuilt, each with the reason for which it fails, if it does."""
        why = F.when(~F.col("connected"), "VALIDATION").when(~F.col("elementary"), "NON_ELEMENTARY").when(F.abs(F.col("length") - F.col("x_length")) > 1e-6, "SUMS")
        return exact(spark, sf_dir).select("spec", "via", F.size("edges").alias("n_edges"), why.alias("failure"))

    @query()
    def via_exhaustive(spark, sf_dir):
        """All feasible profiles of every spec: how many are exact routes, why the others aren't, and the nearest exact one."""
        own = exact(spark, sf_dir)
        sound = F.col("connected") & F.col("elementary")
        return own.groupBy("spec").agg(F.count("*").alias("tried"), F.count_if(sound).alias("exact"), F.count_if(F.col("connected") & ~F.col("elementary")).alias("non_elementary"), F.count_if(~F.col("connected")).alias("rejected"), F.min(F.when(sound, F.struct("center", "length", "via"))).alias("m")).select("spec", "tried", "exact", "non_elementary", "rejected", F.col("m.via").alias("best"))

    @query()
    def via_hmax_recon(spark, sf_dir):
        """Of each spec the profile of the most climb that is short enough, rebuilt even if it isn't feasible."""
        high = profiles(spark, sf_dir).where(F.col("length") <= box.Lmax + 1e-6)
        own = Window.partitionBy("spec").orderBy(F.desc("gain"), "length", "via")
        top = high.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r")
        found = via.validated(via.reconstruct(c.near_forest(spark, sf_dir), top), edges(spark, sf_dir), ["query", "spec", "via"])
        return found.select("spec", "via", "length", "gain", "x_gain", "connected", "elementary", "feasible")

    @query()
    def witness_make(spark, sf_dir):
        """Exact elementary routes as witnesses, each edge sequence once, the first spec by name holding it."""
        own = exact(spark, sf_dir).where("connected and elementary")
        return own.groupBy("edges").agg(F.min(F.struct("spec", "via", "length", "gain")).alias("m")).select(F.xxhash64("edges").alias("witness"), "m.spec", "m.via", "m.length", "m.gain")

    furthest = workloads.longest(2 * box.Lmax)  # no box of a witness goes further

    def pool(spark, sf_dir):
        """Profiles of a loose box by six orders, each up to its number, first come first kept."""
        near = profiles(spark, sf_dir, furthest).where((F.col("length") <= 2 * box.Lmax) & (F.col("length") >= 1000))
        orders = [("length", ["length"], 8), ("climb", [F.desc("gain"), "length"], 12), ("width", ["W", "length"], 12), ("popularity", [F.desc("P"), "length"], 12), ("center", ["center", "length"], 12), ("low", ["gain", "length"], 8)]
        each = None
        for k, (name, order, most) in enumerate(orders):
            ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy("spec").orderBy(*order, "via"))).where(F.col("_r") <= most).select("spec", "via", "L", "H", "P", "W", F.lit(k).alias("_k"), F.lit(name).alias("order"))
            each = ranked if each is None else each.union(ranked)
        return each.groupBy("spec", "via").agg(F.min(F.struct("_k", "order", "L", "H", "P", "W")).alias("m")).select("spec", "via", "m.order", "m.L", "m.H", F.round("m.P", 6).alias("P"), F.round("m.W", 6).alias("W"))

    @query()
    def gen_witness_pool(spark, sf_dir):
        return pool(spark, sf_dir)

    @query()
    def witness_collect_holdout(spark, sf_dir):
        """Witnesses of specs that weren't evaluated, without those that are the shortest route."""
        t = lattice.kept(spark, sf_dir, "holdout", lambda s, d: via.forest(edges(s, d), [names["hinge_pop_strong"], names["low_elevation_strong"]], box, ("fwd",)))
        ends = t.where(F.col("node") == box.target).select("spec", F.col("len").alias("length"), "gain")
        least = trees(spark, sf_dir).where(f"dir = 'fwd' and spec = 'shortest_length' and node = {box.target}").select(F.col("len").alias("_l"), F.col("gain").alias("_g"))
        return ends.crossJoin(F.broadcast(least)).select("spec", "length", "gain", ((F.col("length") == F.col("_l")) & (F.col("gain") == F.col("_g"))).alias("same_as_shortest"))  # one row

    @query()
    def gen_holdout_templates(spark, sf_dir):
        """How many boxes of each category the witnesses give."""
        w = pool(spark, sf_dir).withColumn("route", F.xxhash64("spec", "via"))
        return workloads.boxes(w).groupBy("category", "tightness").agg(F.count("*").alias("n"))

    def boxed(spark, sf_dir):
        return stored(workloads.boxes(pool(spark, sf_dir).withColumn("route", F.xxhash64("spec", "via"))))

    def solved(spark, sf_dir):
        """Boxes joined with the profiles of each spec that lie within them; boxes are as many as witnesses x 8."""
        b, p = boxed(spark, sf_dir), profiles(spark, sf_dir, furthest).select("spec", "L", "H", "P", "W", "via")
        within = F.col("L").between(F.col("Lmin"), F.col("Lmax")) & F.col("H").between(F.col("Hmin"), F.col("Hmax")) & (F.col("P") >= F.col("Pmin")) & (F.col("W") <= F.col("Wmax"))
        # a box is met by length slices: profiles and boxes share a slice of 500 m, so that no box meets all profiles
        cut = b.select("*", F.explode(F.sequence(F.floor(F.col("Lmin") / 500).cast("int"), F.floor(F.col("Lmax") / 500).cast("int"))).alias("slice"))
        hits = cut.join(p.withColumn("slice", F.floor(F.col("L") / 500).cast("int")), "slice").where(within)
        return hits.groupBy("route", "template", "spec").agg(F.count("*").alias("n"))

    @query()
    def run_benchmark(spark, sf_dir):
        """Boxes x specs: how many each spec solves by its profiles, by template."""
        return solved(spark, sf_dir).groupBy("template", "spec").agg(F.count("*").alias("solved"), F.sum("n").alias("profiles"))

    @query()
    def eval_holdout(spark, sf_dir):
        """Of all boxes those that any spec solves, by tightness."""
        all_ = boxed(spark, sf_dir)
        hit = solved(spark, sf_dir).select("route", "template").distinct().withColumn("hit", F.lit(True))
        return all_.join(hit, ["route", "template"], "left").groupBy("tightness").agg(F.count("*").alias("boxes"), F.count_if("hit").alias("solved"))

    @query()
    def gen_final_holdout(spark, sf_dir):
        """Pairs of far nodes with a class of direction, at most three of each."""
        from waywright.operators import workloads as w

        n = lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
        pairs = w.far_pairs(n, [r["node"] for r in lattice.seeds(spark, sf_dir).collect()])
        a, b = n.toDF("source", "sx", "sy"), n.toDF("target", "tx", "ty")
        flat = pairs.join(a, "source").join(b, "target").withColumn("way", F.when(F.abs(F.col("tx") - F.col("sx")) > F.abs(F.col("ty") - F.col("sy")), F.when(F.col("tx") > F.col("sx"), "east").otherwise("west")).otherwise(F.when(F.col("ty") > F.col("sy"), "north").otherwise("south")))
        own = Window.partitionBy("way").orderBy("source", "target")
        return flat.withColumn("place", F.row_number().over(own)).where("place <= 3").select("way", "place", "source", "target", "d2")

    @query()
    def probe_existing_scalar(spark, sf_dir):
        """Specs that weren't evaluated, each on its own: profiles and feasible ones."""
        more = [names[x] for x in ("hinge_pop_strong", "low_elevation_strong", "slope_inverse_beta_5")]
        t = lattice.kept(spark, sf_dir, "probe", lambda s, d: via.forest(edges(s, d), more, box))
        shaped = via.join_via(t, box).select("spec", *search.SUMS, *costs.route_vector())
        return shaped.withColumn("ok", costs.feasible_mul(box)).groupBy("spec").agg(F.count("*").alias("profiles"), F.count_if("ok").alias("feasible"))

    @query()
    def probe_interpolation(spark, sf_dir):
        """Trees of costs between two specs: the length of the direct route for each share."""
        between = [costs.Mix(f"k{k}", names["pop_width_reference"], names["shortest_length"], k / 4) for k in range(5)]
        return via.direct(edges(spark, sf_dir), between, box).select("spec", F.round("dist", 6).alias("cost"), F.col("len").alias("length"), "gain")

    @query("SELECT 4 AS portals, 4 AS labels, 2 AS shortcuts, 2 AS cell_visits, 256 AS scan, 2 AS repairs, 2 AS bridges")
    def cfg_portal(spark, sf_dir):
        own = search.Config()
        return spark.range(1).select(*[F.lit(getattr(own, x)).alias(x) for x in ("portals", "labels", "shortcuts", "cell_visits", "scan", "repairs", "bridges")])

    @query(f"WITH {c.WALKS_SQL}, x AS (SELECT walk, unnest(path) AS cell, unnest(range(len(path))) AS pos FROM walks), f AS (SELECT *, CASE WHEN lag(cell) OVER (PARTITION BY walk ORDER BY pos) = cell THEN 0 ELSE 1 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY walk ORDER BY pos) AS run FROM f) SELECT walk, CAST(run AS BIGINT) AS run, cell, count(*) AS n FROM r GROUP BY ALL")
    def win_cell_runs(spark, sf_dir):
        """Stretches of one cell of each walk, with their lengths."""
        own = Window.partitionBy("walk").orderBy("pos")
        x = c.walks(spark, sf_dir).select("walk", F.posexplode("path").alias("pos", "cell"))
        fresh = x.withColumn("new", F.coalesce((F.lag("cell").over(own) != F.col("cell")).cast("int"), F.lit(1)))
        return fresh.withColumn("run", F.sum("new").over(own)).groupBy("walk", "run", "cell").agg(F.count("*").alias("n"))
