"""All route queries by name, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waywright.functions import costs, geo, paths
from waywright.functions.costs import Box
from waywright.operators import audit, graph, nearest, network, portal, reports, via
from waywright.plans import extra, more, records
from waywright.sources import lattice, text_files
from waywright.sources.lattice import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BOX = Box("corner", 0, 150, 500.0, 6000.0, 0.0, 2000.0, 90.0, 18.0)
SPECS = costs.portfolio(BOX)
FEW = [s for s in SPECS if s.name in ("shortest_length", "hinge_width_strong", "low_elevation_mild")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- derived tables --------------------------------------------------------------------------------------------------

#: coordinates in microdegrees, the first column being the longitude
POINTS_SQL = SQL + ", points AS (SELECT id, 2000000 + 12 * x_m AS x_udeg, 48700000 + 9 * y_m AS y_udeg, x_m, y_m, elev FROM nodes)"
#: nodes of a walk: the parts of an order in line order
WALKS_SQL = "walks AS (SELECT l_orderkey AS walk, list(l_partkey % 9 ORDER BY l_linenumber, l_partkey, l_suppkey) AS path, list(CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey % 4 END ORDER BY l_linenumber, l_partkey, l_suppkey) AS roads FROM lineitem GROUP BY 1)"
#: routes: sums over the lines of an order
ROUTES_SQL = "sums AS (SELECT l_orderkey AS route, sum(l_quantity * 100) AS length, sum(l_linenumber * 7.0) AS gain, sum(l_quantity * 100 * (l_partkey % 256)) AS pop_len, sum(l_quantity * 100 * (5 + l_suppkey % 21)) AS wid_len FROM lineitem GROUP BY 1), routes AS (SELECT *, length AS L, gain AS H, CASE WHEN length > 0 THEN pop_len / length ELSE 0 END AS P, CASE WHEN length > 0 THEN wid_len / length ELSE 0 END AS W FROM sums)"
ROUTE_BOX = Box("routes", 0, 1, 4000.0, 12000.0, 30.0, 150.0, 100.0, 15.0)
RUNS_SQL = "runs AS (SELECT o_orderkey AS item, o_orderpriority AS method, o_orderstatus AS mode, o_custkey % 3 = 0 AS solved, o_totalprice AS elapsed, o_orderkey % 40 AS box FROM orders)"


def points(spark, sf_dir):
    return lattice.nodes(spark, sf_dir).select("id", (2000000 + 12 * F.col("x_m")).alias("x_udeg"), (48700000 + 9 * F.col("y_m")).alias("y_udeg"), "x_m", "y_m", "elev")


def walks(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 9).alias("node"), F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 4).alias("road"))
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("walk")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    return own.select("walk", F.col("x.node").alias("path"), F.col("x.road").alias("roads"))


def routes(spark, sf_dir):
    length = F.col("l_quantity") * 100
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(
        F.sum(length).alias("length"), F.sum(F.col("l_linenumber") * F.lit(7.0)).alias("gain"), F.sum(length * (F.col("l_partkey") % 256)).alias("pop_len"), F.sum(length * (5 + F.col("l_suppkey") % 21)).alias("wid_len"))
    return own.select("*", *costs.route_vector())


def run_rows(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("mode"), (F.col("o_custkey") % 3 == 0).alias("solved"), F.col("o_totalprice").alias("elapsed"), (F.col("o_orderkey") % 40).alias("box"))


def cells(spark, sf_dir):
    return graph.hop_partition(lattice.edges(spark, sf_dir), lattice.seeds(spark, sf_dir))


VORONOI_SQL = f"""WITH RECURSIVE {SQL},
links AS MATERIALIZED (SELECT u, v FROM edges),
r(node, own) USING KEY (node) AS (SELECT node, {{'hop': CAST(0 AS BIGINT), 'cell': CAST(cell AS BIGINT)}} FROM seeds
 UNION SELECT l.v, min({{'hop': r.own.hop + 1, 'cell': r.own.cell}}) FROM r JOIN links l ON l.u = r.node LEFT JOIN recurring.r o ON o.node = l.v
 WHERE o.own IS NULL OR {{'hop': r.own.hop + 1, 'cell': r.own.cell}} < o.own GROUP BY l.v),
cells AS (SELECT node, own.cell AS cell, own.hop AS hop FROM r),
crossing AS (SELECT edge_id, u, v, a.cell AS from_cell, b.cell AS to_cell FROM edges JOIN cells a ON a.node = u JOIN cells b ON b.node = v WHERE a.cell <> b.cell)"""


def sssp_sql(name: str, root: str, reverse: bool = False, cost: str = "length") -> str:
    tail, head = ("v", "u") if reverse else ("u", "v")
    return f"""{name}(node, dist) USING KEY (node) AS (SELECT CAST({root} AS BIGINT), CAST(0 AS DOUBLE)
 UNION SELECT e.{head}, min(x.dist + e.{cost}) FROM {name} x JOIN links e ON e.{tail} = x.node LEFT JOIN recurring.{name} o ON o.node = e.{head}
 WHERE o.dist IS NULL OR x.dist + e.{cost} < o.dist GROUP BY e.{head})"""


LINKS = "links AS MATERIALIZED (SELECT u, v, length FROM edges)"
SSSP = f"WITH RECURSIVE {SQL}, {LINKS}, {sssp_sql('ahead', '0')}, {sssp_sql('back', '150', True)}"


# ---- sources and sinks -----------------------------------------------------------------------------------------------


@query(f"WITH {SQL} SELECT edge_id, u, v, length, gain, popularity, width, road_id FROM edges")
def lattice_edges(spark, sf_dir):
    return lattice.edges(spark, sf_dir)


@query(f"WITH {SQL} SELECT id, cx, cy, elev, x_m, y_m FROM nodes")
def lattice_nodes(spark, sf_dir):
    return lattice.nodes(spark, sf_dir).drop("w")


@query(f"WITH {SQL} SELECT edge_id, u, v, length, CAST(CAST(0.1 * (10 * gain) AS FLOAT) AS DOUBLE) AS gain, popularity, width, road_id FROM edges")
def src_xy(spark, sf_dir):
    """The lattice written as .xy lines and parsed again."""
    lines = text_files.xy_lines(lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "elev"), lattice.edges(spark, sf_dir))
    return text_files.parse_xy(lines)[1]


@query(f"WITH {SQL} SELECT id, x_m AS x_udeg, y_m AS y_udeg, elev AS elev_m FROM nodes")
def src_xy_nodes(spark, sf_dir):
    lines = text_files.xy_lines(lattice.nodes(spark, sf_dir).select("id", F.col("x_m").alias("x"), F.col("y_m").alias("y"), "elev"), lattice.edges(spark, sf_dir))
    return text_files.parse_xy(lines)[0]


@query("SELECT s_suppkey + 1000 AS old_id, CAST(s_suppkey AS INTEGER) AS xy_id FROM supplier")
def src_seeds(spark, sf_dir):
    lines = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), F.concat_ws(" ", F.col("s_suppkey") + 1000, "s_suppkey").alias("value"))
    return text_files.parse_pairs(text_files.with_comments(lines))


@query("SELECT s_suppkey + 1000 AS old_id, CAST(s_suppkey AS INTEGER) AS xy_id, s_suppkey * 0.25 AS lon, s_nationkey * 0.5 AS lat FROM supplier")
def src_seeds_ll(spark, sf_dir):
    lines = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("line"), F.concat_ws(" ", F.col("s_suppkey") + 1000, "s_suppkey", F.col("s_suppkey") * 0.25, F.col("s_nationkey") * 0.5).alias("value"))
    return text_files.parse_seeds_latlon(lines)


@query("SELECT CAST(c_nationkey AS INTEGER) AS node, CAST(max_by(c_custkey % 7, c_custkey) AS INTEGER) AS cell, CAST(max_by(c_custkey % 5, c_custkey) AS INTEGER) AS hop FROM customer GROUP BY 1")
def src_part_dist(spark, sf_dir):
    """Of repeated nodes the last line holds."""
    lines = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.concat_ws(" ", F.col("c_nationkey") + 100, "c_nationkey", F.col("c_custkey") % 7, F.col("c_custkey") % 5).alias("value"))
    return text_files.parse_partition(lines)


@query("SELECT CAST(c_nationkey AS INTEGER) AS node, CAST(max_by(c_custkey % 7, c_custkey) AS INTEGER) AS cell FROM customer GROUP BY 1")
def src_part(spark, sf_dir):
    return src_part_dist(spark, sf_dir).drop("hop")


@query("SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS node FROM customer")
def src_bnodes(spark, sf_dir):
    lines = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.concat_ws(" ", F.col("c_nationkey") + 100, "c_nationkey").alias("value"))
    return text_files.parse_pairs(lines).select(F.col("xy_id").alias("node")).distinct()


@query("SELECT o_custkey AS u_old, o_orderkey AS v_old, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 END AS INTEGER) AS key, CAST(o_custkey + 1 AS INTEGER) AS u, CAST(o_orderkey + 1 AS INTEGER) AS v FROM orders")
def src_bedges(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    lines = o.select(F.col("o_orderkey").alias("line"), F.concat_ws(" ", "o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(3)), F.col("o_custkey") + 1, F.col("o_orderkey") + 1).alias("value"))
    return text_files.parse_boundary_edges(lines)


@query("SELECT CAST(n_regionkey AS INTEGER) AS cell, CAST(n_nationkey AS INTEGER) AS xy, CAST(n_nationkey + 50 AS BIGINT) AS old FROM nation")
def src_cells(spark, sf_dir):
    own = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.format_string("%d(%d)", F.col("n_nationkey") + 50, "n_nationkey"))).alias("x"))
    lines = own.select(F.col("n_regionkey").alias("line"), F.concat(F.col("n_regionkey"), F.lit(" : "), F.array_join("x", " ")).alias("value"))
    return text_files.parse_cells(lines).select("cell", F.explode("nodes").alias("n")).select("cell", "n.xy", "n.old")


@query("SELECT 'box' || r_regionkey AS name, r_regionkey AS source, r_regionkey + 5 AS target, CAST(1000 * r_regionkey AS DOUBLE) AS Lmin, CAST(9000 AS DOUBLE) AS Lmax, CAST(0 AS DOUBLE) AS Hmin, CAST(500 AS DOUBLE) AS Hmax, CAST(150 AS DOUBLE) AS Pmin, CAST(15 AS DOUBLE) AS Wmax FROM region")
def src_queries(spark, sf_dir):
    """Boxes from JSON; bounds that a box lacks have defaults."""
    own = read(spark, sf_dir, "region").select(F.to_json(F.struct(F.concat(F.lit("box"), "r_regionkey").alias("name"), F.col("r_regionkey").alias("source"), (F.col("r_regionkey") + 5).alias("target"), (1000 * F.col("r_regionkey")).alias("Lmin"), F.lit(9000).alias("Lmax"))).alias("value"))
    return text_files.parse_boxes(own, {"Hmin": 0.0, "Hmax": 500.0, "Pmin": 150.0, "Wmax": 15.0})


@query(f"WITH {WALKS_SQL} SELECT walk, sha256(array_to_string(path, ',')) AS fingerprint FROM walks")
def sink_hash(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", F.sha2(F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))), 256).alias("fingerprint"))


# ---- scalar functions ------------------------------------------------------------------------------------------------

_C = "6371000.0"
_XY = f"FROM points, (SELECT avg(x_udeg) AS lon0, avg(y_udeg) AS lat0 FROM points)"
_X, _Y = f"{_C} * cos(radians(lat0 / 1e6)) * (radians(x_udeg / 1e6) - radians(lon0 / 1e6))", f"{_C} * (radians(y_udeg / 1e6) - radians(lat0 / 1e6))"


@query(f"WITH {POINTS_SQL} SELECT id, CAST(round_even({_X}, 0) AS INTEGER) AS x, CAST(round_even({_Y}, 0) AS INTEGER) AS y {_XY}")
def fn_local_xy_int(spark, sf_dir):
    return geo.local_xy(points(spark, sf_dir)).select("id", "x", "y")


@query(f"WITH {POINTS_SQL} SELECT id, round({_X}, 4) AS x, round({_Y}, 4) AS y {_XY}")
def fn_local_xy_m(spark, sf_dir):
    return geo.local_xy(points(spark, sf_dir), whole=False).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_HAV = f"2 * {_C} * asin(sqrt(0.5 - cos(radians(t.y_udeg / 1e6) - radians(p.y_udeg / 1e6)) / 2 + cos(radians(p.y_udeg / 1e6)) * cos(radians(t.y_udeg / 1e6)) * (1 - cos(radians(t.x_udeg / 1e6) - radians(p.x_udeg / 1e6))) / 2))"


def _to_target(spark, sf_dir):
    p = points(spark, sf_dir)
    t = p.where("id = 17").select(F.col("x_udeg").alias("tx"), F.col("y_udeg").alias("ty"), F.col("x_m").alias("tmx"), F.col("y_m").alias("tmy"))
    return p.crossJoin(F.broadcast(t))  # one row


@query(f"WITH {POINTS_SQL} SELECT p.id, round({_HAV}, 3) AS m, CAST(floor(10 * {_HAV} + 1e-7) AS BIGINT) AS dm FROM points p, points t WHERE t.id = 17")
def fn_haversine(spark, sf_dir):
    d = geo.haversine_m(F.col("x_udeg"), F.col("y_udeg"), F.col("tx"), F.col("ty"))
    return _to_target(spark, sf_dir).select("id", F.round(d, 3).alias("m"), F.floor(10 * d + 1e-7).alias("dm"))


@query(f"WITH {POINTS_SQL} SELECT p.id, round(sqrt((p.x_m - t.x_m) ** 2 + (p.y_m - t.y_m) ** 2), 6) AS d, CAST(floor(sqrt(CAST((p.x_m - t.x_m) * (p.x_m - t.x_m) + (p.y_m - t.y_m) * (p.y_m - t.y_m) AS DOUBLE))) AS BIGINT) AS whole FROM points p, points t WHERE t.id = 17")
def fn_euclid(spark, sf_dir):
    a = [F.col(c) for c in ("x_m", "y_m", "tmx", "tmy")]
    return _to_target(spark, sf_dir).select("id", F.round(geo.euclid(*a), 6).alias("d"), geo.euclid_int(*a).alias("whole"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [p_partkey] WHEN p_size % 3 = 1 THEN [p_partkey, CAST(p_size AS BIGINT)] ELSE [CAST(p_size AS BIGINT), 7] END AS ids FROM part")
def fn_parse_osmid(spark, sf_dir):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_size") % 3 == 1, F.format_string("[%d, %d]", "p_partkey", "p_size")).otherwise(F.format_string("%d;x;7", "p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", paths.parse_osmid(text).alias("ids"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_name ELSE '__noname__' END AS road, trim(p_type) AS highway FROM part")
def fn_road_key(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    ref = F.when(F.col("p_size") % 4 == 0, F.array(F.concat(F.lit(" "), "p_brand"), F.lit("x")))
    name = F.when(F.col("p_size") % 4 == 1, F.array(F.concat("p_name", F.lit(" ")))).when(F.col("p_size") % 4 == 2, F.array(F.lit(" ")))
    return p.select("p_partkey", paths.road_key(ref, name, F.array("p_type")).alias("k")).select("p_partkey", "k.road", "k.highway")


@query(f"WITH {SQL} SELECT edge_id, length, gain, length * popularity AS pop_len, length * width AS wid_len FROM edges")
def fn_edge_metrics(spark, sf_dir):
    return lattice.edges(spark, sf_dir).select("edge_id", "length", "gain", (F.col("length") * F.col("popularity")).alias("pop_len"), (F.col("length") * F.col("width")).alias("wid_len"))


@query(f"WITH {ROUTES_SQL} SELECT route, L, H, round(P, 6) AS P, round(W, 6) AS W FROM routes")
def fn_route_vector(spark, sf_dir):
    return routes(spark, sf_dir).select("route", "L", "H", F.round("P", 6).alias("P"), F.round("W", 6).alias("W"))


COSTED_SQL = f"""WITH {SQL}, {costs.specs_sql(SPECS)}, c AS (SELECT max(gain / length) * (1 + pow(2, -52)) AS rho, max(popularity) AS pstar FROM edges),
x AS (SELECT *, length * (w * greatest(0, width - Wref) / greatest(abs(Wref), 1) + p * greatest(0, Pref - popularity) / greatest(abs(Pref), 1)) AS hinge FROM edges, specs, c),
costed AS (SELECT edge_id, spec, {costs.COST_SQL} AS cost FROM x)"""


@query(f"{COSTED_SQL} SELECT edge_id, spec, round(cost, 6) AS cost FROM costed")
def fn_cost_all(spark, sf_dir):
    """All thirty specs on all edges: every cost family."""
    return via.priced(lattice.edges(spark, sf_dir), SPECS, BOX).select("edge_id", "spec", F.round("cost", 6).alias("cost"))


@query(f"{COSTED_SQL} SELECT a.edge_id, k / 8.0 AS share, round((1 - k / 8.0) * a.cost + k / 8.0 * b.cost, 6) AS cost FROM costed a JOIN costed b ON a.edge_id = b.edge_id, range(1, 8) t(k) WHERE a.spec = 'pop_width_reference' AND b.spec = 'shortest_length'")
def fn_cost_interp(spark, sf_dir):
    own = via.priced(lattice.edges(spark, sf_dir), [s for s in SPECS if s.name in ("pop_width_reference", "shortest_length")], BOX).groupBy("edge_id").agg(F.max(F.when(F.col("spec") == "pop_width_reference", F.col("cost"))).alias("a"), F.max(F.when(F.col("spec") == "shortest_length", F.col("cost"))).alias("b"))
    each = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).withColumn("share", F.col("k") / 8.0)
    return each.select("edge_id", "share", F.round((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"), 6).alias("cost"))


@query("SELECT spec, family FROM (VALUES " + ", ".join(f"('{s.name}', '{s.family}')" for s in SPECS) + ") t(spec, family)")
def fn_portfolio(spark, sf_dir):
    return costs.specs_frame(spark, SPECS).select("spec", "family")


@query(f"WITH {WALKS_SQL}, k AS (SELECT walk, [r FOR r IN roads IF r IS NOT NULL] AS r FROM walks) SELECT walk, CAST(coalesce(list_sum([CASE WHEN r[i] <> r[i + 1] THEN 1 ELSE 0 END FOR i IN range(1, len(r))]), 0) AS INTEGER) AS changes FROM k")
def fn_road_delta(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", paths.road_changes(F.col("roads")).cast("int").alias("changes"))


_B = ROUTE_BOX
_LO, _HI, _WT = [0, 0, 0, 5], [20000, 300, 255, 30], [1, 0.5, 0.25, 1]


@query(f"WITH {ROUTES_SQL} SELECT route, round(greatest({', '.join(f'{w} * abs({c} - {(a + b) / 2}) / {(b - a) / 2}' for c, a, b, w in zip('LHPW', _LO, _HI, _WT, strict=True))}), 6) AS score FROM routes")
def fn_chebyshev(spark, sf_dir):
    return routes(spark, sf_dir).select("route", F.round(costs.chebyshev(_LO, _HI, _WT), 6).alias("score"))


#: boxes that try the bounds of the centre: the usual, a high popularity, a narrow width, both, and no width at all
CENTERED = [_B, Box("popular", 0, 1, 0.0, 20000.0, 0.0, 0.5, 254.5, 15.0), Box("narrow", 0, 1, 4000.0, 12000.0, 30.0, 150.0, 100.0, 5.5), Box("both", 0, 1, 1.0, 2.0, 3.0, 3.5, 400.0, 0.5), Box("line", 0, 1, 5000.0, 5000.0, 90.0, 90.0, 0.0, 30.0)]


@query(f"WITH {ROUTES_SQL}, b(box, l0, l1, h0, h1, p0, w1) AS (VALUES {', '.join(f'({chr(39)}{b.name}{chr(39)}, {b.Lmin}, {b.Lmax}, {b.Hmin}, {b.Hmax}, {b.Pmin}, {b.Wmax})' for b in CENTERED)}), c AS (SELECT *, greatest(255, p0 + 1) AS p1, least(5, w1 - 1) AS w0 FROM b) SELECT box, route, round(greatest(abs(L - (l0 + l1) / 2) / greatest((l1 - l0) / 2, 1), abs(H - (h0 + h1) / 2) / greatest((h1 - h0) / 2, 1), abs(P - (p0 + p1) / 2) / greatest((p1 - p0) / 2, 1), abs(W - (w0 + w1) / 2) / greatest((w1 - w0) / 2, 1)), 6) AS score FROM routes, c")
def fn_box_center(spark, sf_dir):
    """The score of every route in each of five boxes."""
    own = routes(spark, sf_dir)
    return own.select("route", F.inline(F.array(*[F.struct(F.lit(b.name).alias("box"), F.round(costs.box_center(b), 6).alias("score")) for b in CENTERED])))


_VIOL = f"greatest(0, {_B.Lmin} - L) AS v1, greatest(0, L - {_B.Lmax}) AS v2, greatest(0, {_B.Hmin} - H) AS v3, greatest(0, H - {_B.Hmax}) AS v4, greatest(0, {_B.Pmin} - P) AS v5, greatest(0, W - {_B.Wmax}) AS v6"
_SCALED = "[v1 / 8000, v2 / 8000, v3 / 120, v4 / 120, v5 / 100, v6 / 15]"


@query(f"WITH {ROUTES_SQL}, v AS (SELECT route, {_VIOL} FROM routes), s AS (SELECT *, {_SCALED} AS a FROM v) SELECT route, v1 AS L_low, v2 AS L_high, v3 AS H_low, v4 AS H_high, round(v5, 6) AS P_low, round(v6, 6) AS W_high, round(list_max(a), 6) AS score, CASE WHEN list_max(a) > 0 THEN {list(costs.KINDS)}[list_position(a, list_max(a))] END AS dominant FROM s")
def fn_violations(spark, sf_dir):
    own = [F.round(v, 6).alias(k) if k in ("P_low", "W_high") else v.alias(k) for k, v in zip(costs.KINDS, costs.violations(_B), strict=True)]
    return routes(spark, sf_dir).select("route", *own, F.round(costs.violation_score(_B), 6).alias("score"), costs.dominant_violation(_B).alias("dominant"))


@query(f"WITH {ROUTES_SQL}, v AS (SELECT *, {_VIOL} FROM routes), s AS (SELECT *, [round(x, 9) FOR x IN [v1 / 8000, v2 / 8000, v3 / 120, v4 / 120, v5 / 155, v6 / 10]] AS a FROM v), k AS (SELECT route, round(a[1] + a[2] + a[3] + a[4] + a[5] + a[6], 8) AS total, list_max(a) AS most, len([x FOR x IN a IF x > 0]) AS broken, a, L, H, round(P, 9) AS P, round(W, 9) AS W FROM s) SELECT route, total, most, CAST(broken AS INTEGER) AS broken, CAST(row_number() OVER (ORDER BY total, most, broken, a, L, H, -P, W, route) AS INTEGER) AS place FROM k QUALIFY place <= 100")
def fn_violation_key(spark, sf_dir):
    """The hundred routes that come first by the lexicographic key of their violations."""
    best = routes(spark, sf_dir).select("route", costs.violation_key(_B, 255.0, 5.0).alias("k")).orderBy("k", "route").limit(100)
    return best.select("route", "k.total", "k.most", "k.broken", F.row_number().over(Window.orderBy("k", "route")).alias("place"))


@query(f"WITH {WALKS_SQL} SELECT walk, [x FOR x IN [CASE WHEN i = 1 OR path[i] <> path[i - 1] THEN path[i] END FOR i IN range(1, len(path) + 1)] IF x IS NOT NULL] AS seq FROM walks")
def fn_cell_seq(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", paths.runs(F.col("path")).alias("seq"))


@query(f"WITH {WALKS_SQL} SELECT walk, list_concat(path, list_reverse(path)[2:]) AS whole FROM walks")
def fn_merge_segments(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", paths.merge_segments(F.col("path"), F.reverse("path")).alias("whole"))


@query(f"WITH {WALKS_SQL} SELECT walk, contains(',' || array_to_string(path, ',') || ',', ',3,4,') OR contains(',' || array_to_string(path, ',') || ',', ',5,5,') AS has FROM walks")
def fn_contains_segment(spark, sf_dir):
    seg = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    return walks(spark, sf_dir).select("walk", (paths.contains_segment(F.col("path"), seg(3, 4)) | paths.contains_segment(F.col("path"), seg(5, 5))).alias("has"))


@query(f"WITH {WALKS_SQL} SELECT a.walk, round(CASE WHEN len(list_distinct(list_concat(a.path, b.path))) = 0 THEN 1 ELSE len(list_intersect(a.path, b.path)) / len(list_distinct(list_concat(a.path, b.path))) END, 6) AS j FROM walks a JOIN walks b ON b.walk = a.walk + 1")
def fn_jaccard(spark, sf_dir):
    a = walks(spark, sf_dir).select("walk", "path")
    b = a.select((F.col("walk") - 1).alias("walk"), F.col("path").alias("other"))
    return a.join(b, "walk").select("walk", F.round(paths.jaccard(F.col("path"), F.col("other")), 6).alias("j"))


@query(f"WITH {WALKS_SQL} SELECT walk, CAST(len(path) - len(list_distinct(path)) AS INTEGER) AS repeats FROM walks")
def fn_repeated(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", paths.repeated_vertices(F.col("path")).alias("repeats"))


@query(f"WITH RECURSIVE {WALKS_SQL}, r AS (SELECT walk, path, 1 AS i, CAST([] AS BIGINT[]) AS out_ FROM walks UNION ALL SELECT walk, path, i + 1, CASE WHEN list_position(out_, path[i]) > 0 THEN out_[1:list_position(out_, path[i])] ELSE list_append(out_, path[i]) END FROM r WHERE i <= len(path)) SELECT walk, out_ AS path FROM r WHERE i = len(path) + 1")
def fn_loop_erase(spark, sf_dir):
    return walks(spark, sf_dir).select("walk", paths.loop_erase("path").alias("path"))


# ---- filters ---------------------------------------------------------------------------------------------------------


@query(f"WITH {ROUTES_SQL} SELECT route FROM routes WHERE L BETWEEN {_B.Lmin} AND {_B.Lmax} AND H BETWEEN {_B.Hmin} AND {_B.Hmax} AND pop_len >= {_B.Pmin} * length AND wid_len <= {_B.Wmax} * length")
def flt_box_mul(spark, sf_dir):
    return routes(spark, sf_dir).where(costs.feasible_mul(_B)).select("route")


@query(f"WITH {ROUTES_SQL} SELECT route FROM routes WHERE L BETWEEN {_B.Lmin} AND {_B.Lmax} AND H BETWEEN {_B.Hmin} AND {_B.Hmax} AND P >= {_B.Pmin} AND W <= {_B.Wmax}")
def flt_box_div(spark, sf_dir):
    return routes(spark, sf_dir).where(costs.feasible_div(_B)).select("route")


@query(f"WITH {ROUTES_SQL}, v AS (SELECT route, {_VIOL} FROM routes) SELECT route, [x FOR x IN [CASE WHEN v1 > 1e-6 THEN 'L_low' END, CASE WHEN v2 > 1e-6 THEN 'L_high' END, CASE WHEN v3 > 1e-6 THEN 'H_low' END, CASE WHEN v4 > 1e-6 THEN 'H_high' END, CASE WHEN v5 > 1e-6 THEN 'P_low' END, CASE WHEN v6 > 1e-6 THEN 'W_high' END] IF x IS NOT NULL] AS misses FROM v")
def flt_misses(spark, sf_dir):
    return routes(spark, sf_dir).select("route", F.array_compact(F.array(*[F.when(v > 1e-6, F.lit(k)) for k, v in zip(costs.KINDS, costs.violations(_B), strict=True)])).alias("misses"))


@query(f"WITH {SQL} SELECT id FROM nodes WHERE id IN (SELECT u FROM edges) AND id IN (SELECT v FROM edges)")
def flt_endpoints_valid(spark, sf_dir):
    e = lattice.edges(spark, sf_dir)
    return lattice.nodes(spark, sf_dir).select("id").join(e.select(F.col("u").alias("id")), "id", "left_semi").join(e.select(F.col("v").alias("id")), "id", "left_semi")


@query(f"WITH {WALKS_SQL}, c AS (SELECT walk, unnest([x FOR x IN [CASE WHEN i = 1 OR path[i] <> path[i - 1] THEN path[i] END FOR i IN range(1, len(path) + 1)] IF x IS NOT NULL]) AS cell FROM walks), n AS (SELECT walk, cell, count(*) AS n FROM c GROUP BY ALL) SELECT walk FROM n GROUP BY walk HAVING max(n) <= 1")
def flt_cell_visits(spark, sf_dir):
    """Walks that enter no cell twice."""
    each = walks(spark, sf_dir).select("walk", F.explode(paths.runs(F.col("path"))).alias("cell")).groupBy("walk", "cell").agg(F.count("*").alias("n"))
    return each.groupBy("walk").agg(F.max("n").alias("n")).where("n <= 1").select("walk")


_CORRIDOR = "corridor AS (SELECT cell FROM (SELECT s.cell, c.x_m AS cx, c.y_m AS cy, a.x_m AS sx, a.y_m AS sy, b.x_m AS tx, b.y_m AS ty FROM seeds s JOIN nodes c ON c.id = s.node, nodes a, nodes b WHERE a.id = 0 AND b.id = 150) WHERE floor(sqrt(CAST((sx-cx)*(sx-cx)+(sy-cy)*(sy-cy) AS DOUBLE))) + floor(sqrt(CAST((tx-cx)*(tx-cx)+(ty-cy)*(ty-cy) AS DOUBLE))) <= floor(sqrt(CAST((sx-tx)*(sx-tx)+(sy-ty)*(sy-ty) AS DOUBLE))) + 1500)"


def _corridor(spark, sf_dir):
    at = lattice.nodes(spark, sf_dir).select(F.col("id").alias("node"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    one = lambda k: spark.range(1).select(F.lit(k).cast("long").alias("node"))
    return network.corridor_cells(lattice.seeds(spark, sf_dir), at, one(BOX.source), one(BOX.target), 1500)


@query(f"WITH {SQL}, {_CORRIDOR} SELECT cell FROM corridor")
def flt_corridor(spark, sf_dir):
    return _corridor(spark, sf_dir)


_KEPT = f"{VORONOI_SQL}, {_CORRIDOR}, inside AS (SELECT node FROM cells WHERE cell IN (SELECT cell FROM corridor)), edge_ AS (SELECT u AS node FROM crossing UNION SELECT v FROM crossing), start AS (SELECT node FROM edge_ WHERE node IN (SELECT node FROM inside)), kept AS (SELECT node FROM inside UNION SELECT v FROM start JOIN edges ON u = node)"


@query(f"{_KEPT} SELECT node FROM kept")
def flt_kept_nodes(spark, sf_dir):
    return network.kept_nodes(lattice.edges(spark, sf_dir), cells(spark, sf_dir), _corridor(spark, sf_dir), 1)


@query(f"{_KEPT} SELECT edge_id FROM edges WHERE u IN (SELECT node FROM kept) AND v IN (SELECT node FROM kept)")
def flt_geometric(spark, sf_dir):
    e = lattice.edges(spark, sf_dir)
    return network.within(e, flt_kept_nodes(spark, sf_dir)).select("edge_id")


@query(f"{SSSP} SELECT edge_id FROM edges e JOIN ahead a ON a.node = u JOIN back b ON b.node = v WHERE a.dist + length + b.dist <= 6000 + 1e-6")
def flt_certified(spark, sf_dir):
    e = lattice.edges(spark, sf_dir)
    return network.certified(e, near(spark, sf_dir, BOX.source), near(spark, sf_dir, BOX.target, reverse=True), BOX.Lmax).select("edge_id")


# ---- graph iteration -------------------------------------------------------------------------------------------------


def near(spark, sf_dir, root: int, reverse: bool = False):
    """(node, dist): distances of at most the box's length, from root or to it. No route within the box goes further."""
    return graph.distances(lattice.edges(spark, sf_dir), spark.range(1).select(F.lit(root).cast("long").alias("node")), reverse=reverse, longest=BOX.Lmax + 1e-6)


@query(f"{SSSP} SELECT node, dist FROM ahead")
def g_sssp_fwd(spark, sf_dir):
    return graph.distances(lattice.edges(spark, sf_dir), spark.range(1).select(F.lit(BOX.source).cast("long").alias("node")))


@query(f"{SSSP} SELECT node, dist FROM back")
def g_sssp_rev(spark, sf_dir):
    return graph.distances(lattice.edges(spark, sf_dir), spark.range(1).select(F.lit(BOX.target).cast("long").alias("node")), reverse=True)


@query(f"{VORONOI_SQL} SELECT node, cell, hop FROM cells")
def g_voronoi(spark, sf_dir):
    return cells(spark, sf_dir)


@query(f"WITH {SQL}, a AS (SELECT node FROM seeds UNION SELECT v FROM seeds JOIN edges ON u = node), b AS (SELECT node FROM a UNION SELECT v FROM a JOIN edges ON u = node) SELECT node FROM b")
def g_hop_expand(spark, sf_dir):
    return graph.hop_expand(lattice.edges(spark, sf_dir), lattice.seeds(spark, sf_dir), 2)


def forest(spark, sf_dir, specs=FEW):
    return via.forest(lattice.edges(spark, sf_dir), specs, BOX)


def near_forest(spark, sf_dir, longest: float = BOX.Lmax + 1e-6):
    """forest where only via routes of at most longest are asked for: a large graph is searched no further than such routes go."""
    e = lattice.edges(spark, sf_dir)
    if graph.fits(e):
        return lattice.kept(spark, sf_dir, "forest", forest)
    return lattice.kept(spark, sf_dir, f"forest-{longest:.0f}", lambda s, d: via.forest(e, FEW, BOX, longest=longest))


@query(f"{SSSP} SELECT 'fwd' AS dir, node, dist FROM ahead UNION ALL SELECT 'bwd', node, dist FROM back")
def g_scalar_tree(spark, sf_dir):
    return forest(spark, sf_dir, SPECS[:1]).select("dir", "node", "dist")


@query(f"{SSSP} SELECT a.node AS via, a.dist + b.dist AS length FROM ahead a JOIN back b ON a.node = b.node WHERE a.dist + b.dist > 0")
def join_via(spark, sf_dir):
    return via.join_via(forest(spark, sf_dir, SPECS[:1]), BOX).select("via", "length")


@query()
def g_scalar_path(spark, sf_dir):
    """Every spec's route from source to target, with its metrics, feasibility and violation."""
    tree = via.forest(lattice.edges(spark, sf_dir), SPECS, BOX, ("fwd",)).where(F.col("node") == BOX.target)
    shaped = tree.select("spec", "dist", F.col("len").alias("length"), "gain", "pop_len", "wid_len", "road_changes").select("*", *costs.route_vector())
    return shaped.select("spec", F.round("dist", 6).alias("cost"), "L", "H", F.round("P", 6).alias("P"), F.round("W", 6).alias("W"), "road_changes", costs.feasible_mul(BOX).alias("feasible"), F.round(costs.violation_score(BOX), 6).alias("score"))


@query(f"{COSTED_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, links AS MATERIALIZED (SELECT e.u, e.v, c.spec, c.cost FROM costed c JOIN edges e USING (edge_id)), way(spec, node, dist) USING KEY (spec, node) AS (SELECT spec, CAST({BOX.source} AS BIGINT), CAST(0 AS DOUBLE) FROM specs UNION SELECT x.spec, l.v, min(x.dist + l.cost) FROM way x JOIN links l ON l.u = x.node AND l.spec = x.spec LEFT JOIN recurring.way o ON o.node = l.v AND o.spec = x.spec WHERE o.dist IS NULL OR x.dist + l.cost < o.dist GROUP BY x.spec, l.v) SELECT spec, round(dist, 6) AS cost FROM way WHERE node = {BOX.target}")
def g_scalar_cost(spark, sf_dir):
    """What each spec's route from source to target costs."""
    tree = via.forest(lattice.edges(spark, sf_dir), SPECS, BOX, ("fwd",)).where(F.col("node") == BOX.target)
    return tree.select("spec", F.round("dist", 6).alias("cost"))


@query()
def g_reconstruct(spark, sf_dir):
    """The best via routes of three specs, rebuilt from the trees and checked edge by edge."""
    trees = near_forest(spark, sf_dir)
    found = via.reconstruct(trees, via.best(via.join_via(trees, BOX), BOX))
    checked = via.validated(found, lattice.edges(spark, sf_dir), ["query", "spec", "via"])
    return checked.select("spec", "via", "rank", "length", "x_length", "gain", "x_gain", "connected", "elementary", F.size("edges").alias("n_edges"))


@query(f"{SSSP} SELECT a.node AS via, round(greatest(abs(a.dist + b.dist - 3250) / 2750), 9) AS score FROM ahead a JOIN back b ON a.node = b.node WHERE a.dist + b.dist BETWEEN 500 AND 6000 ORDER BY score, via LIMIT 5")
def top_best_candidate(spark, sf_dir):
    own = join_via(spark, sf_dir).where(F.col("length").between(BOX.Lmin, BOX.Lmax))
    return own.select("via", F.round(F.abs(F.col("length") - 3250) / 2750, 9).alias("score")).orderBy("score", "via").limit(5)


@query(f"{SSSP} SELECT e.v AS node, count(*) AS tight FROM edges e JOIN ahead a ON a.node = e.u JOIN ahead b ON b.node = e.v WHERE abs(a.dist + e.length - b.dist) <= 1e-9 GROUP BY 1 HAVING count(*) > 1")
def via_tie_diag(spark, sf_dir):
    d = graph.stored(g_sssp_fwd(spark, sf_dir))
    own = lattice.edges(spark, sf_dir).join(d.select(F.col("node").alias("u"), F.col("dist").alias("a")), "u").join(d.select(F.col("node").alias("v"), F.col("dist").alias("b")), "v")
    return own.where(F.abs(F.col("a") + F.col("length") - F.col("b")) <= 1e-9).groupBy(F.col("v").alias("node")).agg(F.count("*").alias("tight")).where("tight > 1")


# ---- cells, hubs, constants ------------------------------------------------------------------------------------------


@query(f"{VORONOI_SQL} SELECT edge_id, from_cell, to_cell FROM crossing")
def join_boundary(spark, sf_dir):
    return network.crossings(lattice.edges(spark, sf_dir), cells(spark, sf_dir)).select("edge_id", "from_cell", "to_cell")


@query(f"{VORONOI_SQL} SELECT from_cell, to_cell, count(*) AS n FROM crossing GROUP BY 1, 2")
def join_cell_crossing(spark, sf_dir):
    return network.crossings(lattice.edges(spark, sf_dir), cells(spark, sf_dir)).groupBy("from_cell", "to_cell").agg(F.count("*").alias("n"))


@query(f"{VORONOI_SQL} SELECT u AS node FROM crossing UNION SELECT v FROM crossing")
def sink_bnodes(spark, sf_dir):
    return network.boundary_nodes(network.crossings(lattice.edges(spark, sf_dir), cells(spark, sf_dir))).orderBy("node")


@query(f"{VORONOI_SQL} SELECT cell, count(*) AS n, max(hop) AS radius FROM cells GROUP BY 1")
def agg_cell_counts(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.max("hop").alias("radius"))


@query(f"{VORONOI_SQL}, p AS (SELECT least(from_cell, to_cell) AS low, greatest(from_cell, to_cell) AS high, CASE WHEN from_cell < to_cell THEN {{'u': u, 'v': v}} ELSE {{'u': v, 'v': u}} END AS e FROM crossing), m AS (SELECT low, high, min(e) AS e FROM p GROUP BY 1, 2) SELECT low, high, e.u AS u, e.v AS v FROM m")
def ps_select_portals(spark, sf_dir):
    return network.mandatory_portals(network.crossings(lattice.edges(spark, sf_dir), cells(spark, sf_dir)))


@query(f"{VORONOI_SQL}, r2 AS (SELECT u, v, from_cell, to_cell, length, gain, row_number() OVER (PARTITION BY from_cell, to_cell ORDER BY length, gain, edge_id) AS k FROM crossing JOIN edges USING (edge_id, u, v)) SELECT u, v, from_cell, to_cell, k AS rank FROM r2 WHERE k <= 2")
def win_overlay_capacity(spark, sf_dir):
    e = lattice.edges(spark, sf_dir)
    own = network.crossings(e, cells(spark, sf_dir)).join(e.select("edge_id", "length", "gain"), "edge_id").select("u", "v", F.col("from_cell").alias("src"), F.col("to_cell").alias("dst"), F.lit("inter").alias("kind"), "length", "gain", F.col("edge_id").alias("seq"))
    return network.overlay(own).select("u", "v", F.col("src").alias("from_cell"), F.col("dst").alias("to_cell"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SQL}, e2 AS (SELECT u AS node, road_id FROM edges UNION ALL SELECT v, road_id FROM edges) SELECT node, count(DISTINCT road_id) AS score FROM e2 GROUP BY 1")
def agg_hub_score(spark, sf_dir):
    return network.hub_scores(lattice.edges(spark, sf_dir))


@query(f"WITH {SQL}, e2 AS (SELECT u AS node, road_id FROM edges UNION ALL SELECT v, road_id FROM edges) SELECT node, count(DISTINCT road_id) AS score FROM e2 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 70")
def top_candidates(spark, sf_dir):
    return network.hub_candidates(lattice.edges(spark, sf_dir), 7)


@query("WITH t AS (SELECT p_brand AS road, p_partkey % 6 AS way, sum(p_size) AS wt FROM part GROUP BY 1, 2), b AS (SELECT road, way, row_number() OVER (PARTITION BY road ORDER BY wt DESC, way) AS k FROM t) SELECT road, way, CAST(dense_rank() OVER (ORDER BY road) - 1 AS INTEGER) AS road_id FROM b WHERE k = 1")
def agg_canonical_way(spark, sf_dir):
    return network.canonical_ways(read(spark, sf_dir, "part").select(F.col("p_brand").alias("road"), (F.col("p_partkey") % 6).alias("way"), F.col("p_size").alias("weight")))


@query(f"WITH {SQL} SELECT round(max(gain / length), 9) AS max_slope, max(popularity) AS pstar, count(*) FILTER (length <= 1e-9 AND gain > 0) AS flat_climbs, count(*) FILTER (length > 1e-9) AS usable, arg_max(edge_id, {{'s': gain / length, 'e': -edge_id}}) AS steepest FROM edges")
def agg_metric_constants(spark, sf_dir):
    return network.metric_constants(lattice.edges(spark, sf_dir)).withColumn("max_slope", F.round("max_slope", 9))


@query(f"WITH {SQL} SELECT p_partkey AS part, arg_min(cell, {{'d': (n.x_m - s.x_m) * (n.x_m - s.x_m) + (n.y_m - s.y_m) * (n.y_m - s.y_m), 'c': cell}}) AS cell FROM part p JOIN nodes n ON n.id = p_partkey, (SELECT cell, x_m, y_m FROM seeds JOIN nodes ON id = node) s GROUP BY 1")
def join_nearest_node(spark, sf_dir):
    """The seed nearest to each node."""
    n = lattice.nodes(spark, sf_dir).select(F.col("id").alias("part"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    s = lattice.seeds(spark, sf_dir).join(n.withColumnRenamed("part", "node"), "node").select("cell", "x", "y")
    return nearest.nearest(n, s, "part", "cell").select("part", "cell")


@query(f"{_KEPT}, g AS (SELECT edge_id FROM edges WHERE u IN (SELECT node FROM kept) AND v IN (SELECT node FROM kept)) SELECT (SELECT count(*) FROM edges) AS full_edges, (SELECT count(*) FROM g) AS geometric_edges, (SELECT count(*) FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM g)) AS only_full")
def agg_graph_compare(spark, sf_dir):
    e, g = lattice.edges(spark, sf_dir), flt_geometric(spark, sf_dir).withColumn("g", F.lit(1))
    return e.join(g, "edge_id", "left").agg(F.count("*").alias("full_edges"), F.count("g").alias("geometric_edges"), F.count_if(F.col("g").isNull()).alias("only_full"))


# ---- audits, windows, reports, set operations, generators, portals -----------------------------------------------------
audit.register(query, walks, WALKS_SQL)
reports.register(query, run_rows, RUNS_SQL, routes, ROUTES_SQL, read)
portal.register(query, lattice, cells, BOX, graph, network)
more.register(query, sys.modules[__name__])
extra.register(query, sys.modules[__name__])
records.register(query, sys.modules[__name__])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g_scalar_path(spark, sf_dir)
