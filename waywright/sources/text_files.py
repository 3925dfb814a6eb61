"""Text formats of graphs and partitions: parsing and writing, over (line, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waywright.storage import stored


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file; line grows with the position in the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def data_lines(raw: DataFrame) -> DataFrame:
    """Lines that hold data, trimmed: neither blank nor a comment."""
    own = raw.select("line", F.trim("value").alias("value"))
    return own.where((F.length("value") > 0) & ~F.col("value").startswith("#"))


def with_comments(raw: DataFrame) -> DataFrame:
    """raw with a comment line and a blank one put in, as files have them."""
    extra = raw.sparkSession.range(2).select((-F.col("id") - 1).alias("line"), F.when(F.col("id") == 0, "# old xy").otherwise("  ").alias("value"))
    return raw.select(F.col("line").cast("long").alias("line"), "value").union(extra)


def parts(raw: DataFrame) -> DataFrame:
    return data_lines(raw).select("line", F.split("value", r"\s+").alias("p"))


def field(i: int, kind: str) -> Column:
    return F.get("p", F.lit(i)).cast(kind)


def parse_pairs(raw: DataFrame) -> DataFrame:
    """(old_id, xy_id); short lines are passed over."""
    return parts(raw).where(F.size("p") >= 2).select(field(0, "long").alias("old_id"), field(1, "int").alias("xy_id"))


def parse_seeds_latlon(raw: DataFrame) -> DataFrame:
    return parts(raw).where(F.size("p") >= 4).select(field(0, "long").alias("old_id"), field(1, "int").alias("xy_id"), field(2, "double").alias("lon"), field(3, "double").alias("lat"))


def parse_partition(raw: DataFrame) -> DataFrame:
    """(node, cell, hop): of lines of one node the last holds."""
    own = parts(raw).where(F.size("p") >= 4).select("line", field(1, "int").alias("node"), F.struct(field(2, "int").alias("cell"), field(3, "int").alias("hop")).alias("own"))
    return own.groupBy("node").agg(F.max_by("own", "line").alias("own")).select("node", "own.cell", "own.hop")


def parse_boundary_edges(raw: DataFrame) -> DataFrame:
    """(u_old, v_old, key, u, v) of lines of four fields, or of five with a key."""
    keyed = F.size("p") >= 5
    pick = lambda i: F.when(keyed, field(i + 1, "int")).otherwise(field(i, "int"))
    return parts(raw).where(F.size("p") >= 4).select(field(0, "long").alias("u_old"), field(1, "long").alias("v_old"), F.when(keyed, field(2, "int")).alias("key"), pick(2).alias("u"), pick(3).alias("v"))


def parse_cells(raw: DataFrame) -> DataFrame:
    """(cell, nodes): lines `cell : old(xy) old(xy) ...`; a bare id is both."""
    own = data_lines(raw).select(F.split("value", r"\s*:\s*").alias("h"))
    items = F.filter(F.split(F.get("h", F.lit(1)), r"\s+"), lambda x: F.length(x) > 0)
    node = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^(-?\d+)", 1).cast("long").alias("old"), F.coalesce(F.nullif(F.regexp_extract(x, r"\((-?\d+)\)", 1), F.lit("")), F.regexp_extract(x, r"^(-?\d+)", 1)).cast("int").alias("xy")))
    return own.select(F.get("h", F.lit(0)).cast("int").alias("cell"), node.alias("nodes"))


BOX = "name string, source int, target int, Lmin double, Lmax double, Hmin double, Hmax double, Pmin double, Wmax double"


def parse_boxes(raw: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Boxes of JSON texts in column value, one object each; missing bounds come from defaults."""
    own = raw.select(F.from_json("value", BOX).alias("b")).select("b.*")
    return own.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in own.columns])


def xy_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line, value) of the .xy format: a header, `v id x y elev`, `e u v length 10*gain popularity width road`."""
    v = nodes.select((F.col("id") + 1).cast("long").alias("line"), F.concat_ws(" ", F.lit("v"), "id", "x", "y", "elev").alias("value"))
    whole = lambda c: F.ceil(c).cast("long")
    e = edges.select((F.lit(1 << 40) + F.col("edge_id")).alias("line"), F.concat_ws(" ", F.lit("e"), "u", "v", whole("length"), (10 * F.col("gain")).cast("long"), whole("popularity"), whole("width"), "road_id").alias("value"))
    counts = nodes.agg(F.count("*").alias("n")).crossJoin(edges.agg(F.count("*").alias("m")))
    head = counts.select(F.lit(0).cast("long").alias("line"), F.format_string("nodes %d edges %d attributes 5", "n", "m").alias("value"))
    return head.union(v).union(e)


def parse_xy(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of .xy lines. Edges are numbered by source, then by line; climbs are stored as float32 tenths.
    An unknown tag is an error."""
    own = parts(raw).withColumn("tag", F.get("p", F.lit(0)))
    known = F.assert_true(F.col("tag").isin("nodes", "v", "e"), F.lit("unknown tag in .xy"))
    own = own.where(known.isNull())
    nodes = own.where("tag = 'v'").select(field(1, "long").alias("id"), field(2, "long").alias("x_udeg"), field(3, "long").alias("y_udeg"), field(4, "long").alias("elev_m"))
    e = own.where("tag = 'e'").select("line", field(1, "long").alias("u"), field(2, "long").alias("v"), field(3, "double").alias("length"), (F.lit(0.1) * field(4, "double")).cast("float").cast("double").alias("gain"), field(5, "double").alias("popularity"), field(6, "double").alias("width"), field(7, "long").alias("road_id"))
    degree = e.groupBy("u").agg(F.count("*").alias("n"))
    block = F.expr("u div 1024")
    before = degree.groupBy(block.alias("block")).agg(F.sum("n").alias("own"))
    before = before.select("block", (F.sum("own").over(Window.orderBy("block")) - F.col("own")).alias("before"))
    ranked = e.withColumn("block", block).withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy("u", "line")))
    return nodes, ranked.join(before, "block").select((F.col("before") + F.col("rank") - 1).alias("edge_id"), "u", "v", "length", "gain", "popularity", "width", "road_id")


def checked_xy(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parse_xy, and an error where the header's counts or an edge's ends don't agree with the lines."""
    nodes, edges = parse_xy(raw)
    head = parts(raw).where(F.get("p", F.lit(0)) == "nodes").select(field(1, "long").alias("n"), field(3, "long").alias("m")).first()
    if head is None:
        raise ValueError("no header in .xy")
    found = nodes.count(), edges.count()
    if found != (head["n"], head["m"]):
        raise ValueError(f"the header of .xy says {head['n']} nodes and {head['m']} edges, the lines have {found[0]} and {found[1]}")
    ends = edges.select(F.explode(F.array("u", "v")).alias("id")).join(nodes.select("id"), "id", "left_anti")
    if not ends.isEmpty():
        raise ValueError(f"an edge of .xy ends at node {ends.first()['id']}, which has no line")
    return nodes, edges


def graphml_lines(*elements: DataFrame) -> DataFrame:
    """The lines of one GraphML file: elements (value) between its head and its end, in one partition as the format asks for."""
    spark = elements[0].sparkSession
    line = lambda k, text: spark.range(1).select(F.lit(k).alias("_k"), F.lit(text).alias("value"))
    out = line(-1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">')
    for k, own in enumerate(elements):
        out = out.union(own.select(F.lit(k).alias("_k"), "value"))
    return out.union(line(len(elements), "</graph></graphml>")).coalesce(1).sortWithinPartitions("_k").select("value")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, data) of the nodes and (source, target, data) of the edges of GraphML files; data maps an attribute's name, which
    the file's keys give, to its text. Files are split at elements; keys are as many as attributes."""
    data = "data array<struct<_key string, _VALUE string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string").where("_id is not null").distinct().collect()
    names = F.create_map(*[F.lit(x) for k in keys for x in (k["_id"], k["_attr.name"])]) if keys else F.create_map().cast("map<string,string>")
    own = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(names[d["_key"]], d["_key"]), d["_VALUE"]))).alias("data")
    nodes = read("node", f"_id string, {data}").where("_id is not null").select(F.col("_id").alias("id"), own)
    edges = read("edge", f"_source string, _target string, {data}").where("_source is not null").select(F.col("_source").alias("source"), F.col("_target").alias("target"), own)
    return nodes, edges


def parse_items(raw: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """(item, category, bounds of the box) of JSON texts in column value."""
    own = raw.select(F.from_json("value", f"item string, category string, query struct<{', '.join(f.replace(' ', ':') for f in BOX.split(', '))}>").alias("i")).select("i.item", "i.category", "i.query.*")
    return own.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in own.columns])


def parse_walks(raw: DataFrame) -> DataFrame:
    """(walk, nodes, edge_ids) of JSON texts in column value."""
    return raw.select(F.from_json("value", "walk long, nodes array<long>, edge_ids array<long>").alias("w")).select("w.*")


def nested_walks(raw: DataFrame) -> DataFrame:
    """(file, json_path, query_id, source, target, path_node_ids, edge_ids) of all objects, however deep, that have arrays of node ids
    and of edge ids (csr_edge_ids or edge_ids). raw: (file, value), a JSON text each; broken ones are passed over.

    A round looks at one level of all texts; only what has objects within is opened for the next."""
    spark = raw.sparkSession
    level, found = raw.select("file", F.lit("").alias("json_path"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL"), []
    ids = lambda name: F.try_variant_get("v", f"$.{name}", "array<bigint>")
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string")
    number = lambda name: F.try_variant_get("v", f"$.{name}", "bigint")
    while True:
        level = stored(level.withColumn("kind", F.schema_of_variant("v")), "json")
        edge_ids = F.coalesce(ids("csr_edge_ids"), ids("edge_ids"))
        hit = level.where(F.col("kind").startswith("OBJECT")).select("file", F.when(F.col("json_path") == "", "/").otherwise(F.col("json_path")).alias("json_path"), F.coalesce(text("query_id"), text("name")).alias("query_id"), number("query.source").alias("source"), number("query.target").alias("target"), ids("path_node_ids").alias("path_node_ids"), edge_ids.alias("edge_ids"))
        found.append(hit.where("path_node_ids IS NOT NULL AND edge_ids IS NOT NULL"))
        inside = level.where("substr(kind, 2) LIKE '%OBJECT%' OR kind LIKE '%VARIANT%'")
        if inside.isEmpty():
            break
        level = spark.sql("SELECT file, concat(json_path, CASE WHEN key IS NULL THEN concat('[', pos, ']') ELSE concat('/', key) END) AS json_path, value AS v FROM {inside}, LATERAL variant_explode(v) WHERE value IS NOT NULL", inside=inside)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


REFUSED = ("empty", "unknown_edge", "broken", "other_nodes", "wrong_ends")


def witnessed(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """walks with reason, the first of REFUSED that holds (null: the walk is sound), and length and gain of its edges: every edge must be
    in edges and follow the one before, the nodes must be those of the edges, and the ends those of the query, if it names any."""
    keyed = walks.withColumn("_w", F.xxhash64("file", "json_path"))
    at = keyed.select("_w", F.posexplode("edge_ids").alias("pos", "edge_id")).join(edges.select("edge_id", "u", "v", "length", "gain"), "edge_id", "left")
    steps = at.groupBy("_w").agg(F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("s"), F.sum("length").alias("length"), F.sum("gain").alias("gain"), F.bool_or(F.col("u").isNull()).alias("unknown"))  # the edges of one walk
    made = F.concat(F.array(F.col("s")[0]["u"]), F.transform("s", lambda x: x["v"]))
    joined = keyed.join(steps, "_w", "left")
    broken = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.col("s")[i]["u"] != F.col("s")[i - 1]["v"])
    ends = F.coalesce(F.col("source") != F.get("path_node_ids", F.lit(0)), F.lit(False)) | F.coalesce(F.col("target") != F.element_at("path_node_ids", -1), F.lit(False))
    reason = F.when(F.col("s").isNull(), "empty").when(F.col("unknown"), "unknown_edge").when((F.size("s") > 1) & broken, "broken").when(made != F.col("path_node_ids"), "other_nodes").when(ends, "wrong_ends")
    return joined.withColumn("reason", reason).select(*walks.columns, "reason", "length", "gain")


def parse_ids(raw: DataFrame) -> DataFrame:
    """(line, old_id, xy_id): a node's id, tagged `old` or untagged."""
    old = F.get("p", F.lit(0)) == "old"
    return parts(raw).select("line", F.when(old, field(1, "long")).alias("old_id"), F.when(~old, field(0, "long")).alias("xy_id"))
