"""Audits of walks: repetitions, loops, out-and-back spurs, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywright.functions import paths


def repetition(walks: DataFrame) -> DataFrame:
    """(walk, repeated, multiplicity, repeated_edges): distinct repeated vertices, most visits, directed edges used again."""
    visits = walks.select("walk", F.explode("path").alias("v")).groupBy("walk", "v").agg(F.count("*").alias("n"))
    own = visits.groupBy("walk").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("multiplicity"))
    steps = walks.where(F.size("path") > 1).select("walk", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))).alias("e"))
    again = steps.groupBy("walk", "e").agg(F.count("*").alias("n")).groupBy("walk").agg(F.sum(F.col("n") - 1).alias("repeated_edges"))
    return own.join(again, "walk", "left").select("walk", "repeated", "multiplicity", F.coalesce("repeated_edges", F.lit(0)).alias("repeated_edges"))


def loop_spans(walks: DataFrame) -> DataFrame:
    """(walk, vertex, first, last): neighbouring visits of one vertex."""
    own = walks.select("walk", F.posexplode("path").alias("pos", "vertex"))
    return own.withColumn("last", F.lead("pos").over(Window.partitionBy("walk", "vertex").orderBy("pos"))).where("last is not null").select("walk", "vertex", F.col("pos").alias("first"), "last")


def spurs(walks: DataFrame, least_edges: int = 4) -> DataFrame:
    """(walk, first, last, road_clashes): spans between two visits of a vertex, of an even number of edges and least_edges at
    least, that go out over different vertices and come back over the same. road_clashes: edges whose way back has another
    road, where both are known. roads[i] is the road of the edge from path[i] on."""
    own = walks.select("walk", "path", "roads", F.posexplode("path").alias("first", "vertex"))
    spans = own.select("*", F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("path") - 1), lambda j: (j > F.col("first")) & (F.get("path", j) == F.col("vertex"))), lambda j: j)).alias("last"))
    edges = F.col("last") - F.col("first")
    half = F.expr("(last - first) div 2")
    out = F.slice("path", F.col("first") + 1, half + 1)
    back = F.slice("path", F.col("first") + 1 + half, half + 1)
    found = spans.where((edges >= least_edges) & (edges % 2 == 0)).where((F.size(F.array_distinct(out)) == F.size(out)) & (F.reverse(out) == back))
    clash = F.size(F.filter(F.sequence(F.lit(0), half - 1), lambda k: F.get("roads", F.col("first") + k) != F.get("roads", F.col("last") - 1 - k)))
    return found.select("walk", "first", "last", clash.alias("road_clashes"))


def road_runs(walks: DataFrame) -> DataFrame:
    """(walk, run, road, n): stretches of one road, known roads only."""
    own = walks.select("walk", F.posexplode("roads").alias("pos", "road")).where("road is not null")
    w = Window.partitionBy("walk").orderBy("pos")
    fresh = own.withColumn("new", F.coalesce((F.lag("road").over(w) != F.col("road")).cast("int"), F.lit(1)))
    return fresh.withColumn("run", F.sum("new").over(w)).groupBy("walk", "run", "road").agg(F.count("*").alias("n"))


def pattern(repeated: Column, edges: Column) -> Column:
    return F.when(repeated == 0, "ELEMENTARY").when((repeated == 1) & (edges == 0), "ONE_REPEATED_VERTEX").when(edges > 0, "REPEATED_EDGE").otherwise("SEVERAL_REPEATED_VERTICES")


def register(query, walks, walks_sql: str) -> None:
    rep = f"WITH {walks_sql}, x AS (SELECT walk, unnest(path) AS v FROM walks), n AS (SELECT walk, v, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT walk, count(*) FILTER (n > 1) AS repeated, max(n) AS multiplicity FROM n GROUP BY 1), st AS (SELECT walk, unnest([{{'a': path[i], 'b': path[i + 1]}} FOR i IN range(1, len(path))]) AS e FROM walks), en AS (SELECT walk, e, count(*) AS n FROM st GROUP BY ALL), b AS (SELECT walk, sum(n - 1) AS r FROM en GROUP BY 1), rep AS (SELECT a.walk, repeated, multiplicity, CAST(coalesce(r, 0) AS BIGINT) AS repeated_edges FROM a LEFT JOIN b USING (walk))"

    @query(f"{rep} SELECT * FROM rep")
    def aud_repetition(spark, sf_dir):
        return repetition(walks(spark, sf_dir))

    @query(f"{rep} SELECT CASE WHEN repeated = 0 THEN 'ELEMENTARY' WHEN repeated = 1 AND repeated_edges = 0 THEN 'ONE_REPEATED_VERTEX' WHEN repeated_edges > 0 THEN 'REPEATED_EDGE' ELSE 'SEVERAL_REPEATED_VERTICES' END AS pattern, count(*) AS n FROM rep GROUP BY 1")
    def rep_shape(spark, sf_dir):
        return repetition(walks(spark, sf_dir)).groupBy(pattern(F.col("repeated"), F.col("repeated_edges")).alias("pattern")).agg(F.count("*").alias("n"))

    spans = f"WITH {walks_sql}, x AS (SELECT walk, path, unnest(path) AS vertex, unnest(range(len(path))) AS pos FROM walks), s AS (SELECT walk, path, vertex, pos AS first, lead(pos) OVER (PARTITION BY walk, vertex ORDER BY pos) AS last FROM x), spans AS (SELECT * FROM s WHERE last IS NOT NULL)"

    @query(f"{spans} SELECT walk, vertex, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM spans")
    def win_loop_spans(spark, sf_dir):
        return loop_spans(walks(spark, sf_dir))

    @query(f"WITH {walks_sql}, a AS (SELECT walk, path, roads, unnest(range(len(path))) AS first FROM walks), s AS (SELECT *, unnest(range(first + 4, len(path), 2)) AS last FROM a), t AS (SELECT *, (last - first) // 2 AS half FROM s WHERE path[first + 1] = path[last + 1]), u AS (SELECT *, path[first + 1:first + half + 1] AS o, path[first + half + 1:last + 1] AS b FROM t) SELECT walk, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, CAST(len([k FOR k IN range(half) IF roads[first + k + 1] <> roads[last - k]]) AS INTEGER) AS road_clashes FROM u WHERE len(list_distinct(o)) = len(o) AND list_reverse(o) = b")
    def aud_spur(spark, sf_dir):
        return spurs(walks(spark, sf_dir))

    runs = f"WITH {walks_sql}, x AS (SELECT walk, unnest(roads) AS road, unnest(range(len(roads))) AS pos FROM walks), k AS (SELECT * FROM x WHERE road IS NOT NULL), f AS (SELECT *, CASE WHEN lag(road) OVER (PARTITION BY walk ORDER BY pos) = road THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY walk ORDER BY pos) AS run FROM f)"

    @query(f"{runs} SELECT walk, CAST(run AS BIGINT) AS run, road, count(*) AS n FROM r GROUP BY ALL")
    def win_lag_road(spark, sf_dir):
        return road_runs(walks(spark, sf_dir))

    @query(f"WITH {walks_sql} SELECT min(walk) AS walk, path FROM walks WHERE len(path) > len(list_distinct(path)) GROUP BY path")
    def aud_recover(spark, sf_dir):
        """Non-elementary walks, one for each node sequence."""
        return walks(spark, sf_dir).where(paths.repeated_vertices(F.col("path")) > 0).groupBy("path").agg(F.min("walk").alias("walk")).select("walk", "path")
