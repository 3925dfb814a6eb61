"""Benchmark reports: success, times, unions, coverage, templates of query boxes."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywright.operators import workloads


def success(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count_if("solved").alias("solved"), F.count("*").alias("attempted"), F.round(100.0 * F.count_if("solved") / F.count("*"), 6).alias("percent"))


def ranked_times(runs: DataFrame, *keys: str, buckets: int = 1000) -> DataFrame:
    """count, median, p90, p95 and max by nearest rank. Times are counted in buckets of equal width; running counts over a
    key's buckets say where a rank lies, and only those buckets are ordered, so that no task orders a whole key."""
    low, high = runs.agg(F.min("elapsed"), F.max("elapsed")).first()
    width = max((high - low) / buckets, 1e-9) if low is not None else 1.0
    each = runs.withColumn("_b", F.floor((F.col("elapsed") - F.lit(low or 0.0)) / width))
    w = Window.partitionBy(*keys)
    sums = each.groupBy(*keys, "_b").agg(F.count("*").alias("_own")).withColumn("_n", F.sum("_own").over(w)).withColumn("_upto", F.sum("_own").over(w.orderBy("_b")))
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), F.greatest(F.ceil(F.lit(q) * F.col("_n")), F.lit(1)).alias("k")) for q in (0.5, 0.9, 0.95)])
    found = sums.select(*keys, "_b", "_own", "_upto", F.inline(ranks)).where((F.col("k") <= F.col("_upto")) & (F.col("k") > F.col("_upto") - F.col("_own")))
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_at"), "q", (F.col("k") - F.col("_upto") + F.col("_own")).alias("_place"))
    ordered = each.select(*keys, "_b", "elapsed").join(found.select(*[f"_{k}" for k in keys], "_at").distinct(), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_b") == F.col("_at")], "left_semi")
    ordered = ordered.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("elapsed")))
    hit = ordered.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_b") == F.col("_at"), F.col("_r") == F.col("_place")])
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("elapsed")))
    values = hit.groupBy(*keys).agg(at(0.5).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95")).withColumnsRenamed({k: f"_{k}" for k in keys})
    whole = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.max("elapsed").alias("most"))
    return whole.join(values, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).select(*keys, "n", "median", "p90", "p95", "most")


def first_solved(runs: DataFrame, key: str) -> DataFrame:
    """Per key the number and time of attempts up to the first that solved, itself included; keys without one give no row."""
    first = runs.where("solved").groupBy(key).agg(F.min("item").alias("_first"))
    return runs.join(first, key).where(F.col("item") <= F.col("_first")).groupBy(key).agg(F.count("*").cast("int").alias("tries"), F.max("item").alias("item"), F.round(F.sum("elapsed"), 2).alias("spent"))


def cover(solved: DataFrame, k: int) -> DataFrame:
    """(members, n): the k methods that together solve the most boxes; of equals the first by name. solved: (method, box)
    without repeats; methods are as many as a benchmark has, and their sets are combined by expressions."""
    names = sorted(r["method"] for r in solved.select("method").distinct().collect())  # names of methods, not rows
    flags = solved.groupBy("box").agg(*[F.max((F.col("method") == m).cast("int")).alias(f"m{i}") for i, m in enumerate(names)])
    groups = list(itertools.combinations(range(len(names)), min(k, len(names))))
    counts = flags.agg(*[F.sum(F.greatest(*[F.col(f"m{i}") for i in g]) if len(g) > 1 else F.col(f"m{g[0]}")).alias(f"g{j}") for j, g in enumerate(groups)])
    rows = F.array(*[F.struct((-F.col(f"g{j}")).alias("n"), F.array(*[F.lit(names[i]) for i in g]).alias("members")) for j, g in enumerate(groups)])
    return counts.select(F.array_min(rows).alias("m")).select(F.array_join("m.members", "+").alias("members"), (-F.col("m.n")).alias("n"))


def failure_class() -> Column:
    """The class of a failure from counts rejected, profiles, exact and non_elementary."""
    none = F.col("profiles") == 0
    looped = (F.col("exact") == 0) & (F.col("non_elementary") >= F.col("profiles"))
    return F.when(F.col("rejected") > 0, "C_VALIDATION_FAILURE").when(none, "A_NO_PROFILE_FEASIBLE").when(looped, "B_PROFILE_FEASIBLE_BUT_NON_ELEMENTARY").otherwise("D_OTHER")


def mixed_union(runs: DataFrame) -> DataFrame:
    """(box, item, kind): a box's solving runs of any pair type, each item once, the first type by name winning."""
    return runs.where("solved").groupBy("box", "item").agg(F.min("method").alias("kind"))


def register(query, runs, runs_sql: str, routes, routes_sql: str, read) -> None:
    rate = "count(*) FILTER (solved) AS solved, count(*) AS attempted, round(100.0 * count(*) FILTER (solved) / count(*), 6) AS percent"

    @query(f"WITH {runs_sql} SELECT mode, method, {rate} FROM runs GROUP BY 1, 2")
    def agg_success_rate(spark, sf_dir):
        return success(runs(spark, sf_dir), "mode", "method")

    @query(f"WITH {runs_sql}, r AS (SELECT *, count(*) OVER (PARTITION BY method) AS n, row_number() OVER (PARTITION BY method ORDER BY elapsed) AS k FROM runs) SELECT method, count(*) AS n, max(elapsed) FILTER (k = greatest(1, ceil(0.5 * n))) AS median, max(elapsed) FILTER (k = greatest(1, ceil(0.9 * n))) AS p90, max(elapsed) FILTER (k = greatest(1, ceil(0.95 * n))) AS p95, max(elapsed) AS most FROM r GROUP BY 1")
    def agg_time_stats(spark, sf_dir):
        return ranked_times(runs(spark, sf_dir), "method")

    @query(f"WITH {runs_sql} SELECT method, mode, round(quantile_cont(elapsed, 0.5), 4) AS median, round(quantile_cont(elapsed, 0.9), 4) AS p90 FROM runs GROUP BY 1, 2")
    def rep_mixed_timing(spark, sf_dir):
        return runs(spark, sf_dir).groupBy("method", "mode").agg(F.round(F.percentile("elapsed", 0.5), 4).alias("median"), F.round(F.percentile("elapsed", 0.9), 4).alias("p90"))

    @query(f"WITH {runs_sql}, r AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY item) AS tries, sum(elapsed) OVER (PARTITION BY box ORDER BY item ROWS UNBOUNDED PRECEDING) AS spent FROM runs), f AS (SELECT *, row_number() OVER (PARTITION BY box ORDER BY tries) AS k FROM r WHERE solved) SELECT box, CAST(tries AS INTEGER) AS tries, item, round(spent, 2) AS spent FROM f WHERE k = 1")
    def win_running_to_first(spark, sf_dir):
        return first_solved(runs(spark, sf_dir), "box")

    @query(f"WITH {runs_sql} SELECT box, arg_min(method, {{'e': elapsed, 'm': method}}) AS winner, min(elapsed) AS elapsed FROM runs WHERE solved AND method IN ('1-URGENT', '2-HIGH') GROUP BY 1")
    def union2_winner(spark, sf_dir):
        own = runs(spark, sf_dir).where(F.col("solved") & F.col("method").isin("1-URGENT", "2-HIGH"))
        return own.groupBy("box").agg(F.min_by("method", F.struct("elapsed", "method")).alias("winner"), F.min("elapsed").alias("elapsed"))

    #: of a benchmark's boxes, here customers, which methods solved them within time
    some = "s AS (SELECT DISTINCT o_orderpriority AS method, o_custkey AS box FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 40000)"

    def in_time(spark, sf_dir):
        own = read(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice < 40000")
        return own.select(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("box")).distinct()

    @query(f"WITH {runs_sql}, {some}, p AS (SELECT a.method || '+' || b.method AS members, (SELECT count(DISTINCT box) FROM s WHERE s.method IN (a.method, b.method)) AS n FROM (SELECT DISTINCT method FROM s) a, (SELECT DISTINCT method FROM s) b WHERE a.method < b.method) SELECT members, n FROM p ORDER BY n DESC, members LIMIT 1")
    def aud_cover(spark, sf_dir):
        return cover(in_time(spark, sf_dir), 2)

    @query(f"WITH {runs_sql}, {some} SELECT box, string_agg(method, ',' ORDER BY method) AS methods FROM s GROUP BY 1")
    def cover_provenance(spark, sf_dir):
        return in_time(spark, sf_dir).groupBy("box").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"))

    @query("SELECT l_orderkey AS item, CAST(count(*) FILTER (l_linenumber > 5) AS BIGINT) AS rejected, count(*) FILTER (l_quantity > 25) AS profiles, count(*) FILTER (l_quantity > 40) AS exact, count(*) FILTER (l_quantity > 25 AND l_suppkey % 3 = 0) AS non_elementary, CASE WHEN rejected > 0 THEN 'C_VALIDATION_FAILURE' WHEN profiles = 0 THEN 'A_NO_PROFILE_FEASIBLE' WHEN exact = 0 AND non_elementary >= profiles THEN 'B_PROFILE_FEASIBLE_BUT_NON_ELEMENTARY' ELSE 'D_OTHER' END AS class FROM lineitem GROUP BY 1")
    def aud_failure_class(spark, sf_dir):
        """Why an item wasn't solved, from the counts of its profiles."""
        own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.count_if(F.col("l_linenumber") > 5).alias("rejected"), F.count_if(F.col("l_quantity") > 25).alias("profiles"), F.count_if(F.col("l_quantity") > 40).alias("exact"), F.count_if((F.col("l_quantity") > 25) & (F.col("l_suppkey") % 3 == 0)).alias("non_elementary"))
        return own.withColumn("class", failure_class())

    @query(f"WITH {runs_sql} SELECT DISTINCT box, method FROM runs WHERE mode = 'F' AND solved UNION SELECT box, method FROM runs WHERE mode = 'O' AND solved")
    def set_union2(spark, sf_dir):
        own = runs(spark, sf_dir).where("solved")
        return own.where("mode = 'F'").select("box", "method").union(own.where("mode = 'O'").select("box", "method")).distinct()

    @query(f"WITH {runs_sql} SELECT box, method FROM runs WHERE mode = 'F' AND solved EXCEPT SELECT box, method FROM runs WHERE mode = 'P' AND solved")
    def set_mask_diff(spark, sf_dir):
        own = runs(spark, sf_dir).where("solved")
        return own.where("mode = 'F'").select("box", "method").subtract(own.where("mode = 'P'").select("box", "method"))

    @query(f"WITH {runs_sql} SELECT box, item, min(method) AS kind FROM (SELECT box, item, method FROM runs WHERE solved AND mode = 'F' UNION SELECT box, item, method FROM runs WHERE solved AND mode = 'O' UNION SELECT box, item, method FROM runs WHERE solved AND mode = 'P') GROUP BY 1, 2")
    def set_mixed(spark, sf_dir):
        """Boxes solved by the union of all pair types, and by which."""
        return mixed_union(runs(spark, sf_dir))

    @query(f"WITH {runs_sql} SELECT DISTINCT box, method FROM runs WHERE solved AND method IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
    def set_union3(spark, sf_dir):
        own = runs(spark, sf_dir).where("solved")
        first, second, third = (own.where(F.col("method") == m).select("box", "method") for m in ("1-URGENT", "2-HIGH", "3-MEDIUM"))
        return first.union(second).union(third).distinct()

    union = " UNION ALL ".join(map(workloads.boxes_sql, workloads.TEMPLATES))

    @query(f"WITH {routes_sql} {union}")
    def gen_box_templates(spark, sf_dir):
        return workloads.boxes(routes(spark, sf_dir))

    @query(f"WITH {routes_sql} SELECT wmax, pmin, count(*) FILTER (pop_len >= pmin * length AND wid_len <= wmax * length) AS n FROM routes, (VALUES (15), (16), (17), (18), (19)) a(wmax), (VALUES (150), (145), (140)) b(pmin) GROUP BY 1, 2")
    def sens_grid(spark, sf_dir):
        """Routes that pass each of fifteen pairs of bounds: one scan, one conditional count for each."""
        pairs = [(w, p) for w in range(15, 20) for p in (150, 145, 140)]
        own = routes(spark, sf_dir).agg(*[F.count_if((F.col("pop_len") >= p * F.col("length")) & (F.col("wid_len") <= w * F.col("length"))).alias(f"n{w}_{p}") for w, p in pairs])
        return own.select(F.inline(F.array(*[F.struct(F.lit(w).alias("wmax"), F.lit(p).alias("pmin"), F.col(f"n{w}_{p}").alias("n")) for w, p in pairs])))
