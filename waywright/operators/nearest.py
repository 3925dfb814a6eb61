"""The nearest site of every point, by buckets of a grid that coarsens for points whose nearest site is far."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywright.storage import dropped, stored


def _bucket(size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"_{c}") for c in ("x", "y")]


def nearest(points: DataFrame, sites: DataFrame, key: str = "node", site: str = "cell") -> DataFrame:
    """(key, site, d2): the site of least squared distance, of equals the least site. points: (key, x, y), each key once; sites: (site, x, y).

    A site within one bucket's width of a point lies in the bucket of the point or one of the eight around it. So a point
    whose best site there is that near has its answer; the others look again in buckets of twice the width, until one
    holds all. At the first width a bucket has about one site. No sites: no rows."""
    own = stored(sites.select(F.col(site).alias("_site"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "sites")
    left = stored(points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    span = lambda df: df.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    a, b = span(own), span(left)
    if not a["n"] or not b["n"]:
        return points.select(key).limit(0).join(own.select(F.col("_site").alias(site), F.lit(0.0).alias("d2")).limit(0), F.lit(True))
    whole = max(max(a["x1"], b["x1"]) - min(a["x0"], b["x0"]), max(a["y1"], b["y1"]) - min(a["y0"], b["y0"]))
    size = max(math.sqrt(max((a["x1"] - a["x0"]) * (a["y1"] - a["y0"]), 0.0) / a["n"]), whole / 2**20) or 1.0
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> named_struct('i', i, 'j', j))))"))
    parts = []
    while True:
        near = left.select(key, "x", "y", *_bucket(size), around.alias("_o")).select(key, F.col("x").alias("_px"), F.col("y").alias("_py"), (F.col("_x") + F.col("_o.i")).alias("_x"), (F.col("_y") + F.col("_o.j")).alias("_y"))
        d2 = (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")) + (F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py"))
        best = near.join(own.select("*", *_bucket(size)), ["_x", "_y"]).groupBy(key).agg(F.min(F.struct(d2.alias("d2"), "_site")).alias("_m"))
        last = size > whole
        found = stored(best.where(F.lit(last) | (F.col("_m.d2") <= size * size)).select(key, F.col("_m._site").alias(site), F.col("_m.d2").alias("d2")), "nearest")
        parts.append(found)
        before, left = left, stored(left.join(found.select(key), key, "left_anti"), "points")
        dropped(before)
        if last or left.isEmpty():
            break
        size *= 2
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
