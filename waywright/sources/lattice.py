"""A deterministic road lattice derived from the `part` table: nodes, directed edges, seeds and a query box."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywright.storage import ship, stored

SEEDS = 7
BLOCK_NODES = 65_536  # ids of a block of nodes

#: The same lattice for DuckDB, as the head of a WITH clause.
SQL = f"""
n_ AS (SELECT count(*) AS n, CAST(floor(sqrt(CAST(count(*) AS DOUBLE))) AS BIGINT) AS w FROM part),
nodes AS (SELECT p_partkey AS id, p_partkey % w AS cx, p_partkey // w AS cy, CAST(floor(p_retailprice * 10) AS BIGINT) % 120 AS elev,
  100 * (p_partkey % w) + p_size AS x_m, 100 * (p_partkey // w) + (p_partkey * 13) % 50 AS y_m FROM part, n_),
cand AS (SELECT a.id AS u, b.id AS v, a.cy AS road_id FROM nodes a JOIN nodes b ON b.id = a.id + 1, n_ WHERE a.cx + 1 < w
  UNION ALL SELECT a.id, b.id, 100000 + a.cx FROM nodes a, n_, nodes b WHERE b.id = a.id + w),
both_ AS (SELECT * FROM cand UNION ALL SELECT v, u, road_id FROM cand),
edges AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS edge_id, u, v, CAST(100 + (u * 7919 + v * 104729) % 61 AS DOUBLE) AS length,
  CAST(greatest(0, b.elev - a.elev) AS DOUBLE) AS gain, CAST((u * 31 + v * 17) % 256 AS DOUBLE) AS popularity,
  CAST(5 + (u * 37 + v * 41) % 21 AS DOUBLE) AS width, road_id
  FROM both_ JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE (u * 7919 + v * 6101) % 23 <> 0),
seeds AS (SELECT i AS cell, (i * n) // {SEEDS} AS node FROM n_, range({SEEDS}) t(i))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cx, cy, elev, x_m, y_m); the width of the lattice is a scalar subquery over the table's count."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice", "p_size")
    size = part.agg(F.floor(F.sqrt(F.count("*").cast("double"))).alias("w"))
    own = part.crossJoin(F.broadcast(size))  # one row
    key = F.col("p_partkey")
    return own.select(
        key.alias("id"), (key % F.col("w")).alias("cx"), F.expr("p_partkey div w").alias("cy"), (F.floor(F.col("p_retailprice") * 10) % 120).alias("elev"),
        (100 * (key % F.col("w")) + F.col("p_size")).alias("x_m"), (100 * F.expr("p_partkey div w") + (key * 13) % 50).alias("y_m"), "w",
    )


_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table made from a folder's, stored once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = stored(make(spark, sf_dir), name)
    return _kept[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """made_edges, stored once for each application and folder."""
    return kept(spark, sf_dir, "lattice", made_edges)


def _rows(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's nodes and those beside them: its own ones, places of their neighbours by id, which of these lead an edge, and climbs."""
    frame = frame.sort_values("id", ignore_index=True)
    ids, elev = frame["id"].to_numpy(), frame["elev"].to_numpy(float)
    inner = np.nonzero(frame["own"].to_numpy(bool))[0]
    own = frame.iloc[inner]
    u, cx, w = (own[c].to_numpy()[:, None] for c in ("id", "cx", "w"))
    one = np.ones_like(w)
    v = u + np.concatenate([-w, -one, one, w], 1)  # by id
    at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
    leads = (ids[at] == v) & ((u * 7919 + v * 6101) % 23 != 0)
    leads[:, 1:3] &= np.concatenate([cx > 0, cx + 1 < w], 1)
    return own, v, leads, np.fmax(0.0, elev[at] - elev[inner][:, None])


def _counted(key, frame):
    return pd.DataFrame({"block": [key[0]], "n": [int(_rows(frame)[2].sum())]})


def _numbered(before: dict[int, int]):
    def run(key, frame):
        own, v, leads, gain = _rows(frame)
        at, side = np.nonzero(leads)
        road = np.where((side == 0) | (side == 3), 100_000 + own["cx"].to_numpy()[at], own["cy"].to_numpy()[at])
        return pd.DataFrame({"edge_id": before[int(key[0])] + np.arange(len(at)), "u": own["id"].to_numpy()[at], "v": v[at, side], "gain": gain[at, side], "road_id": road})

    return run


def made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_id, u, v, length, gain, popularity, width, road_id), numbered by (u, v).

    Nodes are dealt to blocks by ranges of their ids, with those of other blocks that are beside them: blocks find and count their
    edges by themselves, and nothing is joined or sorted as a whole.
    """
    ship(spark)
    key = F.col("id")
    beside = F.array_distinct(F.array(*[F.expr(f"(id + {step}) div {BLOCK_NODES}") for step in ("0", "1", "-1", "w", "-w")]))
    dealt = nodes(spark, sf_dir).where(key.isNotNull()).select("id", "cx", "cy", "elev", "w", F.explode(beside).alias("block"))
    blocks = dealt.withColumn("own", F.col("block") == F.expr(f"id div {BLOCK_NODES}")).groupBy("block")
    before, number = {}, 0
    for r in sorted(blocks.applyInPandas(_counted, "block long, n long").collect()):  # a row for each block
        before[r["block"]], number = number, number + r["n"]
    u, v = F.col("u"), F.col("v")
    return blocks.applyInPandas(_numbered(before), "edge_id long, u long, v long, gain double, road_id long").select(
        "edge_id", "u", "v", (100 + (u * 7919 + v * 104729) % 61).cast("double").alias("length"), "gain",
        ((u * 31 + v * 17) % 256).cast("double").alias("popularity"), (5 + (u * 37 + v * 41) % 21).cast("double").alias("width"), "road_id",
    )


def seeds(spark: SparkSession, sf_dir: str, k: int = SEEDS) -> DataFrame:
    """(cell, node)."""
    count = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"))
    return count.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "n").select(F.col("i").cast("long").alias("cell"), F.expr(f"(i * n) div {k}").alias("node"))
