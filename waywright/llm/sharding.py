"""Sharding by proportional stratified interleaving, with DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank (rank + offset) / rows of the
source spreads every source evenly over (0, 1), where offset is a hash of the source, so that sources of one row don't meet
in one place; all rows are sorted by it and cut into equal runs. So each shard holds its share of every source, and shard
sizes in rows differ by one at most. Equal texts are dealt like any others: the law is about rows, not groups of copies.

No rank is taken over a whole source or table. Hash and fraction are cut into buckets of about ROWS rows; counts by
bucket, summed up, give each bucket's offset, and rows are numbered within buckets only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywright.llm.common import staged

ROWS = 1000
GROUP = 1000


def offsets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(keys, bucket, before, total): rows of the same keys in lower buckets, and in all. Two levels keep windows short."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n")).withColumn("_group", F.expr(f"{bucket} div {GROUP}"))
    counts = staged(counts, "bucket-counts")
    groups = counts.groupBy(*keys, "_group").agg(F.sum("_n").alias("_g"))
    own = Window.partitionBy(*keys)
    ran = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_group").alias("_at"), (F.sum("_g").over(own.orderBy("_group")) - F.col("_g")).alias("_first"), F.sum("_g").over(own).alias("_total"))
    near = F.sum("_n").over(Window.partitionBy(*keys, "_group").orderBy(bucket)) - F.col("_n")
    same = F.col("_group") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return counts.withColumn("_near", near).join(ran, same).select(*keys, bucket, (F.col("_first") + F.col("_near")).alias("before"), F.col("_total").alias("total"))


def interleave(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    law is `rows`: shard sizes differ by one row at most. slot numbers a shard's rows from 0 in training order;
    grown_shard is null under this law. Null texts have size 1 and checksum 0; rows without a source form a source of
    their own; equal rows are told apart by nothing, so any order of them is the same result. Texts
    of any length count by their size only. An empty table gives an
    empty result; further columns of docs aren't read.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    rows = staged(base.withColumn("draw", F.xxhash64(F.lit(seed), "id", "crc")), "shard-rows")
    n = rows.count()
    buckets = n // ROWS + 1
    rows = rows.withColumn("bucket", F.expr(f"(shiftrightunsigned(draw, 33) * {buckets}L) div {1 << 31}L"))
    first = offsets(rows, ["source"], "bucket").select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "before", "total")
    within = F.row_number().over(Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("draw", 33), "draw", "id", "crc"))
    ranked = rows.withColumn("within", within).join(first, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    offset = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "source"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    part = (F.col("before") + F.col("within") - offset) / F.col("total")
    spread = staged(ranked.select("id", "size", "crc", "draw", F.xxhash64(F.lit(seed), "source").alias("tie"), part.alias("part")).withColumn("run", F.floor(F.col("part") * buckets)), "shard-ranks")
    second = offsets(spread, [], "run").select(F.col("run").alias("_run"), "before")
    at = F.row_number().over(Window.partitionBy("run").orderBy("part", "tie", "draw", "id", "crc"))
    placed = spread.withColumn("within", at).join(second, F.col("run") == F.col("_run")).withColumn("at", F.col("before") + F.col("within") - 1)
    shard = F.expr(f"(at * {shards}L) div {max(n, 1)}L")
    start = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("at") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
