"""Routes as arrays, and road tags, as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def runs(values: Column) -> Column:
    """Equal neighbours become one."""
    return F.filter(F.transform(values, lambda v, i: F.struct(v.alias("v"), ((i == 0) | (v != F.get(values, i - 1))).alias("new"))), lambda x: x["new"]).getField("v")


def merge_segments(first: Column, second: Column) -> Column:
    """Two routes, the second beginning where the first ends."""
    return F.concat(first, F.slice(second, 2, F.greatest(F.size(second) - 1, F.lit(0))))


def contains_segment(path: Column, segment: Column) -> Column:
    """Whether segment stands in path without gaps; an empty one does."""
    n = F.size(segment)
    return (n == 0) | ((F.size(path) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(path) - n + 1, F.lit(1))), lambda i: F.slice(path, i, n) == segment))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def repeated_vertices(path: Column) -> Column:
    """How many visits are not the first of their vertex; 0 for an elementary route."""
    return F.size(path) - F.size(F.array_distinct(path))


def road_changes(roads: Column) -> Column:
    """Neighbouring known roads that differ; unknown ones are passed over."""
    known = F.filter(roads, lambda r: r.isNotNull() & (r >= 0))
    return F.greatest(F.size(runs(known)) - 1, F.lit(0))


def known_road(road: Column) -> Column:
    return F.when(road >= 0, road)


def roads_of(roads: Column) -> Column:
    """(first, last, changes) of a list of roads, unknown ones passed over: the fold of append_road."""
    start = F.struct(F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(0).alias("changes"))
    return F.aggregate(roads, start, append_road)


def append_road(own: Column, road: Column) -> Column:
    """(first, last, changes) with one more road at the end."""
    known = known_road(road)
    turn = F.coalesce((own["last"] != known).cast("int"), F.lit(0))
    return F.struct(F.coalesce(own["first"], known).alias("first"), F.coalesce(known, own["last"]).alias("last"), (own["changes"] + turn).alias("changes"))


def prepend_road(own: Column, road: Column) -> Column:
    """(first, last, changes) with one more road in front."""
    known = known_road(road)
    turn = F.coalesce((own["first"] != known).cast("int"), F.lit(0))
    return F.struct(F.coalesce(known, own["first"]).alias("first"), F.coalesce(own["last"], known).alias("last"), (own["changes"] + turn).alias("changes"))


def join_roads(a: Column, b: Column) -> Column:
    """(first, last, changes) of one route after another."""
    turn = F.coalesce((a["last"] != b["first"]).cast("int"), F.lit(0))
    return F.struct(F.coalesce(a["first"], b["first"]).alias("first"), F.coalesce(b["last"], a["last"]).alias("last"), (a["changes"] + b["changes"] + turn).alias("changes"))


def parse_osmid(text: Column) -> Column:
    """Whole numbers in a text such as 12, [12, 13] or 12;13; other parts are passed over."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"[\[\]()]", ""), r"[;,\s]+"), lambda t: t.rlike(r"^-?\d+$")), lambda t: t.cast("long"))


def norm_tag(tag: Column) -> Column:
    """First of a list of tags, trimmed; empty for none."""
    return F.trim(F.coalesce(F.get(tag, F.lit(0)), F.lit("")))


def road_key(ref: Column, name: Column, highway: Column) -> Column:
    """(reference, else name, else a mark for none; kind of road)."""
    first = F.coalesce(F.nullif(norm_tag(ref), F.lit("")), F.nullif(norm_tag(name), F.lit("")), F.lit("__noname__"))
    return F.struct(first.alias("road"), norm_tag(highway).alias("highway"))


def loop_erase(path: Column | str) -> Column:
    """A route with every loop cut at its first repeated vertex: a vertex met again takes back what came after it."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(path, none, lambda out, v: F.when(F.array_contains(out, v), F.slice(out, F.lit(1), F.array_position(out, v).cast("int"))).otherwise(F.concat(out, F.array(v))))
