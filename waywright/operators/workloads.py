"""Workloads of a benchmark: query boxes around witness routes, pairs of far nodes, choice of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Of each template its category, whether its bounds conflict on purpose, and its pads. A pad of length or climb
# is the larger of a least value and a share; those of popularity and width are plain.
TEMPLATES = {
    "loose": ("LOOSE_CONTROL", False, (1000, 0.14), (1000, 0.14), (90, 0.30), (90, 0.30), 35, 3.5),
    "multi_tight": ("MULTI_TIGHT", False, (180, 0.035), (220, 0.040), (18, 0.075), (22, 0.085), 6, 0.75),
    "l_low_h_low": ("L_LOW_AND_H_LOW", True, (90, 0.010), (1800, 0.10), (4, 0.018), (90, 0.24), 25, 2.2),
    "width_active": ("WIDTH_ACTIVE", False, (1500, 0.10), (3000, 0.16), (80, 0.25), (140, 0.35), 30, 0.35),
    "pop_active": ("POP_ACTIVE", False, (1500, 0.10), (3000, 0.16), (80, 0.25), (140, 0.35), 3, 2.2),
    "quality_conflict": ("QUALITY_CONFLICT", False, (1200, 0.08), (2500, 0.13), (70, 0.18), (130, 0.28), 4, 0.55),
    "h_high_active": ("H_HIGH_ACTIVE", False, (1300, 0.09), (2400, 0.13), (140, 0.45), (8, 0.025), 22, 2.0),
    "l_high_active": ("L_HIGH_ACTIVE", False, (1800, 0.12), (90, 0.018), (90, 0.25), (140, 0.35), 24, 2.3),
}


def boxes(witnesses: DataFrame) -> DataFrame:
    """Eight query boxes around each witness (L, H, P, W), clamped so that it stays within them."""
    L, H, P, W = (F.col(c) for c in "LHPW")
    climb = F.greatest(H, F.lit(1.0))
    pad = lambda least, share, of: F.greatest(F.lit(float(least)), share * of)

    def box(name: str) -> Column:
        category, deliberate, l0, l1, h0, h1, p, w = TEMPLATES[name]
        bounds = {
            "Lmin": F.greatest(F.lit(0.0), F.least(L - pad(*l0, L), L - 1e-3)),
            "Lmax": F.greatest(L + pad(*l1, L), L + 1e-3),
            "Hmin": F.greatest(F.lit(0.0), F.least(H - pad(*h0, climb), H - 1e-3)),
            "Hmax": F.greatest(H + pad(*h1, climb), H + 1e-3),
            "Pmin": F.least(F.greatest(F.lit(0.0), P - float(p)), P - 1e-6),
            "Wmax": F.greatest(W + float(w), W + 1e-6),
        }
        tight = "loose" if name == "loose" else "tight"
        return F.struct(F.lit(name).alias("template"), F.lit(category).alias("category"), F.lit(tight).alias("tightness"), F.lit(deliberate).alias("deliberate"), *[F.round(b, 6).alias(k) for k, b in bounds.items()])

    return witnesses.select("route", F.inline(F.array(*map(box, TEMPLATES))))


def longest(length: float) -> float:
    """The highest Lmax of a box around a witness of at most length."""
    return max(length + max(least, share * length) for _, _, _, (least, share), *_ in TEMPLATES.values()) + 1e-3


def boxes_sql(name: str) -> str:
    """One template for DuckDB, over routes (route, L, H, P, W)."""
    category, deliberate, l0, l1, h0, h1, p, w = TEMPLATES[name]
    pad = lambda x, of: f"greatest({float(x[0])}, {x[1]} * {of})"
    climb = "greatest(H, 1.0)"
    bounds = {
        "Lmin": f"greatest(0.0, least(L - {pad(l0, 'L')}, L - 1e-3))", "Lmax": f"greatest(L + {pad(l1, 'L')}, L + 1e-3)",
        "Hmin": f"greatest(0.0, least(H - {pad(h0, climb)}, H - 1e-3))", "Hmax": f"greatest(H + {pad(h1, climb)}, H + 1e-3)",
        "Pmin": f"least(greatest(0.0, P - {p}), P - 1e-6)", "Wmax": f"greatest(W + {w}, W + 1e-6)",
    }
    return f"SELECT route, '{name}' AS template, '{category}' AS category, '{'loose' if name == 'loose' else 'tight'}' AS tightness, {str(deliberate).lower()} AS deliberate, " + ", ".join(f"round({b}, 6) AS {k}" for k, b in bounds.items()) + " FROM routes"


def far_pairs(nodes: DataFrame, sources: list[int], far: int = 3) -> DataFrame:
    """(source, target, d2): each of a benchmark's sampled sources with the far nodes that lie furthest from it, of equals the
    lower ids. Every source is held against all nodes; a task keeps its best only."""
    at = {r["id"]: (r["x"], r["y"]) for r in nodes.where(F.col("id").isin(sources)).collect()}  # the sources
    out = None
    for source, (x, y) in sorted(at.items()):
        d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
        own = nodes.where(F.col("id") != source).select(F.lit(source).cast("long").alias("source"), F.col("id").alias("target"), d2.alias("d2")).orderBy(F.desc("d2"), "target").limit(far)
        out = own if out is None else out.union(own)
    return out


def pairs_in_range(pairs: DataFrame, lengths: DataFrame, least: float, most: float) -> DataFrame:
    """pairs (source, target) whose shortest length (source, target, dist) lies in a range; unconnected pairs go."""
    return pairs.join(lengths, ["source", "target"]).where(F.col("dist").between(least, most))


def choose_items(items: DataFrame, most: int) -> DataFrame:
    """(pair, item, place): of each pair at most most items (item, category, tightness, deliberate): one loose first, then the
    deliberate ones, then one of each category in turn, by item."""
    turn = F.row_number().over(Window.partitionBy("pair", "category").orderBy("item"))
    loose = F.row_number().over(Window.partitionBy("pair", "tightness").orderBy("item"))
    own = items.withColumn("turn", turn).withColumn("loose", (F.col("tightness") == "loose") & (loose == 1))
    order = Window.partitionBy("pair").orderBy(F.desc("loose"), F.desc("deliberate"), "turn", "category", "item")
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("pair", "item", "place")
