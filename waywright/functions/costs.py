"""Edge costs, boxes and scores as Column factories."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-9


@dataclass(frozen=True)
class Box:
    """Bounds of a query; lengths and climbs on both sides, popularity from below, width from above."""

    name: str
    source: int
    target: int
    Lmin: float
    Lmax: float
    Hmin: float
    Hmax: float
    Pmin: float
    Wmax: float


@dataclass(frozen=True)
class Spec:
    """An edge cost: its family and parameters."""

    name: str
    family: str
    params: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Mix:
    """A cost between two specs': share of the second's, the rest of the first's."""

    name: str
    first: Spec
    second: Spec
    share: float


def portfolio(box: Box) -> list[Spec]:
    """The thirty fixed specs. R stands for the box's own references."""
    R = {"Wref": box.Wmax, "Pref": box.Pmin}
    # Names, families and parameters of the portfolio.
    rows = [
        ("shortest_length", "physical_length", {}),
        ("pop_width_reference", "hinge", {"L": 1, "w": 3, "p": 2, **R}),
        ("hinge_width_strong", "hinge", {"L": 1, "w": 8, "p": 2, **R}),
        ("hinge_width_very_strong", "hinge", {"L": 1, "w": 14, "p": 2, **R}),
        ("hinge_pop_strong", "hinge", {"L": 1, "w": 3, "p": 8, **R}),
        ("hinge_pop_very_strong", "hinge", {"L": 1, "w": 3, "p": 14, **R}),
        ("hinge_balanced_strong", "hinge", {"L": 1, "w": 8, "p": 8, **R}),
        ("hinge_low_length_pressure", "hinge", {"L": 0.35, "w": 5, "p": 5, **R}),
        ("hinge_medium_length_pressure", "hinge", {"L": 1.75, "w": 5, "p": 5, **R}),
        ("hinge_high_length_pressure", "hinge", {"L": 4, "w": 5, "p": 5, **R}),
        ("width_linear_mild", "width_linear", {"L": 1, "w": 0.35, "p": 0, **R}),
        ("width_linear_strong", "width_linear", {"L": 1, "w": 1.25, "p": 1.5, **R}),
        ("pop_complement_mild", "pop_complement", {"L": 1, "pop": 0.5, "w": 0, **R}),
        ("pop_complement_strong", "pop_complement", {"L": 1, "pop": 2.5, "w": 2, **R}),
        ("low_elevation_mild", "low_elevation", {"L": 1, "h": 1.5, **R}),
        ("low_elevation_strong", "low_elevation", {"L": 1, "h": 6, **R}),
        ("low_elevation_with_width_pop", "low_elevation", {"L": 1, "h": 2, "w": 3, "p": 2, **R}),
        ("high_elevation_weak_length", "high_elevation", {"L": 0.05, "H": 4, **R}),
        ("high_elevation_medium_length", "high_elevation", {"L": 0.35, "H": 4, **R}),
        ("high_elevation_strong_length", "high_elevation", {"L": 1.25, "H": 4, **R}),
        ("high_elevation_width", "high_elevation", {"L": 0.25, "H": 5, "w": 4, **R}),
        ("high_elevation_pop", "high_elevation", {"L": 0.25, "H": 5, "p": 4, **R}),
        ("high_elevation_width_pop", "high_elevation", {"L": 0.25, "H": 5, "w": 4, "p": 4, **R}),
        ("slope_inverse_beta_5", "slope_inverse", {"beta": 5, **R}),
        ("slope_inverse_beta_12_width_pop", "slope_inverse", {"beta": 12, "w": 3, "p": 2, **R}),
        ("slope_exp_beta_150_width", "slope_exp", {"beta": 150, "w": 1, **R}),
        ("slope_exp_beta_250_width_pop_light", "slope_exp", {"beta": 250, "w": 1, "p": 0.05, **R}),
        ("slope_exp_beta_8", "slope_exp", {"beta": 8, **R}),
        ("slope_exp_beta_400_width_light", "slope_exp", {"beta": 400, "w": 0.25, **R}),
        ("slope_exp_beta_16_width_pop", "slope_exp", {"beta": 16, "w": 3, "p": 3, **R}),
    ]
    return [Spec(*r) for r in rows]


def specs_frame(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """(spec, family, params): as many rows as the caller's list."""
    rows = F.array(*[F.struct(F.lit(s.name).alias("spec"), F.lit(s.family).alias("family"), F.create_map(*[x for k, v in (s.params or {"L": 1}).items() for x in (F.lit(k), F.lit(float(v)))]).alias("params")) for s in specs])
    return spark.range(1).select(F.inline(rows))


def cost(length="length", gain="gain", popularity="popularity", width="width", family="family", params="params", rho="rho", pstar="pstar") -> Column:
    """Cost of an edge under (family, params). rho: just over the steepest slope; pstar: the highest popularity."""
    l, g, pop, wid = (F.col(x) for x in (length, gain, popularity, width))

    def p(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.element_at(F.col(params), name), F.lit(default))

    wref, pref = p("Wref"), p("Pref")
    wscale, pscale = F.greatest(F.abs(wref), F.lit(1.0)), F.greatest(F.abs(pref), F.lit(1.0))
    over, under = F.greatest(F.lit(0.0), wid - wref), F.greatest(F.lit(0.0), pref - pop)
    hinge = l * (p("w") * over / wscale + p("p") * under / pscale)
    base = p("L", 1.0) * l
    slope = F.greatest(F.lit(0.0), g / l)
    out = (
        F.when(F.col(family) == "physical_length", l)
        .when(F.col(family) == "hinge", base + hinge)
        .when(F.col(family) == "low_elevation", base + p("h") * g + hinge)
        .when(F.col(family) == "high_elevation", base + p("H") * F.greatest(F.lit(0.0), F.col(rho) * l - g) + hinge)
        .when(F.col(family) == "pop_complement", base + p("pop") * l * F.greatest(F.lit(0.0), F.col(pstar) - pop) / F.greatest(F.col(pstar), F.lit(1.0)) + p("w") * l * over / wscale)
        .when(F.col(family) == "width_linear", base + p("w") * l * F.greatest(wid, F.lit(0.0)) / wscale + hinge)
        .when(F.col(family) == "slope_inverse", l / (1 + p("beta") * slope) + hinge)
        .when(F.col(family) == "slope_exp", l * F.exp(-p("beta") * slope) + hinge)
    )
    sound = out.isNotNull() & ~F.isnan(out) & (out >= -EPS)
    return F.when(sound, F.greatest(out, F.lit(0.0))).otherwise(F.raise_error(F.lit("edge cost isn't finite or is negative")).cast("double"))


PARAMS = ("L", "w", "p", "h", "H", "pop", "beta", "Wref", "Pref")


def spec_rows(specs: list[Spec]) -> Column:
    """An array with a struct for each spec: spec, _family, and its parameters as _L, _w, ...; constants, so it is one literal."""
    value = lambda s, n: float(s.params.get(n, 1.0 if n == "L" else 0.0))
    return F.array(*[F.struct(F.lit(s.name).alias("spec"), F.lit(s.family).alias("_family"), *[F.lit(value(s, n)).alias(f"_{n.lower()}_{n.isupper():d}") for n in PARAMS]) for s in specs])


def _families(p, rho: float, pstar: float) -> dict[str, Column]:
    """The cost of each family; p(name) is a parameter."""
    l, g, pop, wid = (F.col(x) for x in ("length", "gain", "popularity", "width"))
    wscale, pscale = F.greatest(F.abs(p("Wref")), F.lit(1.0)), F.greatest(F.abs(p("Pref")), F.lit(1.0))
    over, under = F.greatest(F.lit(0.0), wid - p("Wref")), F.greatest(F.lit(0.0), p("Pref") - pop)
    hinge = l * (p("w") * over / wscale + p("p") * under / pscale)
    slope = F.greatest(F.lit(0.0), g / l)
    return {
        "physical_length": l,
        "hinge": p("L") * l + hinge,
        "low_elevation": p("L") * l + p("h") * g + hinge,
        "high_elevation": p("L") * l + p("H") * F.greatest(F.lit(0.0), rho * l - g) + hinge,
        "pop_complement": p("L") * l + p("pop") * l * F.greatest(F.lit(0.0), pstar - pop) / max(pstar, 1.0) + p("w") * l * over / wscale,
        "width_linear": p("L") * l + p("w") * l * F.greatest(wid, F.lit(0.0)) / wscale + hinge,
        "slope_inverse": l / (1 + p("beta") * slope) + hinge,
        "slope_exp": l * F.exp(-p("beta") * slope) + hinge,
    }


def row_cost(rho: float, pstar: float) -> Column:
    """cost() of an edge beside a row of spec_rows: an expression for each family, whatever the number of specs."""
    out = F.lit(None).cast("double")
    for name, own in _families(lambda n: F.col(f"_{n.lower()}_{n.isupper():d}"), rho, pstar).items():
        out = F.when(F.col("_family") == name, own).otherwise(out)
    return out


def spec_cost(spec: Spec | Mix, rho: float, pstar: float) -> Column:
    """cost() of one spec as an expression of columns length, gain, popularity and width."""
    if isinstance(spec, Mix):
        return (1 - spec.share) * spec_cost(spec.first, rho, pstar) + spec.share * spec_cost(spec.second, rho, pstar)
    return checked(_families(lambda n: F.lit(float(spec.params.get(n, 1.0 if n == "L" else 0.0))), rho, pstar)[spec.family])


def checked(out: Column) -> Column:
    """A cost that is finite and not negative but for rounding; else an error."""
    sound = out.isNotNull() & ~F.isnan(out) & (out >= -EPS) & (out < float("inf"))
    return F.when(sound, F.greatest(out, F.lit(0.0))).otherwise(F.raise_error(F.lit("edge cost isn't finite or is negative")).cast("double"))


def price(spec: Spec | Mix, edges: dict[str, np.ndarray], rho: float, pstar: float) -> np.ndarray:
    """cost() of one spec over arrays length, gain, popularity and width."""
    if isinstance(spec, Mix):
        return (1 - spec.share) * price(spec.first, edges, rho, pstar) + spec.share * price(spec.second, edges, rho, pstar)
    l, g, pop, wid = (edges[c] for c in ("length", "gain", "popularity", "width"))
    p = lambda name, default=0.0: float(spec.params.get(name, default))
    wscale, pscale = max(abs(p("Wref")), 1.0), max(abs(p("Pref")), 1.0)
    over, under = np.maximum(0.0, wid - p("Wref")), np.maximum(0.0, p("Pref") - pop)
    hinge = l * (p("w") * over / wscale + p("p") * under / pscale)
    base = p("L", 1.0) * l
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.maximum(0.0, g / l)
        out = {
            "physical_length": lambda: l,
            "hinge": lambda: base + hinge,
            "low_elevation": lambda: base + p("h") * g + hinge,
            "high_elevation": lambda: base + p("H") * np.maximum(0.0, rho * l - g) + hinge,
            "pop_complement": lambda: base + p("pop") * l * np.maximum(0.0, pstar - pop) / max(pstar, 1.0) + p("w") * l * over / wscale,
            "width_linear": lambda: base + p("w") * l * np.maximum(wid, 0.0) / wscale + hinge,
            "slope_inverse": lambda: l / (1 + p("beta") * slope) + hinge,
            "slope_exp": lambda: l * np.exp(-p("beta") * slope) + hinge,
        }[spec.family]()
    if not (np.isfinite(out) & (out >= -EPS)).all():
        raise ValueError("edge cost isn't finite or is negative")
    return np.maximum(out, 0.0)


#: The same cost for DuckDB, over columns of edges e, specs s (family and one column for each parameter) and constants c.
COST_SQL = """CASE family WHEN 'physical_length' THEN length
 WHEN 'hinge' THEN L * length + hinge WHEN 'low_elevation' THEN L * length + h * gain + hinge
 WHEN 'high_elevation' THEN L * length + H2 * greatest(0, rho * length - gain) + hinge
 WHEN 'pop_complement' THEN L * length + pop * length * greatest(0, pstar - popularity) / greatest(pstar, 1) + w * length * greatest(0, width - Wref) / greatest(abs(Wref), 1)
 WHEN 'width_linear' THEN L * length + w * length * width / greatest(abs(Wref), 1) + hinge
 WHEN 'slope_inverse' THEN length / (1 + beta * greatest(0, gain / length)) + hinge
 WHEN 'slope_exp' THEN length * exp(-beta * greatest(0, gain / length)) + hinge END"""


def specs_sql(specs: list[Spec]) -> str:
    """VALUES for DuckDB: name, family and parameters."""
    names = ("L", "w", "p", "h", "H", "pop", "beta", "Wref", "Pref")
    rows = ", ".join("('" + s.name + "', '" + s.family + "', " + ", ".join(repr(float(s.params.get(n, 1 if n == "L" else 0))) for n in names) + ")" for s in specs)
    return f"specs(spec, family, L, w, p, h, H2, pop, beta, Wref, Pref) AS (VALUES {rows})"


def route_vector(length="length", gain="gain", pop_len="pop_len", wid_len="wid_len") -> list[Column]:
    """length, climb, mean popularity and mean width; means of an empty route are 0."""
    l = F.col(length)
    return [l.alias("L"), F.col(gain).alias("H"), F.when(l > 0, F.col(pop_len) / l).otherwise(F.lit(0.0)).alias("P"), F.when(l > 0, F.col(wid_len) / l).otherwise(F.lit(0.0)).alias("W")]


def feasible_mul(box: Box, length="length", gain="gain", pop_len="pop_len", wid_len="wid_len") -> Column:
    """Box predicate without division: an empty route passes the means."""
    l, h = F.col(length), F.col(gain)
    return l.between(box.Lmin, box.Lmax) & h.between(box.Hmin, box.Hmax) & (F.col(pop_len) >= box.Pmin * l) & (F.col(wid_len) <= box.Wmax * l)


def feasible_div(box: Box, l="L", h="H", p="P", w="W") -> Column:
    """Box predicate on means; an empty route's means are 0."""
    return F.col(l).between(box.Lmin, box.Lmax) & F.col(h).between(box.Hmin, box.Hmax) & (F.col(p) >= box.Pmin) & (F.col(w) <= box.Wmax)


def hopeless(box: Box, l="L", h="H") -> Column:
    """A partial route that no continuation brings back: too long, or too much climb. Means may still change."""
    return (F.col(l) > box.Lmax) | (F.col(h) > box.Hmax)


KINDS = ("L_low", "L_high", "H_low", "H_high", "P_low", "W_high")


def violations(box: Box) -> list[Column]:
    """Six one-sided violations of (L, H, P, W), in the order of KINDS."""
    pairs = [(box.Lmin, F.col("L"), 1), (box.Lmax, F.col("L"), -1), (box.Hmin, F.col("H"), 1), (box.Hmax, F.col("H"), -1), (box.Pmin, F.col("P"), 1), (box.Wmax, F.col("W"), -1)]
    return [F.greatest(F.lit(0.0), sign * (F.lit(float(bound)) - value)) for bound, value, sign in pairs]


def scales(box: Box) -> list[float]:
    """What a violation is divided by: the box's width for length and climb, the threshold for means; 1 at least."""
    wide, high = max(box.Lmax - box.Lmin, 1.0), max(box.Hmax - box.Hmin, 1.0)
    return [wide, wide, high, high, max(box.Pmin, 1.0), max(box.Wmax, 1.0)]


def violation_score(box: Box) -> Column:
    return F.greatest(*[v / s for v, s in zip(violations(box), scales(box), strict=True)])


def violation_key(box: Box, pop_high: float, width_low: float) -> Column:
    """What routes are ordered by: sum, largest and number of the scaled violations, the six, then length, climb, high
    popularity and width. Here means are scaled by the width of their range too."""
    wide = [max(box.Lmax - box.Lmin, 1.0)] * 2 + [max(box.Hmax - box.Hmin, 1.0)] * 2 + [max(pop_high - box.Pmin, 1.0), max(box.Wmax - width_low, 1.0)]
    parts = [F.round(v / s, 9) for v, s in zip(violations(box), wide, strict=True)]
    total = sum(parts[1:], parts[0])
    count = sum(((p > 0).cast("int") for p in parts[1:]), (parts[0] > 0).cast("int"))
    return F.struct(F.round(total, 8).alias("total"), F.greatest(*parts).alias("most"), count.alias("broken"), *[p.alias(k) for p, k in zip(parts, KINDS, strict=True)], F.col("L").alias("l"), F.col("H").alias("h"), (-F.round("P", 9)).alias("p"), F.round("W", 9).alias("w"))


def dominant_violation(box: Box) -> Column:
    """The first kind of the largest scaled violation; null if nothing is violated."""
    own = F.array(*[v / s for v, s in zip(violations(box), scales(box), strict=True)])
    top = F.array_max(own)
    return F.when(top > 0, F.element_at(F.array(*map(F.lit, KINDS)), F.array_position(own, top).cast("int")))


def box_center(box: Box) -> Column:
    """Largest distance from the box's centre, scaled to its half widths; popularity up to 255, or just over a higher
    threshold, and width from 5, or just under a lower one."""
    bounds = [("L", box.Lmin, box.Lmax), ("H", box.Hmin, box.Hmax), ("P", box.Pmin, max(255.0, box.Pmin + 1)), ("W", min(5.0, box.Wmax - 1), box.Wmax)]
    return F.greatest(*[F.abs(F.col(c) - (lo + hi) / 2) / max((hi - lo) / 2, 1.0) for c, lo, hi in bounds])


def box_center_of_sums(box: Box) -> Column:
    """box_center of columns length, gain, pop_len and wid_len."""
    l = F.col("length")
    mean = lambda c: F.when(l > 0, F.col(c) / l).otherwise(F.lit(0.0))
    bounds = [(l, box.Lmin, box.Lmax), (F.col("gain"), box.Hmin, box.Hmax), (mean("pop_len"), box.Pmin, max(255.0, box.Pmin + 1)), (mean("wid_len"), min(5.0, box.Wmax - 1), box.Wmax)]
    return F.greatest(*[F.abs(c - (lo + hi) / 2) / max((hi - lo) / 2, 1.0) for c, lo, hi in bounds])


def chebyshev(lower: list[float], upper: list[float], weights: list[float], columns=("L", "H", "P", "W")) -> Column:
    """Weighted largest distance from the middle; a range of no width counts nothing."""
    parts = []
    for c, lo, hi, w in zip(columns, lower, upper, weights, strict=True):
        half = (hi - lo) / 2
        parts.append(F.lit(0.0) if half <= 1e-12 else w * F.abs(F.col(c) - (lo + hi) / 2) * (1 / half))
    return F.greatest(*parts)
