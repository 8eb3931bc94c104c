"""Dempster-Shafer evidence over {consistent, conflict}: a mass is a struct c, f, u."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIRM, REFUTE, CONFLICT, TAU, OCR_TRUST, MASK_GAIN, SIGMA = 0.60, 0.40, 0.70, 5.0, 0.8, 2.0, 0.1


def mass(c, f, u) -> Column:
    d = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(d(c).alias("c"), d(f).alias("f"), d(u).alias("u"))


def support(p: Column) -> Column:
    return mass(p, 0.0, 1 - p)


def opposed(p: Column) -> Column:
    return mass(p, 1 - p, 0.0)


def unit(p: Column) -> Column:
    """p held between 0 and 1; null stays null."""
    return F.when(p < 0, 0.0).when(p > 1, 1.0).otherwise(p)


#: Mass of one piece of evidence by its kind; shares are held between 0 and 1.
FACTORIES = {
    "ocr": lambda conf: support(unit(conf) * OCR_TRUST),
    "color": lambda delta: opposed(F.exp(-delta / TAU)),
    "detect": lambda conf: support(unit(conf)),
    "segment": lambda share: support(unit(unit(share) * MASK_GAIN)),
    "saliency": lambda score: support(unit(score)),
    "depth": lambda gap: opposed(1 - F.least(F.abs(gap) / SIGMA, F.lit(1.0))),
    "rule": lambda conf: support(unit(conf)),
}


def conflict(a: Column, b: Column) -> Column:
    return a["c"] * b["f"] + a["f"] * b["c"]


def combine(a: Column, b: Column) -> Column:
    """Dempster's rule; total conflict leaves nothing but uncertainty."""
    left = 1 - conflict(a, b)
    c = (a["c"] * b["c"] + a["c"] * b["u"] + a["u"] * b["c"]) / left
    f = (a["f"] * b["f"] + a["f"] * b["u"] + a["u"] * b["f"]) / left
    u = a["u"] * b["u"] / left
    return F.when(left <= 1e-12, mass(0.0, 0.0, 1.0)).otherwise(mass(c, f, u))


def fold(masses: Column) -> Column:
    """All masses of an array combined, in its order."""
    return F.aggregate(masses, mass(0.0, 0.0, 1.0), combine)


def most_conflict(masses: Column) -> Column:
    """The largest conflict between two of the array."""
    pairs = F.flatten(F.transform(masses, lambda a, i: F.transform(F.slice(masses, i + 2, F.greatest(F.size(masses) - i - 1, F.lit(0))), lambda b: conflict(a, b))))
    return F.coalesce(F.array_max(pairs), F.lit(0.0))


def belief(m: Column) -> Column:
    return m["c"]


def plausibility(m: Column) -> Column:
    return m["c"] + m["u"]


def verdict(k: Column, m: Column) -> Column:
    return F.when(k > CONFLICT, "needs_review").when(belief(m) > CONFIRM, "confirmed").when(plausibility(m) < REFUTE, "conflict").otherwise("needs_review")
