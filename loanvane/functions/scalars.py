"""Numeric, banding and formatting expressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band edges of the credit-score midpoint.
SCORE_BANDS = [600, 640, 660, 680, 700, 720, 740, 760, 800]

SCORE_EPS = 1e-6
NUISANCE_EPS = 1e-4


def is_missing(value: Column, floating: bool = True) -> Column:
    """NULL, and for floating columns NaN too."""
    return (value.isNull() | F.isnan(value)) if floating else value.isNull()


def clamp(value: Column, low: float, high: float) -> Column:
    """Bound to [low, high]; a missing value stays missing (least/greatest would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def clamp_probability(p: Column, eps: float = SCORE_EPS) -> Column:
    return clamp(p, eps, 1 - eps)


def classify(p: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """Class 1 at ``p >= threshold``, or ``p > threshold`` when ``strict``."""
    hit = p > F.lit(threshold) if strict else p >= F.lit(threshold)
    return F.when(p.isNotNull(), hit.cast("int"))


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) * F.lit(0.5)


def band_labels(edges: Sequence[float]) -> list[str]:
    """``[a,b)`` texts, the last closed on both sides."""
    pairs = list(zip(edges, edges[1:]))
    return [f"[{a:g},{b:g}{']' if i == len(pairs) - 1 else ')'}" for i, (a, b) in enumerate(pairs)]


def band(value: Column, edges: Sequence[float] = SCORE_BANDS) -> Column:
    """Left-closed band label, last band closed on the right too, NULL outside."""
    labels = band_labels(edges)
    inside = value <= F.lit(float(edges[-1]))
    out = F.when((value >= F.lit(float(edges[-2]))) & inside, labels[-1])
    for low, label in reversed(list(zip(edges[:-2], labels))):
        out = out.when((value >= F.lit(float(low))) & inside, label)
    return out


def round_to_grid(value: Column, digits: int) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)


def at_least(value: Column, threshold: Column | float) -> Column:
    """0/1 treatment of a value reaching a threshold."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (value >= limit).cast("double")


def interpolate(low: Column, high: Column, share: Column) -> Column:
    """Linear step between two order statistics (type-7 quantiles); equal ends stay exact."""
    return F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share)


def recode(value: Column, names: Mapping[str, str]) -> Column:
    """Name-to-label map; unmapped names stay."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(pairs[value], value)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value * F.lit(100.0)), F.lit("%"))


def thousands_text(value: Column) -> Column:
    return F.format_number(value, 0)


def effect_text(theta: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.2f [%.2f, %.2f]", theta, low, high)


def student_cdf_two_sided(t: float, df: int) -> float:
    """P(|T| <= t) for whole degrees of freedom: the finite trigonometric series."""
    angle = math.atan(abs(t) / math.sqrt(df))
    cos, sin = math.cos(angle), math.sin(angle)
    term, total = (cos, 0.0) if df % 2 else (1.0, 0.0)
    first = 3 if df % 2 else 2
    if df % 2 == 0 or df > 1:
        total = term
        for k in range(first, df, 2):
            term *= (k - 1) / k * cos * cos
            total += term
    return 2 / math.pi * (angle + sin * total) if df % 2 else sin * total


def student_p_value(t: float, df: int) -> float:
    """Two-sided p-value at any degrees of freedom: the regularised incomplete beta function at df / (df + t^2)."""
    x = df / (df + t * t)
    return 1.0 if x >= 1 else _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def _student_quantile(df: int, coverage: float) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf_two_sided(mid, df) < coverage else (low, mid)
    return (low + high) / 2


Z_975 = 1.959963984540054
_EXACT_DF = 100


def student_975(df: Column) -> Column:
    """97.5 % Student quantile: solved values up to 100 degrees, the series in 1/df beyond."""
    z = Z_975
    solved = F.array(*[F.lit(_student_quantile(k, 0.95)) for k in range(1, _EXACT_DF + 1)])
    nu = df.cast("double")
    series = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / nu
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (nu * nu)
        + F.lit((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384) / (nu * nu * nu)
    )
    return F.when(df < 1, F.lit(None).cast("double")).when(df <= _EXACT_DF, F.get(solved, df.cast("int") - 1)).otherwise(series)
