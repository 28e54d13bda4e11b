"""Ordered bands, flags and fixed maps, as column expressions.

A band comes as a label and, where charts sort by it, as a rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def right_closed(value: Column | str, edges: list[float], labels: list[str], low: float | None = None) -> Column:
    """Bins ``(a, b]``; values at or below ``low`` and nulls get no band."""
    v = _c(value)
    inside = v.isNotNull() if low is None else v > low
    band = F.coalesce(*[F.when(v <= edge, F.lit(label)) for edge, label in zip(edges, labels)], F.lit(labels[-1]))
    return F.when(inside, band)


# Band edges and labels.
TIMELINESS = (
    (10, True, ">10d early"),
    (3, True, "4-10d early"),
    (0, False, "0-3d early"),
    (-3, False, "1-3d late"),
    (-10, False, "4-10d late"),
    (None, False, ">10d late"),
)
WEATHER_CODES = (
    (0, 3, "clear_or_cloudy"),
    (45, 48, "fog"),
    (51, 57, "drizzle"),
    (61, 67, "rain"),
    (71, 77, "snow"),
    (80, 82, "rain_showers"),
    (95, 99, "thunderstorm"),
)
RAIN_MM = 1.0
HEAVY_RAIN_MM = 20.0
GRADES = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
VERIFICATION = {"Not Verified": 0, "Source Verified": 1, "Verified": 2}


def timeliness(days_early: Column | str) -> tuple[Column, Column]:
    """Delivery band and its rank 1-6 from whole days ahead of the estimate."""
    days = _c(days_early)
    label, rank = None, None
    for i, (edge, strict, name) in enumerate(TIMELINESS, start=1):
        hit = F.lit(True) if edge is None else (days > edge if strict else days >= edge)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return F.when(days.isNotNull(), label), F.when(days.isNotNull(), rank)


def weather_condition(code: Column | str) -> Column:
    """Weather-code group; codes between the groups are ``other``."""
    named = [F.when(_c(code).between(a, b), F.lit(name)) for a, b, name in WEATHER_CODES]
    return F.coalesce(*named, F.lit("other"))


def is_rainy(rain_mm: Column | str, threshold: float = RAIN_MM) -> Column:
    return _c(rain_mm) >= threshold


def celsius_to_fahrenheit(celsius: Column | str) -> Column:
    return _c(celsius) * 9 / 5 + 32


def temp_band(fahrenheit: Column | str) -> Column:
    """Cold below 55, mild up to 75, warm above; an unknown temperature has no band."""
    f = _c(fahrenheit)
    return F.when(f < 55, "Cold (<55F)").when(f <= 75, "Mild (55-75F)").when(f > 75, "Warm (>75F)")


def rain_day(precipitation_mm: Column | str) -> Column:
    """Any measurable precipitation; null stays null."""
    return _c(precipitation_mm) > 0


def dti_band(dti: Column | str) -> Column:
    return right_closed(dti, [10, 20, 30], ["low", "medium", "high", "very_high"])


def revol_band(utilisation: Column | str) -> Column:
    return right_closed(utilisation, [30, 60, 80], ["low", "moderate", "high", "maxed"])


def income_band(income: Column | str) -> Column:
    return right_closed(income, [40_000, 75_000, 120_000], ["<40k", "40-75k", "75-120k", "120k+"], low=0)


def ordinal(value: Column | str, mapping: dict[str, int], default: int) -> Column:
    """A fixed label-to-number map with a default."""
    v = _c(value)
    return F.coalesce(*[F.when(v == label, F.lit(n)) for label, n in mapping.items()], F.lit(default))


def grade_number(grade: Column | str) -> Column:
    return ordinal(grade, GRADES, 4)


def verification_number(status: Column | str) -> Column:
    return ordinal(status, VERIFICATION, 0)


def significance_stars(p_value: Column | str) -> Column:
    p = _c(p_value)
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").when(p.isNotNull(), "")
