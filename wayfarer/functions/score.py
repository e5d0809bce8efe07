"""Scores of places, crowds and budgets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the recommendation score.
WEIGHTS = {"distance": 0.25, "rating": 0.20, "popularity": 0.15, "interest": 0.20, "season": 0.10, "confidence": 0.10}

# Daily rates by budget level.
RATES = {
    "transport": {"budget": 6.0, "standard": 8.0, "premium": 12.0},
    "food": {"budget": 300.0, "standard": 500.0, "premium": 900.0},
    "accommodation": {"budget": 700.0, "standard": 1200.0, "premium": 2500.0},
    "misc": {"budget": 100.0, "standard": 200.0, "premium": 400.0},
}


def clip(c: Column, low: float, high: float) -> Column:
    """Within the bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def weighted_rating_sql(avg: Column, n: Column) -> Column:
    """Mean rating pulled to zero by ten missing votes."""
    return F.coalesce(avg * n / F.nullif(n + 10.0, F.lit(0.0)), F.lit(0.0))


def rating_confidence(n: Column) -> Column:
    value = F.coalesce(n.try_cast("double"), F.lit(0.0))
    return F.when(value <= 0, 0.0).otherwise(F.round(F.least(value / 1000.0, F.lit(1.0)), 4))


def weighted_rating_bayes(rating: Column, n: Column, digits: int = 4) -> Column:
    """Rating mixed with 3.5 by confidence; few votes cost a tenth."""
    c = rating_confidence(n)
    mixed = F.coalesce(rating, F.lit(0.0)) * c + 3.5 * (1 - c)
    return F.round(F.when(F.coalesce(n.try_cast("double"), F.lit(0.0)) < 10, mixed * 0.9).otherwise(mixed), digits)


def popularity(rating: Column, n: Column, visitors: Column, stored: Column | None = None) -> Column:
    zero = F.lit(0.0)
    parts = 0.4 * clip(F.coalesce(rating, zero) / 5.0, 0, 1) + 0.3 * clip(F.coalesce(n, zero) / 1000.0, 0, 1) + 0.3 * clip(F.coalesce(visitors, zero) / 100000.0, 0, 1)
    value = F.round(100 * parts, 2)
    return value if stored is None else F.greatest(value, F.coalesce(stored, zero))


def recommendation_score(distance: Column, rating: Column, pop: Column, interest: Column, season: Column, confidence: Column, suitability: Column, digits: int = 2) -> Column:
    """Weighted parts, each in 0..1, times the clipped suitability, in percent."""
    zero = F.lit(0.0)
    near = F.when(distance.isNull(), 0.0).otherwise(1 / (1 + F.greatest(distance, zero) / 10))
    parts = {"distance": near, "rating": clip(F.coalesce(rating, zero) / 5, 0, 1), "popularity": clip(F.coalesce(pop, zero) / 100, 0, 1), "interest": clip(F.coalesce(interest, zero), 0, 1), "season": clip(F.coalesce(season, zero), 0, 1), "confidence": clip(F.coalesce(confidence, zero), 0, 1)}
    total = sum((WEIGHTS[k] * v for k, v in parts.items()), zero)
    return F.round(100 * total * clip(F.coalesce(suitability, F.lit(1.0)), 0, 1), digits)


def classify_crowd(level: Column) -> Column:
    x = level.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | ~x.between(0, 1), "Unknown").when(x <= 0.33, "Low").when(x <= 0.66, "Medium").otherwise("High")


def classify_count(n: Column, low: Column, high: Column) -> Column:
    """Low up to ``low`` visitors, Medium up to ``high``; Unknown where a number is missing, negative or out of order."""
    x, a, b = (c.try_cast("double") for c in (n, low, high))
    known = x.isNotNull() & a.isNotNull() & b.isNotNull() & (x >= 0) & (a >= 0) & (b >= 0) & (a <= b)
    return F.when(~known, "Unknown").when(x <= a, "Low").when(x <= b, "Medium").otherwise("High")


def season(month: Column) -> Column:
    return F.when(month.between(3, 5), "Summer").when(month.between(6, 9), "Monsoon").when(month.isin(10, 11, 12, 1, 2), "Winter").otherwise("Unknown")


def status_suitability(score: Column, status: Column) -> Column:
    """The given score clipped to 0..1; else 0.2 where the status speaks against a visit, else 1."""
    against = F.lower(F.coalesce(status, F.lit(""))).rlike("closed|closure|dry|unsafe")
    return F.coalesce(clip(score.try_cast("double"), 0, 1), F.when(against, 0.2).otherwise(1.0))


def rate(kind: str, level: Column) -> Column:
    by = RATES[kind]
    return F.when(level == "budget", by["budget"]).when(level == "premium", by["premium"]).otherwise(by["standard"])


def transport_cost(km: Column, per_km: Column) -> Column:
    return F.round(F.greatest(km, F.lit(0.0)) * F.greatest(per_km, F.lit(0.0)), 2)


def food_cost(n: Column, days: Column, per_day: Column) -> Column:
    return F.greatest(n, F.lit(1)) * F.greatest(days, F.lit(1)) * per_day


def accommodation_cost(n: Column, nights: Column, per_night: Column) -> Column:
    return F.greatest(n, F.lit(1)) * F.greatest(nights, F.lit(0)) * per_night


def misc_cost(days: Column, per_day: Column) -> Column:
    return F.greatest(days, F.lit(1)) * per_day


def drive_minutes(km: Column) -> Column:
    """Minutes of a leg: roads are 1.3 times as long, 40 km an hour and ten minutes more, to the nearest five."""
    road = km * 1.3
    minutes = F.bround((road / 40.0 * 60.0 + 10.0) / 5.0, 0) * 5
    return F.when(km.isNull(), 30.0).when(road < 0.3, 0.0).otherwise(minutes)
