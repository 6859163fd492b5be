"""Arithmetic of ranking, fading and statistics. A zero or null weight counts as 0.5, as weights that are missing do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_days(at: Column, now: Column) -> Column:
    """Days since ``at``: 0 for the future, 365 for no date."""
    days = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86400e6)
    return F.when(at.isNull(), 365.0).otherwise(F.greatest(days, F.lit(0.0)))


def weight(w: Column) -> Column:
    return F.when(w.isNull() | (w == 0), 0.5).otherwise(w)


def decay(days: Column, w: Column, intent: Column | None = None) -> Column:
    """Freshness counts most for three days, the weight after them; long-term questions see memories younger."""
    ew = weight(w)
    days = days if intent is None else F.when(intent == "long_term", days * 0.4).otherwise(days)
    rate = F.when(ew >= 0.8, 0.005).when(ew >= 0.6, 0.01).when(ew >= 0.4, 0.02).otherwise(0.04)
    fresh, kept = F.exp(-rate * days), 0.3 + ew * 0.7
    return F.when(days <= 3, 0.7 * fresh + 0.3 * kept).otherwise(0.3 * fresh + 0.7 * kept)


def recency(days: Column) -> Column:
    return F.when(days <= 1, 1.3).when(days <= 3, 1.15).when(days <= 7, 1.05).otherwise(1.0)


def importance(w: Column) -> Column:
    return 0.4 + weight(w) * 0.6


def novelty(count: Column) -> Column:
    return F.when(count.isNull() | (count <= 1), 1.0).otherwise(1 / (1 + F.log10(count + 1)))


def rank_score(relevance: Column, days: Column, w: Column, count: Column, intent: Column | None = None, decay_weight: float = 0.05) -> Column:
    return relevance * F.pow(decay(days, w, intent) * recency(days), F.lit(decay_weight)) * importance(w) * novelty(count)


def confidence_tier(by_text: Column, by_vector: Column, similarity: Column, rrf: Column, by_entity: Column) -> Column:
    return F.when(by_text & by_vector, "high").when(similarity > 0.35, "high").when((rrf > 0.015) | (similarity > 0.2) | by_entity, "medium").otherwise("low")


def channel(by_text: Column, by_vector: Column, by_entity: Column) -> Column:
    return (
        F.when(by_text & by_vector, "BOTH")
        .when(by_entity & by_text, "ENTITY+FTS")
        .when(by_entity & by_vector, "ENTITY+VEC")
        .when(by_entity, "ENTITY")
        .when(by_text, "FTS")
        .otherwise("VEC")
    )


def permission(days: Column, tier: Column, source: Column) -> Column:
    """cite, cautious or associate."""
    return F.when((days >= 90) | (tier == "low"), "associate").when((tier == "high") & (days < 30) & (source == "BOTH"), "cite").otherwise("cautious")


def faded(intensity: Column, valence: Column, days: Column) -> Column:
    """Intensity left: the half-life is 60 days up to valence -0.1, 120 from 0.1, and between them in between."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(valence, F.lit(0.0)) + 0.1) / 0.2))
    return intensity * F.pow(F.lit(0.5), days / (60 + 60 * share))


def pattern_confidence(evidence: Column, span_days: Column) -> Column:
    return F.least(F.lit(0.9), F.lit(0.15) + F.least(F.lit(0.4), evidence * 0.04) + F.least(F.lit(0.25), F.greatest(F.lit(1.0), span_days) / 365 * 0.25))


def z_score(y: Column, mean: Column, sigma: Column) -> Column:
    return (y - mean) / sigma


def winsorised(z: Column, k: float = 2.0) -> Column:
    """Squared residual, cut at k."""
    return F.pow(F.greatest(F.lit(-k), F.least(F.lit(k), z)), F.lit(2))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; zero where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def half_up(x: Column, places: int) -> Column:
    """A double that isn't negative, rounded by doubles as SQL engines do; ``round`` goes by its shortest decimal, and 0.285 up."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places
