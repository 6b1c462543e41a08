"""Column functions for vectors, confidence, decay and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights of source tiers, and the weight of any other.
TIER_WEIGHT = {"delegate": 1.0, "stated": 1.0, "inferred": 0.7, "imported": 0.6, "unknown": 0.8, "tool": 0.5}
OTHER_WEIGHT = 0.8


def tier_weight(tier: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for pair in TIER_WEIGHT.items() for x in pair))
    return F.coalesce(F.try_element_at(weights, tier), F.lit(OTHER_WEIGHT))


def first_confidence(tier: Column) -> Column:
    return tier_weight(tier) * 0.5


def raised_confidence(confidence: Column, tier: Column, step: float = 0.3) -> Column:
    """Confidence after one more mention."""
    return F.least(F.lit(1.0), confidence + (1.0 - confidence) * tier_weight(tier) * step)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with 1e-12 added to both norms."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def cosine_or_minus_one(a: Column, b: Column) -> Column:
    """Cosine; -1 if the sizes differ or a vector is missing or zero."""
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(-1.0)


def unit(a: Column) -> Column:
    """a over its norm; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def age_days(now: Column, then: Column) -> Column:
    """Days between two timestamps, as a double."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(now) - micros(then)) / 8.64e10


def recall_weight(now: Column, valid_at: Column, confidence: Column, corrected: Column, decay_days: float = 180.0) -> Column:
    """exp(-age / decay_days), if valid_at is known, times 0.7 + 0.3 confidence, times 0.3 if corrected."""
    decay = F.when(valid_at.isNotNull(), F.exp(-F.greatest(age_days(now, valid_at), F.lit(0.0)) / decay_days)).otherwise(1.0)
    return decay * (0.7 + 0.3 * confidence) * F.when(corrected, 0.3).otherwise(1.0)


def granularity_prior(kind: Column, symbol: Column) -> Column:
    """0.65 for modules, 0.8 for internal names and nested functions, else 1."""
    last = F.element_at(F.split(symbol, r"\."), -1)
    return F.when(kind == "module", 0.65).when(last.startswith("_") | ((kind == "function") & symbol.contains(".")), 0.8).otherwise(1.0)


def hits(retrieved: Column, gold: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, hits(retrieved, gold, k) / F.size(gold)).otherwise(0.0)


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    return hits(retrieved, gold, k) / F.lit(k) if k > 0 else F.lit(0.0)


def precision_at_least(retrieved: Column, gold: Column, k: int) -> Column:
    """Hits over the smaller of k and the gold set's size."""
    return F.when((F.size(gold) > 0) & (F.lit(k) > 0), hits(retrieved, gold, k) / F.least(F.lit(k), F.size(gold))).otherwise(0.0)


def hit_rate_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when(hits(retrieved, gold, k) > 0, 1.0).otherwise(0.0)


def reciprocal_rank(retrieved: Column, gold: Column) -> Column:
    """One over the first place of a gold element in the whole list."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(1.0 / F.try_element_at(places, F.lit(1)), F.lit(0.0))


def ndcg_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Binary gain over the ideal order's."""
    gain = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.size(gold)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return F.when(F.size(gold) > 0, gain / ideal).otherwise(0.0)


def all_found_at(retrieved: Column, gold: Column, k: int) -> Column:
    return F.when((F.size(gold) > 0) & (F.size(F.array_except(gold, F.slice(retrieved, 1, k))) == 0), 1.0).otherwise(0.0)


def eval_status(gold: Column, error: Column) -> Column:
    """What becomes of a query of an evaluation: without gold it is not asked, one that failed is counted apart, the rest is measured."""
    return F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, "empty_gold").when(error.isNotNull(), "error").otherwise("ok")
