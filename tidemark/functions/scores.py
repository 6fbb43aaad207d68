"""Column functions on scores, weights and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight and the largest score of each source tier; any other tier weighs 0 and is capped at 3.
TIER_WEIGHT = {1: 1.0, 2: 1.0, 3: 0.6, 4: 0.0}
TIER_CAP = {1: 3, 2: 3, 3: 2, 4: 0}

DECAY = 0.12
EARLY_UNTIL = 2021


def _by_value(key: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def tier_weight(tier: Column) -> Column:
    return _by_value(tier, TIER_WEIGHT, 0.0)


def tier_cap(tier: Column) -> Column:
    return _by_value(tier, TIER_CAP, 3)


def clamp(score: Column, tier: Column, hedged: Column) -> Column:
    """Within the tier's cap, then within one if hedged."""
    cap = tier_cap(tier)
    capped = F.greatest(-cap, F.least(cap, score))
    return F.when(hedged, F.greatest(F.lit(-1), F.least(F.lit(1), capped))).otherwise(capped)


def decay_rate(year: Column, rate: float = DECAY, early_until: int = EARLY_UNTIL) -> Column:
    """Per month; half as fast in the sparse years."""
    return F.when(year >= early_until, F.lit(rate)).otherwise(F.lit(rate / 2))


def number(text: Column) -> Column:
    """A number, or null: not a number is null as well."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def rounded(x: Column, digits: int) -> Column:
    """``bround`` of a double. By whole numbers, as decimals are slow; only what is close to a tie, or very large, goes through decimals."""
    scaled = x * float(10**digits)
    whole = F.rint(scaled)
    clear = F.abs(scaled - whole) + F.abs(scaled) * 1e-14 < 0.499  # false where scaling gives infinity, as the difference is no number then
    return F.when(clear, whole / float(10**digits) + 0.0).otherwise(F.bround(x, digits))  # + 0.0: no negative zero


def rescaled(raw: Column, baseline: Column, ceiling: Column) -> Column:
    """Where a raw score stands between chance and the ceiling, 0 to 1."""
    share = F.try_divide(raw - baseline, ceiling - baseline)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4)


def evidence_status(
    n: Column, docs: Column, mass: Column, newest: Column, least_mass: float = 0.35, sparse_mass: float = 1.2, stale: float = 18.0
) -> Column:
    insufficient = (n < 2) | (docs < 2) | (mass < least_mass)
    return F.when(insufficient, "insufficient").when((mass < sparse_mass) | (newest > stale), "sparse").otherwise("well_evidenced")


def flag(text: Column) -> Column:
    """Whether a text says yes: one of true, yes, checked, 1."""
    return F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("true", "yes", "checked", "1")


def open_weights(access: Column) -> Column:
    """Null where nothing is known."""
    return F.when(F.coalesce(access, F.lit("")) != "", F.lower(access).startswith("open weights"))


def web_link(link: Column) -> Column:
    return F.when(link.startswith("http"), link)
