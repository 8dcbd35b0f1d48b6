"""The ranking score: a blend of fit and desirability, decayed by age, scaled by how a platform calls back.

Scores are left unrounded for ordering; `shown` rounds for display, half up on the decimal value, which
other engines can repeat.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import iso_date

GATED_SHARE = 0.05
DESIRABILITY_WEIGHT, FIT_WEIGHT = 0.7, 0.3
PENDING_SHARE = 0.6
GRACE_DAYS, DECAY_DAYS, DECAY_FLOOR, UNDATED = 30, 90, 0.8, 0.9
SMOOTHING, DEFAULT_RATE, FACTOR_LOW, FACTOR_HIGH = 10, 0.10, 0.8, 1.25
MIN_APPLIED = 30


def shown(score: Column) -> Column:
    return F.floor(score * 100 + 0.5) / 100


def age_decay(day: Column, as_of: Column) -> Column:
    """1 within the grace period, then down to the floor; a constant where the date is unknown."""
    days = F.datediff(as_of, day)
    return F.when(day.isNull(), F.lit(UNDATED)).when(days <= GRACE_DAYS, F.lit(1.0)).otherwise(F.greatest(F.lit(DECAY_FLOOR), 1 - (days - GRACE_DAYS) / DECAY_DAYS * 0.2))


def platform_factor(callbacks: Column, applied: Column, global_rate: Column) -> Column:
    """The platform's call-back rate, smoothed towards the global one, as a bounded factor."""
    rate = F.when(global_rate > 0, global_rate).otherwise(F.lit(DEFAULT_RATE))
    smooth = (callbacks + rate * SMOOTHING) / (applied + SMOOTHING)
    return F.greatest(F.lit(FACTOR_LOW), F.least(F.lit(FACTOR_HIGH), 0.5 + smooth / rate * 0.5))


def rank_score(fit: Column, desirability: Column, gated: Column, posted: Column, discovered: Column, as_of: Column, *, callbacks: Column, applied: Column, global_rate: Column, global_applied: Column, adjustment: Column | None = None, preferences: bool = False) -> Column:
    """The score, null without a fit. A gated posting keeps a share of its fit and nothing else counts.

    posted that is given but unreadable counts as undated; only a missing one falls back to discovered.
    """
    plain = fit * PENDING_SHARE if preferences else fit
    base = F.when(desirability.isNotNull(), desirability * DESIRABILITY_WEIGHT + fit * FIT_WEIGHT).otherwise(plain)
    base = F.greatest(F.lit(0.0), F.least(F.lit(100.0), base + (F.lit(0.0) if adjustment is None else F.coalesce(adjustment, F.lit(0.0)))))
    given = F.coalesce(F.nullif(posted.cast("string"), F.lit("")), discovered.cast("string"))
    factor = F.when(global_applied >= MIN_APPLIED, platform_factor(callbacks, applied, global_rate)).otherwise(F.lit(1.0))
    live = F.least(F.lit(100.0), base * age_decay(iso_date(given), as_of) * factor)
    return F.when(fit.isNull(), F.lit(None).cast("double")).when(F.coalesce(gated, F.lit(0)) == 1, fit * GATED_SHARE).otherwise(live)


def legacy_score(fit: Column, desirability: Column, posted: Column, discovered: Column, as_of: Column, *, callbacks: Column, applied: Column, global_rate: Column, global_applied: Column) -> Column:
    """The earlier formula: an even blend, no gate, no bounds, no adjustment."""
    base = F.when(desirability.isNotNull(), desirability * 0.5 + fit * 0.5).otherwise(fit)
    given = F.coalesce(F.nullif(posted.cast("string"), F.lit("")), discovered.cast("string"))
    factor = F.when(global_applied >= MIN_APPLIED, platform_factor(callbacks, applied, global_rate)).otherwise(F.lit(1.0))
    return base * age_decay(iso_date(given), as_of) * factor
