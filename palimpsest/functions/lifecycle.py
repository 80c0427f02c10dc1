"""Retention, zones, tiers and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the zones.
ZONES = (("active", 0.8), ("warm", 0.5), ("cold", 0.2), ("archive", 0.05))


def strength(access: Column, importance: Column, confirmations: Column, salience: Column) -> Column:
    """Memory strength in [0.1, 100]: 2 ln(1 + access) + 1.5 importance + confirmations + 0.5 salience."""
    raw = 2 * F.log1p(access) + 1.5 * importance + confirmations + 0.5 * salience
    return F.least(F.lit(100.0), F.greatest(F.lit(0.1), raw))


def retention(hours: Column, strength: Column, trust: Column | None = None, kappa: float = 2.0) -> Column:
    """exp(-hours / strength) in [0, 1]; low trust speeds the decay by up to 1 + kappa. The future counts as now."""
    rate = F.lit(1.0) if trust is None else 1 + kappa * (1 - trust)
    return F.least(F.lit(1.0), F.exp(-F.greatest(hours, F.lit(0.0)) * rate / strength))


def zone(r: Column) -> Column:
    out = F.lit("forgotten")
    for name, bound in reversed(ZONES):
        out = F.when(r > bound, name).otherwise(out)
    return out


def repetition(strength: Column, hours: Column, eta: float = 0.5) -> Column:
    """Strength after an access: spaced repetition adds eta ln(1 + hours / 24)."""
    return F.least(F.lit(100.0), strength + eta * F.log1p(F.greatest(hours, F.lit(0.0)) / 24))


def tier(days: Column, access: Column, importance: Column) -> Column:
    """active, warm, cold or archived by idle days; much used and important facts stay 2 or 3 times as long."""
    factor = F.greatest(F.when(access >= 5, 2).otherwise(1), F.when(importance >= 0.8, 3).otherwise(1))
    return F.when(days < 30 * factor, "active").when(days < 180 * factor, "warm").when(days < 365 * factor, "cold").otherwise("archived")


def compliance_state(days: Column, access: Column) -> Column:
    return F.when(access > 10, "active").when(days < 7, "active").when(days < 30, "warm").when(days < 90, "cold").otherwise("archived")


def drifted(confidence: Column, access: Column, days: Column) -> Column:
    """Confidence plus 0.02 an access, to 1 at most; never used and over 7 days old: minus 0.001, to 0.1 at least."""
    up = F.least(F.lit(1.0), confidence + 0.02 * access)
    down = F.greatest(F.lit(0.1), confidence - 0.001)
    return F.when(access > 0, up).when(days > 7, down).otherwise(confidence)


def precision_bits(r: Column) -> Column:
    """Bits an embedding component is stored with, by retention."""
    return F.when(r > 0.8, 32).when(r > 0.5, 8).when(r > 0.2, 4).when(r > 0.05, 2).otherwise(0)
