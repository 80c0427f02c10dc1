"""One Langevin step of a fact's position in the unit ball, as column expressions with seeded noise.

The noise of a fact hangs on its id, the seed and the component alone: two uniforms from the digits of one hash make a
normal by Box and Muller, so a step gives the same rows whatever the partitions and can be repeated or told in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pulls of the potential, the forgetting drift's scale, the ball's radius and the zones' upper radii.
BASE, ACCESS, AGE, IMPORTANCE = 3.0, 0.8, 0.005, 0.5
FORGETTING = 0.1
MOST, TINY = 0.99, 1e-8
RADII = (("active", 0.3), ("warm", 0.55), ("cold", 0.8))


def normal(key: Column, seed: int, component: Column) -> Column:
    """A standard normal of a key (never null), a seed and a component's number."""
    digits = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), component.cast("string")).cast("binary"))
    part = lambda at: F.conv(F.substring(digits, at, 13), 16, 10).cast("double")  # noqa: E731  52 bits
    return F.sqrt(-2 * F.log((part(1) + 0.5) / 2.0**52)) * F.cos(part(14) * (2 * 3.141592653589793 / 2.0**52))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def resized(position: Column, dim: int) -> Column:
    """The first dim components, with zeros where there are none; a null position is the origin."""
    at = F.coalesce(position.cast("array<double>"), F.array().cast("array<double>"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.coalesce(F.get(at, j), F.lit(0.0)))


def step(position: Column, access: Column, age_days: Column, importance: Column, key: Column, seed: int, dt: float = 0.01, temperature: float = 1.0, dim: int = 8) -> Column:
    """The position after one Euler-Maruyama step: confinement, forgetting, curvature and noise, then back into the ball.

    Confinement grows with accesses and importance and weakens with age (a year at most); what is seldom used drifts
    outwards. Nulls of the figures count as 0.
    """
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    x, access, importance = resized(position, dim), zero(access), zero(importance)
    radius = norm(x)
    shrink = (1 - F.least(radius * radius, F.lit(MOST**2)) + TINY) / 2  # inverse of the metric's factor
    pull = F.greatest(F.lit(0.1), BASE + ACCESS * F.log1p(access) / 10 - AGE * F.least(zero(age_days), F.lit(365.0)) / 365 + IMPORTANCE * importance)
    outwards = F.when(radius > TINY, FORGETTING * dt / (F.greatest(F.lit(0.5), 0.3 * F.log1p(access) + 0.4 * importance) * radius)).otherwise(0.0)
    grow = 1 - shrink * shrink * 2 * pull * dt + outwards + 0.5 * temperature * (dim - 2) * shrink * dt
    spread = F.sqrt(F.lit(2.0 * temperature * dt)) * shrink
    moved = F.transform(x, lambda v, j: v * grow + spread * normal(key, seed, j))
    return in_ball(moved)


def in_ball(x: Column) -> Column:
    """x, or what lies in its direction just inside the ball."""
    return F.when(norm(x) >= MOST, F.transform(x, lambda v: v * (MOST / (norm(x) + TINY)))).otherwise(x)


def weight(radius: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """From high at the origin to low at the ball's rim."""
    return F.greatest(F.lit(low), F.least(F.lit(high), high - (high - low) * F.least(radius, F.lit(MOST)) / MOST))


def state(radius: Column) -> Column:
    out = F.lit("archived")
    for name, bound in reversed(RADII):
        out = F.when(radius < bound, name).otherwise(out)
    return out
