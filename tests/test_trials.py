"""Thompson draws against the Beta's moments, and the decisions of paired tests."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import trials as T


@pytest.mark.parametrize("a, b", [(1, 1), (2, 5), (30, 4), (1000, 600)])
def test_draws_have_the_mean_and_variance_of_the_beta(spark, a, b):
    key = F.col("id").cast("string")
    frame = spark.range(20000).select(T.beta(F.lit(a), F.lit(b), key, 5).alias("x"))
    mean, var, low, high = frame.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    want = a * b / ((a + b) ** 2 * (a + b + 1))
    assert mean == pytest.approx(a / (a + b), abs=4 * math.sqrt(want / 20000)) and var == pytest.approx(want, rel=0.06) and 0 < low < high < 1


def test_choices_follow_the_posteriors_and_the_seed_alone(spark):
    plays = spark.range(6000).selectExpr("id as play", "if(id % 3 = 0, 'new', 'known') as stratum")
    posteriors = spark.createDataFrame([("known", 1, 90.0, 10.0), ("known", 2, 10.0, 90.0), ("known", 3, 85.0, 15.0)], "stratum string, arm int, alpha double, beta double")
    runs = [sorted(map(tuple, T.thompson(plays.repartition(n), posteriors, [1, 2, 3, 4], seed=s).collect())) for n, s in ((1, 7), (5, 7), (5, 8))]
    assert runs[0] == runs[1] != runs[2] and len(runs[0]) == 6000
    share = lambda stratum, arm: sum(r[1] == stratum and r[2] == arm for r in runs[0]) / sum(r[1] == stratum for r in runs[0])
    rng = random.Random(1)
    want = [0] * 4
    for _ in range(20000):
        draws = [rng.betavariate(90, 10), rng.betavariate(10, 90), rng.betavariate(85, 15), rng.betavariate(1, 1)]
        want[draws.index(max(draws))] += 1 / 20000
    for arm in (1, 2, 3, 4):
        assert share("known", arm) == pytest.approx(want[arm - 1], abs=0.03)
        assert share("new", arm) == pytest.approx(0.25, abs=0.05)


def test_critical_values_of_tables(spark):
    """Known two-tailed values of Student's t."""
    for df, alpha, want in ((99, 0.05, 1.9842), (99, 0.001, 3.3915), (884, 0.05, 1.9626), (120, 0.1, 1.6577), (30, 0.05, 2.0423)):
        assert spark.range(1).select(T.critical_t(F.lit(df), alpha)).first()[0] == pytest.approx(want, abs=2e-4)


def outcomes(name, n, effect, seed, extra=0, noise=0.1):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        base = rng.uniform(0.2, 0.6)
        rows += [(name, f"q{q}", "active", 1, base), (name, f"q{q}", "candidate", 1, base + effect + rng.gauss(0, noise))]
    return rows + [(name, f"x{q}", "candidate", 1, 0.9) for q in range(extra)]


def test_decisions_at_the_borders(spark):
    rows = outcomes("few", 99, 0.3, 1) + outcomes("strong", 100, 0.3, 2) + outcomes("weak", 100, 0.03, 3) + outcomes("open", 884, 0.03, 4)
    rows += outcomes("better", 885, 0.03, 5) + outcomes("same", 885, 0.0, 6) + outcomes("small", 885, 0.01, 7, noise=0.01) + outcomes("worse", 400, -0.3, 8) + outcomes("flat", 100, 0.1, 9, noise=0.0)
    rows += outcomes("two to one", 900, 0.3, 10, extra=900) + outcomes("over two to one", 900, 0.3, 11, extra=901)
    rows += [("unpaired", "q1", "active", 1, 0.5), ("unpaired", "q2", "candidate", 1, 0.5)]
    rows += [("late", "q1", "active", 1, 0.1), ("late", "q1", "active", 2, 0.4), ("late", "q1", "candidate", 1, 0.5)]
    found = {r["experiment"]: r for r in T.decisions(spark.createDataFrame(rows, "experiment string, query_id string, arm string, arrived int, score double").repartition(4)).collect()}
    assert {k: (r["decision"], r["criterion"]) for k, r in found.items()} == {
        "few": ("continue", "accumulating"), "strong": ("promote", "phase_a_strong_signal"), "weak": ("continue", "phase_a_continue"), "open": ("continue", "phase_a_continue"),
        "better": ("promote", "phase_b_promote"), "same": ("reject", "phase_b_reject"), "small": ("reject", "phase_b_reject"), "worse": ("continue", "phase_a_continue"), "flat": ("promote", "phase_a_strong_signal"),
        "two to one": ("promote", "phase_b_promote"), "over two to one": ("continue", "unbalanced_arms"), "unpaired": ("continue", None), "late": ("continue", "accumulating"),
    }
    diffs = [b[4] - a[4] for a, b in zip(*[iter(outcomes("better", 885, 0.03, 5))] * 2, strict=True)]
    mean = sum(diffs) / 885
    sd = math.sqrt(sum((d - mean) ** 2 for d in diffs) / 884)
    assert (found["better"]["effect"], found["better"]["std"], found["better"]["t_stat"]) == pytest.approx((mean, sd, mean / sd * math.sqrt(885)))
    assert found["late"]["effect"] == pytest.approx(0.1) and found["late"]["n_active"] == 2
