"""Trials of rankings: seeded Thompson draws for every play, and paired tests of a candidate against the active ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.langevin import normal

# Pairs for the early and the full decision, least effects, error levels, rows an arm needs for a balance check.
EARLY, FULL = 100, 885
EFFECT, STRONG_EFFECT = 0.02, 0.08
ALPHA, STRONG_ALPHA = 0.049, 0.001
PER_ARM = 8
#: Tries of a gamma draw; one fails with a probability of at most 0.05, and after TRIES the density's mode stands.
TRIES = 6


def uniform(key: Column, seed: int, number: Column) -> Column:
    """In (0, 1), by a hash of the key, the seed and a number."""
    digits = F.md5(F.concat_ws("/", key, F.lit(str(seed)), number.cast("string")).cast("binary"))
    return (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that it uses several times, which is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def gamma(shape: Column, key: Column, seed: int) -> Column:
    """A gamma draw (scale 1) of a shape of 1 or more, by Marsaglia and Tsang's rejection."""

    def tried(d: Column, key: Column, i: int) -> Column:
        """The draw of a try, null if it fails."""
        cube = lambda x: F.struct(x.alias("x"), F.pow(1 + x / F.sqrt(9 * d), F.lit(3.0)).alias("v"))
        below = lambda t: F.log(uniform(key, seed, F.lit(i))) < 0.5 * t["x"] * t["x"] + d - d * t["v"] + d * F.log(F.greatest(t["v"], F.lit(1e-300)))
        return once(once(normal(key, seed, F.lit(i)), cube), lambda t: F.when((t["v"] > 0) & below(t), d * t["v"]))

    # A later try is made only where the earlier ones fail.
    own = F.struct((shape - 1 / 3).alias("d"), key.alias("key"))
    return once(own, lambda s: F.coalesce(*(tried(s["d"], s["key"], i) for i in range(TRIES)), s["d"]))


def beta(a: Column, b: Column, key: Column, seed: int = 42) -> Column:
    """A draw of Beta(a, b), each taken as 1 at least; the same for the same key (text) and seed."""
    x, y = (gamma(F.greatest(c.cast("double"), F.lit(1.0)), F.concat_ws("|", key, F.lit(side)), seed) for c, side in ((a, "a"), (b, "b")))
    return once(F.struct(x.alias("x"), y.alias("y")), lambda p: p["x"] / (p["x"] + p["y"]))


def thompson(plays: DataFrame, posteriors: DataFrame, arms: Sequence, seed: int = 42) -> DataFrame:
    """play, stratum, arm and sample: for each play the arm of the largest draw, the earlier in arms of equals.

    plays: play, stratum; posteriors: stratum, arm, alpha, beta. An arm without a posterior in a stratum is Beta(1, 1). The
    arms of a stratum are one map (no longer than arms), so a play stays one row and is shuffled at most for that join.
    """
    pair = F.struct(F.col("alpha").cast("double").alias("a"), F.col("beta").cast("double").alias("b"))
    known = posteriors.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("arm", pair))).alias("known"))
    of = lambda n, part: F.coalesce(F.try_element_at("known", n)[part], F.lit(1.0))
    key = lambda n: F.concat_ws(":", F.col("play").cast("string"), n.cast("string"))
    draw = lambda n, i: F.struct(F.round(beta(of(n, "a"), of(n, "b"), key(n), seed), 9).alias("sample"), (-i).alias("place"), n.alias("arm"))
    best = F.array_max(F.transform(F.array(*map(F.lit, arms)), draw))
    # Draws cost far more than reading, so the plays of a few files are dealt to all tasks.
    spread = plays.repartition(int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = spread.join(known, "stratum", "left").select("play", "stratum", best.alias("m"))
    return rows.select("play", "stratum", "m.arm", "m.sample")


def expansion(alpha: float) -> tuple[float, list[float]]:
    """The two-tailed normal value and the terms of Student's t in powers of 1 / df."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    return z, [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def critical_t(df: Column, alpha: float) -> Column:
    """The two-tailed critical value of Student's t, good to four places from 30 degrees of freedom on."""
    z, terms = expansion(alpha)
    out = F.lit(z)
    for power, term in enumerate(terms, 1):
        out = out + F.lit(term) / F.pow(F.greatest(df, F.lit(1)).cast("double"), F.lit(float(power)))
    return out


def decisions(outcomes: DataFrame) -> DataFrame:
    """experiment, n_active, n_candidate, n_pairs, effect, std, t_stat, criterion and decision of each experiment.

    outcomes: experiment, query_id, arm (active or candidate), arrived, score. A query's latest score of an arm counts;
    pairs are queries with both. One arm over twice the other: no decision. From 100 pairs a strong effect promotes at
    once, from 885 the one-sided test promotes or rejects. Sums are of each query and then of each experiment, both partial.
    """
    part = lambda arm: F.max_by("score", F.when(F.col("arm") == arm, F.struct("arrived", "score"))).alias(arm)
    count = lambda arm: F.count_if(F.col("arm") == arm).alias(f"n_{arm}")
    each = outcomes.groupBy("experiment", "query_id").agg(part("active"), part("candidate"), count("active"), count("candidate"))
    has = (F.col("n_active") > 0) & (F.col("n_candidate") > 0)
    diff = F.when(has, F.col("candidate") - F.col("active"))
    s = each.groupBy("experiment").agg(
        F.sum("n_active").alias("n_active"), F.sum("n_candidate").alias("n_candidate"), F.count(diff).alias("n_pairs"),
        F.coalesce(F.avg(diff), F.lit(0.0)).alias("effect"), F.coalesce(F.nullif(F.stddev_samp(diff), F.lit(float("nan"))), F.lit(0.0)).alias("std"),
    )
    n, mean, flat = F.col("n_pairs"), F.col("effect"), F.col("std") == 0
    t = F.when(flat, F.when(mean > 0, math.inf).when(mean < 0, -math.inf).otherwise(0.0)).otherwise(mean / (F.col("std") / F.sqrt(n)))
    s = s.withColumn("t_stat", t)
    least, most = F.least("n_active", "n_candidate"), F.greatest("n_active", "n_candidate")
    unbalanced = (n > 0) & (least >= PER_ARM) & (most > 2 * least)
    strong = (mean > STRONG_EFFECT) & (F.col("t_stat") > critical_t(n - 1, STRONG_ALPHA))
    better = (mean >= EFFECT) & (F.col("t_stat") > critical_t(n - 1, 2 * ALPHA))
    criterion = F.when(n == 0, F.lit(None).cast("string")).when(unbalanced, "unbalanced_arms").when(n < EARLY, "accumulating")
    criterion = criterion.when((n < FULL) & strong, "phase_a_strong_signal").when(n < FULL, "phase_a_continue").when(better, "phase_b_promote").otherwise("phase_b_reject")
    s = s.withColumn("criterion", criterion)
    decision = F.when(F.col("criterion").isin("phase_a_strong_signal", "phase_b_promote"), "promote").when(F.col("criterion") == "phase_b_reject", "reject").otherwise("continue")
    return s.withColumn("decision", decision)
