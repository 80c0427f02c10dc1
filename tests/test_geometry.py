"""Langevin steps, quantisers, block joins and merges against plain forms."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import langevin as L
from palimpsest.operators import merging, neighbours, quantise

# --- Langevin ---------------------------------------------------------------------------------------------------


def noise(key, seed, j):
    digits = hashlib.md5(f"{key}:{seed}:{j}".encode()).hexdigest()
    return math.sqrt(-2 * math.log((int(digits[:13], 16) + 0.5) / 2**52)) * math.cos(int(digits[13:26], 16) * 2 * math.pi / 2**52)


def plain_step(position, access, age, importance, key, seed, dt, temperature, dim):
    x = np.zeros(dim)
    x[: len(position or [])] = (position or [])[:dim]
    access, age, importance = access or 0, age or 0.0, importance or 0.0
    radius = np.linalg.norm(x)
    inverse = (1 - min(radius**2, 0.99**2) + 1e-8) / 2
    alpha = max(0.1, 3 + 0.8 * math.log(access + 1) / 10 - 0.005 * min(age, 365) / 365 + 0.5 * importance)
    drift = -(inverse**2) * 2 * alpha * x * dt
    outwards = x / radius * dt * 0.1 / max(0.5, 0.3 * math.log(1 + access) + 0.4 * importance) if radius > 1e-8 else 0
    curved = 0.5 * temperature * (dim - 2) * inverse * x * dt
    x = x + drift + outwards + curved + math.sqrt(2 * temperature * dt) * inverse * np.array([noise(key, seed, j) for j in range(dim)])
    radius = np.linalg.norm(x)
    return x * 0.99 / (radius + 1e-8) if radius >= 0.99 else x


@pytest.mark.parametrize("dim, dt, temperature", [(8, 0.01, 1.0), (3, 0.5, 2.0)])
def test_step_agrees_with_numpy_and_stays_in_the_ball(spark, dim, dt, temperature):
    rng = random.Random(dim)
    rows = [(i, [rng.uniform(-1, 1) * s for _ in range(n)], rng.randrange(50), rng.uniform(0, 900), rng.random()) for i, (s, n) in enumerate([(0.3, 8), (0.0, 8), (2.0, 8), (0.2, 2), (0.2, 11), (1e-12, 8)] * 20)]
    rows += [(500, None, None, None, None), (501, [], 3, 1.0, 0.5)]
    frame = spark.createDataFrame(rows, "id long, x array<double>, access int, age double, importance double")
    step = L.step(F.col("x"), F.col("access"), F.col("age"), F.col("importance"), F.col("id"), 7, dt, temperature, dim)
    runs = [{r["id"]: r["y"] for r in frame.repartition(n).select("id", step.alias("y")).collect()} for n in (1, 5)]
    assert runs[0] == runs[1]
    for i, x, access, age, importance in rows:
        np.testing.assert_allclose(runs[0][i], plain_step(x, access, age, importance, i, 7, dt, temperature, dim), atol=1e-12)
        assert np.linalg.norm(runs[0][i]) < 1


def test_noise_is_standard_normal(spark):
    x = np.array([r[0] for r in spark.range(20000).select(L.normal(F.col("id"), 3, F.lit(2))).collect()])
    assert abs(x.mean()) < 0.03 and abs(x.var() - 1) < 0.04 and abs((x**4).mean() - 3) < 0.3


def test_weights_and_states(spark):
    row = spark.range(1).select(*[L.weight(F.lit(r)) for r in (0.0, 0.495, 1.0)], *[L.state(F.lit(r)) for r in (0.29, 0.3, 0.55, 0.8)]).first()
    assert list(row) == [1.0, pytest.approx(0.5), 0.0, "active", "warm", "cold", "archived"]


# --- quantisers -------------------------------------------------------------------------------------------------


def test_numbers_are_packed_and_unpacked():
    rng = np.random.default_rng(1)
    for bits in (2, 4, 8):
        for count in (1, 7, 64):
            n = rng.integers(0, 1 << bits, (5, count))
            data = quantise.packed(n, bits)
            assert data.shape[1] == -(-count * bits // 8) and (quantise.unpacked(data, bits, count) == n).all()
    assert quantise.packed(np.array([[1, 2, 3, 0]]), 2).tolist() == [[0b01101100]]


@pytest.mark.parametrize("bits, bound", [(2, 0.118), (4, 0.0096), (8, 0.00012)])
def test_levels_are_as_good_as_brute_force(bits, bound):
    """No level can be moved for a smaller error on a fine sample of the normal; the bound is that of the best levels known."""
    levels = quantise.lloyd_max(1.0, 1 << bits)
    p = (np.arange(200_001) + 0.5) / 200_001
    grid = np.linspace(-6, 6, 200_001)
    mass = np.exp(-grid**2 / 2)
    mass /= mass.sum()
    error = lambda lv: (mass * ((grid[:, None] - lv[None]) ** 2).min(1)).sum() if bits < 8 else (mass * (grid - lv[np.searchsorted((lv[1:] + lv[:-1]) / 2, grid)]) ** 2).sum()
    assert error(levels) < bound and len(p)
    for j in (0, len(levels) // 2, len(levels) - 1):
        for shift in (-0.02, 0.02):
            moved = levels.copy()
            moved[j] += shift
            assert error(np.sort(moved)) >= error(levels) - 1e-12


@pytest.mark.parametrize("kind", ["turbo", "polar"])
@pytest.mark.parametrize("bits, bound", [(2, 0.14), (4, 0.011), (8, 0.0002)])
def test_codes_come_back_within_the_bound(spark, kind, bits, bound):
    rng = np.random.default_rng(bits)
    x = rng.standard_normal((300, 48)) * rng.uniform(0.1, 9, (300, 1))
    x[0], x[1] = 0, np.eye(48)[3] * 5
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0] * 47), (902, [float("nan")] * 48), (903, [None] * 48), (904, [])]
    q = quantise.Quantiser(48, bits, kind)
    codes = quantise.coded(spark.createDataFrame(rows, "fact_id long, embedding array<double>").repartition(3), q)
    assert {r["n"] for r in codes.selectExpr("length(codes) as n").collect()} == {-(-q.count * bits // 8)}
    got = {r["fact_id"]: np.array(r["embedding"]) for r in quantise.restored(codes, q).collect()}
    assert sorted(got) == list(range(300)) and not got[0].any()
    errors = [((got[i] - x[i]) ** 2).sum() / (x[i] ** 2).sum() for i in range(1, 300)]
    assert np.mean(errors) < bound
    with pytest.raises(ValueError, match="bits must be"):
        quantise.Quantiser(8, 3)


def test_sketch_is_unbiased():
    """Over many projections the estimate's mean is the inner product itself, where the code alone is off."""
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((1, 32)), rng.standard_normal((1, 32))
    runs = [quantise.Quantiser(32, 2, "turbo", sketch=64, seed=s) for s in range(400)]
    found = np.array([q.products(y, q.encoded(x))[0, 0] for q in runs])
    want = (x @ y.T)[0, 0]
    assert abs(found.mean() - want) < 4 * found.std() / math.sqrt(len(found))
    plain = quantise.Quantiser(32, 2, "turbo", seed=0)
    parts = [quantise.Quantiser(32, 2, "turbo", sketch=4096, seed=0)]
    assert abs(parts[0].products(y, parts[0].encoded(x))[0, 0] - want) < abs(plain.products(y, plain.encoded(x))[0, 0] - want)


def brute_nearest(x, queries, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u[queries] @ u.T, 6)
    return {(int(q), int(i)) for q, row in zip(queries, s, strict=True) for i in sorted(range(len(x)), key=lambda i: (-row[i], i))[:k]}


def test_search_over_codes_has_recall(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((40, 32)), 20, 0) + 0.6 * rng.standard_normal((800, 32))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "fact_id long, embedding array<double>")
    queries = v.where("fact_id % 20 = 0").selectExpr("fact_id as query_id", "embedding")
    want = brute_nearest(x, range(0, 800, 20), 10)
    for bits, least in ((2, 0.9), (4, 0.97)):
        q = quantise.Quantiser(32, bits, "turbo", sketch=32)
        got = {(r["query_id"], r["fact_id"]) for r in quantise.search(queries, quantise.coded(v, q), v, q, 10, 40).collect()}
        assert len(got) == len(want) and len(got & want) >= least * len(want)


# --- neighbours and merges --------------------------------------------------------------------------------------


def test_blocks_meet_every_block(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (230, 3)).astype(float)  # many ties and zero vectors
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "fact_id long, embedding array<double>").repartition(3)
    q = v.selectExpr("fact_id as query_id", "embedding")
    want = brute_nearest(x, range(230), 5)
    for sizes in ((4096, 16384), (50, 30), (1000, 7)):
        got = neighbours.best_in_blocks(q, v, 5, query_block=sizes[0], item_block=sizes[1]).collect()
        assert {(r["query_id"], r["fact_id"]) for r in got} == want and len(got) == len(want)
    assert neighbours.best_in_blocks(q.where("false"), v, 5).count() == 0 and neighbours.best_in_blocks(q, v.where("false"), 5).count() == 0


def test_merges_and_their_undoing(spark):
    base = np.eye(4)
    rows = [
        (1, base[0], ["a", "b", "c", "d", "e"], 0.5, 0.5, "2024-01-02", None),
        (2, base[0] + 0.1 * base[1], ["a", "b", "c", "d", "e", "e"], 0.9, 0.1, "2024-01-03", "live"),  # more important than 1
        (3, base[0] + 0.05 * base[2], ["a", "b", "c", "d"], 0.9, 0.1, "2024-01-03", "live"),  # 4 of 5 shared: not above .8
        (4, base[1], [], 0.5, 0.5, "2024-01-01", None),
        (5, base[1], [], 0.5, 0.5, "2024-01-01", None),  # no entities: no match
        (6, base[2], ["x"], 0.5, 0.5, "2024-01-05", "archived"),
        (7, base[2], ["x"], 0.5, 0.5, "2024-01-04", "live"),  # older than 6
        (8, base[3], ["y"], 0.5, 0.5, "2024-01-01", "merged"),
        (9, base[3], ["y"], 0.5, 0.6, "2024-01-01", None),
        (10, None, ["y"], 0.5, 0.6, "2024-01-01", None),
    ]
    rows = [(i, None if v is None else [float(x) for x in v], *r, None, None) for i, v, *r in rows]
    f = spark.createDataFrame(rows, "fact_id long, embedding array<double>, entities array<string>, importance double, confidence double, created_at string, archive_status string, archive_reason string, merged_into long")
    pairs = merging.candidates(f)
    assert sorted((r["canonical_id"], r["merged_id"], r["jaccard"]) for r in pairs.collect()) == [(2, 1, 1.0), (7, 6, 1.0), (9, 8, 1.0)]
    after, log = merging.apply_merges(f, pairs, "2024-02-01 00:00:00")
    state = lambda df: {r["fact_id"]: (r["archive_status"], r["merged_into"]) for r in df.collect()}
    before = state(f)
    assert state(after) == before | {1: ("merged", 2), 6: ("merged", 7)} and after.columns == f.columns
    again, second = merging.apply_merges(after, pairs, "2024-02-02 00:00:00")
    assert second.count() == 0 and state(again) == state(after)
    assert sorted(map(tuple, merging.roots(log).collect())) == [(1, 1), (2, 1), (6, 6), (7, 6)]
    back, log2 = merging.unmerge(after, log, log.where("merged_id = 6").select("merge_id"))
    assert state(back) == before | {1: ("merged", 2)}
    assert {r["merged_id"]: r["reversible"] for r in log2.collect()} == {1: True, 6: False}
    once, _ = merging.unmerge(back, log2, log2.select("merge_id"))
    assert state(once) == before
    assert [r.asDict() for r in once.orderBy("fact_id").collect()] == [r.asDict() for r in f.orderBy("fact_id").collect()]
