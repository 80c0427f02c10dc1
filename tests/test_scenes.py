"""Scenes against taking facts one by one."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import numpy as np

from palimpsest.operators import scenes as S

FACTS = "profile_id string, fact_id long, created_at timestamp, embedding array<double>"


def one_by_one(rows, threshold=0.6, candidates=256):
    state, out = {}, {}
    for profile, fact, at, vector in sorted((r for r in rows if r[3]), key=lambda r: (r[2], r[1])):
        own = state.setdefault(profile, [])
        v = np.array(vector)
        v = v / max(np.linalg.norm(v), 1e-300)
        best = max(((round(float(t @ v), 9), i) for i, (_, t) in enumerate(own) if len(t) == len(v)), default=(-1, -1))
        if best[0] >= threshold:
            own.append(own.pop(best[1]))
        else:
            own.append((fact, v))
            del own[:-candidates]
        out[fact] = own[-1][0]
    return out


def test_scenes_of_one_slice_are_those_of_the_sequential_form(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = []
    for i in range(400):
        c = rng.choice(centres)
        rows.append((rng.choice(["a", "a", "a", "b", None]), i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200)), [x + rng.gauss(0, 0.5) for x in c]))
    rows += [("a", 900, dt.datetime(2024, 1, 2), None), ("a", 901, dt.datetime(2024, 1, 2), []), ("b", 902, dt.datetime(2024, 1, 2), [1.0]), ("b", 903, dt.datetime(2024, 1, 3), [2.0]), ("c", 904, dt.datetime(2024, 1, 3), [0.0, 0.0])]
    frame = spark.createDataFrame(rows, FACTS).repartition(5)
    for candidates in (256, 3):
        want = one_by_one(rows, candidates=candidates)
        found = S.in_slices(frame, candidates=candidates).collect()
        assert {r["fact_id"]: r["leader"] for r in found} == want and len(found) == len(want)
        whole = {r["fact_id"]: r["scene"] for r in S.scenes(frame, candidates=candidates).collect()}
        assert whole == want
    assert len(set(want.values())) > len(set(one_by_one(rows).values()))


def test_scenes_go_on_in_the_next_slice(spark):
    at = lambda month, day: dt.datetime(2024, month, day)
    rows = [("a", 1, at(1, 1), [1.0, 0.0]), ("a", 2, at(1, 2), [0.0, 1.0]), ("a", 5, at(3, 1), [0.9, 0.1]), ("a", 6, at(3, 2), [-1.0, 0.0]), ("a", 7, at(4, 1), [1.0, 0.1]), ("a", 8, at(4, 2), [-0.9, 0.1]), ("b", 9, at(3, 1), [1.0, 0.0])]
    got = {r["fact_id"]: r["scene"] for r in S.scenes(spark.createDataFrame(rows, FACTS)).collect()}
    assert got == {1: 1, 2: 2, 5: 1, 6: 6, 7: 1, 8: 6, 9: 9}
    assert S.scenes(spark.createDataFrame([], FACTS)).count() == 0
    assert Counter(got.values())[1] == 3
