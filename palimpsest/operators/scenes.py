"""Scenes: facts join, in the order of their time, the scene whose first fact they resemble most, or begin one.

A profile's facts are cut into slices of time. A slice is dealt to a task and sorted by Spark, and goes through it as a
stream: the state is the slice's latest scenes, at most CANDIDATES of them, so neither a profile nor a slice is ever held
whole. Afterwards the first fact of a scene is compared with the slice before, of whose latest scenes it goes on the
most similar one; scenes that go on each other are one. A profile within one slice has exactly the scenes that taking
its facts one by one would give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.graphs import components
from palimpsest.session import checkpointed

# The similarity that joins, and how many of the latest scenes a fact is compared with.
JOIN = 0.6
CANDIDATES = 256


def in_slices(facts: DataFrame, every: str = "month", threshold: float = JOIN, candidates: int = CANDIDATES) -> DataFrame:
    """profile_id, slice, fact_id, leader (the scene's first fact) and similarity to it, within slices of time.

    facts: profile_id, fact_id (long), created_at, embedding. Facts without a vector, or with an empty one, are left out; a
    vector of another length than a leader's is not compared with it. Equal times are ordered by id. A null profile is one.
    """
    own = facts.where("size(embedding) > 0").select("profile_id", F.date_trunc(every, "created_at").alias("slice"), "created_at", "fact_id", F.col("embedding").cast("array<double>").alias("embedding"))
    dealt = own.repartition("profile_id", "slice").sortWithinPartitions("profile_id", "slice", "created_at", "fact_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, leaders, themes = None, [], []  # latest last; a scene that is joined becomes the latest
        for batch in batches:
            out = []
            for profile, part, fact, vector in zip(batch["profile_id"], batch["slice"], batch["fact_id"], batch["embedding"], strict=True):
                if (profile, part) != key:
                    key, leaders, themes = (profile, part), [], []
                v = np.asarray(vector, np.float64)
                v = v / max(np.linalg.norm(v), 1e-300)
                same = [i for i, t in enumerate(themes) if len(t) == len(v)]
                sims = np.round(np.array([themes[i] for i in same]) @ v, 9) if same else np.empty(0)
                best = same[len(sims) - 1 - int(sims[::-1].argmax())] if len(sims) else -1
                if best >= 0 and sims.max() >= threshold:
                    leaders.append(leaders.pop(best))
                    themes.append(themes.pop(best))
                    out.append((leaders[-1], float(sims.max())))
                else:
                    leaders.append(fact)
                    themes.append(v)
                    out.append((fact, 1.0))
                    del leaders[:-candidates], themes[:-candidates]
            if out:
                yield pd.DataFrame({"profile_id": batch["profile_id"], "slice": batch["slice"], "fact_id": batch["fact_id"], "leader": [o[0] for o in out], "similarity": [o[1] for o in out]})

    kind = facts.schema["profile_id"].dataType.simpleString()
    rows = dealt.select("profile_id", F.unix_timestamp("slice").alias("slice"), "fact_id", "embedding")
    return rows.mapInPandas(run, f"profile_id {kind}, slice long, fact_id long, leader long, similarity double")


def scenes(facts: DataFrame, every: str = "month", threshold: float = JOIN, candidates: int = CANDIDATES) -> DataFrame:
    """profile_id, fact_id, scene (the smallest first fact of it) and similarity to the fact's own leader."""
    found = checkpointed(in_slices(facts, every, threshold, candidates))
    unit = F.transform(F.col("embedding"), lambda x: x.cast("double") / F.greatest(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))), F.lit(1e-300)))
    vectors = facts.select(F.col("fact_id").alias("leader"), unit.alias("u"))
    last = found.groupBy("profile_id", "slice", "leader").agg(F.max("fact_id").alias("latest")).join(vectors, "leader")
    # The number of the slice among those of its profile, so that the one before need not be the month before.
    place = found.select("profile_id", "slice").distinct().withColumn("place", F.row_number().over(Window.partitionBy("profile_id").orderBy("slice")))
    last = last.join(place.withColumnRenamed("profile_id", "p"), F.col("profile_id").eqNullSafe(F.col("p")) & (last["slice"] == place["slice"])).select("profile_id", "place", "leader", "latest", "u")
    w = Window.partitionBy("profile_id", "place").orderBy(F.desc("latest"))
    before = last.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= candidates).select(F.col("profile_id").alias("q"), (F.col("place") + 1).alias("next"), F.col("leader").alias("old"), F.col("u").alias("v"))
    both = last.join(before, F.col("profile_id").eqNullSafe(F.col("q")) & (F.col("place") == F.col("next")) & (F.size("u") == F.size("v")))
    sim = F.round(F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    goes_on = both.select("leader", "old", sim.alias("s")).where(F.col("s") >= threshold).groupBy("leader").agg(F.max(F.struct("s", (-F.col("old")).alias("o"))).alias("m"))
    links = goes_on.select(F.col("leader").alias("src"), (-F.col("m.o")).alias("dst"), F.lit(1).alias("weight"))
    one = components(links).select(F.col("node").alias("leader"), F.col("component").alias("scene"))
    return found.join(one, "leader", "left").select("profile_id", "fact_id", F.coalesce("scene", "leader").alias("scene"), "similarity")
