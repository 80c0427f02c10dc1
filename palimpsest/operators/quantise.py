"""Vector quantisers: a seeded rotation, levels or angles of few bits packed into bytes, and a one-bit sketch of the rest.

Three codes share the rotation, which spreads a vector's energy evenly, so that its components are nearly normal:
`turbo` rounds each component to the Lloyd-Max levels of that normal; `polar` takes the vector's angles one after the
other and rounds each to the levels of its density; either may carry a sketch (signs of normal projections of what the code misses,
and its length) whose estimate of an inner product is unbiased. Matrices hang on (dim, seed) only and are made where
they are used; they are dim * dim numbers, whatever the number of vectors. Encoding and decoding are one pass without
a shuffle. Left out are vectors that are null, hold a null or non-finite component, or have another length than dim.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import best_in_blocks, top_per_query, unit
from palimpsest.session import written

#: More than what rounding to six places and lengths in 32 bits can move a bound.
SLACK = 2e-6
CODES = "fact_id {kind}, bits int, radius float, codes binary, signs binary, rest float"


def packed(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Rows of numbers below 2**bits as rows of bytes, first number in the highest bits."""
    each = (numbers[:, :, None].astype(np.uint8) >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(each.reshape(len(numbers), -1), axis=1)


def unpacked(data: np.ndarray, bits: int, count: int) -> np.ndarray:
    each = np.unpackbits(data, axis=1)[:, : count * bits].reshape(len(data), count, bits)
    return (each << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2).astype(np.int64)


def lloyd_max(sigma: float, count: int, rounds: int = 500) -> np.ndarray:
    """Levels of least squared error for a normal of deviation sigma: each is the mean of its cell, cells end half way."""
    density = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    below = lambda x: 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in x]))
    levels = np.linspace(-3.5, 3.5, count)
    for _ in range(rounds):
        edges = np.r_[-12.0, (levels[1:] + levels[:-1]) / 2, 12.0]
        mass = np.diff(below(edges))
        fresh = np.where(mass > 1e-15, -np.diff(density(edges)) / np.maximum(mass, 1e-15), levels)
        if np.abs(fresh - levels).max() < 1e-10:
            break
        levels = fresh
    return levels * sigma


def angle_levels(power: int, count: int, rounds: int = 200) -> np.ndarray:
    """Levels of least squared error for an angle in [0, pi] whose density goes with a power of its sine."""
    grid = (np.arange(8192) + 0.5) * (math.pi / 8192)
    mass = np.r_[0, np.cumsum(np.sin(grid) ** power)]
    moment = np.r_[0, np.cumsum(grid * np.sin(grid) ** power)]
    levels = (np.arange(count) + 0.5) * (math.pi / count)
    for _ in range(rounds):
        cell = np.r_[0, np.searchsorted(grid, (levels[1:] + levels[:-1]) / 2), len(grid)]
        own = np.diff(mass[cell])
        levels = np.where(own > 0, np.diff(moment[cell]) / np.where(own > 0, own, 1), levels)
    return levels


@dataclass(frozen=True)
class Quantiser:
    dim: int
    bits: int = 4
    kind: str = "turbo"
    sketch: int = 0  #: Signs of the sketch; 0 for none.
    seed: int = 42

    def __post_init__(self) -> None:
        if self.bits not in (2, 4, 8) or self.kind not in ("turbo", "polar"):
            raise ValueError("bits must be 2, 4 or 8, and kind turbo or polar")

    @cached_property
    def rotation(self) -> np.ndarray:
        """Uniform among rotations: QR of a normal matrix, with signs that make R's diagonal positive."""
        q, r = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((self.dim, self.dim)))
        return q * np.sign(np.diag(r))

    @cached_property
    def projection(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).standard_normal((self.sketch, self.dim))

    @cached_property
    def levels(self) -> np.ndarray:
        return lloyd_max(1 / math.sqrt(self.dim), 1 << self.bits)

    @cached_property
    def angles(self) -> np.ndarray:
        """A row of levels for each angle but the last; angle k has the sine's power dim - 2 - k, from the 16th on as good as normal."""
        normal = lloyd_max(1.0, 1 << self.bits)
        powers = range(self.dim - 2, 0, -1)
        return np.array([math.pi / 2 + normal / math.sqrt(m + 0.5) if m >= 16 else angle_levels(m, 1 << self.bits) for m in powers])

    def numbers(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths (as kept, in float32) and codes of rows of x."""
        y = x @ self.rotation.T
        radius = np.linalg.norm(y, axis=1)
        y = y / np.maximum(radius, 1e-300)[:, None]
        if self.kind == "turbo":
            return radius.astype(np.float32), np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, y)
        # Angle k lies between axis k and what is left of the vector; the last one runs the whole circle.
        left = np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
        angle = np.arccos(np.clip(y[:, :-2] / np.maximum(left[:, :-2], 1e-300), -1, 1))
        last = np.arctan2(y[:, -1], y[:, -2]) % (2 * math.pi)
        found = np.empty(angle.shape, np.int64)
        for k, levels in enumerate(self.angles):
            found[:, k] = np.searchsorted((levels[1:] + levels[:-1]) / 2, angle[:, k])
        return radius.astype(np.float32), np.c_[found, np.minimum((last / (2 * math.pi) * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)]

    def vectors(self, radius: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Rows that codes stand for."""
        if self.kind == "turbo":
            y = self.levels[numbers]
        else:
            own = self.angles[np.arange(self.dim - 2), numbers[:, :-1]] if self.dim > 2 else np.empty((len(numbers), 0))
            angle = np.c_[own, (numbers[:, -1:] + 0.5) * (2 * math.pi / (1 << self.bits))]
            y = np.c_[np.ones(len(angle)), np.cumprod(np.sin(angle), 1)] * np.c_[np.cos(angle), np.ones(len(angle))]
        return (y * radius.astype(np.float64)[:, None]) @ self.rotation

    @property
    def count(self) -> int:
        return self.dim if self.kind == "turbo" else self.dim - 1

    def encoded(self, x: np.ndarray) -> pd.DataFrame:
        radius, numbers = self.numbers(x)
        out = pd.DataFrame({"radius": radius, "codes": [r.tobytes() for r in packed(numbers, self.bits)]})
        out["signs"], out["rest"] = None, np.float32(0)
        if self.sketch:
            rest = x - self.vectors(radius, numbers)
            out["signs"] = [r.tobytes() for r in np.packbits(rest @ self.projection.T > 0, axis=1)]
            out["rest"] = np.linalg.norm(rest, axis=1).astype(np.float32)
        return out

    def decoded(self, codes: pd.DataFrame) -> np.ndarray:
        data = np.array([np.frombuffer(c, np.uint8) for c in codes["codes"]])
        return self.vectors(codes["radius"].to_numpy(np.float32), unpacked(data, self.bits, self.count))

    def products(self, queries: np.ndarray, codes: pd.DataFrame) -> np.ndarray:
        """Inner products of queries (rows) and coded vectors (columns), with the sketch's correction where there is one."""
        return self.against(queries, *self.unpacked(codes))

    def unpacked(self, codes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
        """Vectors that codes stand for, and their sketches' signs times what these weigh."""
        if not self.sketch:
            return self.decoded(codes), None
        signs = np.unpackbits(np.array([np.frombuffer(c, np.uint8) for c in codes["signs"]]), axis=1)[:, : self.sketch] * 2.0 - 1
        return self.decoded(codes), signs * (math.sqrt(math.pi / 2) / self.sketch * codes["rest"].to_numpy(np.float64))[:, None]

    def against(self, queries: np.ndarray, decoded: np.ndarray, signs: np.ndarray | None) -> np.ndarray:
        out = queries @ decoded.T
        return out if signs is None else out + (queries @ self.projection.T) @ signs.T


def coded(vectors: DataFrame, quantiser: Quantiser, keep: bool = False) -> DataFrame:
    """fact_id, bits, radius, codes, signs, rest of vectors (fact_id, embedding); with keep the vector itself as source."""
    v = F.col("embedding")
    whole = vectors.where((F.size(v) == quantiser.dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = quantiser.encoded(np.array([np.asarray(r, np.float64) for r in batch["embedding"]]))
                out.insert(0, "fact_id", batch["fact_id"].to_numpy())
                out.insert(1, "bits", np.int32(quantiser.bits))
                yield out.assign(source=list(batch["embedding"])) if keep else out

    source = f", source {vectors.schema['embedding'].dataType.simpleString()}" if keep else ""
    return whole.select("fact_id", "embedding").mapInPandas(run, CODES.format(kind=vectors.schema["fact_id"].dataType.simpleString()) + source)


def restored(codes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """fact_id and the embedding that its code stands for, with the code itself, and the source if it was kept."""
    other = [f for f in codes.schema.fields if f.name in ("codes", "source")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"fact_id": batch["fact_id"], "embedding": list(quantiser.decoded(batch))} | {f.name: batch[f.name] for f in other})

    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in other)
    return codes.mapInPandas(run, f"fact_id {codes.schema['fact_id'].dataType.simpleString()}, embedding array<double>{kinds}")


def search(queries: DataFrame, codes: DataFrame, vectors: DataFrame, quantiser: Quantiser, k: int, candidates: int) -> DataFrame:
    """query_id, fact_id, score and rank: the k nearest coded vectors by cosine, exactly.

    A code with a sketch keeps the length of what it misses, so it bounds its vector's cosine from above. The candidates of
    the highest bounds are rescored by the vectors' own cosine, by a join on the id. Where the next bound does not lie
    below the k-th score, as with many copies of one vector, the query goes to the search over all coded vectors.
    """
    if not quantiser.sketch:
        raise ValueError("bounds need a quantiser with a sketch")

    def bounds(q: pd.DataFrame, own: pd.DataFrame) -> Callable[[slice], np.ndarray]:
        x, decoded, rest = unit(q["embedding"]), quantiser.decoded(own), own["rest"].to_numpy(np.float64)
        radius = np.maximum(own["radius"].to_numpy(np.float64), 1e-300)
        return lambda rows: (x[rows] @ decoded.T + rest) / radius

    asked = queries.select("query_id", "embedding")
    rough = written(best_in_blocks(asked, codes, candidates + 1, bounds, digits=9), "bounds")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    own = vectors.select("fact_id", F.col("embedding").alias("own"))
    both = rough.where(F.col("rank") <= candidates).select("query_id", "fact_id").join(own, "fact_id").join(asked, "query_id")
    length = F.sqrt(dot("own", "own")) * F.sqrt(dot("embedding", "embedding"))
    score = F.when(length > 0, dot("own", "embedding") / length).otherwise(0.0)
    found = written(top_per_query(both.select("query_id", "fact_id", F.round(score, 6).alias("score")), k), "found")
    least = found.groupBy("query_id").agg(F.min("score").alias("least"))
    more = rough.where(F.col("rank") > candidates).select("query_id", F.col("score").alias("next"))
    unsure = written(least.join(more, "query_id").where(F.col("next") + SLACK >= F.col("least")).select("query_id"), "unsure")
    if unsure.isEmpty():
        return found
    rest = best_in_blocks(asked.join(unsure, "query_id", "left_semi"), vectors.select("fact_id", "embedding").join(codes.select("fact_id"), "fact_id", "left_semi"), k)
    return found.join(unsure, "query_id", "left_anti").unionByName(rest)
