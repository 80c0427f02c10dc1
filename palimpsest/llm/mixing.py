"""Mixing sources to target weights by iterative proportional fitting.

The tokens of all documents are summed by cell (source, language, topic). Raking scales the cells to the target
marginals of source, language and topic in turn until every marginal is within tolerance. A cell's weight is its raked
tokens over its own; documents are kept with probability share * weight, so the expected tokens are the wanted share
of all. Where that is over 1 in a cell, the cells are raked again with probabilities of at most 1, so that other
cells make up for what it lacks. A level whose tokens are fewer than its target gives all it has, the others of its
dimension share the rest by their targets, and what is missed is logged. Whether a document is kept depends on a
hash of its id alone, so a rerun or a lost executor gives the same sample.

Only the table of cells is iterated: up to BROADCAST_CELLS cells by arrays in one task, more by joins and windows, each
round checkpointed. Null texts have no tokens; a null source or language is a level of its own. Very long texts count
whole. Documents without tokens have the weight of their cell, 0 in a cell without any. Repeated ids are kept or left
together; a document stays if the hash of its id, as a share of all hashes, is under its probability, and goes where they are equal.
An empty table gives an empty result; other columns are passed on, whatever their names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

DIMENSIONS = ("source", "lang", "topic")
NONE = "\0none"
BROADCAST_CELLS = 200_000


def n_tokens(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long")


def topic(text: Column) -> Column:
    """A plain surface topic: table, shouting, contact, list or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!!"), "shouting")
        .when(text.rlike(r"[0-9]{6,}|@[a-z]"), "records")
        .when(F.length(text) < 600, "short")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of a dimension: its shares of the tokens to the given power, made to sum to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0")
    raised = sums.withColumn("t", F.pow("t", F.lit(power)))
    total = raised.agg(F.sum("t")).first()[0] or 1.0
    return raised.select(dimension, (F.col("t") / F.lit(total)).alias("target"))


def given(spark, dimension: str, shares: Mapping[str, float]) -> DataFrame:
    total = sum(shares.values())
    return spark.createDataFrame([(k, v / total) for k, v in shares.items()], f"{dimension} string, target double")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-4, max_rounds: int = 30) -> tuple[DataFrame, float]:
    """cells (dimensions, tokens) with raked shares and the targets of their levels, and the largest distance of a marginal from its target.

    Cells whose level has no target get 0. Targets are made to fit the levels that have tokens. Cells are dealt by each
    dimension in turn.
    """
    now = cells.where("tokens > 0")
    for d, shares in targets.items():
        now = now.join(shares.withColumnRenamed("target", f"target_{d}"), d)
    for d in targets:
        seen = now.select(d, f"target_{d}").distinct().agg(F.sum(f"target_{d}")).first()[0] or 1.0
        now = now.withColumn(f"target_{d}", F.col(f"target_{d}") / F.lit(seen))
    total = now.agg(F.sum("tokens")).first()[0] or 1
    now = checkpointed(now.withColumn("raked", F.col("tokens") / F.lit(total)))
    off = 0.0
    for _ in range(max_rounds):
        for d in targets:
            now = now.withColumn("raked", F.col("raked") * F.col(f"target_{d}") / F.sum("raked").over(Window.partitionBy(d)))
        now = checkpointed(now)
        gaps = [now.groupBy(d).agg(F.abs(F.sum("raked") - F.first(f"target_{d}")).alias("gap")) for d in targets]
        gap = gaps[0].select("gap")
        for other in gaps[1:]:
            gap = gap.union(other.select("gap"))
        off = gap.agg(F.max("gap")).first()[0] or 0.0
        if off <= tolerance:
            break
    return now.select(*DIMENSIONS, "tokens", "raked", *[f"target_{d}" for d in targets]), off


def _filling(group: list[str], size: str, rate: Column, wanted: Column) -> Column:
    """The factor at which the sum of size * min(1, factor * rate) over a group is wanted; all of it where that is too much."""
    order = Window.partitionBy(*group).orderBy(rate.desc())
    full = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col(size) * rate).over(order.rowsBetween(0, Window.unboundedFollowing))
    return (wanted - full) / rest


def _filled(rows: DataFrame, group: list[str], size: str, rate: str, wanted: Column) -> DataFrame:
    """rows with rate times the factor of _filling."""
    rows = rows.withColumn("_f", _filling(group, size, F.col(rate), wanted))
    every = Window.partitionBy(*group)
    factor = F.coalesce(F.max(F.when(F.col("_f") * F.col(rate) <= 1, F.col("_f"))).over(every), 1 / F.min(rate).over(every))
    return rows.withColumn(rate, F.col(rate) * factor).drop("_f")


def bounded(weighed: DataFrame, share: float, tolerance: float = 1e-4, max_rounds: int = 60) -> tuple[DataFrame, float]:
    """weighed (dimensions, tokens, weight, targets) with probabilities, and the largest distance of a marginal from its target.

    The probabilities are min(1, weight times a factor of each level), with factors at which the expected tokens of
    every level are its target of the wanted ones, or all it has. Each level's factor is solved in turn.
    """
    n_cells, total, most = weighed.agg(F.count(F.lit(1)), F.sum("tokens"), F.max("weight")).first()
    share = min(share, 1.0)
    if not n_cells or most * share <= 1:
        return weighed.withColumn("probability", F.lit(share) * F.col("weight")), 0.0
    now = weighed.withColumn("rate", F.lit(share) * F.col("weight"))
    for d in DIMENSIONS:
        levels = weighed.groupBy(d).agg(F.sum("tokens").alias("own"), F.first(f"target_{d}").alias("target"))
        levels = levels.where("target > 0").withColumns({"rate": F.col("target") / F.col("own"), "_all": F.lit(0)})
        levels = _filled(levels, ["_all"], "own", "rate", F.lit(share * total))
        now = now.join(levels.select(d, (F.col("own") * F.least(F.lit(1.0), F.col("rate"))).alias(f"wanted_{d}")), d)
    now = checkpointed(now)
    expected = F.col("tokens") * F.least(F.lit(1.0), F.col("rate"))

    def gap(goal) -> float:
        sums = [now.groupBy(d).agg(F.abs(F.sum(expected) / F.lit(share * total) - F.first(goal(d))).alias("gap")).select("gap") for d in DIMENSIONS]
        return sums[0].union(sums[1]).union(sums[2]).agg(F.max("gap")).first()[0] or 0.0

    for _ in range(max_rounds):
        for d in DIMENSIONS:
            now = _filled(now, [d], "tokens", "rate", F.col(f"wanted_{d}"))
        now = checkpointed(now)
        if gap(lambda d: F.col(f"wanted_{d}") / F.lit(share * total)) <= tolerance:
            break
    return now.withColumn("probability", F.least(F.lit(1.0), F.col("rate"))), gap(lambda d: F.col(f"target_{d}"))


def _filling_factors(group: np.ndarray, size: np.ndarray, rate: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """_filled in arrays: rate times its group's factor at which the sum of size * min(1, rate) is wanted, or all of it."""
    order = np.lexsort((-rate, group))
    g, s, r = group[order], size[order], rate[order]
    begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    before = np.cumsum(s) - s
    after = np.cumsum((s * r)[::-1])[::-1]
    own = np.repeat(np.arange(len(begins)), np.diff(np.concatenate([begins, [len(g)]])))
    ends = np.concatenate([begins[1:], [len(g)]])
    beyond = np.concatenate([after, [0.0]])[ends]
    with np.errstate(divide="ignore", invalid="ignore"):
        factor = (wanted[g] - (before - before[begins][own])) / (after - beyond[own])
        fits = np.where(factor * r <= 1, factor, -np.inf)
    best = np.maximum.reduceat(fits, begins)
    best = np.where(np.isfinite(best), best, 1 / np.minimum.reduceat(r, begins))
    out = np.empty_like(rate)
    out[order] = r * best[own]
    return out


def solved(cells: pd.DataFrame, share: float, tolerance: float = 1e-4, rake_rounds: int = 30, fill_rounds: int = 60) -> pd.DataFrame:
    """rake and bounded in arrays: cells (dimensions, tokens, target of each level) with weight, probability, off and missed."""
    tokens = cells["tokens"].to_numpy(np.float64)
    codes = [pd.factorize(cells[d])[0] for d in DIMENSIONS]
    targets = []
    for d, code in zip(DIMENSIONS, codes, strict=True):
        level = np.zeros(code.max(initial=-1) + 1)
        level[code] = cells[f"target_{d}"]
        targets.append(level / (level.sum() or 1.0))
    total, off = tokens.sum() or 1.0, 0.0
    raked = tokens / total
    for _ in range(rake_rounds):
        for code, level in zip(codes, targets, strict=True):
            raked = raked * (level / np.bincount(code, raked, len(level)))[code]
        off = max((np.abs(np.bincount(c, raked, len(t)) - t).max(initial=0.0) for c, t in zip(codes, targets, strict=True)), default=0.0)
        if off <= tolerance:
            break
    weight, share, missed = raked * total / tokens, min(share, 1.0), 0.0
    probability = share * weight
    if probability.max(initial=0.0) > 1:
        goals = []
        for code, level in zip(codes, targets, strict=True):
            own = np.bincount(code, tokens, len(level))
            rate = _filling_factors(np.zeros(len(own), np.int64), own, level / own, np.array([share * total]))
            goals.append(own * np.minimum(1, rate))
        for _ in range(fill_rounds):
            for code, goal in zip(codes, goals, strict=True):
                probability = _filling_factors(code, tokens, probability, goal)
            expected = tokens * np.minimum(1, probability)
            if max(np.abs(np.bincount(c, expected, len(g)) - g).max() for c, g in zip(codes, goals, strict=True)) <= tolerance * share * total:
                break
        missed = max(np.abs(np.bincount(c, expected, len(t)) / (share * total) - t).max() for c, t in zip(codes, targets, strict=True))
    return cells[[*DIMENSIONS, "tokens"]].assign(weight=weight, probability=np.minimum(1, probability), off=off, missed=missed)


def _solved_at_once(cells: DataFrame, targets: Mapping[str, DataFrame], share: float) -> tuple[DataFrame, float, float]:
    """The few cells with weight and probability, by one task; how far marginals are off in weights and in the sample."""
    for d, shares in targets.items():
        cells = cells.join(F.broadcast(shares.withColumnRenamed("target", f"target_{d}")), d)

    def all_of_them(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if sum(map(len, held)):
            yield solved(pd.concat(held).sort_values(list(DIMENSIONS), ignore_index=True), share)

    kinds = ", ".join(f"{d} string" for d in DIMENSIONS)
    rows = cells.where("tokens > 0").coalesce(1).mapInPandas(all_of_them, f"{kinds}, tokens long, weight double, probability double, off double, missed double")
    rows = checkpointed(rows)
    off, missed = rows.agg(F.max("off"), F.max("missed")).first()
    return rows, off or 0.0, missed or 0.0


def _levels(text_col: str) -> dict[str, Column]:
    own = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col))}
    return {d: F.coalesce(c.cast("string"), F.lit(NONE)) for d, c in own.items()}


def fitted(
    docs: DataFrame,
    share: float,
    powers: Mapping[str, float] | None = None,
    shares: Mapping[str, Mapping[str, float]] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """The weight of each cell and the probability of its documents; targets that are missed are logged."""
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.7} | dict(powers or {})
    levels = [c.alias(d) for d, c in _levels(text_col).items()]
    rows = docs.select(*levels, n_tokens(F.col(text_col)).alias("n_tokens"))
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    targets = {d: given(docs.sparkSession, d, shares[d]) if shares and d in shares else tempered(cells, d, powers[d]) for d in DIMENSIONS}
    n_cells = cells.count()
    if n_cells <= BROADCAST_CELLS:
        found, off, missed = _solved_at_once(cells, targets, share)
    else:
        raked, off = rake(cells, targets)
        all_tokens = raked.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        weighed = checkpointed(raked.withColumn("weight", F.col("raked") * F.lit(all_tokens) / F.col("tokens")))
        found, missed = bounded(weighed, share)
    if max(off, missed) > 1e-3:
        logging.getLogger(__name__).warning("target shares are missed by up to %.4f (weights) and %.4f (sample of %s of the tokens)", off, missed, share)
    weights = found.select(F.struct(*DIMENSIONS).alias("_cell"), F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    return F.broadcast(weights) if n_cells <= BROADCAST_CELLS else weights


def _kept(identity: Column, seed: int) -> tuple[Column, Column]:
    """The probability of a document, and whether the hash of its id falls under it."""
    probability = F.coalesce("_probability", F.lit(0.0))
    unit = F.shiftrightunsigned(F.xxhash64(identity, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return probability, unit < probability


def mix(docs: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **targets) -> DataFrame:
    """id, source, lang, topic, n_tokens, weight, probability and kept for every row of docs.

    Targets: shares gives those of a dimension; other dimensions are tempered by their power, in powers.
    """
    weights = fitted(docs, share, text_col=text_col, **targets)
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*[c.alias(d) for d, c in _levels(text_col).items()]).alias("_cell"), n_tokens(F.col(text_col)).alias("n_tokens"))
    probability, kept = _kept(F.col("id"), seed)
    return rows.join(weights, "_cell", "left").select(
        F.col("id").alias(id_col),
        *[F.when(F.col("_cell")[d] != NONE, F.col("_cell")[d]).alias(d) for d in DIMENSIONS],
        "n_tokens",
        F.coalesce("_weight", F.lit(0.0)).alias("weight"),
        probability.alias("probability"),
        kept.alias("kept"),
    )


def mixed(docs: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, **targets) -> DataFrame:
    """The kept rows of docs with all their columns; the texts are not shuffled."""
    weights = fitted(docs, share, text_col=text_col, **targets)
    held = docs.select(F.struct("*").alias("_row"), F.struct(*[c.alias(d) for d, c in _levels(text_col).items()]).alias("_cell"))
    _, kept = _kept(F.col("_row")[id_col], seed)
    return held.join(weights, "_cell", "left").where(kept).select("_row.*")
