"""Language-model scoring with a probabilistic suffix tree.

A text is its tokens (runs of other characters than ASCII white space, A-Z lowered) and an end. The tree predicts
it byte by byte: a space closes each token, the end is a symbol of its own. Counts of every run of up to
DEPTH context bytes and the next byte are taken over all training texts on Spark. A context becomes a
state if it is frequent enough and its next-symbol distribution diverges from that of its suffix (Kullback-Leibler);
the suffixes of states are states. Each state's distribution is smoothed towards that of its suffix, by the number
of different symbols that followed, and a byte is scored by the longest state that its context ends with. A text's
score is the sum over its bytes, from the tree alone.

Runs are a Spark table. All contexts of PIVOT or more bytes that end alike (in the same PIVOT bytes) lie, with their runs and
their suffixes of that length, in one task after one shuffle of the longest runs; it finds their counts and states
from these alone. Shorter contexts are at most 256 ** PIVOT runs, whatever the input, and are broadcast. What else is broadcast
is a cache: the tree's probabilities of the runs of at least min_share of the training bytes, and at most CACHED. The
other bytes of texts meet the runs that end like their contexts in a second such shuffle, so the cache's size changes the speed,
not the score. A tree of at most WHOLE runs is broadcast as it is. Tokens under min_share of all tokens are looked up by a
join; they are known by 64-bit hashes.

Null and empty texts are just the end. Very long texts are scored whole, some LIMIT bytes at a time. Repeated rows are
scored alike and count as often as they occur in training; so do repeated ids. An empty training set gives a uniform
model. There are no ties: nothing is chosen by rank. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import SPACED, span_hashes
from palimpsest.session import arrow_batches, written

DEPTH = 6
SYMBOLS = 256
#: Bytes of texts that are worked on at once; entries of counts that a task holds before it merges them, and before it sends them on.
LIMIT, KEPT = 1 << 20, 2_000_000
#: Last bytes of a context that deal it to its task; runs of a tree that is broadcast whole, runs that are cached, rows of whole groups worked on at once.
PIVOT, WHOLE, CACHED, CHUNK = 3, 1 << 19, 1 << 22, 1 << 19
#: Bytes that no token holds: what stands before a text, and its end.
START, END = b"\t" * DEPTH, b"\n"
COUNT_TYPE = "kind int, key long, n long"
GRAMS, WORDS, TEXTS = range(3)


class Counts(NamedTuple):
    """Runs (gram, n) and tokens by hash (word, n); numbers of texts, tokens with ends, distinct tokens with the end, bytes, distinct runs."""

    grams: DataFrame
    words: DataFrame
    texts: int
    tokens: int
    types: int
    symbols: int
    distinct: int


class Level(NamedTuple):
    """Contexts of one length: their runs, sorted, with their counts; contexts, sorted, with the counts and the number of
    different next bytes of their runs, and whether they are states."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray
    states: np.ndarray


class Rule(NamedTuple):
    """When a context is a state, and how its distribution is smoothed: it leaves novelty * types to its suffix."""

    divergence: float
    evidence: float
    novelty: float


class Tree(NamedTuple):
    """Levels of all lengths (whole), or of those under PIVOT and the log10 probabilities of the cached runs, sorted."""

    levels: list[Level]
    whole: bool
    rule: Rule
    keys: np.ndarray
    logs: np.ndarray


def tokens(text) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return data.translate(SPACED).split()


def stream(words: list[bytes]) -> bytes:
    return START + b" ".join([*words, END])


class Streams(NamedTuple):
    """Streams of texts in one buffer; its first skip bytes are context only. closes: the place after each text that ends in it."""

    data: bytes
    skip: int
    closes: np.ndarray


def streams_of(texts) -> Iterator[Streams]:
    """The streams of texts, about LIMIT bytes at a time. A longer text is cut after spaces and stands first in its buffers."""
    parts: list[bytes] = []
    closes: list[int] = []
    size = skip = 0
    for text in texts:
        own = stream(tokens(text))
        if parts and size + len(own) > LIMIT:
            yield Streams(b"".join(parts), skip, np.array(closes))
            parts, closes, size, skip = [], [], 0, 0
        while len(own) > LIMIT:
            cut = own.rfind(b" ", skip + 1, LIMIT) + 1
            if cut <= max(skip, DEPTH):
                break
            yield Streams(own[:cut], skip, np.empty(0, np.int64))
            own, skip = own[cut - DEPTH :], DEPTH
        parts.append(own)
        size += len(own)
        closes.append(size)
    if parts:
        yield Streams(b"".join(parts), skip, np.array(closes))


def gram_keys(streams: Streams) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all places that are predicted, and the places; a key's low byte is the symbol."""
    raw = np.frombuffer(streams.data, np.uint8)
    key = raw.astype(np.int64)
    for back in range(1, DEPTH + 1):
        key[back:] |= raw[:-back].astype(np.int64) << (8 * back)
    at = np.flatnonzero(raw != START[0])
    at = at[at >= streams.skip]
    return key[at], at


def word_hashes(streams: Streams) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens but the ends, and where they begin."""
    raw = np.frombuffer(streams.data, np.uint8)
    gap = (raw == 0x20) | (raw == START[0]) | (raw == END[0])
    starts, ends = np.flatnonzero(~gap[1:] & gap[:-1]) + 1, np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    starts, ends = starts[starts >= streams.skip], ends[ends > streams.skip]
    return span_hashes(raw, starts, ends).view(np.int64), starts


def runs(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often (or with what weight) they occur."""
    if weights is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    if weights is not None:
        return values[first], np.add.reduceat(weights, first) if len(first) else weights[:0]
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


class Tally:
    """Counts of numbers, merged now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.parts.append(runs(values))
        self.size += len(self.parts[-1][0])
        if self.size > KEPT:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [runs(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        self.size = sum(len(k) for k, _ in self.parts)
        return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def count(train: DataFrame, text_col: str = "text") -> Counts:
    """Counts of tokens and of runs of DEPTH + 1 bytes, over all rows of train."""

    def table(kind: int, tally: Tally) -> pd.DataFrame:
        keys, n = tally.merge()
        tally.parts, tally.size = [], 0
        return pd.DataFrame({"kind": np.full(len(keys), kind, np.int32), "key": keys, "n": n})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = {GRAMS: Tally(), WORDS: Tally()}
        texts = 0
        for frame in frames:
            texts += len(frame)
            for streams in streams_of(frame["text"]):
                tallies[GRAMS].add(gram_keys(streams)[0])
                tallies[WORDS].add(word_hashes(streams)[0])
                for kind, tally in tallies.items():
                    if len(tally.parts) == 1 and tally.size > KEPT // 2:
                        yield table(kind, tally)
        for kind, tally in tallies.items():
            yield table(kind, tally)
        yield pd.DataFrame({"kind": np.array([TEXTS], np.int32), "key": [0], "n": [texts]})

    raw = train.select(F.col(text_col).alias("text")).mapInPandas(counted, COUNT_TYPE)
    with arrow_batches(train.sparkSession):
        counts = written(raw.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    n, types = ({r["kind"]: r[c] for r in sums} for c in ("n", "types"))
    texts = n.get(TEXTS, 0)
    grams, words = (counts.where(F.col("kind") == kind).select(F.col("key").alias(name), "n") for kind, name in ((GRAMS, "gram"), (WORDS, "word")))
    return Counts(grams, words, texts, n.get(WORDS, 0) + texts, types.get(WORDS, 0) + (texts > 0), n.get(GRAMS, 0), types.get(GRAMS, 0))


def arrays(rows: DataFrame, key: str, *values: str) -> list[np.ndarray]:
    """Columns of a DataFrame of bounded size as arrays, in the order of key."""
    found = rows.select(key, *values).toArrow()
    keys = found[key].to_numpy()
    order = np.argsort(keys)
    return [keys[order], *(found[v].to_numpy()[order].astype(np.float64) for v in values)]


def low_bytes(keys: np.ndarray, k: int) -> np.ndarray:
    return keys & ((1 << (8 * k)) - 1)


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def grown(keys: np.ndarray, counts: np.ndarray, longest: int, lower: list[Level], rule: Rule, needed: np.ndarray) -> list[Level]:
    """Levels of len(lower) to longest bytes, from all runs of longest bytes that end in the same len(lower) ones.

    lower: the levels of fewer bytes. needed: contexts of longest bytes that are suffixes of states.
    """
    levels, own_shares = [], []
    for k in range(longest, len(lower) - 1, -1):
        keys, counts = runs(low_bytes(keys, k + 1), counts)
        contexts = keys >> 8
        first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]][: len(keys)])
        types = np.diff(np.r_[first, len(keys)])
        totals = np.add.reduceat(counts, first) if len(first) else counts
        levels.insert(0, Level(keys, counts, contexts[first], totals, types, np.full(len(first), k == 0)))
        own_shares.insert(0, (first, counts / np.repeat(totals, types)))
    for k in range(longest, max(len(lower), 1) - 1, -1):
        own, (first, share) = levels[k - len(lower)], own_shares[k - len(lower)]
        if not len(first):
            continue
        if k > len(lower):
            below, before = levels[k - len(lower) - 1], own_shares[k - len(lower) - 1][1]
            before = before[_find(below.keys, low_bytes(own.keys, k))[0]]
        else:
            below = lower[-1]
            suffixes = low_bytes(own.keys, k)
            before = below.counts[_find(below.keys, suffixes)[0]] / below.totals[_find(below.contexts, suffixes >> 8)[0]]
        gain = np.add.reduceat(share * np.log(share / before), first)
        passed = (own.totals >= 2) & (gain >= rule.divergence) & (gain * own.totals >= rule.evidence)
        own.states[:] = passed | np.isin(own.contexts, needed)
        needed = np.unique(low_bytes(own.contexts[own.states], k - 1))
    return levels


def smoothed(levels: list[Level], shortest: int, keys: np.ndarray, novelty: float) -> tuple[np.ndarray, np.ndarray]:
    """a and b of each key: its probability is a + b * p, where p is that of its suffix with shortest - 1 context bytes.

    levels: those of shortest bytes and more. A state's suffixes are states, so a key stops at its first context that is none.
    """
    a, b, live = np.zeros(len(keys)), np.ones(len(keys)), np.arange(len(keys))
    for k, own in enumerate(levels, shortest):
        grams = low_bytes(keys[live], k + 1)
        at, there = _find(own.contexts, grams >> 8)
        there &= own.states[at] if len(own.states) else there
        at, live, grams = at[there], live[there], grams[there]
        place, known = _find(own.keys, grams)
        n = np.where(known, own.counts[place], 0) if len(own.counts) else np.zeros(len(grams))
        mass = novelty * own.types[at]
        a[live], b[live] = (n + mass * a[live]) / (own.totals[at] + mass), mass * b[live] / (own.totals[at] + mass)
    return a, b


def chances(levels: list[Level], keys: np.ndarray, novelty: float) -> np.ndarray:
    """Probability of each key's symbol after its context, by levels of no bytes and more."""
    a, b = smoothed(levels, 0, keys, novelty)
    return a + b / SYMBOLS


def together(grams: DataFrame) -> DataFrame:
    """grams (the first column is gram) with all that end in the same PIVOT context bytes in one task, one after another."""
    pivot = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * PIVOT)) - 1).cast("long"))
    return grams.withColumn("pivot", pivot).repartition("pivot").sortWithinPartitions("pivot").drop("pivot")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows that together() gives a task, about CHUNK rows at a time; what belongs together stays together."""
    held: list[list[np.ndarray]] = []
    size, limit = 0, CHUNK
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= limit:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            pivots = low_bytes(columns[0] >> 8, PIVOT)
            cut = int(np.flatnonzero(np.r_[True, pivots[1:] != pivots[:-1]])[-1])
            if cut:
                yield [c[:cut] for c in columns]
            held, size = [[c[cut:].copy() for c in columns]], size - cut
            limit = max(CHUNK, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


NONE = np.empty(0, np.int64)


def fit(counts: Counts, min_share: float = 3e-8, divergence: float = 0.001, evidence: float = 3.0, novelty: float = 4.0) -> Tree:
    """The tree of counts: tests each context seen twice against its suffix, and keeps the suffixes of states.

    What comes to the driver is bounded: a tree of at most WHOLE runs, or the levels under PIVOT and the cached probabilities.
    """
    rule = Rule(divergence, evidence, novelty)
    least = max(1.0, counts.symbols * min_share)
    if least <= 1 and counts.distinct <= WHOLE:
        keys, n = arrays(counts.grams, "gram", "n")
        return Tree(grown(keys, n, DEPTH, [], rule, NONE), True, rule, NONE, np.empty(0))
    while counts.distinct > CACHED and counts.grams.where(F.col("n") >= least).count() > CACHED:
        least *= 2
    short = F.col("gram").bitwiseAND(F.lit((1 << (8 * PIVOT)) - 1).cast("long")).alias("gram")
    short_keys, short_n = arrays(counts.grams.groupBy(short).agg(F.sum("n").alias("n")), "gram", "n")
    shared = counts.grams.sparkSession.sparkContext.broadcast(grown(short_keys, short_n, PIVOT - 1, [], rule, NONE))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in groups(batches):
            levels = grown(keys, n.astype(np.float64), DEPTH, shared.value, rule, NONE)
            needed = np.unique(low_bytes(levels[0].contexts[levels[0].states], PIVOT - 1))
            hot = np.sort(keys[n >= least])
            a, b = smoothed(levels, PIVOT, hot, novelty)
            cached = np.r_[np.ones(len(hot), bool), np.zeros(len(needed), bool)]
            none = np.zeros(len(needed))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cached, np.r_[hot, needed], np.r_[a, none], np.r_[b, none])], names=["cached", "key", "a", "b"])

    rows = together(counts.grams.select("gram", "n")).mapInArrow(found, "cached boolean, key long, a double, b double").toArrow()
    cached, keys, a, b = (rows[c].to_numpy() for c in ("cached", "key", "a", "b"))
    levels = grown(short_keys, short_n, PIVOT - 1, [], rule, np.unique(keys[~cached]))
    keys, a, b = keys[cached], a[cached], b[cached]
    order = np.argsort(keys)
    suffixes, back = np.unique(low_bytes(keys, PIVOT), return_inverse=True)
    return Tree(levels, False, rule, keys[order], np.log10(a + b * chances(levels, suffixes, novelty)[back])[order])


def log10_probabilities(tree: Tree, keys: np.ndarray) -> np.ndarray:
    """log10 of each key's symbol after its context, by the longest state that the context ends with; nan if the cache can't tell."""
    distinct, back = np.unique(keys, return_inverse=True)
    if tree.whole:
        return np.log10(chances(tree.levels, distinct, tree.rule.novelty))[back]
    at, there = _find(tree.keys, distinct)
    return np.where(there, tree.logs[at] if len(tree.logs) else 0.0, np.nan)[back]


def looked_up(asked: DataFrame, counts: Counts, tree: Tree) -> DataFrame:
    """row, deeper: the sum of times * the tree's log10 probability over the grams of each row of asked (gram, times, row)."""
    shared = counts.grams.sparkSession.sparkContext.broadcast((tree.levels, tree.rule))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, rule = shared.value
        for grams, n, row in groups(batches):
            known = row < 0
            distinct, back = np.unique(grams[~known], return_inverse=True)
            if len(distinct):
                levels = grown(grams[known], n[known].astype(np.float64), DEPTH, lower, rule, NONE)
                a, b = smoothed(levels, PIVOT, distinct, rule.novelty)
                logs = np.log10(a + b * chances(lower, low_bytes(distinct, PIVOT), rule.novelty))
                yield pa.RecordBatch.from_arrays([pa.array(row[~known]), pa.array(n[~known] * logs[back])], names=["row", "deeper"])

    both = counts.grams.select("gram", "n", F.lit(-1).cast("long").alias("row")).union(asked.select("gram", "times", "row"))
    return together(both).mapInArrow(valued, "row long, deeper double").groupBy("row").agg(F.sum("deeper").alias("deeper"))


def score(
    docs: DataFrame, counts: Counts, tree: Tree, id_col: str = "doc_id", text_col: str = "text", min_share: float = 1e-6, alpha: float = 0.1
) -> DataFrame:
    """id, n_tokens, n_known, base_score (smoothed unigram) and score (the tree's), both log10 probabilities."""
    spark = docs.sparkSession
    words, seen = arrays(counts.words.where(F.col("n") >= max(2.0, counts.tokens * min_share)), "word", "n")
    shared = spark.sparkContext.broadcast((tree, words, seen))
    below = float(counts.tokens + alpha * (counts.types + 1))

    @F.pandas_udf("n_tokens long, known long, base double, score double, rare array<long>, grams array<long>, times array<long>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree, words, seen = shared.value
        for texts in batches:
            rows: list[tuple] = []
            open_sum, open_words, open_grams = 0.0, [], []
            for streams in streams_of(texts):
                keys, at = gram_keys(streams)
                codes, distinct = pd.factorize(keys)
                values = np.zeros(len(streams.data))
                logs = log10_probabilities(tree, distinct)
                unsure = np.isnan(logs)
                values[at] = np.where(unsure, 0.0, logs)[codes]
                unsure = unsure[codes]
                keys, at = keys[unsure], at[unsure]
                hashes, starts = word_hashes(streams)
                if not len(streams.closes):
                    open_sum += values.sum()
                    open_words.append(hashes)
                    open_grams.append(keys)
                    continue
                sums = np.add.reduceat(values, np.concatenate([[0], streams.closes[:-1]]))
                own = np.split(hashes, np.searchsorted(starts, streams.closes[:-1]))
                sums[0] += open_sum
                own[0] = np.concatenate([*open_words, own[0]])
                grams = np.split(keys, np.searchsorted(at, streams.closes[:-1]))
                grams[0] = np.concatenate([*open_grams, grams[0]])
                open_sum, open_words, open_grams = 0.0, [], []
                each = np.concatenate(own)
                place, there = _find(words, each)
                logs = np.log10(((seen[place] if len(words) else 0) + alpha) / below) * there
                ends = np.cumsum([len(x) for x in own])
                for i, (a, b) in enumerate(zip(ends - [len(x) for x in own], ends, strict=True)):
                    rows.append((b - a + 1, int(there[a:b].sum()), logs[a:b].sum(), sums[i], each[a:b][~there[a:b]], *runs(grams[i])))
            yield pd.DataFrame(rows, columns=["n_tokens", "known", "base", "score", "rare", "grams", "times"])

    own = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), scored(F.col(text_col)).alias("s"))
    with arrow_batches(spark):
        part = written(own.select("id", "row", "s.*"), "scored")
    rare = part.select("row", F.explode("rare").alias("word")).join(counts.words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = rare.groupBy("row").agg(F.sum(F.log10((F.col("n") + alpha) / F.lit(below))).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("also"))
    joined = part.join(sums, "row", "left")
    if tree.whole:
        joined = joined.withColumn("deeper", F.lit(0.0))
    else:
        deep = part.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select(F.col("g.grams").alias("gram"), "g.times", "row")
        joined = joined.join(looked_up(deep, counts, tree), "row", "left")
    end = float(np.log10((counts.texts + alpha) / below))
    return joined.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0)) + F.lit(int(counts.texts > 0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        (F.col("score") + F.coalesce("deeper", F.lit(0.0))).alias("score"),
    )
