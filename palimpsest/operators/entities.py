"""Entity resolution: similar names found by bounds on their common letters, and mentions taken to known or new entities.

A Jaro-Winkler similarity of at least t asks for a number of common letters. With a common start of p letters (4 count at
most) Jaro itself must reach (t - p/10) / (1 - p/10), and as Jaro is at most (m/a + m/b + 1) / 3 for m common letters of
names of a and b letters, m/a + m/b must reach some c. The 64 letters that two blocks of names hold most often (each
numbered by how often it came before) are bits, so the common bits of two names, and the letters without a bit, bound m
from above by a whole number for each length. What is left is compared letter by letter, many pairs at a time, with the
places of a letter in a name as bits. Blocks of names of bounded size are packed into rows, and a row is a pair of blocks,
so names are not shuffled for each block they meet. No pair is lost; the work is that of all pairs of different names, one or two operations on
bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.graphs import components
from palimpsest.session import checkpointed

# The similarity that merges names, names that stand for someone else, and lengths of names.
MERGE = 0.85
PRONOUNS = ("i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "mine", "yours", "hers", "ours", "theirs", "myself", "yourself", "himself", "herself", "itself", "ourselves", "themselves")
SHORTEST, LONGEST = 3, 100
#: Names of a block, bounds that are taken at once, and pairs that are compared at once.
BLOCK, CELLS = 16384, 1 << 17
PAIRS = 16384
#: Names whose blocks are broadcast (about 80 MB), and entries of a block's table of letters (32 MB).
BROADCAST_NAMES, PLACES = 4_000_000, 1 << 22
#: Letters of names that are compared by bits.
WORD = 64


def reach(threshold: float, start: int) -> float:
    """The least m/a + m/b of a pair whose common start has that many letters."""
    return 3 * (threshold - 0.1 * start) / (1 - 0.1 * start) - 1


class Block:
    """Names with their letters."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.length = np.array([len(x) for x in names], np.int64)
        self.codes = np.full((len(names), max(int(self.length.max(initial=1)), 4)), -1, np.int32)
        self.codes[np.arange(self.codes.shape[1]) < self.length[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.int32)
        self.start = self.codes[:, :4]
        # A letter with how often it came before in the name.
        self.tokens = np.full(self.codes.shape, -1, np.int64)
        for i in range(self.codes.shape[1]):
            has = self.codes[:, i] >= 0
            before = (self.codes[:, :i] == self.codes[:, i, None]).sum(1)
            self.tokens[has, i] = self.codes[has, i].astype(np.int64) << 32 | before[has]


class Pair:
    """Two blocks with what is made for both: bits of their letters, and the places of letters in the second's names."""

    def __init__(self, a: Block, b: Block) -> None:
        self.a, self.b = a, b
        found, number = np.unique(np.concatenate([a.tokens[a.tokens >= 0], b.tokens[b.tokens >= 0]]), return_inverse=True)
        bit = np.zeros(len(found), np.uint64)
        often = np.argsort(-np.bincount(number, minlength=len(found)), kind="stable")[:WORD]
        bit[often] = np.uint64(1) << np.arange(len(often), dtype=np.uint64)
        self.bits, at = [], 0
        for block in (a, b):
            whole = np.zeros(block.tokens.shape, np.uint64)
            n = int((block.tokens >= 0).sum())
            whole[block.tokens >= 0] = bit[number[at : at + n]]
            self.bits.append(np.bitwise_or.reduce(whole, axis=1))
            at += n
        # Letters that have no bit may be common to any name.
        self.loose = [block.length - np.bitwise_count(bits) for block, bits in zip((a, b), self.bits, strict=True)]
        # The first four letters in a word each, of which some may be taken as equal that are not, and no end of a name.
        number = np.unique(np.concatenate([x.start for x in (a, b)]), return_inverse=True)[1].reshape(-1, 4).astype(np.uint64) % np.uint64(65533)
        number[np.concatenate([x.start for x in (a, b)]) < 0] = 65533
        number[len(a.names) :][b.start < 0] = 65534
        number = np.bitwise_or.reduce(number << np.arange(48, -16, -16, dtype=np.uint64), axis=1)
        self.first = number[: len(a.names)], number[len(a.names) :]
        letters = np.unique(b.codes[b.codes >= 0])
        self.rows = None
        if (len(letters) + 1) * len(b.names) <= PLACES:
            places = np.zeros((len(letters) + 1, len(b.names)), np.uint64)
            for j in range(min(b.codes.shape[1], WORD)):
                has = np.nonzero(b.codes[:, j] >= 0)[0]
                places[np.searchsorted(letters, b.codes[has, j]), has] |= np.uint64(1 << j)
            at = np.searchsorted(letters, a.codes)
            known = letters[np.minimum(at, len(letters) - 1)] == a.codes if len(letters) else np.zeros(a.codes.shape, bool)
            self.rows = np.ascontiguousarray((np.where(known, at, len(letters)) * len(b.names)).T)
            self.places = places.ravel()


def close(a: Block, b: Block, threshold: float, pair: Pair | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b that may reach the threshold, some of a's names of one length at a time."""
    if not len(a.names) or not len(b.names):
        return
    pair = pair or Pair(a, b)
    least = [reach(threshold, p) - 1e-4 for p in range(5)]
    loose = pair.loose[0]
    (two_a, two_b), (three_a, three_b) = (starts(a, b, n) for n in (2, 3))
    order = np.lexsort((loose, a.length))
    ends = np.append(np.nonzero((np.diff(a.length[order]) != 0) | (np.diff(loose[order]) != 0))[0] + 1, len(order))
    step, wide = max(1, CELLS // len(b.names)), len(b.names)
    both, held = np.empty((step, wide), np.uint64), np.empty((step, wide), np.uint8)
    one, other, at = np.empty((step, wide), bool), np.empty((step, wide), bool), 0
    for end in ends:
        n, free = int(a.length[order[at]]), np.minimum(loose[order[at]], pair.loose[1])
        # A pair with a common start of p letters needs so many common bits.
        needs = np.stack([np.clip(np.ceil(c * n * b.length / (n + b.length)) - free, 0, 255) for c in least]).astype(np.uint8)
        while at < end:
            own = order[at : min(at + step, end)]
            at, k = at + len(own), slice(0, len(own))
            shared = np.bitwise_count(np.bitwise_and(pair.bits[0][own, None], pair.bits[1], out=both[k]), out=held[k])
            fits = np.greater_equal(shared, needs[1], out=one[k])
            for p, mine, theirs in ((2, two_a, two_b), (4, three_a, three_b)):
                more = np.equal(mine[own, None], theirs, out=other[k])
                more &= shared >= needs[p]
                fits |= more
            hit = np.flatnonzero(fits)
            row = np.repeat(np.arange(len(own)), np.count_nonzero(fits, axis=1))
            col = hit - row * wide
            row = own[row]
            differ = pair.first[0][row] ^ pair.first[1][col]
            start = sum((differ < np.uint64(1 << 16 * p)).view(np.uint8) for p in range(4))
            good = shared.ravel()[hit] >= needs.ravel()[start.astype(np.int64) * wide + col]
            yield row[good], col[good]


def starts(a: Block, b: Block, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where names have the same first letters."""
    found = np.unique(np.concatenate([x.start[:, :letters] for x in (a, b)]), axis=0, return_inverse=True)[1].ravel()
    found = found.astype(np.uint16 if len(found) < 1 << 16 else np.int32)
    return found[: len(a.names)], found[len(a.names) :]


def common_start(a: Block, b: Block, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The number of letters, 4 at most, that names have in common at their start."""
    found, still = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
    for i in range(4):
        x = a.start[rows, i]
        still &= (x == b.start[cols, i]) & (x >= 0)
        found += still
    return found


#: The places that a letter at i may meet within w of it.
WINDOWS = np.array([[sum(1 << j for j in range(max(i - w, 0), min(i + w, WORD - 1) + 1)) for w in range(WORD // 2)] for i in range(WORD)], np.uint64)


def similarities(a: Block, b: Block, rows: np.ndarray, cols: np.ndarray, pair: Pair | None = None, threshold: float = 0.0) -> np.ndarray:
    """Jaro-Winkler similarities of pairs of different names (see similarity.jaro), many at once; 0 for some that do not reach the threshold."""
    pair = pair or Pair(a, b)
    quick = (a.length[rows] <= WORD) & (b.length[cols] <= WORD) & (pair.rows is not None)
    s = np.empty(len(rows))
    start = common_start(a, b, rows, cols)
    for take, of in ((np.nonzero(quick)[0], by_bits), (np.nonzero(~quick)[0], by_steps)):
        for at in range(0, len(take), PAIRS):
            some = take[at : at + PAIRS]
            s[some] = of(pair, rows[some], cols[some], start[some], threshold)
    return winkler(s, start)


def winkler(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.where(s > 0.7, s + 0.1 * start * (1 - s), s)


def jaro(count: np.ndarray, n: np.ndarray, m: np.ndarray, moved: np.ndarray) -> np.ndarray:
    return np.where(count > 0, (count / n + count / m + (count - moved) / np.maximum(count, 1)) / 3, 0.0)


def by_bits(pair: Pair, rows: np.ndarray, cols: np.ndarray, start: np.ndarray, threshold: float) -> np.ndarray:
    """Jaro similarities of names of at most WORD letters: a letter takes the first free place of its kind in its window."""
    n, m = pair.a.length[rows], pair.b.length[cols]
    window = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    used, places, met = np.zeros(len(rows), np.uint64), [], []
    for i in range(int(n.max())):
        at = pair.rows[i].take(rows, mode="clip")
        at += cols
        places.append(pair.places.take(at, mode="clip"))
        free = WINDOWS[i].take(window, mode="clip")
        free &= places[-1]
        free &= ~used
        free &= -free
        used |= free
        met.append(free != 0)
    count = np.bitwise_count(used).astype(np.int64)
    out = jaro(count, n, m, np.zeros_like(count))
    # Letters out of order cost more; they are counted where the pair may still reach the threshold.
    some = np.nonzero(winkler(out, start) >= threshold - 1e-9)[0]
    wrong, rest = np.zeros(len(some), np.int64), used[some]
    for own, hits in zip(places, met, strict=True):
        hit = hits[some]
        first = (rest & -rest) * hit
        wrong += ((own[some] & first) == 0) & hit
        rest ^= first
    out[:] = 0
    out[some] = jaro(count[some], n[some], m[some], wrong // 2)
    return out


def by_steps(pair: Pair, rows: np.ndarray, cols: np.ndarray, *_: object) -> np.ndarray:
    """Jaro similarities of names of any length and letters."""
    x, y, n, m = pair.a.codes[rows], pair.b.codes[cols], pair.a.length[rows], pair.b.length[cols]
    x, y = x[:, : n.max()], y[:, : m.max()]
    window, at = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None], np.arange(y.shape[1])
    free, met = y >= 0, np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        fits = free & (y == x[:, i, None]) & (np.abs(at - i) <= window)
        first = fits.argmax(1)
        hit = np.nonzero(fits[np.arange(len(first)), first])[0]
        free[hit, first[hit]] = False
        met[hit, i] = True
    count, width = met.sum(1), min(x.shape[1], y.shape[1])
    ordered = lambda z, taken: np.take_along_axis(z, np.argsort(~taken, axis=1, kind="stable")[:, :width], 1)
    moved = ((ordered(x, met) != ordered(y, (y >= 0) & ~free)) & (np.arange(width) < count[:, None])).sum(1) // 2
    return jaro(count, n, m, moved)


def matches(a: Block, b: Block, threshold: float, order: tuple[np.ndarray, np.ndarray], apart: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, of b and similarities of the pairs of different names that reach the threshold, some at a time.

    order: numbers of the names that sort as they do. With apart only pairs whose name in a is the smaller one.
    """
    pair, held, number = Pair(a, b), [], 0

    def scored() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows, cols = (np.concatenate(x) for x in zip(*held, strict=True))
        for at in range(0, len(rows), PAIRS):
            i, j = rows[at : at + PAIRS], cols[at : at + PAIRS]
            s = similarities(a, b, i, j, pair, threshold)
            good = s >= threshold
            yield i[good], j[good], s[good]

    for rows, cols in close(a, b, threshold, pair):
        x, y = order[0][rows], order[1][cols]
        wanted = x < y if apart else x != y
        held.append((rows[wanted], cols[wanted]))
        number += int(wanted.sum())
        if number >= PAIRS:
            yield from scored()
            held, number = [], 0
    if held:
        yield from scored()


def packed(df: DataFrame, partitions: int) -> tuple[DataFrame, int, int]:
    """Blocks (block, rows) of at most BLOCK rows of df as one row each, their number and that of the rows; fewer rows to a block while there are few."""
    rows = checkpointed(df)
    number = rows.count()
    blocks = max(1, -(-number // BLOCK), min(-(-number // 512), round((8 * partitions) ** 0.5)))
    block = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(blocks)).alias("block")
    dealt = rows.select(block, F.struct(*rows.columns).alias("r")).groupBy("block").agg(F.collect_list("r").alias("rows"))
    return checkpointed(dealt.select("block", *[F.col("rows")[c].alias(c) for c in rows.columns])), blocks, number


def met(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
    """Rows of pairs of blocks: x, y, the columns of left's block, and of right's with the prefix o_. With once right is left, and blocks meet once."""
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, na, ra = packed(left, partitions)
    b, nb, rb = (a, na, ra) if once else packed(right, partitions)
    pairs = left.sparkSession.range(0, na * nb, 1, min(na * nb, max(4 * partitions, na * nb // 4)))
    pairs = pairs.select(F.floor(F.col("id") / nb).alias("x"), (F.col("id") % nb).alias("y")).where("x <= y" if once else "true")
    side = lambda df, number: F.broadcast(df) if number <= BROADCAST_NAMES else df
    one, other = a.withColumnRenamed("block", "x"), b.select(F.col("block").alias("y"), *[F.col(c).alias(f"o_{c}") for c in b.columns[1:]])
    return pairs.join(side(one, ra), "x").join(side(other, rb), "y")


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.Array, pa.Array, Block, Block, tuple[np.ndarray, np.ndarray]]]:
    """The rows of met() in a batch: the row's columns by name, names of both blocks as arrays and as blocks, and numbers that sort as the names do."""
    for row in range(batch.num_rows):
        cells = {c: batch.column(c)[row] for c in batch.schema.names}
        own, others = cells["name"].values, cells["o_name"].values
        p, q = own.to_pylist(), others.to_pylist()
        number = np.unique(np.array([*p, *q, ""], object)[:-1], return_inverse=True)[1]
        yield cells, own, others, Block(p), Block(q), (number[: len(p)], number[len(p) :])


def similar_names(left: DataFrame, right: DataFrame, threshold: float = MERGE, ordered: bool = False) -> DataFrame:
    """name, other and score of all pairs of a name of left (name) and another of right (name) of at least threshold.

    Null and empty names match nothing; repeated names count once; equal names are no pair. threshold is at least 0.75.
    With ordered only pairs whose name is the smaller one come back, at half the work if right is left.
    """
    if threshold < 0.75:
        raise ValueError("similar names need a threshold of 0.75 or more")
    once = ordered and left is right

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, own, others, p, q, order in blocks_of(batch):
                pool = pa.concat_arrays([own, others])
                same = once and cells["x"].as_py() == cells["y"].as_py()
                for i, j, s in matches(p, q, threshold, order, same or (ordered and not once)):
                    swap = once & (order[0][i] > order[1][j])
                    i, j = np.where(swap, len(own) + j, i), np.where(swap, i, len(own) + j)
                    yield pa.RecordBatch.from_arrays([pool.take(pa.array(i)), pool.take(pa.array(j)), pa.array(s)], ["name", "other", "score"])

    a, b = (df.where("name <> ''").select("name").distinct() for df in (left, right))
    return met(a, b, once).mapInArrow(scored, "name string, other string, score double")


def best_names(left: DataFrame, right: DataFrame, threshold: float = MERGE) -> DataFrame:
    """name, score, rank and entity_id: of the names of right (name, rank, entity_id; different) the one most similar to a name of left, from threshold on.

    Scores are rounded to nine digits; of equals the smallest rank and entity_id. A task gives out a name's few best of a block.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells, own, _, p, q, order in blocks_of(batch):
                ids, ranks = cells["o_entity_id"].values, cells["o_rank"].values
                keys = [np.unique(np.array([*x.to_pylist(), ""], object)[:-1] if x is ids else x.to_numpy(), return_inverse=True)[1] for x in (ranks, ids)]
                first = np.argsort(np.lexsort((keys[1], keys[0])))
                for i, j, s in matches(p, q, threshold, order, apart=False):
                    most = np.zeros(len(own))
                    np.maximum.at(most, i, s)
                    # Rounding is left to Spark, so scores that may round to the best are kept, each with its first entity.
                    near = s >= most[i] - 2e-9
                    i, j, s = i[near], j[near], s[near]
                    turn = np.lexsort((first[j], s, i))
                    i, j, s = i[turn], j[turn], s[turn]
                    new = np.append(True, (np.diff(i) != 0) | (np.diff(s) != 0))[: len(i)]
                    i, j, s = i[new], pa.array(j[new]), s[new]
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(i)), pa.array(s), ranks.take(j), ids.take(j)], ["name", "score", "rank", "entity_id"])

    one = left.where("name <> ''").select("name").distinct()
    pairs = met(one, right.where("name <> ''").select("name", "rank", "entity_id"), once=False)
    found = pairs.mapInArrow(scored, "name string, score double, rank int, entity_id string")
    best = found.groupBy("name").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "rank", "entity_id")).alias("m"))
    return best.select("name", (-F.col("m.s")).alias("score"), "m.rank", "m.entity_id")


def named(mention: Column) -> Column:
    """The name in a mention, null if there is none: pronouns, numbers and versions, names of less than 3 or over 100 letters."""
    name = F.trim(mention)
    bad = F.lower(name).isin(*PRONOUNS) | name.rlike(r"^[\d.v\-/]+$") | ~F.length(name).between(SHORTEST, LONGEST)
    return F.when(~bad, name)


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = MERGE) -> DataFrame:
    """mention, entity_id, how and score of every mention (mention) that is a name.

    entities: entity_id (text), name; aliases: entity_id, alias. In this order a mention is an entity's name (name), an alias
    (alias), or similar to one of them (fuzzy: the best score, names before aliases, then the smallest id), whatever its
    case. What is left is made into new entities (new), mentions that are similar to each other into one; its id is
    made of the smallest name in it. Unlike a resolver that takes one mention after the other, the result hangs on no order.
    """
    own = mentions.select(named(F.col("mention")).alias("name"), "mention").where("name is not null").distinct().withColumn("low", F.lower("name"))
    known = entities.select("entity_id", F.lower(F.trim("name")).alias("low"), F.lit(0).alias("rank")).union(aliases.select("entity_id", F.lower(F.trim("alias")), F.lit(1)))
    known = checkpointed(known.where("low <> ''").groupBy("low").agg(F.min(F.struct("rank", "entity_id")).alias("k")).select("low", "k.*"))
    how = F.when(F.col("rank") == 0, "name").otherwise("alias")
    exact = own.join(known, "low").select("mention", "low", "entity_id", how.alias("how"), F.lit(1.0).alias("score"))
    rest = checkpointed(own.join(known, "low", "left_anti").select("mention", "low"))
    best = checkpointed(best_names(rest.select(F.col("low").alias("name")), known.withColumnRenamed("low", "name"), threshold).withColumnRenamed("name", "low"))
    fuzzy = rest.join(best, "low").select("mention", "low", "entity_id", F.lit("fuzzy").alias("how"), "score")
    left = checkpointed(rest.join(best, "low", "left_anti"))
    alone = left.select(F.col("low").alias("name"))
    links = similar_names(alone, alone, threshold, ordered=True).select(F.col("name").alias("src"), F.col("other").alias("dst"), F.lit(1).alias("weight"))
    groups = components(links).select(F.col("node").alias("low"), "component")
    made = left.join(groups, "low", "left").withColumn("head", F.coalesce("component", "low"))
    fresh = made.select("mention", "low", F.concat(F.lit("new-"), F.substring(F.md5("head"), 1, 16)).alias("entity_id"), F.lit("new").alias("how"), F.lit(1.0).alias("score"))
    return exact.unionByName(fuzzy).unionByName(fresh).select("mention", "entity_id", "how", "score")


def with_aliases(resolved: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases (entity_id, alias, confidence, source) with what resolving has learned; an entity's alias counts once, whatever its case."""
    kinds = {"fuzzy": "jaro_winkler", "new": "canonical"}
    source = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("how")]
    fresh = resolved.where(F.col("how").isin(*kinds)).select("entity_id", F.trim("mention").alias("alias"), F.col("score").alias("confidence"), source.alias("source"))
    every = aliases.select("entity_id", "alias", "confidence", "source", F.lit(0).alias("age")).union(fresh.withColumn("age", F.lit(1)))
    best = every.groupBy("entity_id", F.lower("alias").alias("low")).agg(F.min_by(F.struct("alias", "confidence", "source"), F.struct("age", "alias")).alias("a"))
    return best.select("entity_id", "a.*")


def merged(entities: DataFrame, aliases: DataFrame, facts: DataFrame, keep: str, merge: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, aliases and facts (fact_id, entities) with the entity merge taken into keep: its name and aliases become keep's."""
    to = lambda c: F.when(c == merge, F.lit(keep)).otherwise(c)
    name = entities.where(F.col("entity_id") == merge).select(F.lit(keep).alias("entity_id"), F.col("name").alias("alias"), F.lit(1.0).alias("confidence"), F.lit("merge").alias("source"))
    moved = aliases.withColumn("source", F.when(F.col("entity_id") == merge, F.concat(F.lit("merge_from:"), "entity_id")).otherwise(F.col("source"))).withColumn("entity_id", to(F.col("entity_id")))
    every = moved.unionByName(name).groupBy("entity_id", F.lower("alias").alias("low")).agg(F.min_by(F.struct("alias", "confidence", "source"), F.struct("source", "alias")).alias("a"))
    own = facts.withColumn("entities", F.when(F.array_contains("entities", merge), F.array_distinct(F.transform("entities", to))).otherwise(F.col("entities")))
    return entities.where(F.col("entity_id") != merge), every.select("entity_id", "a.*"), own
