"""Near-duplicate detection with HyperMinHash registers.

A document's set holds its distinct word shingles as 64-bit hashes. Every register keeps, for one hash function,
the leading-zero count of the smallest value and the mantissa bits after it. Registers are cut into bands; two
sets that share a band are candidates. The share of equal registers, corrected for the chance that different
minima look alike in their few bits, estimates the Jaccard similarity; candidates whose estimate is not clearly
too low are verified on the full sets, computed again from the texts.

No group is expanded into all pairs:
1. Documents with equal sets form a class; only its smallest id goes on.
2. In each band bucket every member is compared with the smallest one, so a bucket gives as many pairs as members.
3. The links that a smallest member does not have can only join members of a bucket that are then in several
   components. A shingle is rare if at most RARE of these members hold it. Members that share a rare shingle are
   compared (each shingle gives at most RARE pairs a member). Others share only shingles that are not
   rare, so that their similarity is bounded by the numbers of these; the few whose bound reaches the
   threshold, in one bucket and different components, are compared too. Nothing that can be a link is left out.
With bands of 5 registers and 40 bands a pair at the threshold of 0.8 is missed with probability
(1 - 0.8^5)^40 = 1.2e-7, and less above it.

Documents with an equal id are documents of their own, told apart by their texts: each row gets the smallest id of
the component of its own text. Null or empty texts have the empty set, which is linked with nothing. Equal texts have equal
sets, and of equal ones the smallest id is the component's. Very long texts are whole sets like others, some 20 bytes a
word. Rows with a null id are kept, and give their component no id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.textops import SPACED, chunks, mix64, scan, windows
from palimpsest.session import arrow_batches, checkpointed, written

ROWS, BANDS, MANTISSA = 5, 40, 10
REGISTERS = ROWS * BANDS
RARE = 16
BROADCAST_IDS = 1_000_000
#: Rows of texts or sets in one Arrow batch.
BATCH = 1000
SKETCH_TYPE = "n int, d1 long, d2 long, registers binary, bands array<long>"

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts, n: int):
    """For each text the sorted distinct hashes of its n-word shingles; of its whole words if it has fewer."""
    for _, held in chunks(texts):
        words = scan(held, SPACED)
        keys = windows(words.hashes, n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= n:
                part = np.sort(keys[a : b - n + 1])
                yield part[np.concatenate([[True], part[1:] != part[:-1]])]
            elif b > a:
                yield windows(words.hashes[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest value of each register's hash function over a set."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        part = (low[at : at + 2048, None] ^ _XOR) * _MUL
        part ^= part >> np.uint32(15)
        np.minimum(out, (part * np.uint32(0x2C1B3C6D)).min(axis=0), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Leading-zero count (5 bits) and the mantissa bits after the first one, as 16-bit codes."""
    zeros = 32 - np.frexp(least.astype(np.float64))[1].astype(np.uint32)
    after = (least.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros << np.uint32(MANTISSA)) | (after >> np.uint64(32 - MANTISSA)).astype(np.uint32)).astype(np.uint16)


def band_keys(codes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band's registers; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in codes.reshape(BANDS, ROWS).T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return key


def sketch(values: np.ndarray) -> tuple:
    if not len(values):
        return 0, 0, 0, None, []
    with np.errstate(over="ignore"):
        digests = values.sum(), mix64(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
        codes = registers(minima(values))
        return len(values), *(d.astype(np.int64) for d in digests), codes.tobytes(), band_keys(codes).astype(np.int64)


def estimate(left: pd.Series, right: pd.Series, n_left: pd.Series, n_right: pd.Series) -> np.ndarray:
    """Jaccard estimates: the share of equal registers, less the collisions expected of unequal minima."""
    a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (left, right))
    same = (a == b).mean(axis=1)
    ratio = np.minimum(n_left, n_right) / np.maximum(n_left, n_right)
    chance = 0.169919487159739 * 2.0 ** (4 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.clip((same - chance) / (1 - chance), 0, 1)


def linked(values_a: np.ndarray, values_b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(values_a, values_b, assume_unique=True))
    return 100 * both >= percent * (len(values_a) + len(values_b) - both)


def _texts(docs: DataFrame, firsts: DataFrame, keys: DataFrame) -> DataFrame:
    """key and text of the given classes; they are broadcast if there are at most BROADCAST_IDS of them."""
    wanted = checkpointed(firsts.join(keys, "key", "left_semi").select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "key"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    held = docs.join(wanted, F.col("id").eqNullSafe(F.col("own")) & (F.xxhash64("text") == F.col("own_hash")))
    return held.groupBy("key").agg(F.min("text").alias("text"))


def _residual_pairs(split: DataFrame, firsts: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) across components among the members of split (band, key, n, component) that can be links."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([s.astype(np.int64) for s in shingle_sets(texts, n)], dtype=object)

    members = checkpointed(split.select("key", "component", "n").distinct())
    held = _texts(docs, firsts, members.select("key")).select("key", F.explode(shingles("text")).alias("shingle"))
    with arrow_batches(docs.sparkSession, BATCH):
        held = written(held, "shingles")
    spread = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = written(held.join(spread, "shingle"), "spread")
    rare = known.where(F.col("df") <= RARE).join(members, "key")
    other = rare.select("shingle", F.col("key").alias("q"), F.col("component").alias("c"), F.col("n").alias("nq"))
    sized = f"100 * least(n, nq) >= {percent} * greatest(n, nq)"
    sharing = rare.join(other, "shingle").where("key < q and component <> c").where(sized)
    common = known.groupBy("key").agg(F.sum((F.col("df") > RARE).cast("int")).alias("common"))
    able = split.join(common, "key").where(f"100 * common >= {percent} * n")
    own = able.groupBy("key").agg(F.collect_set("band").alias("bands"))  # at most BANDS of them
    able = able.join(own, "key")
    other = able.select(
        "band", F.col("key").alias("q"), F.col("component").alias("c"), F.col("n").alias("nq"), F.col("common").alias("cq"), F.col("bands").alias("bq")
    )
    bound = f"100 * least(common, cq) >= {percent} * (n + nq - least(common, cq))"
    once = "array_min(array_intersect(bands, bq)) = band"  # the first of the bands that a pair shares
    alike = able.join(other, "band").where(f"key < q and component <> c and {bound} and {once}")
    return sharing.select("key", "q").union(alike.select("key", "q")).toDF("a", "b").distinct()


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""
    margin = 5.5 * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5

    @F.pandas_udf("boolean")
    def likely(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(estimate(ra, rb, na, nb) >= percent / 100 - margin)

    @F.pandas_udf("boolean")
    def similar(ta: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([linked(x, y, percent) for x, y in zip(shingle_sets(ta, n), shingle_sets(tb, n), strict=True)], dtype=bool)

    a = firsts.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    b = firsts.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    close = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    close = checkpointed(close.where(likely("ra", "rb", "na", "nb")).select("a", "b"))
    keys = close.select(F.col("a").alias("key")).union(close.select("b")).distinct()
    texts = checkpointed(_texts(docs, firsts, keys))
    ta, tb = (texts.select(F.col("key").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    with arrow_batches(docs.sparkSession, BATCH):
        return checkpointed(close.join(ta, "a").join(tb, "b").where(similar("ta", "tb")).select("a", "b"))


def _sketches(docs: DataFrame, n: int) -> DataFrame:
    """id, text_hash and sketch of every row of docs (id, text)."""

    @F.pandas_udf(SKETCH_TYPE)
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(s) for s in shingle_sets(texts, n)]
        return pd.DataFrame(rows, columns=["n", "d1", "d2", "registers", "bands"])

    own = docs.select("id", F.xxhash64("text").alias("text_hash"), sketched("text").alias("s"))
    with arrow_batches(docs.sparkSession, BATCH):
        sketches = written(own.select("id", "text_hash", "s.*"), "sketches")
    return sketches


def _components(docs: DataFrame, sketches: DataFrame, n: int, percent: int) -> DataFrame:
    """sketches (id, text_hash, n) with component, the smallest id that a row reaches."""
    full = sketches.where("n > 0").withColumn("key", F.xxhash64("d1", "d2", "n"))
    classes = written(full.groupBy("key").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.min("id").alias("least_id")), "classes")
    of = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))
    firsts = full.join(classes.select(F.col("key").alias("own"), "first"), (F.col("key") == F.col("own")) & of).drop("own", "first")
    firsts = written(firsts.dropDuplicates(["key"]), "firsts")
    # The smallest id is the centre in all of its bands; near copies of one text often share bands with it rather than with each other.
    bands = firsts.select("key", "n", "id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min(F.struct("id", "key"))["key"].alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = written(bands.drop("id").join(shared.drop("c"), "band"), "members")

    stars = members.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(stars, firsts, docs, n, percent)
    found = checkpointed(connected_components(links))

    placed = members.join(found.withColumnRenamed("node", "key"), "key", "left").select(
        "band", "key", "n", F.coalesce("component", "key").alias("component")
    )
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    split = checkpointed(placed.join(split.select("band"), "band"))
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = _residual_pairs(split, firsts, docs, n, percent).join(seen, ["a", "b"], "left_anti")
    more = _verified(rest, firsts, docs, n, percent)
    if not more.isEmpty():
        found = checkpointed(connected_components(links.union(more)))

    held = classes.select("key", "least_id").join(found.withColumnRenamed("node", "key"), "key", "left")
    held = held.withColumn("component", F.coalesce("component", "key"))
    least = held.groupBy("component").agg(F.min("least_id").alias("component_id"))
    merged = held.join(least, "component").select("key", "component_id")
    # Rows without shingles are all alike in their digests: each gets a key of its own.
    key = F.when(F.col("n") > 0, F.xxhash64("d1", "d2", "n"))
    placed = sketches.select("id", "text_hash", "n", key.alias("key")).join(merged, "key", "left")
    return placed.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable over links) and kept (id is the component's), a row for each row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    placed = _components(docs, _sketches(docs, n), n, percent)
    return placed.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with all their columns, one document of each component: the one whose id is the smallest.

    Of rows with that id in one component the one with the smallest hash of the text stays, and of rows that agree in both, one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    placed = _components(own, _sketches(own, n), n, percent).where("n > 0 and id is not null")
    placed = written(placed.groupBy("id", "text_hash", "component_id").agg(F.count(F.lit(1)).alias("rows")), "placed")
    first = placed.where("id = component_id").groupBy("component_id").agg(F.min("text_hash").alias("first"), F.count(F.lit(1)).alias("texts"))
    several = first.where("texts > 1").select("component_id", "first")
    gone = placed.join(several, "component_id", "left").where("id <> component_id or text_hash <> first")
    gone = checkpointed(gone.select(F.col("id").alias("_gone"), F.col("text_hash").alias("_hash")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = (F.col(f"_row.{id_col}") == F.col("_gone")) & (F.xxhash64(f"_row.{text_col}") == F.col("_hash"))
    kept = docs.select(F.struct("*").alias("_row")).join(gone, same, "left_anti")
    again = placed.where("rows > 1 and id = component_id").select(F.col("id").alias("_again"), F.col("text_hash").alias("_hash"))
    if again.isEmpty():
        return kept.select("_row.*")
    twice = (F.col(f"_row.{id_col}") == F.col("_again")) & (F.xxhash64(f"_row.{text_col}") == F.col("_hash"))
    once = kept.join(again, twice).groupBy("_again", "_hash").agg(F.first("_row").alias("_row"))
    return kept.join(again, twice, "left_anti").unionByName(once.select("_row")).select("_row.*")
