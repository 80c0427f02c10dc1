"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line, cut further at sentence ends) is hashed to a wide vector of LANES odd values from -15 to 15; a
document's fingerprint is the sum of its paragraphs' vectors, every lane modulo 2^19. The sum does not depend on the
order, and a paragraph can be added or removed by adding or subtracting its vector (combine). Three lanes stand
in one long, each under two guard bits, so one masked addition adds three lanes. Only DataFrame functions
are used. For whole tables paragraphs become rows and each lane is a sum of its own, in compiled code; the rows of a
document are added where its text is, so that no paragraph is shuffled.

The lanes are also a linear sketch: their cosine estimates how much of two documents' multisets is common. That holds
while no lane has gone round, for texts of any length whose paragraphs differ and for up to 17,476 equal paragraphs in
one text; sums, equality and differences hold beyond. Ids may be numbers only.

Null and empty texts have the zero fingerprint; likeness is 1 for equal fingerprints and 0 if just one is zero.
Documents with an equal id are ordered by their text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

WORDS = 20
LANES = 3 * WORDS
FIELD = 21
LANE_BITS = 19
LANE_MASK = (1 << LANE_BITS) - 1
MASK = sum(LANE_MASK << (FIELD * i) for i in range(3))
#: Four bits of a hash for each lane: an even number up to 30, of which 15 is taken.
VALUES = sum(30 << (FIELD * i) for i in range(3))
_BIAS = sum(((1 << LANE_BITS) - 15) << (FIELD * i) for i in range(3))
#: Characters of first texts of ranges that are broadcast; more of them are joined by a shuffle.
BROADCAST_CHARS = 16 << 20
PARAGRAPH_END = r"\n+|(?<=[.!?])[ \t]+"


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _masked_sum(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_long(MASK))


def _with_word(acc: Column, h: Column) -> Column:
    """acc and three values of a hash, one for each lane; two guard bits hold what is carried."""
    return (acc + h.bitwiseAND(_long(VALUES)) + _long(_BIAS)).bitwiseAND(_long(MASK))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: p != "")


def fingerprint(text: Column) -> Column:
    """array<long>: the packed lanes of a text."""
    hashes = F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))
    return fold(hashes)


def fold(hashes: Column) -> Column:
    """array<long>: the packed lanes of an array of paragraph hashes (a, b)."""

    def lane(k: int) -> Column:
        half = "a" if k % 2 else "b"
        return F.aggregate(hashes, _long(0), lambda acc, h: _with_word(acc, F.xxhash64(h[half], F.lit(k))))

    return F.array(*[lane(k) for k in range(WORDS)])


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs together; with sign -1 of the left ones without the right ones."""
    full = sum(1 << (FIELD * i + LANE_BITS) for i in range(3))
    return F.zip_with(left, right, lambda a, b: _masked_sum(a, b if sign > 0 else _long(full) - b))


def text_form(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def lanes(packed: Column) -> Column:
    """array<double>: the signed value of each lane."""

    def signed(word: Column, i: int) -> Column:
        value = F.shiftrightunsigned(word, FIELD * i).bitwiseAND(_long(LANE_MASK))
        return (value - F.when(value >= 1 << (LANE_BITS - 1), _long(1 << LANE_BITS)).otherwise(_long(0))).cast("double")

    return F.flatten(F.transform(packed, lambda w: F.array(*[signed(w, i) for i in range(3)])))


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: the cosine of two fingerprints' lanes, 1 where they are equal."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(lanes(x), lanes(y), lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    size = F.sqrt(dot(left, left) * dot(right, right))
    cosine = F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys (which tell the rows apart) and fps: the packed lanes of each of texts, an array of no nulls.

    The paragraphs of a text are rows, an empty one if there is none; they add nothing to other rows. Rows that are dealt by
    one of keys are added up without a shuffle.
    """
    texts = rows.select(*keys, F.posexplode("texts").alias("which", "t"))
    each = texts.select(*keys, "which", F.explode(F.split("t", PARAGRAPH_END)).alias("p"))
    hashed = each.select(*keys, "which", (F.col("p") != "").alias("some"), F.xxhash64("p").alias("a"), F.xxhash64("p", F.lit(1)).alias("b"))
    hashed = hashed.select(*keys, "which", "some", *[F.xxhash64("a" if k % 2 else "b", F.lit(k)).alias(f"h{k}") for k in range(WORDS)])
    value = lambda k, i: F.shiftrightunsigned(f"h{k}", FIELD * i).bitwiseAND(_long(30)) - _long(15)
    sums = [F.sum(F.when(F.col("some"), value(k, i)).otherwise(_long(0))).alias(f"s{k}_{i}") for k in range(WORDS) for i in range(3)]
    added = hashed.groupBy(*keys, "which").agg(*sums)
    word = lambda k: sum((F.shiftleft(F.col(f"s{k}_{i}").bitwiseAND(_long(LANE_MASK)), FIELD * i) for i in range(1, 3)), F.col(f"s{k}_0").bitwiseAND(_long(LANE_MASK)))
    return added.select(*keys, "which", F.array(*[word(k) for k in range(WORDS)]).alias("fp"))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (id, text) with next, the text of the row after it in descending (id), after the last the first.

    range and place (from 1) tell where a row stands; last_fp is the next one's fingerprint, for the last of a range only.

    Rows are dealt by ranges of the id, whose borders are quantiles of the id alone; the row after a range's last
    is the first of the next range, found by one small join of at most one row a range.
    """
    borders = sorted(set(docs.stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    edges = F.array(*[F.lit(b) for b in borders]).cast("array<double>")
    place = F.coalesce(F.size(F.filter(edges, lambda e: e <= F.col("id"))), F.lit(-1)) if borders else F.lit(0)
    place = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(place)
    dealt = docs.withColumn("range", place)
    plain = dealt.select("id", "text", "range")

    tops = plain.groupBy("range").agg(F.max("id").alias("top"))
    everywhere = Window.orderBy(F.col("range").desc())
    tops = tops.select(
        F.col("range").alias("head_of"),
        "top",
        F.coalesce(
            F.lag("range").over(everywhere),
            F.min("range").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("before"),
    )
    first = plain.join(F.broadcast(tops), (F.col("range") == F.col("head_of")) & F.col("id").eqNullSafe(F.col("top")))
    heads = first.groupBy(F.col("before").alias("range")).agg(F.min("text").alias("text"))
    heads = checkpointed(heads).select("range", F.struct("text", fingerprint(F.col("text")).alias("fp")).alias("head"))

    order = Window.partitionBy("range").orderBy(F.col("id").desc(), F.col("text"))
    led = dealt.withColumns({"after": F.lead("text").over(order), "place": F.row_number().over(order)})
    # Rows that have their next one join nothing; their keys are spread, so that a shuffled join has no hot key.
    key = F.when(F.col("after").isNull(), F.col("range")).otherwise(-2 - F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("int"))
    size = heads.agg(F.sum(F.length("head.text"))).first()[0] or 0
    heads = heads.withColumnRenamed("range", "last_range")
    heads = F.broadcast(heads) if size <= BROADCAST_CHARS else heads
    joined = led.withColumn("last_of", key).join(heads, F.col("last_of") == F.col("last_range"), "left")
    return joined.select("id", "text", "range", "place", F.coalesce("after", "head.text").alias("next"), F.col("head.fp").alias("last_fp"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next document.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    led = with_next(own, ranges)
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    led = led.withColumn("edited", edited).select(
        "range", "place", "id", "last_fp", n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.array("text", "edited").alias("texts"),
    )
    both = summed(led, ["range", "place", "id", "last_fp", "n_chars", "edited_sha256"])
    # In this order a text is followed by its edited one, and that by the next text.
    order = Window.partitionBy("range").orderBy("place", "which")
    found = both.withColumns({"edited_fp": F.lead("fp").over(order), "next_fp": F.coalesce(F.lead("fp", 2).over(order), "last_fp")}).where("which = 0")
    return found.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
