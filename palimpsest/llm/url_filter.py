"""URL filters: rules by host suffix and path prefix, and a list of canonical URLs behind a blocked Bloom filter.

All of it is DataFrame code. The list is hashed into a filter of 256-bit blocks, one row a block, of bounded
size; it is broadcast and each page reads one block. Pages that pass it are possible hits; they alone go on to
an exact hash join with the list, which removes false positives. When the list outgrows the filter, the filter
stays at its bound and lets more false positives through; results do not change.

A null url, or one without ://, has an empty host and path, fits no rule and is not listed. Repeated rows are
judged alike, an empty list blocks nothing. Columns of pages other than the id and the url are not read.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BITS, WORDS, ROW_BYTES = 256, 4, 64


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def canonical(host: Column, path: Column) -> Column:
    """host and path without a leading www., a trailing slash or .html; null where there is no host."""
    bare = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html|/+)$", "")))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _masks(key: Column) -> list[Column]:
    """Two bits for each 64-bit word of the key's block."""
    h = F.xxhash64(key, F.lit(7))
    return [_bit(h, 12 * w).bitwiseOR(_bit(h, 12 * w + 6)) for w in range(WORDS)]


def _bit(h: Column, at: int) -> Column:
    place = F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_blocks(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """block and its words w0 to w3, for a DataFrame of canonical urls."""
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))]
    hashed = listed.select(_block(F.col(key), blocks).alias("block"), *masks)
    return hashed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules,
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_url: int = 16,
    max_bytes: int = 8 << 20,
) -> DataFrame:
    """id, host, path, rule, verdict, possible (the Bloom filter lets it pass) and listed (the exact join finds it).

    listed has one column, canonical: urls as canonical() makes them. A rule's verdict comes first, then block
    for listed urls and allow for others.
    """
    listed = checkpointed(listed.select("canonical").where("canonical is not null").distinct())
    count, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("canonical") + F.lit(ROW_BYTES)), F.lit(0))).first()
    blocks = max(1, min(ceil(count * bits_per_url / BLOCK_BITS), max_bytes // ROW_BYTES))
    bloom = F.broadcast(bloom_blocks(listed, blocks))

    host, path = parts(F.col("url"))
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = judged.select("id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    judged = judged.withColumn("block", _block(F.col("canonical"), blocks)).join(bloom, "block", "left")
    passes = F.lit(True)
    for i, mask in enumerate(_masks(F.col("canonical"))):
        passes = passes & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    judged = judged.withColumn("possible", F.coalesce(passes & F.col("canonical").isNotNull(), F.lit(False)))
    # Pages that cannot be hits get keys of their own, so a shuffled join deals them out evenly.
    key = F.when(F.col("possible"), F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.xxhash64("id", "host", "path").cast("string")))
    exact = listed.select(F.col("canonical").alias("key"), F.lit(True).alias("listed"))
    exact = F.broadcast(exact) if size <= max_bytes else exact
    judged = judged.withColumn("key", key).join(exact, "key", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    is_listed = F.coalesce("listed", F.lit(False))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict"),
        "possible",
        is_listed.alias("listed"),
    )
