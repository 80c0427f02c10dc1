"""Scope, visibility and validity predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_scope(profile: str, include_global: bool = False, include_shared: bool = False) -> Column:
    """Rows of the profile; on request also global ones and ones shared with it."""
    found = F.col("profile_id") == profile
    if include_global:
        found = found | (F.col("scope") == "global")
    if include_shared:
        found = found | ((F.col("scope") == "shared") & F.array_contains("shared_with", profile))
    return found


def visible() -> Column:
    """Not archived and not quarantined; nulls count as visible."""
    return (F.coalesce("archive_status", F.lit("live")) != "archived") & (F.coalesce("quarantined", F.lit(0)) == 0)


def event_expired(as_of: Column | None, now: Column) -> Column:
    """With as_of: valid_until <= as_of or valid_from > as_of. Without: valid_until < now."""
    if as_of is None:
        return F.coalesce(F.col("valid_until") < now, F.lit(False))
    return F.coalesce(F.col("valid_until") <= as_of, F.lit(False)) | F.coalesce(F.col("valid_from") > as_of, F.lit(False))


def system_expired(as_of: Column) -> Column:
    """The system had expired the row by as_of, that instant included."""
    return F.coalesce(F.col("system_expired_at") <= as_of, F.lit(False))


def known_and_valid(known_as_of: Column, valid_at: Column, unknown_history: bool = False) -> Column:
    """Strict two-clock admission: known at one instant and valid at the other; rows without history on request."""
    known = (F.col("system_created_at") <= known_as_of) & ~system_expired(known_as_of)
    valid = (F.coalesce(F.col("valid_from") <= valid_at, F.lit(True))) & F.coalesce(F.col("valid_until") > valid_at, F.lit(True))
    return F.coalesce(known & valid, F.lit(unknown_history))


def authorised(candidates: DataFrame, facts: DataFrame, scope: Column, key: str = "fact_id") -> DataFrame:
    """Candidates whose fact is in scope and visible."""
    return candidates.join(facts.where(scope & visible()).select(key), key, "left_semi")


def both_directions(edges: DataFrame) -> DataFrame:
    """src, dst, weight of every edge, once for each direction; equi-joins then need no OR."""
    one = edges.select("src", "dst", "weight")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new put in: new rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
