"""Pruning and building of graph edges: what goes and why, chains followed to their end, degrees capped, four kinds of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.neighbours import best_in_blocks
from palimpsest.session import checkpointed

# Words that tell of a cause, and weights and bounds of built edges.
CAUSES = r"(?i)\b(?:because of|as a result|resulted in|in order to|so that|caused by|due to|led to|therefore|consequently|because)\b"
ENTITY_WEIGHT, CAUSAL_WEIGHT = 1.0, 0.8
WEEK_HOURS, DECAY_DAYS = 168.0, 30.0
SIMILAR, NEAREST = 0.7, 5


def chain_heads(edges: DataFrame) -> DataFrame:
    """node and head: where the chain that leads to node begins, for nodes with just one edge into them.

    A node with several edges into it begins a chain of its own, so nothing loses its way to what it leads to. Pointers
    are doubled in every round; what is left when no more are settled hangs on a circle and is left out.
    """
    one = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("head")).where("n = 1")
    now, before = checkpointed(one.select(F.col("dst").alias("node"), "head")), None
    while True:
        up = now.select(F.col("node").alias("head"), F.col("head").alias("next"))
        now = checkpointed(now.join(up, "head", "left").select("node", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("open")))
        left = now.where("open").count()
        if not left or left == before:
            return now.where("not open").select("node", "head")
        now, before = now.drop("open"), left


def marked(edges: DataFrame, live: DataFrame, min_weight: float = 0.0, max_degree: int = 100, kind: str = "supersedes") -> DataFrame:
    """edges (edge_id, src, dst, edge_type, weight) with reason (why pruning takes an edge out, null for those that stay) and added.

    In this order, each looking only at what the ones before have left: weight under min_weight (light), an end that is
    not in live (orphan), a loop (loop), a heavier or equal earlier edge of the same ends and type (duplicate), an edge
    of a kind that goes on from a chain (chain; its chain's head gets an edge to the same end instead, which is added),
    and edges that are not among the max_degree heaviest out of and into their ends (hub). Spark's group limit cuts the
    edges of a hub in every task before they are ranked, so no task sorts them all. A null weight is 0.
    """
    nodes = live.select("node").distinct().withColumn("alive", F.lit(True))
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("alive").alias(f"{end}_alive"))
    e = edges.select("edge_id", "src", "dst", "edge_type", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    names = e.columns
    both = e.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    reason = F.when(F.col("weight") < min_weight, "light").when(F.col("src_alive").isNull() | F.col("dst_alive").isNull(), "orphan").when(F.col("src") == F.col("dst"), "loop")
    both = checkpointed(both.select(*names, reason.alias("reason")))
    out = [both.where("reason is not null")]
    left = both.where("reason is null").drop("reason")
    first = left.groupBy("src", "dst", "edge_type").agg(F.max_by("edge_id", F.struct("weight", (-F.col("edge_id")).alias("i"))).alias("edge_id"))
    left = checkpointed(left.join(first.select("edge_id", F.lit(True).alias("first")), "edge_id", "left"))
    out.append(left.where("first is null").drop("first").withColumn("reason", F.lit("duplicate")))
    left = left.where("first").drop("first")
    heads = chain_heads(left.where(F.col("edge_type") == kind)).select(F.col("node").alias("src"), "head", F.lit(kind).alias("edge_type"))
    linked = checkpointed(left.join(heads, ["src", "edge_type"], "left").select(*names, "head"))
    inner = linked.where("head is not null")
    out.append(inner.select(*names, F.lit("chain").alias("reason")))
    left = linked.where("head is null").select(*names, F.lit(False).alias("added"))
    fresh = inner.groupBy(F.col("head").alias("src"), "dst", "edge_type").agg(F.max("weight").alias("weight")).where("src <> dst")
    fresh = fresh.join(left, ["src", "dst", "edge_type"], "left_anti").select(F.xxhash64("src", "dst", "edge_type").alias("edge_id"), "src", "dst", "edge_type", "weight", F.lit(True).alias("added"))
    left = checkpointed(left.unionByName(fresh))
    best = lambda end: left.withColumn("rn", F.row_number().over(Window.partitionBy(end).orderBy(F.desc("weight"), "edge_id"))).where(F.col("rn") <= max_degree).select("edge_id")
    kept = best("src").join(best("dst"), "edge_id").withColumn("stays", F.lit(True))
    last = left.join(kept, "edge_id", "left").select(*names, F.when(F.col("stays").isNull(), "hub").alias("reason"), "added")
    for part in out:
        last = last.unionByName(part.withColumn("added", F.lit(False)))
    return last


def pruned(edges: DataFrame, live: DataFrame, **bounds) -> DataFrame:
    """The edges that are there after pruning, added ones included."""
    return marked(edges, live, **bounds).where("reason is null").drop("reason", "added")


def counts(marks: DataFrame) -> DataFrame:
    """reason and n: what pruning takes out, what stays (kept) and what is added (added): a dry run."""
    what = F.when(F.col("added") & F.col("reason").isNull(), "added").when(F.col("reason").isNull(), "kept").otherwise(F.col("reason"))
    return marks.where("not added or reason is null").groupBy(what.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def by_entity(facts: DataFrame, per_entity: int = 5) -> DataFrame:
    """src, dst and hours of each fact and the facts right before it (by time, then id) with the same entity, at most per_entity an entity.

    Windows look back a fixed number of rows, so an entity of many facts makes as many edges a fact as any other.
    """
    own = facts.select("fact_id", "created_at", F.explode(F.array_distinct("entities")).alias("entity"))
    # Hot entities are cut into months, so that no task orders all facts of one.
    w = Window.partitionBy("entity", F.date_trunc("month", "created_at")).orderBy("created_at", "fact_id")
    before = own.select("fact_id", "created_at", *[F.lag(F.struct("fact_id", "created_at"), i).over(w).alias(f"b{i}") for i in range(1, per_entity + 1)])
    each = before.select("fact_id", "created_at", F.explode(F.array(*[f"b{i}" for i in range(1, per_entity + 1)])).alias("o")).where("o is not null")
    hours = (F.unix_timestamp("created_at") - F.unix_timestamp("o.created_at")) / 3600
    return each.select(F.col("fact_id").alias("src"), F.col("o.fact_id").alias("dst"), hours.alias("hours")).distinct()


def built(facts: DataFrame) -> DataFrame:
    """src, dst, edge_type and weight of the four kinds of edges of facts (fact_id, content, entities, created_at, embedding).

    entity: a shared entity; temporal: a shared entity within a week, both ways, decaying with time; causal: from the
    earlier fact to one that speaks of a cause; semantic: the nearest five others by cosine of at least 0.7.
    """
    near = checkpointed(by_entity(facts))
    kind = lambda name: F.lit(name).alias("edge_type")
    entity = near.select("src", "dst", kind("entity"), F.lit(ENTITY_WEIGHT).alias("weight"))
    decayed = F.round(F.greatest(F.exp(-(F.col("hours") / 24) / DECAY_DAYS), F.lit(0.01)), 4)
    soon = near.where(F.col("hours") <= WEEK_HOURS).select("src", "dst", decayed.alias("weight"))
    temporal = soon.union(soon.select("dst", "src", "weight")).select("src", "dst", kind("temporal"), "weight")
    told = facts.where(F.col("content").rlike(CAUSES)).select(F.col("fact_id").alias("src"))
    causal = near.join(told, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), kind("causal"), F.lit(CAUSAL_WEIGHT).alias("weight"))
    own = facts.where("embedding is not null").select("fact_id", "embedding")
    ranked = best_in_blocks(own.withColumnRenamed("fact_id", "query_id"), own, NEAREST + 1)
    others = ranked.where(F.col("query_id") != F.col("fact_id")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    near = others.where((F.col("place") <= NEAREST) & (F.col("score") >= SIMILAR))
    semantic = near.select(F.col("query_id").alias("src"), F.col("fact_id").alias("dst"), kind("semantic"), F.round("score", 4).alias("weight"))
    return entity.unionByName(temporal).unionByName(causal).unionByName(semantic)
