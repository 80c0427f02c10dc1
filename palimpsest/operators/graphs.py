"""Graph analytics as iterated joins; each round cuts its lineage by a checkpoint.

tasks is the number of tasks of a step over all links, for graphs that are too large for the session's own number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed, shuffle_tasks


def dealt(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator, which runs its rounds before it returns, with shuffles of so many tasks."""

    @wraps(operator)
    def run(edges: DataFrame, *args, tasks: int | None = None, **options) -> DataFrame:
        with shuffle_tasks(edges.sparkSession, tasks):
            return operator(edges, *args, **options)

    return run


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions, repeated edges with their largest weight, without loops."""
    one = edges.where("src <> dst").select("src", "dst", "weight")
    both = one.union(one.select("dst", "src", "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


@dealt
def pagerank(edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-10, max_rounds: int = 200) -> DataFrame:
    """node and rank: weighted power iteration from the uniform vector until the ranks change by at most tolerance in sum.

    The mass of nodes without out-edges is shared by all.
    """
    nodes = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    sums = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = checkpointed(edges.join(sums, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    ends = checkpointed(nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(max_rounds):
        loose = rank.join(ends, "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        moved = shares.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        fresh = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(loose / max(n, 1))) + F.lit((1 - alpha) / max(n, 1))
        both = nodes.join(moved, "node", "left").join(rank.withColumnRenamed("rank", "before"), "node")
        stepped = checkpointed(both.select("node", fresh.alias("rank"), F.abs(fresh - F.col("before")).alias("change")))
        rank = stepped.drop("change")
        if (stepped.agg(F.sum("change")).first()[0] or 0.0) <= tolerance:
            return rank
    raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")


@dealt
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and component: the smallest node that a node reaches; labels spread and are followed to their own label."""
    links = checkpointed(undirected(edges).select("src", "dst"))
    labels = checkpointed(links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node").select("node", F.least("component", "least").alias("via"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        fresh = checkpointed(lower.join(jump, "via", "left").select("node", F.least("via", F.coalesce("root", "via")).alias("component"), "old"))
        labels = fresh.drop("old")
        if fresh.where("component <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


@dealt
def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node and label: each round takes the label of most weight among the neighbours, the smallest of equals."""
    links = checkpointed(undirected(edges))
    labels = links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
        labels = checkpointed(votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m")).select("node", F.col("m.label").alias("label")))
    return labels


@dealt
def reached(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and hops: what is at most depth edges from seeds (node), with the fewest."""
    links = checkpointed(undirected(edges).select("src", "dst"))
    found = checkpointed(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = found
    for hop in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(found, "node", "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(frontier)
    return found


@dealt
def spread(edges: DataFrame, seeds: DataFrame, rounds: int = 3, keep: float = 0.5, flow: float = 0.8, top: int = 10) -> DataFrame:
    """node and activation: each round keeps a share, receives flow * weight / degree from neighbours, is cut to the top."""
    links = undirected(edges)
    links = checkpointed(links.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))).select("src", "dst", "w"))
    now = seeds.select("node", "activation")
    for _ in range(rounds):
        sent = links.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (flow * F.col("w") * F.col("activation")).alias("activation"))
        kept = now.select("node", (keep * F.col("activation")).alias("activation"))
        total = kept.union(sent).groupBy("node").agg(F.round(F.sum("activation"), 9).alias("activation"))
        now = checkpointed(total.orderBy(F.desc("activation"), "node").limit(top))
    return now.select("node", F.round(1 / (1 + F.exp(-(F.col("activation") - 0.2))), 6).alias("activation"))


def betweenness(edges: DataFrame, depth: int) -> DataFrame:
    """node and score: the share of shortest paths of at most depth edges between two others that pass the node.

    Path counts go forward a hop at a time and dependencies come back the same way, for all sources at once, so a
    row is a (source, node) pair within depth hops. Each unordered pair of ends counts once.
    """
    links = checkpointed(undirected(edges).select("src", "dst"))
    levels = [links.select(F.col("src").alias("s")).distinct().select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths"))]
    seen = levels[0].select("s", "v")
    for _ in range(depth):
        step = levels[-1].join(links.withColumnRenamed("src", "v"), "v").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        levels.append(checkpointed(step.join(seen, ["s", "v"], "left_anti")))
        seen = checkpointed(seen.union(levels[-1].select("s", "v")))
    found, below = None, None
    for level in reversed(levels[1:]):
        own = level if below is None else level.join(below, ["s", "v"], "left")
        own = checkpointed(own.select("s", "v", "paths", (F.lit(0.0) if below is None else F.coalesce("dependency", F.lit(0.0))).alias("dependency")))
        one = own.select("v", "dependency")
        found = one if found is None else found.union(one)
        at = levels.index(level) - 1
        before = levels[at].select("s", F.col("v").alias("src"), F.col("paths").alias("before"))
        share = own.join(links.withColumnRenamed("dst", "v"), "v").join(before, ["s", "src"])
        below = share.groupBy("s", F.col("src").alias("v")).agg(F.sum(F.col("before") / F.col("paths") * (1 + F.col("dependency"))).alias("dependency"))
    return found.groupBy(F.col("v").alias("node")).agg((F.sum("dependency") / 2).alias("score"))
