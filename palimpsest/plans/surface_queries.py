"""Vector and graph backends, ingestion states and the extension surface, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.operators import graphs as G
from palimpsest.operators import retrieval as R
from palimpsest.plans.more_queries import _V
from palimpsest.plans.registry import query
from palimpsest.sources.tables import EDGES_SQL, FACTS_SQL, edge_tasks, edges, facts, table

_KNN = f"with {_V}, q as (select * from e where vec_id % 20 = 0), s as (select q.vec_id as query_id, e.vec_id as fact_id, e.label, round(list_cosine_similarity(q.v, e.v), 6) as score from q, e {{}}), r as (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from s) select query_id, fact_id, score, rank from r where rank <= {{}}"


def _knn(spark, d, where: str, k: int) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding", "label")
    q = e.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    return R.nearest(e.where(where), q, k).withColumn("rank", F.col("rank").cast("long"))


@query("q008_ann_scan", _KNN.format("", 5))
def ann_scan(spark, d):
    return _knn(spark, d, "true", 5)


@query("q009_columnar_vectors", _KNN.format("where e.label in (1, 2, 3)", 8))
def columnar_vectors(spark, d):
    """Nearest vectors of some tiers; the filter reaches the Parquet scan."""
    return _knn(spark, d, "label in (1, 2, 3)", 8)


def _recall_sql(hops: int) -> str:
    steps = ["b as (select src, dst from edges where weight >= 2 union select dst, src from edges where weight >= 2)", "w0 as (select 5::bigint as node, 0 as hops)"]
    for i in range(hops):
        steps.append(f"w{i + 1} as materialized (select node, min(hops) as hops from (select node, hops from w{i} union all select b.dst, hops + 1 from w{i} join b on b.src = w{i}.node) group by 1)")
    return f"with {EDGES_SQL}, " + ", ".join(steps) + f" select node, round(power(0.6, hops), 6) as score from w{hops} where power(0.6, hops) >= 0.3"


@query("q010_graph_recall", _recall_sql(2))
def graph_recall(spark, d):
    found = G.reached(edges(spark, d).where("weight >= 2"), spark.createDataFrame([(5,)], "node long"), 2, tasks=edge_tasks(spark, d))
    return found.select("node", F.round(F.pow(F.lit(0.6), F.col("hops")), 6).alias("score")).where("score >= 0.3")


_STATE = "case event_type when 'login' then 'accepted' when 'view' then 'queryable' when 'click' then 'enriching' else 'complete' end"


def _states():
    kind = F.col("event_type")
    return F.when(kind == "login", "accepted").when(kind == "view", "queryable").when(kind == "click", "enriching").otherwise("complete")


@query("q213_ingestion_states", f"select event_id % 500 as operation_id, arg_max({_STATE}, (ts, event_id)) as state, count(*) as steps from events group by 1")
def ingestion_states(spark, d):
    e = table(spark, d, "events").withColumn("state", _states())
    return e.groupBy((F.col("event_id") % 500).alias("operation_id")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("steps"))


@query("q214_idempotent_submits", "select event_id % 400 as operation_id, arg_min(event_id, (ts, event_id)) as accepted, count(*) - 1 as repeats from events group by 1")
def idempotent_submits(spark, d):
    e = table(spark, d, "events").groupBy((F.col("event_id") % 400).alias("operation_id"))
    return e.agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("accepted"), (F.count(F.lit(1)) - 1).alias("repeats"))


@query("q215_stale_leases", "select event_id % 500 as operation_id, max(ts) as leased from events group by 1 having max(ts) < timestamp '2024-01-28'")
def stale_leases(spark, d):
    e = table(spark, d, "events").groupBy((F.col("event_id") % 500).alias("operation_id")).agg(F.max("ts").alias("leased"))
    return e.where("leased < timestamp '2024-01-28'")


@query("q219_signal_batches", "select event_id // 500 as batch, count(*) as offered, least(count(*), 400) as written, greatest(count(*) - 400, 0) as dropped from events group by 1")
def signal_batches(spark, d):
    n = F.count(F.lit(1))
    g = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("batch"))
    return g.agg(n.alias("offered"), F.least(n, F.lit(400).cast("long")).alias("written"), F.greatest(n - 400, F.lit(0).cast("long")).alias("dropped"))


@query("q230_event_feed", "select event_id, event_type from events where event_id > 900 order by event_id limit 100")
def event_feed(spark, d):
    return table(spark, d, "events").where("event_id > 900").select("event_id", "event_type").orderBy("event_id").limit(100)


@query(
    "q232_vector_cache",
    f"with {_V}, q as (select * from e where vec_id % 20 = 0), s as (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) as s from q join e on e.vec_id % 20 <> 0), m as (select query_id, arg_max(vec_id, (s, -vec_id)) as cached, max(s) as similarity from s group by 1) select query_id, cached, similarity, case when similarity >= 0.9 then 'hit' when similarity >= 0.3 then 'maybe' else 'miss' end as outcome from m",
)
def vector_cache(spark, d):
    """The nearest cached prompt of each new one, under two thresholds."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")
    q = e.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    best = R.nearest(e.where("fact_id % 20 <> 0"), q, 1)
    s = F.col("score")
    return best.select("query_id", F.col("fact_id").alias("cached"), s.alias("similarity"), F.when(s >= 0.9, "hit").when(s >= 0.3, "maybe").otherwise("miss").alias("outcome"))


CHANNELS = {
    "recent": lambda f: f.orderBy(F.desc("created_at"), "fact_id").limit(20).select("fact_id", F.lit(1.0).alias("score")),
    "important": lambda f: f.orderBy(F.desc("importance"), "fact_id").limit(20).select("fact_id", F.col("importance").cast("double").alias("score")),
}


@query(
    "q247_channel_protocol",
    f"with {FACTS_SQL}, a as (select 'recent' as channel, fact_id, 1.0::double as score from facts order by created_at desc, fact_id limit 20), b as (select 'important' as channel, fact_id, importance::double as score from facts order by importance desc, fact_id limit 20) select channel, fact_id, round(score, 6) as score from (select * from a union all select * from b)",
)
def channel_protocol(spark, d):
    """Channels are functions from facts to (fact_id, score); a registry runs them and names their rows."""
    out = None
    for name, channel in CHANNELS.items():
        rows = channel(facts(spark, d)).select(F.lit(name).alias("channel"), "fact_id", F.round("score", 6).alias("score"))
        out = rows if out is None else out.union(rows)
    return out


@query("q248_filter_protocol", f"with {FACTS_SQL} select fact_id from facts where importance >= 0.5 and n_chars >= 500 and fact_type <> 'fr'")
def filter_protocol(spark, d):
    """Filters are functions from results to results, chained by transform."""
    filters = (lambda r: r.where("importance >= 0.5"), lambda r: r.where("n_chars >= 500"), lambda r: r.where("fact_type <> 'fr'"))
    rows = facts(spark, d)
    for f in filters:
        rows = rows.transform(f)
    return rows.select("fact_id")


@query("q249_default_embedder", "select event_id, cast('0x' || substr(sha256(event_type), 1, 8) as bigint) % 1000 as first from events")
def default_embedder(spark, d):
    """The deterministic provider: a component from a hash of the text."""
    first = F.conv(F.substring(F.sha2("event_type", 256), 1, 8), 16, 10).cast("long") % 1000
    return table(spark, d, "events").select("event_id", first.alias("first"))


@query("q251_sql_functions", "select a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def sql_functions(spark, d):
    """A function of the library registered for SQL text."""
    spark.udf.register("name_similarity", S.jaro_winkler)
    table(spark, d, "part").select("p_partkey", "p_name").createOrReplaceTempView("palimpsest_part")
    return spark.sql(
        "select a.p_partkey, round(name_similarity(a.p_name, b.p_name), 6) as similarity from palimpsest_part a join palimpsest_part b on b.p_partkey = a.p_partkey + 1"
    )


@query("q220_dead_letters", "select user_id % 10 as lane, count(*) filter (where value < 5) as dead from events group by 1 having count(*) filter (where value < 5) > 0")
def dead_letters(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("lane")).agg(F.count_if(F.col("value") < 5).alias("dead")).where("dead > 0")


@query("q021_bundle_digests", "select 'nation' as name, count(*) as n, max(sha256(n_name)) as last from nation union all select 'region', count(*), max(sha256(r_name)) from region")
def bundle_digests(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.max(F.sha2(c, 256)).alias("last")) for t, c in (("nation", "n_name"), ("region", "r_name"))]
    return parts[0].union(parts[1])
