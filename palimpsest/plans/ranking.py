"""Retrieval, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import textual as T
from palimpsest.operators import retrieval as R
from palimpsest.plans.registry import query
from palimpsest.sources.tables import AS_OF, FACTS_SQL, facts, table

_BM25 = """with q as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as term from benchmark),
  d as (select doc_id as fact_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
  s as (select count(*) as n, avg(len(t)) as avgdl from d),
  p as (select fact_id, len(t) as dl, unnest(t) as term from d),
  tf as (select term, fact_id, dl, count(*) as tf from p where term in (select term from q) group by 1, 2, 3),
  df as (select term, count(*) as df from tf group by 1),
  w as (select term, fact_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) as w from tf join df using (term), s),
  r as (select query_id, fact_id, round(sum(w), 6) as score from w join q using (term) group by 1, 2)"""


@query("q006_full_text_scan", f"{_BM25}, f as (select doc_id as fact_id from documents where doc_id % 17 <> 0), k as (select r.*, row_number() over (partition by query_id order by score desc, fact_id) as rank from r join f using (fact_id)) select query_id, fact_id, score from k where rank <= 10")
def full_text(spark, d):
    """BM25 hits among the facts that may be seen, ranked before they are cut."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    live = docs.where("fact_id % 17 <> 0").select("fact_id")
    return R.bm25(docs, queries, 10, visible=live).select("query_id", "fact_id", "score")


@query("q119_bm25", f"{_BM25} select query_id, fact_id, score from (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from r) where rank <= 50")
def bm25(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("content"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(docs, queries, 50).select("query_id", "fact_id", "score")


@query(
    "q007_vector_knn",
    """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), q as (select * from e where vec_id % 20 = 0),
       s as (select q.vec_id as query_id, e.vec_id as fact_id, round(list_cosine_similarity(q.v, e.v), 6) as score from q, e),
       r as (select *, row_number() over (partition by query_id order by score desc, fact_id) as rank from s) select query_id, fact_id, score from r where rank <= 10""",
)
def vector_knn(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")
    q = e.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding")
    return R.nearest(e, q, 10).select("query_id", "fact_id", "score")


@query(
    "q124_temporal_proximity",
    """select o_orderkey as fact_id, round(case when abs(days) <= 365 then exp(-days * days / 1800) else 0 end, 6) as score
       from (select o_orderkey, (epoch(o_orderdate) - epoch(timestamp '2023-06-15')) / 86400 as days from orders) where abs(days) <= 120""",
)
def temporal_proximity(spark, d):
    days = (F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lit("2023-06-15").cast("timestamp"))) / 86400
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("fact_id"), days.alias("days")).where("abs(days) <= 120")
    return o.select("fact_id", F.round(R.proximity(F.col("days"), 30, 365), 6).alias("score"))


@query(
    "q125_recency_fallback",
    f"""with {FACTS_SQL}, s as (select fact_id, (epoch(timestamp '{AS_OF}') - epoch(created_at)) / 86400 as days from facts)
        select fact_id, round(exp(-days * days / 98), 9) as score from s where days <= 90 order by score desc, fact_id limit 50""",
)
def recency(spark, d):
    days = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    f = facts(spark, d).select("fact_id", days.alias("days")).where("days <= 90")
    return f.select("fact_id", F.round(R.proximity(F.col("days"), 7, 90), 9).alias("score")).orderBy(F.desc("score"), "fact_id").limit(50)


CHANNELS = {"click": 1.0, "login": 0.5, "purchase": 2.0, "view": 1.2}
_CHANNEL_SQL = """r as (select user_id as query_id, event_type as channel, fact_id, row_number() over (partition by user_id, event_type order by s desc, fact_id) as rank
  from (select user_id, event_type, event_id % 50 as fact_id, max(value) as s from events group by 1, 2, 3))"""


def channel_ranks(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("channel"), (F.col("event_id") % 50).alias("fact_id")).agg(F.max("value").alias("s"))
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("s"), "fact_id")
    return e.withColumn("rank", F.row_number().over(w)).drop("s")


@query(
    "q129_weighted_rrf",
    f"with {_CHANNEL_SQL}, p as (select query_id, fact_id, " + ", ".join(f"min(rank) filter (where channel = '{c}') as {c}" for c in CHANNELS) + " from r group by 1, 2) select query_id, fact_id, round(" + " + ".join(f"{w} / (15 + coalesce({c}, 1000))" for c, w in CHANNELS.items()) + ", 6) as score from p",
)
def weighted_rrf(spark, d):
    return R.fused(channel_ranks(spark, d), CHANNELS).select("query_id", "fact_id", F.round("score", 6).alias("score"))


@query(
    "q130_cross_channel",
    f"with {_CHANNEL_SQL} select query_id, fact_id, count(distinct channel) as groups, case when count(distinct channel) >= 3 then 2.0::double when count(distinct channel) = 2 then 1.5::double else 1.0::double end as boost from r group by 1, 2",
)
def cross_channel(spark, d):
    n = F.countDistinct("channel")
    g = channel_ranks(spark, d).groupBy("query_id", "fact_id").agg(n.alias("groups"))
    return g.withColumn("boost", F.when(F.col("groups") >= 3, 2.0).when(F.col("groups") == 2, 1.5).otherwise(1.0))


@query(
    "q133_temporal_demotion",
    "select event_id, round(value * case when event_id % 13 = 0 then 0.25 when event_id % 7 = 0 then 0.5 else 1 end, 6) as score from events order by score desc, event_id limit 200",
)
def demotion(spark, d):
    factor = F.when(F.col("event_id") % 13 == 0, 0.25).when(F.col("event_id") % 7 == 0, 0.5).otherwise(1.0)
    e = table(spark, d, "events").select("event_id", F.round(F.col("value") * factor, 6).alias("score"))
    return e.orderBy(F.desc("score"), "event_id").limit(200)


@query(
    "q134_reranker_blend",
    """with e as (select user_id, event_id, value, (event_id * 37 % 101) / 101.0::double as ce from events), n as (select *, (ce - min(ce) over w) / nullif(max(ce) over w - min(ce) over w, 0) as c, value / nullif(max(value) over w, 0) as r from e window w as (partition by user_id))
       select event_id, round(0.75 * coalesce(c, 0) + 0.25 * coalesce(r, 0), 6) as score from n""",
)
def blend(spark, d):
    w, ce = Window.partitionBy("user_id"), (F.col("event_id") * 37 % 101) / 101.0
    e = table(spark, d, "events").select("user_id", "event_id", "value", ce.alias("ce"))
    lo, hi = F.min("ce").over(w), F.max("ce").over(w)
    c = F.coalesce((F.col("ce") - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0))
    r = F.coalesce(F.col("value") / F.nullif(F.max("value").over(w), F.lit(0.0)), F.lit(0.0))
    return e.select("event_id", F.round(0.75 * c + 0.25 * r, 6).alias("score"))


@query(
    "q135_final_scoring",
    f"""with {FACTS_SQL} select fact_id, round(1 / (1 + exp(-0.5 * importance * (0.8 + 0.3 * power(2.0, -((epoch(timestamp '{AS_OF}') - epoch(created_at)) / 86400) / 30))
        * case when n_chars < 20 then 0.3 when n_chars < 50 then 0.7 else 1 end * (0.5 + confidence))), 6) as score from facts""",
)
def final_scoring(spark, d):
    age = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    return facts(spark, d).select("fact_id", F.round(R.final_score(F.col("importance"), age, F.col("n_chars"), F.col("confidence")), 6).alias("score"))


@query(
    "q136_query_classifier",
    """select item_id, case when regexp_matches(lower(text), '\\b(when|date|day)\\b') then 'temporal' when regexp_matches(lower(text), '\\b(who|whom)\\b') then 'entity'
       when regexp_matches(lower(text), '\\b(how many|count)\\b') then 'aggregation' when length(text) < 120 then 'factual' else 'open' end as kind from benchmark""",
)
def classifier(spark, d):
    t = F.lower("text")
    kind = F.when(t.rlike(T.bounded("when|date|day")), "temporal").when(t.rlike(T.bounded("who|whom")), "entity").when(t.rlike(T.bounded("how many|count")), "aggregation")
    return table(spark, d, "benchmark").select("item_id", kind.when(F.length("text") < 120, "factual").otherwise("open").alias("kind"))


@query(
    "q138_community_context",
    "with t as (select user_id, k, row_number() over (partition by user_id order by value desc, event_id) as rn from (select *, event_id % 4 as k from events)), c as (select user_id, k, count(*) as n from t where rn <= 10 group by 1, 2) select user_id, arg_max(k, (n, -k)) as community, max(n) as n from c group by 1 having max(n) >= 3",
)
def community_context(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    t = table(spark, d, "events").withColumn("k", F.col("event_id") % 4).withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    c = t.groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("user_id").agg(F.max_by("k", F.struct("n", -F.col("k"))).alias("community"), F.max("n").alias("n")).where("n >= 3")


@query(
    "q141_auto_invoke",
    """with a as (select event_id % 200 as fact_id, epoch(timestamp '2024-02-01') - epoch(ts) as age, row_number() over (partition by event_id % 200 order by ts desc, event_id) as rn from events)
       select fact_id, round(ln(sum(power(age / 86400 + 1, -0.5))), 6) as base_level from a where rn <= 100 group by 1""",
)
def auto_invoke(spark, d):
    """Base-level activation: the logarithm of summed power-law decays of the last 100 accesses."""
    w = Window.partitionBy("fact_id").orderBy(F.desc("ts"), "event_id")
    e = table(spark, d, "events").withColumn("fact_id", F.col("event_id") % 200).withColumn("rn", F.row_number().over(w)).where("rn <= 100")
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400
    return e.groupBy("fact_id").agg(F.round(F.log(F.sum(F.pow(age + 1, F.lit(-0.5)))), 6).alias("base_level"))


@query("q147_relevance_labels", "select event_id, cast(case when value >= 90 then 4 when value >= 60 then 3 when value >= 30 then 2 when value >= 10 then 1 else 0 end as int) as label from events")
def relevance(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.when(v >= 90, 4).when(v >= 60, 3).when(v >= 30, 2).when(v >= 10, 1).otherwise(0).alias("label"))


@query(
    "q148_shadow_ab",
    """with a as (select value, cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 8) as bigint) % 2 as arm from events)
       select arm, count(*) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd from a group by 1""",
)
def shadow_ab(spark, d):
    arm = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 2
    a = table(spark, d, "events").select("value", arm.alias("arm"))
    return a.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query(
    "q149_ranking_metrics",
    """with r as (select user_id, event_id % 6 = 0 as relevant, row_number() over (partition by user_id order by value desc, event_id) as rank from events),
       m as (select user_id, coalesce(max(case when relevant and rank <= 10 then 1.0 / rank end), 0) as rr, count(*) filter (where relevant and rank <= 10) / nullif(count(*) filter (where relevant), 0) as recall from r group by 1)
       select count(*) as queries, round(avg(rr), 6) as mrr, round(avg(recall), 6) as recall from m""",
)
def metrics(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = table(spark, d, "events").select("user_id", (F.col("event_id") % 6 == 0).alias("rel"), F.row_number().over(w).alias("rank"))
    hit = F.col("rel") & (F.col("rank") <= 10)
    m = r.groupBy("user_id").agg(F.coalesce(F.max(F.when(hit, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), (F.count_if(hit) / F.nullif(F.count_if(F.col("rel")), F.lit(0))).alias("recall"))
    return m.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"))
