"""Aggregations, windows, sorts and set operations over events, facts and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions.temporal import monday_week
from palimpsest.operators import mining
from palimpsest.plans.registry import query
from palimpsest.sources.tables import EDGES_SQL, EVENTS_SQL, FACTS_SQL, edges, facts, table, tool_events


@query("q060_grouped_counts", f"with {FACTS_SQL} select fact_type, archive_status, count(*) as n from facts group by 1, 2")
def grouped_counts(spark, d):
    return facts(spark, d).groupBy("fact_type", "archive_status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q061_conditional_counts",
    f"with {FACTS_SQL} select profile_id, count(case when confidence >= 0.8 then 1 end) as high, count(case when confidence < 0.6 then 1 end) as low, count(*) as n from facts group by 1",
)
def conditional_counts(spark, d):
    return facts(spark, d).groupBy("profile_id").agg(F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.6).alias("low"), F.count(F.lit(1)).alias("n"))


@query("q062_distinct_counts", f"with {EVENTS_SQL} select tool_name, count(distinct session_id) as sessions, count(distinct user_id) as users from tool_events group by 1")
def distinct_counts(spark, d):
    return tool_events(spark, d).groupBy("tool_name").agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("user_id").alias("users"))


@query("q063_group_concat", f"with {EVENTS_SQL}, t as (select distinct user_id, tool_name from tool_events) select user_id, string_agg(tool_name, ',' order by tool_name) as tools from t group by 1")
def group_concat(spark, d):
    return tool_events(spark, d).groupBy("user_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("tool_name"))).alias("tools"))


@query("q064_having", f"with {EVENTS_SQL} select session_id, count(*) as n from tool_events group by 1 having count(*) >= 2")
def having(spark, d):
    return tool_events(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query(
    "q065_age_statistics",
    "select o_orderpriority, round(avg(age), 4) as mean_age, round(min(age), 4) as min_age, round(max(age), 4) as max_age from (select o_orderpriority, (epoch(timestamp '2025-01-01') - epoch(o_orderdate)) / 86400 as age from orders) group by 1",
)
def age_statistics(spark, d):
    age = (F.unix_timestamp(F.lit("2025-01-01").cast("timestamp")) - F.unix_timestamp("o_orderdate")) / 86400
    o = table(spark, d, "orders").select("o_orderpriority", age.alias("age"))
    return o.groupBy("o_orderpriority").agg(*[F.round(f("age"), 4).alias(f"{n}_age") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


@query(
    "q066_timeline",
    "select case when grouping(event_type) = 1 then 'all' else event_type end as category, strftime(ts, '%Y-W%W') as week, count(*) as n, round(sum(value), 4) as total from events group by grouping sets ((strftime(ts, '%Y-W%W'), event_type), (strftime(ts, '%Y-W%W')))",
)
def timeline(spark, d):
    e = table(spark, d, "events").select("event_type", monday_week(F.col("ts")).alias("week"), "value")
    by = e.groupBy("week", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    both = by.unionByName(by.groupBy("week").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("event_type", F.lit("all")))
    return both.select(F.col("event_type").alias("category"), "week", "n", F.round("total", 4).alias("total"))


@query(
    "q067_reward_timeline",
    "select strftime(ts, '%Y-%m-%d') as day, round(avg(value), 6) as mean_value from events where ts > (select max(ts) from events) - interval 7 days group by 1",
)
def reward_timeline(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    recent = e.where(F.col("ts") > F.lit(last) - F.expr("interval 7 days"))
    return recent.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    "q068_engagement",
    """with c as (select user_id, count(*) filter (where event_type = 'view') as recalls, count(*) filter (where event_type = 'purchase') as stores,
         count(distinct cast(ts as date)) as days, count(*) filter (where event_type = 'login') as sessions from events group by 1),
       r as (select user_id, 0.4 * recalls + 0.3 * stores + 0.2 * sessions + 0.1 * days as raw from c) select user_id, round(raw / (raw + 20), 6) as score from r""",
)
def engagement(spark, d):
    kind = lambda name: F.count_if(F.col("event_type") == name)
    raw = 0.4 * kind("view") + 0.3 * kind("purchase") + 0.2 * kind("login") + 0.1 * F.countDistinct(F.to_date("ts"))
    c = table(spark, d, "events").groupBy("user_id").agg(raw.alias("raw"))
    return c.select("user_id", F.round(F.col("raw") / (F.col("raw") + 20), 6).alias("score"))


@query(
    "q069_health_band",
    """select user_id, count(*) as n, count(distinct cast(ts as date)) as days, case when count(*) >= 10 then 'active' when count(*) >= 3 then 'warm' when count(*) >= 1 then 'cold' end as band
       from events where ts >= timestamp '2024-01-24' group by 1""",
)
def health_band(spark, d):
    e = table(spark, d, "events").where("ts >= timestamp '2024-01-24'")
    n = F.count(F.lit(1))
    return e.groupBy("user_id").agg(n.alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.when(n >= 10, "active").when(n >= 3, "warm").otherwise("cold").alias("band"))


@query(
    "q070_bigrams",
    f"""with {EVENTS_SQL}, n as (select tool_name as a, lead(tool_name) over (partition by user_id order by created_at, event_id) as b from tool_events),
        c as (select a, b, count(*) as n from n where b is not null and a <> b group by 1, 2) select a, b, n, round(n / sum(n) over (), 6) as share from (select * from c where n >= 3)""",
)
def bigrams(spark, d):
    return mining.transitions(tool_events(spark, d), "user_id", min_count=3)


@query(
    "q071_ngrams",
    f"""with {EVENTS_SQL}, l as (select user_id, list(tool_name order by created_at, event_id) as t from tool_events group by 1),
        g as (select array_to_string(t[i : i + 2], '>') as gram, t[i] as x, t[i + 1] as y, t[i + 2] as z from (select t, unnest(range(1, len(t) - 1)) as i from l))
        select gram, count(*) as n from g where x <> y and y <> z group by 1 having count(*) >= 3 order by n desc, gram limit 20""",
)
def ngrams(spark, d):
    return mining.sequences(tool_events(spark, d), "user_id", 3, min_count=3, top=20)


@query(
    "q072_correction_rates",
    f"with {EVENTS_SQL} select user_id, count(*) as total, round(count(*) filter (where tool_name = 'error') / count(*), 6) as rate from tool_events group by 1 having count(*) >= 3 and count(*) filter (where tool_name = 'error') / count(*) > 0.15",
)
def correction_rates(spark, d):
    n, bad = F.count(F.lit(1)), F.count_if(F.col("tool_name") == "error")
    c = tool_events(spark, d).groupBy("user_id").agg(n.alias("total"), (bad / n).alias("rate")).where("total >= 3 and rate > 0.15")
    return c.withColumn("rate", F.round("rate", 6))


@query(
    "q073_tool_preference",
    f"with {EVENTS_SQL}, t as (select tool_name, count(*) as n from tool_events group by 1 order by n desc, tool_name limit 10), s as (select tool_name, n / sum(n) over () as share from t) select tool_name, round(share, 6) as share from s where share > 0.1",
)
def tool_preference(spark, d):
    return mining.shares_of_top(tool_events(spark, d), "tool_name", 10, 0.1)


@query(
    "q074_peak_hours",
    "with h as (select hour(ts) as hour, count(*) as n from events group by 1), s as (select hour, n / sum(n) over () as share from h) select hour, round(share, 6) as share from s where share > 0.03",
)
def peak_hours(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.hour("ts").cast("long"))
    return mining.shares_of_top(e, "hour", 24, 0.03)


@query(
    "q075_time_of_day",
    """with b as (select case when hour(ts) between 6 and 11 then 'morning' when hour(ts) between 12 and 17 then 'afternoon' when hour(ts) between 18 and 21 then 'evening' else 'night' end as bucket, event_type from events),
       c as (select bucket, event_type, count(*) as n from b group by 1, 2) select bucket, arg_max(event_type, (n, event_type)) as activity, cast(sum(n) as bigint) as evidence from c group by 1 having sum(n) >= 5""",
)
def time_of_day(spark, d):
    h = F.hour("ts")
    bucket = F.when(h.between(6, 11), "morning").when(h.between(12, 17), "afternoon").when(h.between(18, 21), "evening").otherwise("night")
    c = table(spark, d, "events").groupBy(bucket.alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    c = c.groupBy("bucket").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("activity"), F.sum("n").alias("evidence"))
    return c.where("evidence >= 5")


@query(
    "q076_cross_project_promotion",
    f"with {FACTS_SQL} select n_chars % 100 as pattern, count(distinct profile_id) as projects, round(avg(confidence), 6) as confidence from facts group by 1 having count(distinct profile_id) >= 2 and sum(cast(round(confidence * 100) as bigint)) >= 75 * count(*)",
)
def promotion(spark, d):
    """Patterns of several projects whose mean confidence reaches 0.75, compared in whole hundredths so that ties are exact."""
    hundredths = F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("hundredths")
    f = facts(spark, d).groupBy((F.col("n_chars") % 100).alias("pattern"))
    f = f.agg(F.countDistinct("profile_id").alias("projects"), F.avg("confidence").alias("confidence"), hundredths, F.count(F.lit(1)).alias("n"))
    return f.where("projects >= 2 and hundredths >= 75 * n").select("pattern", "projects", F.round("confidence", 6).alias("confidence"))


@query(
    "q077_skill_performance",
    f"""with {EVENTS_SQL}, n as (select tool_name, session_id, lead(value) over (partition by user_id order by created_at, event_id) as after from tool_events)
        select tool_name, count(distinct session_id) as sessions, round((count(*) filter (where after >= 50) - count(*) filter (where after < 20)) / count(*), 6) as score from n where after is not null group by 1""",
)
def skill_performance(spark, d):
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    n = tool_events(spark, d).withColumn("after", F.lead("value").over(w)).where("after is not null")
    score = (F.count_if(F.col("after") >= 50) - F.count_if(F.col("after") < 20)) / F.count(F.lit(1))
    return n.groupBy("tool_name").agg(F.countDistinct("session_id").alias("sessions"), F.round(score, 6).alias("score"))


@query(
    "q078_co_occurrence",
    f"with {EVENTS_SQL}, t as (select distinct session_id, tool_name from tool_events) select a.tool_name as a, b.tool_name as b, count(*) as n from t a join t b on a.session_id = b.session_id and a.tool_name < b.tool_name group by 1, 2",
)
def co_occurrence(spark, d):
    return mining.co_occurrence(tool_events(spark, d), "session_id", "tool_name")


@query(
    "q079_topic_words",
    "with w as (select unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) as word from conversations) select word, count(*) as n from w group by 1 having count(*) >= 5 order by n desc, word limit 50",
)
def topic_words(spark, d):
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").orderBy(F.desc("n"), "word").limit(50)


@query("q080_channel_performance", f"with {EVENTS_SQL} select tool_name as channel, count(*) as n, round(avg(value), 6) as mean_signal from tool_events group by 1 having count(*) >= 3")
def channel_performance(spark, d):
    return tool_events(spark, d).groupBy(F.col("tool_name").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_signal")).where("n >= 3")


@query(
    "q081_reward_per_fact",
    f"with {EVENTS_SQL}, u as (select unnest([user_id, k]) as fact_id, value from tool_events) select fact_id, count(*) as n, round(avg(value), 6) as mean_reward from u group by 1",
)
def reward_per_fact(spark, d):
    u = tool_events(spark, d).select(F.explode(F.array("user_id", F.col("k").cast("long"))).alias("fact_id"), "value")
    return u.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_reward"))


OUTCOME = "case when value >= 60 then {full} when value >= 30 then {part} else 0.0 end"


@query("q082_success_rate", f"select user_id, round(avg({OUTCOME.format(full='1.0', part='0.5')}), 6) as overall, round(avg({OUTCOME.format(full='1.0', part='0.0')}), 6) as strict from events group by 1")
def success_rate(spark, d):
    rate = lambda part: F.round(F.avg(F.when(F.col("value") >= 60, 1.0).when(F.col("value") >= 30, part).otherwise(0.0)), 6)
    return table(spark, d, "events").groupBy("user_id").agg(rate(0.5).alias("overall"), rate(0.0).alias("strict"))


@query(
    "q083_beta_trust",
    "select user_id, round((1 + sum(case when value >= 50 then 1.0 else 0.0 end)) / (2 + count(*)), 6) as trust, count(*) as evidence from events group by 1",
)
def beta_trust(spark, d):
    """The lossless posterior of all evidence, whatever its order."""
    hits, n = F.sum(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(F.round((1 + hits) / (2 + n), 6).alias("trust"), n.alias("evidence"))


@query("q084_source_quality", f"with {FACTS_SQL} select profile_id, round((1 + sum(importance)) / (2 + count(*)), 6) as quality from facts group by 1")
def source_quality(spark, d):
    good, bad = F.sum("importance"), F.sum(1 - F.col("importance"))
    return facts(spark, d).groupBy("profile_id").agg(F.round((1 + good) / (2 + good + bad), 6).alias("quality"))


@query("q085_channel_credit", f"with {EVENTS_SQL} select tool_name, round(0.7 + 0.8 * count(*) filter (where value >= 50) / count(*), 6) as weight from tool_events group by 1 having count(*) >= 5")
def channel_credit(spark, d):
    n = F.count(F.lit(1))
    e = tool_events(spark, d).groupBy("tool_name").agg(F.round(0.7 + 0.8 * F.count_if(F.col("value") >= 50) / n, 6).alias("weight"), n.alias("n"))
    return e.where("n >= 5").drop("n")


@query(
    "q086_calibration",
    """with p as (select quality as y, (doc_id % 97) / 97.0::double as p from labels), b as (select least(cast(floor(p * 10) as bigint), 9) as bin, count(*) as n, avg(p) as p, avg(y) as y from p group by 1)
       select (select round(avg((p - y) * (p - y)), 6) from p) as brier, round(sum(n * abs(p - y)) / sum(n), 6) as ece, round(max(abs(p - y)), 6) as mce from b""",
)
def calibration(spark, d):
    p = table(spark, d, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 97) / 97.0).alias("p"))
    return mining.calibration(p, bins=10)


@query(
    "q088_community_labels",
    """with w as (select lang as community, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as term from documents), tf as (select community, term, count(*) as tf from w group by 1, 2),
       df as (select term, count(*) as df from tf group by 1), n as (select count(distinct lang) as n from documents),
       s as (select community, term, tf * ln(1 + n / (1 + df)) as s from tf join df using (term), n), r as (select *, row_number() over (partition by community order by round(s, 6) desc, term) as rank from s)
       select community, term, rank from r where rank <= 3""",
)
def community_labels(spark, d):
    w = table(spark, d, "documents").select(F.col("lang").alias("community"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("term"))
    return mining.tfidf_labels(w, top=3)


@query("q090_centroids", "with e as (select label, unnest(embedding) as x, unnest(range(0, len(embedding))) as i from embeddings) select label, i, round(avg(x), 5) as mean from e group by 1, 2")
def centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("q091_cache_metrics", "select round(count(*) filter (where value > 50) / nullif(count(*), 0), 6) as hit_rate, round(sum(value) / nullif(sum(length(props)), 0), 6) as ratio from events")
def cache_metrics(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").agg(F.round(F.count_if(F.col("value") > 50) / F.nullif(n, F.lit(0)), 6).alias("hit_rate"), F.round(F.sum("value") / F.nullif(F.sum(F.length("props")), F.lit(0)), 6).alias("ratio"))


@query(
    "q092_cube",
    "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as priority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
)
def cube(spark, d):
    c = table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query(
    "q093_degree_cap",
    f"with {EDGES_SQL}, r as (select src, dst, weight, row_number() over (partition by src order by weight desc, dst) as o, row_number() over (partition by dst order by weight desc, src) as i from edges) select src, dst, weight from r where o <= 20 and i <= 3",
)
def degree_cap(spark, d):
    out, into = Window.partitionBy("src").orderBy(F.desc("weight"), "dst"), Window.partitionBy("dst").orderBy(F.desc("weight"), "src")
    e = edges(spark, d).withColumns({"o": F.row_number().over(out), "i": F.row_number().over(into)})
    return e.where("o <= 20 and i <= 3").select("src", "dst", "weight")


@query("q094_latest_per_group", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn = 1")
def latest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", "role")).alias("m")).select("conv_id", "m.turn", "m.role")


@query("q095_first_member", "select label, min(vec_id) as anchor from embeddings group by 1")
def first_member(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.min_by("vec_id", "vec_id").alias("anchor"))


@query("q096_duplicate_edges", "select l_suppkey as src, l_partkey as dst, l_returnflag as kind, max(l_quantity) as weight from lineitem group by 1, 2, 3")
def duplicate_edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).agg(F.max("l_quantity").alias("weight"))


@query("q097_channel_ranks", "select event_type as channel, event_id as fact_id, row_number() over (partition by event_type order by value desc, event_id) as rank from events qualify rank <= 50")
def channel_ranks(spark, d):
    w = Window.partitionBy("channel").orderBy(F.desc("value"), "fact_id")
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("fact_id"), "value")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 50").drop("value")


@query("q098_share_of_total", "select event_type, round(count(*) / sum(count(*)) over (), 6) as share from events group by 1")
def share_of_total(spark, d):
    return mining.shares_of_top(table(spark, d, "events"), "event_type", 1000, 0.0)


@query("q100_min_max", "select event_id, round((value - min(value) over w) / nullif(max(value) over w - min(value) over w, 0), 6) as scaled from events window w as (partition by user_id)")
def min_max(spark, d):
    w = Window.partitionBy("user_id")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return table(spark, d, "events").select("event_id", F.round((F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)), 6).alias("scaled"))


@query("q101_softmax", "with e as (select event_id, user_id, exp((value - max(value) over (partition by user_id)) / 10) as x from events) select event_id, round(x / sum(x) over (partition by user_id), 6) as p from e")
def softmax(spark, d):
    w = Window.partitionBy("user_id")
    e = table(spark, d, "events").withColumn("x", F.exp((F.col("value") - F.max("value").over(w)) / 10))
    return e.select("event_id", F.round(F.col("x") / F.sum("x").over(w), 6).alias("p"))


@query(
    "q102_gap_clusters",
    """with g as (select o_custkey, o_orderkey, case when epoch(o_orderdate) - epoch(lag(o_orderdate) over w) > 7 * 86400 then 1 else 0 end as cut, o_orderdate from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
       select o_orderkey, cast(sum(cut) over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as cluster from g""",
)
def gap_clusters(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lag("o_orderdate").over(w)) > 7 * 86400
    cut = table(spark, d, "orders").withColumn("cut", F.coalesce(gap, F.lit(False)).cast("long"))
    return cut.select("o_orderkey", F.sum("cut").over(w).alias("cluster"))


@query("q104_top_k", "select fact_id, score from (select event_id as fact_id, value as score from events) order by score desc, fact_id limit 50")
def top_k(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("fact_id"), F.col("value").alias("score")).orderBy(F.desc("score"), "fact_id").limit(50)


@query("q105_proximity_limit", "select o_orderkey from orders order by abs(epoch(o_orderdate) - epoch(timestamp '2023-06-15')), o_orderkey limit 5000")
def proximity_limit(spark, d):
    away = F.abs(F.unix_timestamp("o_orderdate") - F.unix_timestamp(F.lit("2023-06-15").cast("timestamp")))
    return table(spark, d, "orders").orderBy(away, "o_orderkey").limit(5000).select("o_orderkey")


@query(
    "q106_session_diversity",
    """with r as (select event_id, user_id, row_number() over (order by value desc, event_id) as rank, row_number() over (partition by user_id order by value desc, event_id) as own from events),
       p as (select *, case when own = 1 and rank > 17 then 1 when rank <= 17 then 0 else 2 end as tier from r where rank <= 100)
       select event_id, row_number() over (order by tier, rank) as position from p qualify position <= 20""",
)
def session_diversity(spark, d):
    """The first 17 of the best 100, then the best of sessions not seen: top 100 by a bounded sort."""
    e = table(spark, d, "events")
    own = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = e.withColumn("own", F.row_number().over(own)).orderBy(F.desc("value"), "event_id").limit(100)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")))
    tier = F.when(F.col("rank") <= 17, 0).when(F.col("own") == 1, 1).otherwise(2)
    return top.withColumn("position", F.row_number().over(Window.orderBy(tier, "rank")).cast("long")).where("position <= 20").select("event_id", "position")


@query(
    "q107_channel_quota",
    """with r as (select event_id, event_type, row_number() over (partition by event_type order by value desc, event_id) as own, row_number() over (order by value desc, event_id) as rank from events)
       select event_id from r order by case when own <= 2 then 0 else 1 end, rank limit 20""",
)
def channel_quota(spark, d):
    own = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    r = table(spark, d, "events").withColumn("own", F.row_number().over(own))
    return r.orderBy(F.when(F.col("own") <= 2, 0).otherwise(1), F.desc("value"), "event_id").limit(20).select("event_id")


@query("q108_fifo_claim", "select event_type, arg_min(event_id, (ts, event_id)) as claimed from events group by 1")
def fifo(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("claimed"))


@query("q111_union_distinct", "select l_orderkey as id from lineitem where l_quantity > 45 union select o_orderkey from orders where o_orderstatus = 'F'")
def union_distinct(spark, d):
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return a.union(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")).distinct()


@query(
    "q112_tier_merge",
    "select id, round(max(s), 6) as score from (select event_id as id, value as s from events where event_id % 2 = 0 union all select event_id, value * 0.98 from events where event_id % 3 = 0 union all select event_id, value * 0.97 from events) group by 1",
)
def tier_merge(spark, d):
    e = table(spark, d, "events")
    tiers = [e.where(c).select(F.col("event_id").alias("id"), (F.col("value") * f).alias("s")) for c, f in (("event_id % 2 = 0", 1.0), ("event_id % 3 = 0", 0.98), ("true", 0.97))]
    return tiers[0].union(tiers[1]).union(tiers[2]).groupBy("id").agg(F.round(F.max("s"), 6).alias("score"))


@query(
    "q113_additive_union",
    "with a as (select event_id as id, value as s from events where event_type = 'view'), b as (select event_id as id, value * 0.85 as s from events where user_id % 2 = 0) select id, round(s, 6) as score from a union all select id, round(s, 6) from b where id not in (select id from a)",
)
def additive_union(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("value").alias("s"))
    b = e.where("user_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("value") * 0.85).alias("s")).join(a, "id", "left_anti")
    return a.unionByName(b).select("id", F.round("s", 6).alias("score"))


@query("q114_exact_dedup", "select sha256(lower(trim(text))) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def exact_dedup(spark, d):
    h = F.sha2(F.lower(F.trim("text")), 256).alias("content_hash")
    return table(spark, d, "documents").select(h, "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    "q116_consolidation_fallback",
    f"with {FACTS_SQL}, k as (select fact_id, confidence, row_number() over (partition by lower(trim(substr(content, 1, 100))) order by fact_id) as rn from facts) select fact_id, round(case when rn > 1 then greatest(0.1, confidence * 0.5) else confidence end, 6) as confidence from k",
)
def consolidation_fallback(spark, d):
    f = facts(spark, d).withColumn("key", F.lower(F.trim(F.substring("content", 1, 100))))
    later = F.row_number().over(Window.partitionBy("key").orderBy("fact_id")) > 1
    return f.select("fact_id", F.round(F.when(later, F.greatest(F.lit(0.1), F.col("confidence") * 0.5)).otherwise(F.col("confidence")), 6).alias("confidence"))


@query(
    "q117_idempotency",
    "select event_id % 400 as key, count(*) as submitted, count(distinct event_type) > 1 as conflict from events group by 1",
)
def idempotency(spark, d):
    return table(spark, d, "events").groupBy((F.col("event_id") % 400).alias("key")).agg(F.count(F.lit(1)).alias("submitted"), (F.countDistinct("event_type") > 1).alias("conflict"))


@query("q118_intersect", "select user_id from events where event_type = 'view' intersect select user_id from events where event_type = 'purchase'")
def intersect(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))
