"""Further queries: similarity joins, activation, routing, signals, resolution, consolidation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.functions import textual as T
from palimpsest.operators import graphs as G
from palimpsest.operators import retrieval as R
from palimpsest.plans.ranking import _CHANNEL_SQL, channel_ranks
from palimpsest.plans.registry import query
from palimpsest.sources.tables import AS_OF, EDGES_SQL, EVENTS_SQL, FACTS_SQL, edge_tasks, edges, facts, table, tool_events

_V = "e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("q014_embedding_codec", "select vec_id, len(embedding) as dims, round(list_sum(list_transform(embedding, lambda x: cast(x as double))), 4) as total from embeddings where len(embedding) = 64")
def codec(spark, d):
    """Vectors written as JSON text and read back, those of the right length."""
    raw = table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("text"))
    v = raw.select("vec_id", F.from_json("text", "array<float>").alias("v")).where(F.size("v") == 64)
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", F.size("v").cast("long").alias("dims"), F.round(total, 4).alias("total"))


@query("q024_backup_manifest", "select 'nation' as name, count(*) as n, cast(sum(n_nationkey) as bigint) as keys from nation union all select 'region', count(*), cast(sum(r_regionkey) as bigint) from region")
def manifest(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(k).alias("keys")) for t, k in (("nation", "n_nationkey"), ("region", "r_regionkey"))]
    return parts[0].union(parts[1])


@query(
    "q035_window_inference",
    "select item_id, case when regexp_matches(t, '(last|past) [0-9]+ day') then regexp_extract(t, '(last|past) ([0-9]+) day', 2) || 'd' when contains(t, 'yesterday') then '2d' when contains(t, 'the') then '1w' end as spec from (select item_id, lower(text) as t from benchmark)",
)
def window_inference(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    spec = F.when(F.col("t").rlike("(last|past) [0-9]+ day"), F.concat(F.regexp_extract("t", "(last|past) ([0-9]+) day", 2), F.lit("d")))
    return t.select("item_id", spec.when(F.col("t").contains("yesterday"), "2d").when(F.col("t").contains("the"), "1w").alias("spec"))


@query("q041_hits_with_facts", f"with {FACTS_SQL} select fact_id, profile_id, fact_type from facts join (select doc_id from documents where contains(text, 'tion')) on doc_id = fact_id where coalesce(archive_status, 'live') <> 'archived'")
def hits(spark, d):
    found = table(spark, d, "documents").where(F.col("text").contains("tion")).select(F.col("doc_id").alias("fact_id"))
    live = facts(spark, d).where(F.coalesce("archive_status", F.lit("live")) != "archived")
    return live.join(found, "fact_id").select("fact_id", "profile_id", "fact_type")


@query(
    "q052_similarity_join",
    f"""with {_V}, s as (select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.v, b.v), 6) as similarity from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
       r as (select *, row_number() over (partition by a order by similarity desc, b) as rank from s) select a, b, similarity from r where rank <= 6 and similarity > 0.3""",
)
def similarity_join(spark, d):
    """The six nearest of all vectors to each of the query set, of whatever label, whose cosine is over the threshold."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding")
    near = R.nearest(e, e.where("fact_id % 20 = 0").select(F.col("fact_id").alias("query_id"), "embedding"), 7)  # itself, and six more
    near = near.where("query_id <> fact_id").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return near.where("place <= 6 and score > 0.3").select(F.col("query_id").alias("a"), F.col("fact_id").alias("b"), F.col("score").alias("similarity"))


@query("q059_nearest_import", "select a.n_nationkey as caller, arg_min(b.n_nationkey, (abs(a.n_regionkey - b.n_regionkey), b.n_nationkey)) as target from nation a join nation b on a.n_nationkey % 5 = b.n_nationkey % 5 and a.n_nationkey <> b.n_nationkey group by 1")
def nearest_import(spark, d):
    n = table(spark, d, "nation").withColumn("name", F.col("n_nationkey") % 5)
    b = n.select("name", F.col("n_nationkey").alias("t"), F.col("n_regionkey").alias("r"))
    found = n.join(b, "name").where("n_nationkey <> t").groupBy(F.col("n_nationkey").alias("caller"))
    return found.agg(F.min_by("t", F.struct(F.abs(F.col("n_regionkey") - F.col("r")), "t")).alias("target"))


@query("q099_next_tools", f"with {EVENTS_SQL} select event_id, lead(tool_name) over w as next, lead(tool_name, 2) over w as second from tool_events window w as (partition by user_id order by created_at, event_id)")
def next_tools(spark, d):
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    return tool_events(spark, d).select("event_id", F.lead("tool_name").over(w).alias("next"), F.lead("tool_name", 2).over(w).alias("second"))


@query("q103_total_order", "select user_id, event_id, row_number() over (partition by user_id order by round(value) desc, event_id) as position from events")
def total_order(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.round("value").desc(), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("position"))


@query("q110_neighbours", f"with {EDGES_SQL} select dst as n from edges where src = 2 union all select src from edges where dst = 2 union all select dst from edges where src = 4 and weight > 1 union all select src from edges where dst = 4")
def neighbours(spark, d):
    e = edges(spark, d)
    parts = [e.where("src = 2").select(F.col("dst").alias("n")), e.where("dst = 2").select("src"), e.where("src = 4 and weight > 1").select("dst"), e.where("dst = 4").select("src")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "q115_near_duplicate_merge",
    f"with {FACTS_SQL}, c as (select sha256(content) as h, first_value(fact_id) over (partition by sha256(content) order by importance desc, confidence desc, created_at, fact_id) as canonical, fact_id from facts) select fact_id, canonical, case when fact_id = canonical then 'live' else 'merged' end as state from c",
)
def near_duplicate_merge(spark, d):
    w = Window.partitionBy("h").orderBy(F.desc("importance"), F.desc("confidence"), "created_at", "fact_id")
    c = facts(spark, d).withColumn("h", F.sha2("content", 256)).select("fact_id", F.first("fact_id").over(w).alias("canonical"))
    return c.withColumn("state", F.when(F.col("fact_id") == F.col("canonical"), "live").otherwise("merged"))


@query(
    "q120_graduated_semantic",
    f"""with {_V}, q as (select v from e where vec_id = 0), s as (select vec_id, vec_id % 20 as access, (1 + list_cosine_similarity(e.v, q.v)) / 2 as c,
        exp(-sqrt(2 * list_sum(list_transform(list_zip(e.v, q.v), lambda z: power(acosh(1 + power(z[1] - z[2], 2) / 2 / 2), 2)))) / 10) as f from e, q)
        select vec_id, round(w * f + (1 - w) * c, 5) as score from (select *, least(1.0, greatest(0.15, access / 10 * 1.2)) as w from s)""",
)
def graduated(spark, d):
    """Cosine, moved to 0 to 1, mixed with a Fisher similarity that gains weight with use."""
    q = vectors(spark, d).where("vec_id = 0").first()["v"]
    own = F.array(*[F.lit(float(x)) for x in q])
    e = vectors(spark, d)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.15), (F.col("vec_id") % 20) / 10 * 1.2))
    fisher = F.exp(-S.fisher_distance(F.col("v"), own, F.lit(1.0), F.lit(1.0)) / 10)
    return e.select("vec_id", F.round(weight * fisher + (1 - weight) * (1 + S.cosine(F.col("v"), own)) / 2, 5).alias("score"))


def _activation_sql(hops: int) -> str:
    steps = ["b as (select src, dst from edges union select dst, src from edges)", "a0 as (select 1::bigint as node, 1.0::double as a)"]
    for i in range(hops):
        steps.append(f"a{i + 1} as materialized (select node, max(a) as a from (select node, a from a{i} union all select dst, a * 0.7 from a{i} join b on src = node where a * 0.7 >= 0.05) group by 1)")
    return f"with {EDGES_SQL}, " + ", ".join(steps) + f" select node, round(a / (select max(a) from a{hops}), 6) as activation from a{hops}"


@query("q121_entity_activation", _activation_sql(4))
def activation(spark, d):
    """The best of 0.7 to the number of hops; hops are at most four, so reach gives it."""
    found = G.reached(edges(spark, d), spark.createDataFrame([(1,)], "node long"), 4, tasks=edge_tasks(spark, d))
    return found.select("node", F.round(F.pow(F.lit(0.7), F.col("hops")), 6).alias("activation"))


@query("q122_signal_enhancer", "select e.event_id, round(value * (1 + 0.3 * coalesce(k.s, 0)), 6) as score from events e left join (select o_orderkey as event_id, (o_orderkey % 10) / 10 as s from orders where o_orderkey % 3 = 0) k on k.event_id = e.event_id")
def enhancer(spark, d):
    k = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_id"), ((F.col("o_orderkey") % 10) / 10).alias("s"))
    return table(spark, d, "events").join(k, "event_id", "left").select("event_id", F.round(F.col("value") * (1 + 0.3 * F.coalesce("s", F.lit(0.0))), 6).alias("score"))


@query("q123_query_entities", "select item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))), ',') as entities from benchmark")
def query_entities(spark, d):
    names = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)))
    return table(spark, d, "benchmark").select("item_id", F.array_join(names, ",").alias("entities"))


@query(
    "q127_pattern_completion",
    f"""with {_V}, q as (select v from e where vec_id = 1), s as (select vec_id, list_sum(list_transform(list_zip(e.v, q.v), lambda z: z[1] * z[2])) / 8 as s from e, q), w as (select vec_id, exp(s - max(s) over ()) as x from s)
        select vec_id, round(x / sum(x) over (), 8) as attention from w order by attention desc, vec_id limit 20""",
)
def completion(spark, d):
    """Softmax attention of a probe over all stored patterns with inverse temperature 1 / sqrt(dimensions)."""
    probe = F.array(*[F.lit(float(x)) for x in vectors(spark, d).where("vec_id = 1").first()["v"]])
    s = vectors(spark, d).select("vec_id", (S.dot(F.col("v"), probe) / 8).alias("s"))
    top = s.agg(F.max("s")).first()[0]
    x = s.withColumn("x", F.exp(F.col("s") - F.lit(top)))
    total = x.agg(F.sum("x")).first()[0]
    return x.select("vec_id", F.round(F.col("x") / F.lit(total), 8).alias("attention")).orderBy(F.desc("attention"), "vec_id").limit(20)


@query("q128_profile_channel", f"with {FACTS_SQL} select fact_id, 0.95::double as score from facts where profile_id = 'src7' order by fact_id limit 50")
def profile_channel(spark, d):
    return facts(spark, d).where("profile_id = 'src7'").orderBy("fact_id").limit(50).select("fact_id", F.lit(0.95).alias("score"))


@query(
    "q131_unenriched_rank",
    f"with {FACTS_SQL}, m as (select count(*) as n, median(importance) as med from facts where fact_id in (select vec_id from embeddings)) select fact_id, n // 2 as rank, round(med, 6) as score from facts, m where fact_id not in (select vec_id from embeddings) and created_at > timestamp '2024-01-05'",
)
def unenriched(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"))
    f = facts(spark, d)
    n, med = f.join(v, "fact_id", "left_semi").agg(F.count(F.lit(1)), F.median("importance")).first()
    new = f.where("created_at > timestamp '2024-01-05'").join(v, "fact_id", "left_anti")
    return new.select("fact_id", F.lit(n // 2).cast("long").alias("rank"), F.round(F.lit(med), 6).alias("score"))


@query("q137_weighted_channels", "select user_id, round(sum(value * case event_type when 'view' then 1.2 when 'click' then 1.0 when 'purchase' then 2.0 else 0.5 end), 3) as score from events group by 1")
def weighted_channels(spark, d):
    weights = F.create_map(*[F.lit(x) for pair in {"view": 1.2, "click": 1.0, "purchase": 2.0}.items() for x in pair])
    w = F.coalesce(F.try_element_at(weights, F.col("event_type")), F.lit(0.5))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.col("value") * w), 3).alias("score"))


@query("q142_exact_first", "select event_id, row_number() over (order by case when event_type = 'purchase' then 0 else 1 end, value desc, event_id) as position from events qualify position <= 100")
def exact_first(spark, d):
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.desc("value"), F.col("event_id")]
    top = table(spark, d, "events").orderBy(*order).limit(100)
    return top.select("event_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))


@query("q144_features", f"with {FACTS_SQL} select fact_id, (fact_type = 'en')::int as is_en, round(ln(1 + access_count), 6) as use, round((epoch(timestamp '{AS_OF}') - epoch(created_at)) / 86400, 4) as age, round(confidence, 6) as trust, least(n_chars, 10000) as size from facts")
def features(spark, d):
    age = (F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    return facts(spark, d).select("fact_id", (F.col("fact_type") == "en").cast("int").alias("is_en"), F.round(F.log1p("access_count"), 6).alias("use"), F.round(age, 4).alias("age"), F.round("confidence", 6).alias("trust"), F.least("n_chars", F.lit(10000)).alias("size"))


@query(
    "q146_bandit_posteriors",
    "select event_type || '/' || case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 16 then 'afternoon' when hour(ts) between 17 and 20 then 'evening' else 'night' end as stratum, user_id % 8 as arm, least(1000, 1 + count(*) filter (where value >= 50)) as alpha, least(1000, 1 + count(*) filter (where value < 50)) as beta from events group by 1, 2",
)
def bandit(spark, d):
    h = F.hour("ts")
    part = F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")
    cap = lambda c: F.least(F.lit(1000).cast("long"), 1 + F.count_if(c))
    e = table(spark, d, "events").groupBy(F.concat_ws("/", "event_type", part).alias("stratum"), (F.col("user_id") % 8).alias("arm"))
    return e.agg(cap(F.col("value") >= 50).alias("alpha"), cap(F.col("value") < 50).alias("beta"))


@query(
    "q156_entity_communities",
    """with recursive p as (select a.l_suppkey as x, b.l_suppkey as y, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(*) >= 2),
       b as (select x, y from p union select y, x from p), w as (select distinct x as node, x as r from b union select w.node, b.y from w join b on b.x = w.r) select node, min(r) as community from w group by 1""",
)
def communities(spark, d):
    one = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    a, b = one.withColumnRenamed("l_suppkey", "src"), one.withColumnRenamed("l_suppkey", "dst")
    e = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where("weight >= 2")
    return G.components(e).withColumnRenamed("component", "community")


@query("q156_modular_communities")
def modular_communities(spark, d):
    """Communities of largest modularity of suppliers that share orders, at least three to a community; see q155 for its SQL."""
    from palimpsest.operators.communities import leiden

    one = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    a, b = one.withColumnRenamed("l_suppkey", "src"), one.withColumnRenamed("l_suppkey", "dst")
    e = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    found = leiden(e, refine=False, max_levels=4, max_rounds=6)
    return found.join(found.groupBy("community").count().where("count >= 3").select("community"), "community").select("node", "community")


@query("q165_change_risk", f"with {EDGES_SQL}, s as (select src, count(*) as fan, sum(weight) as load, max(weight) as peak from edges group by 1) select src, round(0.4 * least(1, fan / 500) + 0.3 * least(1, load / 800) + 0.2 * least(1, peak / 5) + 0.1 * (src % 2), 6) as risk from s")
def change_risk(spark, d):
    s = edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("fan"), F.sum("weight").alias("load"), F.max("weight").alias("peak"))
    part = lambda c, n: F.least(F.lit(1.0), F.col(c) / n)
    return s.select("src", F.round(0.4 * part("fan", 500) + 0.3 * part("load", 800) + 0.2 * part("peak", 5) + 0.1 * (F.col("src") % 2), 6).alias("risk"))


@query("q167_code_search_fusion", f"with {_CHANNEL_SQL} select query_id, fact_id, round(sum(1.0 / (60 + rank)), 6) as score from r group by 1, 2")
def code_search(spark, d):
    """The other rank fusion: k is 60 and a channel that lacks an item adds nothing."""
    return channel_ranks(spark, d).groupBy("query_id", "fact_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"))


@query(
    "q175_quantised_distance",
    f"with {_V}, p as (select a.vec_id, list_zip(a.v, b.v) as z, case a.vec_id % 3 when 0 then 1.0 when 1 then 1.5 else 4.0 end as s from e a join e b on b.vec_id = a.vec_id + 1) select vec_id, round(sqrt(2 * list_sum(list_transform(z, lambda x: power(acosh(1 + (power(x[1] - x[2], 2) / 2) / (2 * s)), 2)))), 5) as distance from p",
)
def quantised_distance(spark, d):
    """Fisher distance with variances raised for vectors kept in fewer bits."""
    e = vectors(spark, d)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    s = F.when(F.col("vec_id") % 3 == 0, 1.0).when(F.col("vec_id") % 3 == 1, 1.5).otherwise(4.0)
    return e.join(n, "vec_id").select("vec_id", F.round(S.fisher_distance(F.col("v"), F.col("u"), s, s), 5).alias("distance"))


@query(
    "q177_contradiction_norm",
    f"with {_V} select a.vec_id as a, b.vec_id as b, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: power(z[1] - z[2], 2)))), 6) as norm from e a join e b on b.vec_id = a.vec_id + 7 where sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: power(z[1] - z[2], 2)))) > 0.45",
)
def contradiction(spark, d):
    a, b = vectors(spark, d), vectors(spark, d).select((F.col("vec_id") - 7).alias("vec_id"), F.col("vec_id").alias("b"), F.col("v").alias("u"))
    gap = F.transform(F.arrays_zip("v", "u"), lambda z: z["v"] - z["u"])
    p = a.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.sqrt(S.dot(gap, gap)).alias("norm"))
    return p.where("norm > 0.45").withColumn("norm", F.round("norm", 6))


@query("q190_signals", "select conv_id, turn, case when regexp_matches(t, '\\b(no|not|wrong)\\b') then 'correction' when regexp_matches(t, '\\b(always|never)\\b') then 'rule' when contains(t, 'the') then 'statement' else 'other' end as signal from (select conv_id, turn, lower(text) as t from conversations)")
def signals(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("t"))
    kind = F.when(F.col("t").rlike(T.bounded("no|not|wrong")), "correction").when(F.col("t").rlike(T.bounded("always|never")), "rule").when(F.col("t").contains("the"), "statement")
    return t.select("conv_id", "turn", kind.otherwise("other").alias("signal"))


@query("q191_emotion", "select conv_id, turn, len(regexp_extract_all(text, '!')) as arousal, len(regexp_extract_all(lower(text), '\\b(good|great|love)\\b')) - len(regexp_extract_all(lower(text), '\\b(bad|hate|no)\\b')) as valence from conversations")
def emotion(spark, d):
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    low = F.lower("text")
    return table(spark, d, "conversations").select("conv_id", "turn", n("text", "!").alias("arousal"), (n(low, T.bounded("good|great|love")) - n(low, T.bounded("bad|hate|no"))).alias("valence"))


@query(
    "q193_name_matches",
    "select a.p_partkey as a, b.p_partkey as b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) as similarity from part a join part b on substr(a.p_name, 1, 4) = substr(b.p_name, 1, 4) and a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey where jaro_winkler_similarity(a.p_name, b.p_name) >= 0.85",
)
def name_matches(spark, d):
    """Names over the threshold among pairs of one block: first letters, brand and size."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.substring("p_name", 1, 4).alias("k"))
    # Two names are compared once, however many parts have them.
    names = p.select("k", "p_brand", "p_size", "p_name").distinct()
    met = names.join(names.withColumnRenamed("p_name", "other"), ["k", "p_brand", "p_size"]).select("p_brand", "p_size", "p_name", "other")
    alike = met.select("p_name", "other").distinct().withColumn("s", S.jaro_winkler("p_name", "other")).where("s >= 0.85")
    alike = met.join(alike, ["p_name", "other"])
    q = p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("other"), "p_brand", "p_size")
    pairs = p.join(alike, ["p_brand", "p_size", "p_name"]).join(q, ["p_brand", "p_size", "other"]).where("p_partkey < b")
    return pairs.select(F.col("p_partkey").alias("a"), "b", F.round("s", 6).alias("similarity"))


@query("q194_entity_types", "select c_custkey, case when c_name like '%Inc%' then 'organisation' when regexp_matches(c_name, '[0-9]{4}') then 'record' else 'person' end as kind from customer")
def entity_types(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_name").contains("Inc"), "organisation").when(F.col("c_name").rlike("[0-9]{4}"), "record").otherwise("person").alias("kind"))


@query(
    "q197_update_decision",
    f"with {_V}, p as (select a.vec_id, 0.4 * (a.label = b.label)::int + 0.6 * list_cosine_similarity(a.v, b.v) as s from e a join e b on b.vec_id = a.vec_id + 1) select vec_id, case when round(s, 6) > 0.95 then 'noop' when round(s, 6) > 0.4 then case when vec_id % 5 = 0 then 'supersede' else 'update' end else 'add' end as decision from p",
)
def decision(spark, d):
    e = vectors(spark, d)
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l"), F.col("v").alias("u"))
    s = F.round(0.4 * (F.col("label") == F.col("l")).cast("int") + 0.6 * S.cosine(F.col("v"), F.col("u")), 6)
    p = e.join(n, "vec_id").select("vec_id", s.alias("s"))
    change = F.when(F.col("vec_id") % 5 == 0, "supersede").otherwise("update")
    return p.select("vec_id", F.when(F.col("s") > 0.95, "noop").when(F.col("s") > 0.4, change).otherwise("add").alias("decision"))


@query("q205_expanded_keys", "select n_nationkey, n_name || '|' || r_name || '|' || lower(n_name) as keys from nation join region on n_regionkey = r_regionkey")
def expanded_keys(spark, d):
    r = table(spark, d, "region")
    return table(spark, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("|", "n_name", "r_name", F.lower("n_name")).alias("keys"))


@query("q208_compression", "select page_id, length(html) as before, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as after from pages")
def compression(spark, d):
    text = T.tidy(F.regexp_replace("html", "<[^>]*>", " "), 2**31 - 1)
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("before"), F.length(text).cast("long").alias("after"))


@query("q217_play_settlement", "select a.event_id, count(b.event_id) as evidence from events a left join events b on a.user_id = b.user_id and b.event_type = 'purchase' and abs(epoch(b.ts) - epoch(a.ts)) <= 3600 where a.event_type = 'click' group by 1")
def settlement(spark, d):
    """Evidence within an hour; an hour bucket joins equal and next hours, so a hot user is split by time."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", seconds.alias("t"), F.floor(seconds / 3600).alias("h"))
    b = e.where("event_type = 'purchase'").select("user_id", F.explode(F.array(F.col("h") - 1, F.col("h"), F.col("h") + 1)).alias("h"), F.col("event_id").alias("b"), F.col("t").alias("u"))
    a = e.where("event_type = 'click'")
    found = a.join(b, ["user_id", "h"]).where("abs(u - t) <= 3600").groupBy("event_id").agg(F.count("b").alias("evidence"))
    return a.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"))


@query("q218_clamped_signals", "select event_id, least(ts, timestamp '2024-01-20') as at, least(value, 80) as dwell from events where value >= 1")
def clamped(spark, d):
    e = table(spark, d, "events").where("value >= 1")
    return e.select("event_id", F.least("ts", F.lit("2024-01-20").cast("timestamp_ntz")).alias("at"), F.least("value", F.lit(80.0)).alias("dwell"))


@query("q220_recall_queue", "select user_id % 10 as lane, arg_max(event_type, (ts, event_id)) as state, count(distinct event_type) as kinds, count(*) as attempts from events group by 1")
def recall_queue(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("lane")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.countDistinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("attempts"))


@query("q224_live_cache", "select event_id % 200 as key, max(ts) as fresh from events where ts >= timestamp '2024-01-25' group by 1")
def live_cache(spark, d):
    return table(spark, d, "events").where("ts >= timestamp '2024-01-25'").groupBy((F.col("event_id") % 200).alias("key")).agg(F.max("ts").alias("fresh"))


@query(
    "q226_rate_limit",
    "select user_id, date_trunc('day', ts) as day, least(count(*), 3) as admitted, greatest(count(*) - 3, 0) as refused from events group by 1, 2",
)
def rate_limit(spark, d):
    n = F.count(F.lit(1))
    g = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    return g.agg(F.least(n, F.lit(3).cast("long")).alias("admitted"), F.greatest(n - 3, F.lit(0).cast("long")).alias("refused"))


@query(
    "q235_entity_clusters",
    f"with {FACTS_SQL}, r as (select n_chars % 200 as entity, fact_id, row_number() over (partition by n_chars % 200 order by confidence desc, created_at desc, fact_id) as rn from facts where importance < 0.8), c as (select entity, list(fact_id order by fact_id) as members from r where rn <= 10 group by 1 having count(*) >= 3) select entity, len(members) as n, array_to_string(members, ',') as members from c",
)
def entity_clusters(spark, d):
    """Of each entity with at least three facts its ten of highest confidence, then newest."""
    f = facts(spark, d).where("importance < 0.8").select((F.col("n_chars") % 200).alias("entity"), "fact_id", "confidence", "created_at")
    w = Window.partitionBy("entity").orderBy(F.desc("confidence"), F.desc("created_at"), "fact_id")
    c = f.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("entity").agg(F.array_sort(F.collect_list("fact_id")).alias("m"))
    c = c.where(F.size("m") >= 3)
    return c.select("entity", F.size("m").cast("long").alias("n"), F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


@query(
    "q236_entity_compilation",
    f"with {FACTS_SQL}, s as (select profile_id, fact_id, row_number() over (partition by profile_id order by importance desc, fact_id) as rn from facts) select profile_id, string_agg(cast(fact_id as varchar), ' ' order by rn) as top from s where rn <= 3 group by 1",
)
def entity_compilation(spark, d):
    w = Window.partitionBy("profile_id").orderBy(F.desc("importance"), "fact_id")
    s = facts(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return s.groupBy("profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "fact_id"))), lambda x: x["fact_id"].cast("string")), " ").alias("top"))


@query("q237_observation_profiles", f"with {FACTS_SQL} select fact_type, count(*) as n, min(fact_id) as first, max(fact_id) as last from facts group by 1")
def observation_profiles(spark, d):
    return facts(spark, d).groupBy("fact_type").agg(F.count(F.lit(1)).alias("n"), F.min("fact_id").alias("first"), F.max("fact_id").alias("last"))


@query(
    "q238_scene_assignment",
    f"with {_V}, c as (select label, i, avg(x) as m from (select label, unnest(v) as x, unnest(range(0, 64)) as i from e) group by 1, 2), k as (select label, list(m order by i) as m from c group by 1), s as (select vec_id, k.label, list_cosine_similarity(v, m) as s from e, k) select vec_id, arg_max(label, (round(s, 6), -label)) as scene, round(max(s), 4) >= 0.6 as joined from s group by 1",
)
def scenes(spark, d):
    """Each vector's nearest scene centre; the centres are one row a label, broadcast after their number is checked."""
    e = vectors(spark, d)
    c = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    k = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).orderBy("label")
    centres = k.limit(10_001).collect()
    if len(centres) > 10_000:
        raise ValueError("too many scenes to compare with every vector at once")
    options = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.array(*[F.lit(float(x)) for x in r["m"]]).alias("m")) for r in centres])
    best = F.array_max(F.transform(options, lambda o: F.struct(F.round(S.cosine(F.col("v"), o["m"]), 6).alias("s"), (-o["label"]).alias("n"))))
    return e.select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.n")).alias("scene"), (F.round("b.s", 4) >= 0.6).alias("joined"))


@query("q239_persona_tiers", f"with {FACTS_SQL} select fact_id, profile_id from (select *, row_number() over (partition by profile_id order by confidence desc, fact_id) as rn from facts) where rn <= 5")
def persona(spark, d):
    w = Window.partitionBy("profile_id").orderBy(F.desc("confidence"), "fact_id")
    return facts(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("fact_id", "profile_id")
