"""Joins over events, facts, edges and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.plans.registry import query
from palimpsest.sources.tables import AS_OF, EDGES_SQL, EVENTS_SQL, FACTS_SQL, edge_tasks, edges, facts, table, tool_events


#: Users of a list, and lists that are broadcast at most (16 MB).
PEERS, BROADCAST_LISTS = 4096, 512
#: Messages of a list, and users of a list that come in turn for each of them.
MESSAGES, REPEATED = 1024, 256


@query(
    "q042_events_entities_facts",
    f"with {FACTS_SQL}, {EVENTS_SQL} select event_id, n_name, fact_id from tool_events join nation on lower(n_name) = lower('NATION_' || (user_id % 25)) or n_nationkey = user_id % 25 join facts on fact_id = event_id",
)
def events_entities_facts(spark, d):
    e = tool_events(spark, d).withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    found = e.join(table(spark, d, "nation"), "n_nationkey").join(facts(spark, d).select("fact_id"), F.col("event_id") == F.col("fact_id"))
    return found.select("event_id", "n_name", "fact_id")


@query(
    "q043_facts_with_retention",
    f"""with {FACTS_SQL}, {EVENTS_SQL}, last as (select event_id % 700 as fact_id, max(created_at) as seen from tool_events group by 1)
        select fact_id, coalesce(seen, created_at) as last_seen from facts left join last using (fact_id)""",
)
def facts_with_retention(spark, d):
    last = tool_events(spark, d).groupBy((F.col("event_id") % 700).alias("fact_id")).agg(F.max("created_at").alias("seen"))
    return facts(spark, d).join(last, "fact_id", "left").select("fact_id", F.coalesce("seen", "created_at").alias("last_seen"))


@query(
    "q044_contradiction_pairs",
    f"""with {EDGES_SQL} select src, dst, s_name, p_name from edges left join supplier on s_suppkey = src left join part on p_partkey = -dst where edge_type = 'supersedes'""",
)
def contradiction_pairs(spark, d):
    e = edges(spark, d).where("edge_type = 'supersedes'")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), "s_name")
    p = table(spark, d, "part").select((-F.col("p_partkey")).alias("dst"), "p_name")
    return e.join(s, "src", "left").join(p, "dst", "left").select("src", "dst", "s_name", "p_name")


@query(
    "q045_entities_in_many_sessions",
    f"with {EVENTS_SQL} select k, count(distinct session_id) as sessions from tool_events where k in (select n_nationkey from nation) group by k having count(distinct session_id) >= 5",
)
def entities_in_sessions(spark, d):
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    e = tool_events(spark, d).join(known, "k", "left_semi")
    return e.groupBy("k").agg(F.countDistinct("session_id").alias("sessions")).where("sessions >= 5")


@query(
    "q046_supersede_chains",
    "with e as (select n_nationkey as src, (n_nationkey * 3 + 1) % 25 as dst from nation) select a.src, a.dst as mid, b.dst from e a join e b on a.dst = b.src",
)
def supersede_chains(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("dst"))
    b = e.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return e.withColumnRenamed("dst", "mid").join(b, "mid").select("src", "mid", F.col("end").alias("dst"))


@query(
    "q047_not_in_consolidated",
    f"with {FACTS_SQL} select fact_id from facts where fact_id not in (select unnest([conv_id, conv_id * 2, conv_id * 3]) from conversations)",
)
def not_consolidated(spark, d):
    ids = F.array(F.col("conv_id"), F.col("conv_id") * 2, F.col("conv_id") * 3)
    used = table(spark, d, "conversations").select(F.explode(ids).alias("fact_id"))
    return facts(spark, d).join(used, "fact_id", "left_anti").select("fact_id")


@query(
    "q048_orphan_edges",
    f"""with {EDGES_SQL}, nodes as (select s_suppkey as id from supplier where s_suppkey % 9 <> 0 union select -p_partkey from part where p_partkey % 11 <> 0)
        select src, dst from edges where src not in (select id from nodes) or dst not in (select id from nodes)""",
)
def orphan_edges(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("id"))
    nodes = s.union(table(spark, d, "part").where("p_partkey % 11 <> 0").select(-F.col("p_partkey")))
    e = edges(spark, d).select("src", "dst")
    bad_src = e.join(nodes.withColumnRenamed("id", "src"), "src", "left_anti")
    bad_dst = e.join(nodes.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    return bad_src.union(bad_dst).distinct()


@query(
    "q049_unnested_outcomes",
    f"with {EVENTS_SQL} select event_id, unnest([user_id, user_id + 1, k]) as fact_id from tool_events where tool_name = 'purchase'",
)
def unnested(spark, d):
    ids = F.from_json(F.to_json(F.array("user_id", F.col("user_id") + 1, "k")), "array<bigint>")
    return tool_events(spark, d).where("tool_name = 'purchase'").select("event_id", F.explode(ids).alias("fact_id"))


@query(
    "q050_interval_join",
    """select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b
       on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) <= 168 * 3600""",
)
def interval_join(spark, d):
    """Pairs of one customer within 168 hours; a week bucket joins equal and next weeks, so a hot key is split."""
    week, seconds = 168 * 3600, F.unix_timestamp("o_orderdate")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", seconds.alias("t"), F.floor(seconds / week).alias("w"))
    near = o.withColumn("w", F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)))
    near = near.select("o_custkey", "w", F.col("o_orderkey").alias("b"), F.col("t").alias("u"))
    pairs = o.join(near, ["o_custkey", "w"]).where((F.col("o_orderkey") < F.col("b")) & (F.abs(F.col("t") - F.col("u")) <= week))
    return pairs.select(F.col("o_orderkey").alias("a"), "b")


@query(
    "q051_entity_overlap",
    """with d as (select distinct l_orderkey, l_suppkey from lineitem)
       select a.l_orderkey as a, b.l_orderkey as b, count(*) as shared from d a join d b on a.l_suppkey = b.l_suppkey and a.l_orderkey < b.l_orderkey
       group by 1, 2 having count(*) >= 2""",
)
def entity_overlap(spark, d):
    """Orders with two suppliers in common: those that meet under a pair of suppliers; k common ones are k (k - 1) / 2 pairs."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("own"))  # an order's few suppliers
    later = F.transform("own", lambda p, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda q: F.struct(p.alias("p"), q.alias("q"))))
    pairs = x.select("l_orderkey", F.explode(F.flatten(later)).alias("pair"))
    both = pairs.withColumnRenamed("l_orderkey", "a").join(pairs.withColumnRenamed("l_orderkey", "b"), "pair").where("a < b")
    met = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"))
    return met.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("m"))) / 2).cast("long").alias("shared"))


@query(
    "q053_state_as_of",
    "select user_id, arg_max(event_type, (ts, event_id)) as state, max(ts) as at from events where ts <= timestamp '2024-01-15' group by user_id",
)
def state_as_of(spark, d):
    e = table(spark, d, "events").where("ts <= timestamp '2024-01-15'")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


@query(
    "q054_look_ahead",
    f"""with {EVENTS_SQL} select event_id, count(*) over w as following, coalesce(sum(value) over w, 0) > 100 as evidence
        from tool_events window w as (partition by user_id order by epoch(created_at) range between 1 following and 86400 following)""",
)
def look_ahead(spark, d):
    e = tool_events(spark, d).withColumn("t", F.col("created_at").cast("timestamp").cast("double"))  # with its fraction, as epoch() gives it
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(1, 86400)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("following"), (F.coalesce(F.sum("value").over(w), F.lit(0.0)) > 100).alias("evidence"))


@query(
    "q055_graph_expansion",
    f"""with {EDGES_SQL}, both_ways as (select src as node, dst as other, weight from edges union all select dst, src, weight from edges),
        r as (select *, row_number() over (partition by node order by weight desc, other) as rn from both_ways) select node, other, weight from r where rn <= 5""",
)
def graph_expansion(spark, d):
    from palimpsest.operators.predicates import both_directions

    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    e = both_directions(edges(spark, d)).select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").repartition(edge_tasks(spark, d), "node")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query(
    "q056_alias_resolution",
    "select n_nationkey as id from nation where lower(n_name) like '%a%' union select r_regionkey from region where length(r_name) > 4",
)
def alias_resolution(spark, d):
    a = table(spark, d, "nation").where(F.lower("n_name").contains("a")).select(F.col("n_nationkey").alias("id"))
    return a.union(table(spark, d, "region").where(F.length("r_name") > 4).select("r_regionkey")).distinct()


@query(
    "q057_scene_expansion",
    """with top as (select vec_id, label, vec_id / 100.0 as score from embeddings order by vec_id desc limit 20),
       scenes as (select e.label, e.vec_id from embeddings e where e.vec_id % 7 = 0)
       select s.vec_id as fact_id, round(max(t.score) * 0.8, 6) as score from top t join scenes s on t.label = s.label
       where s.vec_id not in (select vec_id from top) group by s.vec_id""",
)
def scene_expansion(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    top = e.withColumn("score", F.col("vec_id") / 100.0).orderBy(F.desc("vec_id")).limit(20)
    scenes = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("fact_id"), "label")
    found = top.join(scenes, "label").join(top.select(F.col("vec_id").alias("fact_id")), "fact_id", "left_anti")
    return found.groupBy("fact_id").agg(F.round(F.max("score") * 0.8, 6).alias("score"))


@query(
    "q058_read_receipts",
    """with reads as (select distinct user_id, event_id % 100 as msg from events where event_type = 'view')
       select m.c_custkey as msg, u.user_id, case when r.msg is not null then 'read' else 'unread' end as state
       from customer m join (select distinct user_id from events) u on m.c_custkey % 5 = u.user_id % 5 left join reads r on r.msg = m.c_custkey and r.user_id = u.user_id""",
)
def read_receipts(spark, d):
    e = table(spark, d, "events")
    reads = e.where("event_type = 'view'").select("user_id", (F.col("event_id") % 100).alias("msg"), F.lit(True).alias("seen")).distinct()
    inbox = table(spark, d, "customer").select(F.col("c_custkey").alias("msg"), (F.col("c_custkey") % 5).alias("b"))
    peers = e.select("user_id", (F.col("user_id") % 5).alias("b")).distinct()
    # Each message meets all its peers. Both come in lists, so that no pair is shuffled; only messages that someone has read are joined.
    lists = -(-peers.count() // PEERS)
    part = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(max(parts, 1)))
    peers = peers.groupBy("b", part("user_id", lists).alias("part")).agg(F.collect_list("user_id").alias("ids"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = max(-(-inbox.count() // MESSAGES), tasks)

    def paired(rows):
        rows = rows.groupBy("b", part("msg", packs).alias("pack")).agg(F.collect_list("msg").alias("msgs")).repartition(tasks)
        if lists > BROADCAST_LISTS:
            rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)).cast("array<long>"))).join(peers, ["b", "part"])
        else:
            rows = rows.join(F.broadcast(peers), "b")
        # A few users at a time for all messages of a list: what repeats within some hundred rows takes little disk when the result is written.
        few = F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(REPEATED)), lambda i: F.slice("ids", i, F.lit(REPEATED)))
        rows = rows.select("msgs", F.explode(few).alias("ids")).select(F.explode("msgs").alias("msg"), "ids")
        return rows.select("msg", F.explode("ids").alias("user_id"))

    hot = reads.select("msg").distinct()
    opened = paired(inbox.join(hot, "msg", "left_semi")).join(reads, ["msg", "user_id"], "left")
    opened = opened.select("msg", "user_id", F.when(F.col("seen").isNotNull(), "read").otherwise("unread").alias("state"))
    return opened.unionByName(paired(inbox.join(hot, "msg", "left_anti")).withColumn("state", F.lit("unread")))


@query(
    "q089_access_counts_30_days",
    f"""with {EVENTS_SQL} select c_custkey as fact_id, count(event_id) as n from customer left join tool_events on event_id % 300 = c_custkey and created_at >= timestamp '{AS_OF}' - interval 30 days
        group by c_custkey""",
)
def access_counts(spark, d):
    recent = tool_events(spark, d).where(F.col("created_at") >= F.lit(AS_OF).cast("timestamp") - F.expr("interval 30 days"))
    counts = recent.groupBy((F.col("event_id") % 300).alias("fact_id")).agg(F.count(F.lit(1)).alias("n"))
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("fact_id"))
    return ids.join(counts, "fact_id", "left").select("fact_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
