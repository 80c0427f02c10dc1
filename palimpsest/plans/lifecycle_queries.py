"""Retention, tiers, confidence, time-grouped state and governance queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import lifecycle as L
from palimpsest.plans.registry import query
from palimpsest.plans.scans import ZONE_SQL
from palimpsest.sources.tables import EVENTS_SQL, FACTS_SQL, RETENTION_SQL, facts, retention_input, table, tool_events

_S = "least(100, greatest(0.1, 2 * ln(1 + access_count) + 1.5 * importance + confirmation_count + 0.5 * emotional_salience))"
_R = f"least(1, exp(-greatest(hours / 24, 0) * (1 + 2 * (1 - least(trust_score, 1))) / {_S}))"


def _strength():
    return L.strength(F.col("access_count"), F.col("importance"), F.col("confirmation_count"), F.col("emotional_salience"))


def _retention():
    return L.retention(F.col("hours") / 24, _strength(), F.least(F.col("trust_score"), F.lit(1.0)))


@query("q168_retention", f"with {RETENTION_SQL} select fact_id, round({_S}, 6) as strength, round({_R}, 6) as retention from retention_input")
def retention(spark, d):
    return retention_input(spark, d).select("fact_id", F.round(_strength(), 6).alias("strength"), F.round(_retention(), 6).alias("retention"))


@query("q169_zones", f"with {RETENTION_SQL}, r as (select round({_R}, 6) as r from retention_input) select {ZONE_SQL} as zone, count(*) as n from r group by 1")
def zones(spark, d):
    r = retention_input(spark, d).select(F.round(_retention(), 6).alias("r"))
    return r.groupBy(L.zone(F.col("r")).alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("q087_retention_statistics", f"with {RETENTION_SQL}, r as (select fact_id, round({_R}, 6) as r from retention_input) select count(*) as n, round(avg(r), 5) as mean, count(*) filter (where r > 0.8) as active, cast(sum(case when r > 0.8 then 32 when r > 0.5 then 8 when r > 0.2 then 4 when r > 0.05 then 2 else 0 end) as bigint) as bits from r")
def retention_statistics(spark, d):
    r = retention_input(spark, d).select(F.round(_retention(), 6).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 5).alias("mean"), F.count_if(F.col("r") > 0.8).alias("active"), F.sum(L.precision_bits(F.col("r"))).alias("bits"))


@query("q170_spaced_repetition", f"with {RETENTION_SQL} select fact_id, round(least(100, {_S} + 0.5 * ln(1 + greatest(hours, 0) / 24)), 6) as strength from retention_input")
def repetition(spark, d):
    return retention_input(spark, d).select("fact_id", F.round(L.repetition(_strength(), F.col("hours")), 6).alias("strength"))


@query(
    "q171_decay_cycle",
    f"""with {RETENTION_SQL}, r as (select round({_R}, 6) as a, round(exp(ln({_R}) * 1.5), 6) as b from retention_input), z as (select (select {ZONE_SQL.replace('r >', 'a >')}) as before, (select {ZONE_SQL.replace('r >', 'b >')}) as after from r) select before, after, count(*) as n from z group by 1, 2""",
)
def decay_cycle(spark, d):
    r = retention_input(spark, d).select(F.round(_retention(), 6).alias("a"), F.round(F.exp(F.log(_retention()) * 1.5), 6).alias("b"))
    return r.groupBy(L.zone(F.col("a")).alias("before"), L.zone(F.col("b")).alias("after")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q172_tiers",
    f"""with {RETENTION_SQL}, t as (select fact_id, hours as days, greatest(case when access_count >= 5 then 2 else 1 end, case when importance >= 0.8 then 3 else 1 end) as f from retention_input where fact_id % 50 <> 0)
        select case when days < 30 * f then 'active' when days < 180 * f then 'warm' when days < 365 * f then 'cold' else 'archived' end as tier, count(*) as n from t group by 1""",
)
def tiers(spark, d):
    r = retention_input(spark, d)
    pinned = r.where("fact_id % 50 = 0").select("fact_id")
    free = r.join(pinned, "fact_id", "left_anti")
    return free.groupBy(L.tier(F.col("hours"), F.col("access_count"), F.col("importance")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q173_compliance_states",
    f"with {RETENTION_SQL} select fact_id, case when access_count > 10 or hours / 6 < 7 then 'active' when hours / 6 < 30 then 'warm' when hours / 6 < 90 then 'cold' else 'archived' end as state from retention_input",
)
def compliance(spark, d):
    return retention_input(spark, d).select("fact_id", L.compliance_state(F.col("hours") / 6, F.col("access_count")).alias("state"))


@query(
    "q174_fisher_similarity",
    """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings), p as (select a.vec_id, list_zip(a.v, b.v) as z from e a join e b on b.vec_id = a.vec_id + 1)
       select vec_id, round(exp(-sqrt(list_sum(list_transform(z, lambda x: power(acosh(1 + power(x[1] - x[2], 2) / 0.5), 2))))  / 10), 5) as similarity from p""",
)
def fisher(spark, d):
    """exp(-distance / 10) of neighbouring vectors, the distance summing the hyperbolic one of each dimension at variance 1/4."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    squares = F.zip_with("v", "u", lambda a, b: F.pow(F.acosh(1 + (a - b) * (a - b) / 0.5), F.lit(2.0)))
    total = F.aggregate(squares, F.lit(0.0), lambda x, y: x + y)
    return e.join(n, "vec_id").select("vec_id", F.round(F.exp(-F.sqrt(total) / 10), 5).alias("similarity"))


@query("q179_precision_bits", f"with {RETENTION_SQL}, r as (select fact_id, round({_R}, 6) as r from retention_input) select fact_id, cast(case when r > 0.8 then 32 when r > 0.5 then 8 when r > 0.2 then 4 when r > 0.05 then 2 else 0 end as int) as bits from r")
def precision(spark, d):
    return retention_input(spark, d).select("fact_id", L.precision_bits(F.round(_retention(), 6)).alias("bits"))


@query("q181_reward_labels", "select event_id, round(greatest(0, least(1, 0.5 + 0.4 * (event_id % 2) + 0.25 * (event_id % 3 = 0)::int + value / 1000 - 0.5 * (event_id % 7 = 0)::int)), 6) as reward from events")
def reward_labels(spark, d):
    i = F.col("event_id")
    raw = 0.5 + 0.4 * (i % 2) + 0.25 * (i % 3 == 0).cast("int") + F.col("value") / 1000 - 0.5 * (i % 7 == 0).cast("int")
    return table(spark, d, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6).alias("reward"))


@query("q182_confidence_drift", f"with {RETENTION_SQL}, c as (select r.fact_id, r.access_count % 4 as a, hours / 24 as days, confidence from retention_input r join facts f on r.fact_id = f.fact_id) select fact_id, round(case when a > 0 then least(1, confidence + 0.02 * a) when days > 7 then greatest(0.1, confidence - 0.001) else confidence end, 6) as confidence from c")
def drift(spark, d):
    c = facts(spark, d).select("fact_id", "confidence").join(retention_input(spark, d), "fact_id")
    return c.select("fact_id", F.round(L.drifted(F.col("confidence"), F.col("access_count") % 4, F.col("hours") / 24), 6).alias("confidence"))


@query(
    "q183_cross_project_merge",
    f"""with {FACTS_SQL}, w as (select n_chars % 50 as key, fact_type as value, sum(exp(-(epoch(timestamp '2024-02-01') - epoch(created_at)) / 86400 / 365)) as w, count(*) as n from facts group by 1, 2),
        t as (select key, arg_max(value, (round(w, 6), value)) as winner, max(w) / sum(w) as share, sum(n) as n from w group by 1) select key, winner, round(least(0.95, share), 6) as confidence from t where share >= 0.3 and n >= 2""",
)
def cross_project(spark, d):
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("created_at")) / 86400
    w = facts(spark, d).groupBy((F.col("n_chars") % 50).alias("key"), F.col("fact_type").alias("value")).agg(F.sum(F.exp(-age / 365)).alias("w"), F.count(F.lit(1)).alias("n"))
    t = w.groupBy("key").agg(F.max_by("value", F.struct(F.round("w", 6), "value")).alias("winner"), (F.max("w") / F.sum("w")).alias("share"), F.sum("n").alias("n"))
    return t.where("share >= 0.3 and n >= 2").select("key", "winner", F.round(F.least(F.lit(0.95), "share"), 6).alias("confidence"))


@query(
    "q221_sessions",
    f"""with {EVENTS_SQL}, g as (select user_id, created_at, value, case when created_at - lag(created_at) over (partition by user_id order by created_at) >= interval 24 hours then 1 else 0 end as cut from tool_events),
        s as (select *, sum(cut) over (partition by user_id order by created_at) as s from g) select user_id, min(created_at) as started, count(*) as n, round(sum(value), 4) as total from s group by user_id, s""",
)
def sessions(spark, d):
    w = F.session_window("created_at", "24 hours")
    s = tool_events(spark, d).groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.col("session_window.start").alias("started"), "n", "total")


@query("q222_tumbling", "select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2")
def tumbling(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n")


@query("q223_sliding", "with e as (select date_trunc('day', ts) as day, unnest(range(0, 7)) as back from events) select day - to_days(cast(back as int)) as start, count(*) as n from e group by 1")
def sliding(spark, d):
    g = table(spark, d, "events").groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


@query("q216_pending_outcomes", "select user_id, max(ts) as last_signal, count(*) as signals, max(ts) < timestamp '2024-01-31' as final from events group by 1")
def pending(spark, d):
    """What the stateful operator settles on when every signal has come: one row an outcome, final after its grace."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_signal"), F.count(F.lit(1)).alias("signals"))
    return g.withColumn("final", F.col("last_signal") < F.lit("2024-01-31").cast("timestamp"))


@query("q227_last_writer_wins", "select event_id % 300 as key, arg_max(value, (ts, event_id)) as value from events group by 1")
def last_writer(spark, d):
    return table(spark, d, "events").groupBy((F.col("event_id") % 300).alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("q228_lock_holders", "select event_id % 20 as lock, arg_max(user_id, (event_id // 20 % 7, user_id)) as holder from events where ts >= timestamp '2024-01-20' group by 1")
def locks(spark, d):
    live = table(spark, d, "events").where("ts >= timestamp '2024-01-20'")
    token = F.floor(F.col("event_id") / 20) % 7
    return live.groupBy((F.col("event_id") % 20).alias("lock")).agg(F.max_by("user_id", F.struct(token, "user_id")).alias("holder"))


@query("q229_message_queue", "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id) as rn from events where ts > (select max(ts) from events) - interval 48 hours) where rn <= 50")
def message_queue(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts")).first()[0]
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    live = e.where(F.col("ts") > F.lit(last) - F.expr("interval 48 hours")).withColumn("rn", F.row_number().over(w))
    return live.where("rn <= 50").select("event_id")


_STORED = "select page_id, sha256(case when page_id % 3 = 0 then html || '<!-- old -->' else html end) as h from pages where page_id % 7 <> 0"


@query("q231_changed_files", f"with stored as ({_STORED}) select n.page_id, case when o.h is null then 'new' else 'changed' end as change from pages n left join stored o using (page_id) where o.h is null or o.h <> sha256(n.html)")
def changed(spark, d):
    """Pages whose hash is not the stored one: changed since, or never seen."""
    pages = table(spark, d, "pages")
    then = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<!-- old -->"))).otherwise(F.col("html"))
    stored = pages.where("page_id % 7 <> 0").select("page_id", F.sha2(then, 256).alias("old"))
    now = pages.select("page_id", F.sha2("html", 256).alias("h")).join(stored, "page_id", "left")
    return now.where("old is null or old <> h").select("page_id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("change"))


@query(
    "q225_retention_rules",
    f"""with {RETENTION_SQL}, rules as (select * from (values (1, 100, 'archive'), (2, 300, 'tombstone'), (3, 600, 'notify')) t(rule, max_hours, action)), f as (select fact_id, fact_id % 3 + 1 as rule, hours from retention_input)
        select fact_id, action from f join rules using (rule) where hours > max_hours""",
)
def retention_rules(spark, d):
    rules = spark.createDataFrame([(1, 100, "archive"), (2, 300, "tombstone"), (3, 600, "notify")], "rule long, max_hours long, action string")
    f = retention_input(spark, d).withColumn("rule", F.col("fact_id") % 3 + 1)
    return f.join(rules, "rule").where("hours > max_hours").select("fact_id", "action")


@query("q241_noisy_or", "select user_id, round(1 - product(1 - least(value / 200, 0.999)), 5) as confidence from events group by 1")
def noisy_or(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.round(1 - F.product(1 - F.least(F.col("value") / 200, F.lit(0.999))), 5).alias("confidence"))


@query("q240_session_summaries", f"with {EVENTS_SQL}, c as (select session_id, tool_name, count(*) as n from tool_events group by 1, 2) select session_id, string_agg(tool_name || ':' || n, ',' order by n desc, tool_name) as tools, cast(sum(n) as bigint) as events from c group by 1")
def summaries(spark, d):
    c = tool_events(spark, d).groupBy("session_id", "tool_name").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tool_name", "n")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["tool_name"], r["n"])), ",")
    return c.groupBy("session_id").agg(text.alias("tools"), F.sum("n").alias("events"))


@query(
    "q243_erase_residue",
    f"""with {FACTS_SQL}, owned as (select fact_id from facts where profile_id = 'src3')
        select 'facts' as name, (select count(*) from owned) as owned, count(*) as residue from labels where doc_id in (select fact_id from owned)
        union all select 'events', (select count(*) from events where user_id = 3), count(*) from orders where o_custkey = 3""",
)
def erase(spark, d):
    """How many rows an owner has, and how many rows of the table that refers to them dangle once they are erased."""
    f = facts(spark, d).select("fact_id", "profile_id")
    gone = f.where("profile_id = 'src3'").select("fact_id")
    left = f.join(gone, "fact_id", "left_anti").select("fact_id")
    labels = table(spark, d, "labels").join(f.select("fact_id"), F.col("doc_id") == F.col("fact_id"), "left_semi")
    dangling = labels.join(left, F.col("doc_id") == F.col("fact_id"), "left_anti")
    events = table(spark, d, "events").where("user_id = 3").agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("owned"))
    orders = table(spark, d, "orders").where("o_custkey = 3").agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("residue"))
    one = gone.agg(F.lit("facts").alias("name"), F.count(F.lit(1)).alias("owned")).join(dangling.agg(F.lit("facts").alias("name"), F.count(F.lit(1)).alias("residue")), "name")
    return one.union(events.join(orders, "name"))


@query("q244_access_policies", f"with {FACTS_SQL}, p as (select * from (values ('src3', 'shared'), ('src5', 'global')) t(profile_id, scope)) select fact_id from facts where (profile_id, scope) not in (select profile_id, scope from p)")
def policies(spark, d):
    denied = spark.createDataFrame([("src3", "shared"), ("src5", "global")], "profile_id string, scope string")
    return facts(spark, d).join(denied, ["profile_id", "scope"], "left_anti").select("fact_id")


@query("q245_memory_health", f"with {FACTS_SQL} select count(*) as n, count(*) filter (where coalesce(archive_status, 'live') <> 'archived' and coalesce(quarantined, 0) = 0) as live, count(vec_id) as with_vector from facts left join embeddings on vec_id = fact_id")
def health(spark, d):
    from palimpsest.operators.predicates import visible

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "vec_id")
    return facts(spark, d).join(v, "fact_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(visible()).alias("live"), F.count("vec_id").alias("with_vector"))


@query("q246_reward_gated_archive", f"with {FACTS_SQL} select fact_id from facts where importance < 0.9 and fact_id not in (select event_id % 1000 from events where value > 95)")
def gated(spark, d):
    rewarded = table(spark, d, "events").where("value > 95").select((F.col("event_id") % 1000).alias("fact_id"))
    return facts(spark, d).where("importance < 0.9").join(rewarded, "fact_id", "left_anti").select("fact_id")
