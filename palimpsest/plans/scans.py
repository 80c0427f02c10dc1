"""Scans, predicates and projections over facts, edges and bi-temporal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import predicates as P
from palimpsest.plans.registry import query
from palimpsest.sources.tables import AS_OF, EDGES_SQL, FACTS_SQL, RETENTION_SQL, VALIDITY_SQL, edges, facts, table, validity

VISIBLE_SQL = "coalesce(archive_status, 'live') <> 'archived' and coalesce(quarantined, 0) = 0"
SCOPE_SQL = "(profile_id = 'src3' or scope = 'global' or (scope = 'shared' and list_contains(shared_with, 'src3')))"
VALID_AT = "2023-06-01 00:00:00"


@query("q001_profile_scan", f"with {FACTS_SQL} select fact_id, created_at from facts where profile_id = 'src3' and {VISIBLE_SQL} order by created_at desc, fact_id limit 5000")
def profile_scan(spark, d):
    found = facts(spark, d).where(P.in_scope("src3") & P.visible())
    return found.select("fact_id", "created_at").orderBy(F.desc("created_at"), "fact_id").limit(5000)


@query("q002_external_visible_scan", f"with {FACTS_SQL} select fact_id, profile_id, scope from facts where {SCOPE_SQL} and profile_id <> 'src3' and {VISIBLE_SQL}")
def external_visible(spark, d):
    found = facts(spark, d).where(P.in_scope("src3", True, True) & (F.col("profile_id") != "src3") & P.visible())
    return found.select("fact_id", "profile_id", "scope")


@query("q003_batch_lookup", f"with {FACTS_SQL} select fact_id, profile_id, n_chars from facts where fact_id in (select item_id * 3 from benchmark) and {SCOPE_SQL} and {VISIBLE_SQL}")
def batch_lookup(spark, d):
    wanted = table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("fact_id")).distinct()
    found = facts(spark, d).where(P.in_scope("src3", True, True) & P.visible())
    return found.join(wanted, "fact_id", "left_semi").select("fact_id", "profile_id", "n_chars")


@query("q004_scan_by_entity", f"with {FACTS_SQL} select fact_id from facts where list_contains(shared_with, 'src5') and {VISIBLE_SQL}")
def scan_by_entity(spark, d):
    return facts(spark, d).where(F.array_contains("shared_with", "src5") & P.visible()).select("fact_id")


@query("q005_scan_by_type", f"with {FACTS_SQL} select fact_id, fact_type from facts where fact_type = 'fr' and {VISIBLE_SQL}")
def scan_by_type(spark, d):
    return facts(spark, d).where((F.col("fact_type") == "fr") & P.visible()).select("fact_id", "fact_type")


@query("q011_edges_both_directions", f"with {EDGES_SQL} select src as node, dst as other, weight from edges where src = 3 union all select dst, src, weight from edges where dst = 3")
def edge_scan(spark, d):
    return P.both_directions(edges(spark, d)).where("src = 3").select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")


@query("q012_logical_edges", f"with {EDGES_SQL} select distinct src, dst, coalesce(edge_type, 'related') as edge_type from edges where weight >= 2")
def logical_edges(spark, d):
    return edges(spark, d).where("weight >= 2").select("src", "dst", F.coalesce("edge_type", F.lit("related")).alias("edge_type")).distinct()


@query("q013_vectors_with_lifecycle", f"with {FACTS_SQL} select vec_id, label, coalesce(archive_status, 'live') as archive_status from embeddings join facts on vec_id = fact_id where {VISIBLE_SQL}")
def vectors_with_lifecycle(spark, d):
    f = facts(spark, d).where(P.visible())
    found = table(spark, d, "embeddings").join(f, F.col("vec_id") == F.col("fact_id"))
    return found.select("vec_id", "label", F.coalesce("archive_status", F.lit("live")).alias("archive_status"))


@query(
    "q025_upsert",
    """select c_custkey, c_acctbal, c_mktsegment from customer where c_custkey % 10 <> 0
       union all select c_custkey, round(c_acctbal * 2, 4), 'NEW' from customer where c_custkey % 10 = 0""",
)
def upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.where("c_custkey % 10 = 0").select("c_custkey", F.round(F.col("c_acctbal") * 2, 4).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return P.upserted(old, new, "c_custkey")


@query("q026_scope_predicate", f"with {FACTS_SQL} select scope, count(*) as n from facts where {SCOPE_SQL} group by scope")
def scope_predicate(spark, d):
    return facts(spark, d).where(P.in_scope("src3", True, True)).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("q027_visibility_predicate", f"with {FACTS_SQL} select {VISIBLE_SQL} as visible, count(*) as n from facts group by 1")
def visibility(spark, d):
    return facts(spark, d).groupBy(P.visible().alias("visible")).agg(F.count(F.lit(1)).alias("n"))


@query("q028_authorised_candidates", f"with {FACTS_SQL} select vec_id as fact_id, label from embeddings where vec_id in (select fact_id from facts where {SCOPE_SQL} and {VISIBLE_SQL})")
def authorised(spark, d):
    candidates = table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "label")
    return P.authorised(candidates, facts(spark, d), P.in_scope("src3", True, True))


@query(
    "q029_valid_now",
    f"""with {VALIDITY_SQL} select c.o_orderkey as fact_id from (select o_orderkey from orders union all select -o_orderkey from orders where o_orderkey % 100 = 0) c
        left join validity v on v.fact_id = c.o_orderkey
        where v.fact_id is null or (coalesce(v.valid_until >= timestamp '{VALID_AT}', true) and coalesce(v.system_expired_at > timestamp '{VALID_AT}', true))""",
)
def valid_now(spark, d):
    orders, at = table(spark, d, "orders"), F.lit(VALID_AT).cast("timestamp")
    ids = orders.select(F.col("o_orderkey").alias("fact_id")).union(orders.where("o_orderkey % 100 = 0").select(-F.col("o_orderkey")))
    joined = ids.join(validity(spark, d), "fact_id", "left")
    return joined.where(~P.event_expired(None, at) & ~P.system_expired(at)).select("fact_id")


@query("q030_system_expired", f"with {VALIDITY_SQL} select fact_id from validity where system_expired_at <= timestamp '{VALID_AT}'")
def system_expired(spark, d):
    return validity(spark, d).where(P.system_expired(F.lit(VALID_AT).cast("timestamp"))).select("fact_id")


@query("q031_event_expired_as_of", f"with {VALIDITY_SQL} select fact_id from validity where profile_id = 'src3' and (valid_until <= timestamp '{VALID_AT}' or valid_from > timestamp '{VALID_AT}')")
def event_expired(spark, d):
    at = F.lit(VALID_AT).cast("timestamp")
    return validity(spark, d).where((F.col("profile_id") == "src3") & P.event_expired(at, at)).select("fact_id")


@query(
    "q032_two_clocks",
    f"""with {VALIDITY_SQL} select fact_id from validity
        where system_created_at <= timestamp '2023-09-01' and (system_expired_at is null or system_expired_at > timestamp '2023-09-01')
          and valid_from <= timestamp '{VALID_AT}' and (valid_until is null or valid_until > timestamp '{VALID_AT}')""",
)
def two_clocks(spark, d):
    known = F.lit("2023-09-01").cast("timestamp")
    return validity(spark, d).where(P.known_and_valid(known, F.lit(VALID_AT).cast("timestamp"))).select("fact_id")


@query(
    "q033_correction_admission",
    f"""with {VALIDITY_SQL}, cases as (select fact_id, fact_id + 1 as successor, ['proposed', 'applied', 'rejected', 'rolled_back'][cast(fact_id % 4 as int) + 1] as state from validity where fact_id % 6 = 0)
        select fact_id from validity where fact_id not in (
          select fact_id from cases where state = 'applied' union select successor from cases where state in ('proposed', 'rejected', 'rolled_back'))""",
)
def correction_admission(spark, d):
    rows = validity(spark, d)
    states = F.array(*[F.lit(s) for s in ("proposed", "applied", "rejected", "rolled_back")])
    cases = rows.where("fact_id % 6 = 0").select("fact_id", (F.col("fact_id") + 1).alias("successor"), F.get(states, (F.col("fact_id") % 4).cast("int")).alias("state"))
    expired = cases.where("state = 'applied'").select("fact_id")
    refused = cases.where("state in ('proposed', 'rejected', 'rolled_back')").select(F.col("successor").alias("fact_id"))
    return rows.join(expired.union(refused).distinct(), "fact_id", "left_anti").select("fact_id")


@query("q034_time_window", f"with {FACTS_SQL} select fact_id, created_at from facts where created_at between timestamp '{AS_OF}' - interval 30 days and timestamp '{AS_OF}'")
def time_window(spark, d):
    from palimpsest.functions.temporal import window_bounds

    lo, hi = window_bounds("1m", AS_OF)
    return facts(spark, d).where(F.col("created_at").between(F.lit(lo), F.lit(hi))).select("fact_id", "created_at")


@query(
    "q036_low_information_gate",
    "select conv_id, turn, length(text) < 10 or lower(trim(text)) in ('ok', 'thanks', 'yes', 'no') as dropped from conversations",
)
def low_information(spark, d):
    t = table(spark, d, "conversations")
    stock = F.lower(F.trim("text")).isin("ok", "thanks", "yes", "no")
    return t.select("conv_id", "turn", ((F.length("text") < 10) | stock).alias("dropped"))


ZONE_SQL = "case when r > 0.8 then 'active' when r > 0.5 then 'warm' when r > 0.2 then 'cold' when r > 0.05 then 'archive' else 'forgotten' end"


@query(
    "q037_forgetting_filter",
    f"""with {RETENTION_SQL}, r as (select fact_id, round(exp(-hours / 50 / (1 + access_count)), 6) as r from retention_input), z as (select fact_id, r, {ZONE_SQL} as zone from r)
        select fact_id, zone, case zone when 'active' then 1.0::double when 'warm' then 0.7::double else 0.3::double end as weight from z where zone not in ('archive', 'forgotten')""",
)
def forgetting_filter(spark, d):
    from palimpsest.functions.lifecycle import zone
    from palimpsest.sources.tables import retention_input

    r = retention_input(spark, d).select("fact_id", F.round(F.exp(-F.col("hours") / 50 / (1 + F.col("access_count"))), 6).alias("r"))
    z = r.select("fact_id", zone(F.col("r")).alias("zone")).where(~F.col("zone").isin("archive", "forgotten"))
    return z.withColumn("weight", F.when(F.col("zone") == "active", 1.0).when(F.col("zone") == "warm", 0.7).otherwise(0.3))


@query(
    "q038_evidence_floor",
    "select event_id, value >= 60 or event_type = 'purchase' or user_id % 50 = 0 as kept from events",
)
def evidence_floor(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", ((F.col("value") >= 60) | (F.col("event_type") == "purchase") | (F.col("user_id") % 50 == 0)).alias("kept"))


@query("q039_truncated_projection", "select doc_id, substr(text, 1, 200) as content, round(n_chars / 1000, 3) as score from documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 200).alias("content"), F.round(F.col("n_chars") / 1000, 3).alias("score"))


@query("q040_pagination", f"with {FACTS_SQL} select fact_id, created_at from facts order by created_at desc, fact_id limit 50 offset 100")
def pagination(spark, d):
    return facts(spark, d).select("fact_id", "created_at").orderBy(F.desc("created_at"), "fact_id").offset(100).limit(50)
