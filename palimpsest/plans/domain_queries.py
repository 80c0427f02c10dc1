"""Bridges, quantised search, extraction, resolution, consolidation and contradiction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.functions import textual as T
from palimpsest.operators import graphs as G
from palimpsest.plans.more_queries import _V, vectors
from palimpsest.plans.registry import query
from palimpsest.sources.tables import EDGES_SQL, FACTS_SQL, edge_tasks, edges, facts, table


def _bridge_sql(hops: int) -> str:
    steps = ["b as (select src, dst from e where src <> dst union select dst, src from e where src <> dst)", "w0 as (select unnest([1, 2])::bigint as node, 0 as hops)"]
    for i in range(hops):
        steps.append(f"w{i + 1} as materialized (select node, min(hops) as hops from (select node, hops from w{i} union all select b.dst, hops + 1 from w{i} join b on b.src = w{i}.node) group by 1)")
    return f"with {EDGES_SQL}, e as (select src, dst from edges), " + ", ".join(steps) + f" select node, round(power(0.8, hops), 6) as score from w{hops} where hops > 0"


@query("q132_bridges", _bridge_sql(4))
def bridges(spark, d):
    """What is new within four hops of the seeds; each hop costs a fifth. Hops are the budget, not the clock."""
    found = G.reached(edges(spark, d), spark.createDataFrame([(1,), (2,)], "node long"), 4, tasks=edge_tasks(spark, d)).where("hops > 0")
    return found.select("node", F.round(F.pow(F.lit(0.8), F.col("hops")), 6).alias("score"))


@query(
    "q139_rewritten_round",
    """with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) as w from benchmark)
       select item_id, len(w) < 12 as insufficient, array_to_string(list_sort(w)[1:6], ' ') as rewritten from w""",
)
def rewritten(spark, d):
    """A second round for queries with few salient words: their longest-word form, without a language model."""
    w = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("w"))
    return w.select("item_id", (F.size("w") < 12).alias("insufficient"), F.array_join(F.slice(F.array_sort("w"), 1, 6), " ").alias("rewritten"))


@query(
    "q140_quantised_search",
    f"""with {_V}, c as (select vec_id, v, list_transform(v, lambda x: round_even(x * 4, 0)) as c from e), q as (select v from c where vec_id = 0), s as (select vec_id, round(list_cosine_similarity(c.c, q.v), 6) as score from c, q where list_sum(list_transform(c.c, lambda x: x * x)) > 0)
        select vec_id, score from s order by score desc, vec_id limit 20""",
)
def quantised(spark, d):
    """The nearest vectors by cosine of the probe and codes in quarters, rounded half to even."""
    probe = F.array(*[F.lit(float(x)) for x in vectors(spark, d).where("vec_id = 0").first()["v"]])
    c = vectors(spark, d).select("vec_id", F.transform("v", lambda x: F.rint(x * 4)).alias("c")).where(S.dot(F.col("c"), F.col("c")) > 0)
    return c.select("vec_id", F.round(S.cosine(F.col("c"), probe), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query("q143_score_contract", "select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as position, round(least(1, greatest(0, value / 100)), 6) as score, max(value) over (partition by user_id) < 90 as abstain from events")
def contract(spark, d):
    w, every = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"), Window.partitionBy("user_id")
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)), 6)
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("position"), score.alias("score"), (F.max("value").over(every) < 90).alias("abstain"))


@query("q157_community_summaries", "select label, count(*) as n, array_to_string(list_sort(list(vec_id))[1:5], ',') as members from embeddings group by 1")
def community_summaries(spark, d):
    """Size and first members; the members are cut in each partition before they meet."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").select("label", "vec_id")
    first = e.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")).cast("array<string>"), ",").alias("members"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(first, "label")


@query(
    "q178_scalar_codes",
    f"with {_V}, m as (select vec_id, v, list_max(list_transform(v, lambda x: abs(x))) as m from e) select vec_id, round(m, 6) as radius, array_to_string(list_transform(v[1:8], lambda x: cast(cast(floor(x / m * 7 + 0.5) as int) as varchar)), ',') as codes from m where m > 0",
)
def scalar_codes(spark, d):
    """Radius and four-bit codes of a vector's components, the first eight shown."""
    m = vectors(spark, d).withColumn("m", F.array_max(F.transform("v", F.abs))).where("m > 0")
    codes = F.transform(F.slice("v", 1, 8), lambda x: F.floor(x / F.col("m") * 7 + 0.5).cast("int").cast("string"))
    return m.select("vec_id", F.round("m", 6).alias("radius"), F.array_join(codes, ",").alias("codes"))


@query("q180_coupling_terms", f"with {FACTS_SQL} select fact_id, round(1 / (1 + importance * confidence), 6) as temperature, round(sqrt(1 - least(0.99, importance)), 6) as radius from facts")
def coupling_terms(spark, d):
    return facts(spark, d).select("fact_id", F.round(1 / (1 + F.col("importance") * F.col("confidence")), 6).alias("temperature"), F.round(F.sqrt(1 - F.least(F.lit(0.99), F.col("importance"))), 6).alias("radius"))


@query(
    "q188_extracted_facts",
    r"""with s as (select conv_id, turn, unnest(string_split_regex(text, '[.!?]+\s+')) as s from conversations where role = 'user'), n as (select conv_id, turn, trim(s) as s from s)
        select conv_id, turn, count(*) as sentences, count(*) filter (where length(s) >= 20) as facts from n where s <> '' group by 1, 2""",
)
def extracted(spark, d):
    s = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.split("text", r"[.!?]+\s+")).alias("s"))
    n = s.select("conv_id", "turn", F.trim("s").alias("s")).where("s <> ''")
    return n.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(F.length("s") >= 20).alias("facts"))


@query(
    "q192_activity_classes",
    """with v as (select doc_id, len(regexp_extract_all(lower(text), '[ .,](the|and)[ .,]')) as a, len(regexp_extract_all(lower(text), '[ .,](der|und|die)[ .,]')) as b, len(regexp_extract_all(lower(text), '[ .,](de|la|le)[ .,]')) as c from documents)
       select doc_id, case when greatest(a, b, c) = 0 then 'none' when a = greatest(a, b, c) then 'first' when b = greatest(a, b, c) then 'second' else 'third' end as activity from v""",
)
def activity(spark, d):
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p))
    v = table(spark, d, "documents").select("doc_id", n("[ .,](the|and)[ .,]").alias("a"), n("[ .,](der|und|die)[ .,]").alias("b"), n("[ .,](de|la|le)[ .,]").alias("c"))
    most = F.greatest("a", "b", "c")
    return v.select("doc_id", F.when(most == 0, "none").when(F.col("a") == most, "first").when(F.col("b") == most, "second").otherwise("third").alias("activity"))


@query("q195_resolved_entities", "with k as (select c_custkey, lower(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) || (c_custkey % 40) as k from customer) select c_custkey, min(c_custkey) over (partition by k) as entity from k")
def resolved(spark, d):
    k = F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z]", "")), (F.col("c_custkey") % 40).cast("string"))
    c = table(spark, d, "customer").select("c_custkey", k.alias("k"))
    return c.join(c.groupBy("k").agg(F.min("c_custkey").alias("entity")), "k").select("c_custkey", "entity")


@query(
    "q198_parsed_dates",
    "select o_orderkey, cast(o_orderdate as date)::varchar as day from orders where o_orderkey % 3 = 0 union all select o_orderkey, (cast(o_orderdate as date) - interval 1 day)::date::varchar from orders where o_orderkey % 3 = 1 union all select o_orderkey, null from orders where o_orderkey % 3 = 2",
)
def parsed_dates(spark, d):
    """A written date, a phrase relative to a reference date, and text that is no date."""
    k, day = F.col("o_orderkey") % 3, F.to_date("o_orderdate")
    text = F.when(k == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).when(k == 1, "yesterday").otherwise("some day")
    o = table(spark, d, "orders").select("o_orderkey", text.alias("t"), day.alias("reference"))
    written = F.to_date(F.try_to_timestamp("t", F.lit("MMMM d, yyyy")))
    found = F.coalesce(written, F.when(F.col("t") == "yesterday", F.date_sub("reference", 1)).when(F.col("t") == "today", F.col("reference")))
    return o.select("o_orderkey", found.cast("string").alias("day"))


@query("q201_foresight", "select doc_id, len(regexp_extract_all(lower(text), '\\b(plan to|going to|will|to the)\\b')) as n from documents where regexp_matches(lower(text), '\\b(plan to|going to|will|to the)\\b')")
def foresight(spark, d):
    pattern = T.bounded("plan to|going to|will|to the")
    found = table(spark, d, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(pattern)).cast("long").alias("n"))
    return found.where("n > 0")


@query("q211_watermarks", "select page_id, substr(sha256(cast(page_id as varchar)), 1, 8) as mark from pages")
def watermarks(spark, d):
    """Eight hex digits hidden in a text as zero-width characters, and read back."""
    marked = table(spark, d, "pages").select("page_id", T.marked(F.col("url"), F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 8)).alias("t"))
    return marked.select("page_id", T.mark_of(F.col("t")).alias("mark"))


@query(
    "q234_consolidation",
    f"""with {FACTS_SQL}, c as (select profile_id, n_chars // 500 as cluster, count(*) as n, arg_max(fact_id, (importance, -fact_id)) as gist, cast(sum(n_chars) as bigint) as chars from facts where coalesce(archive_status, 'live') = 'live' group by 1, 2 having count(*) >= 2)
        select profile_id, cluster, n, gist, round(1 - 500.0 / greatest(chars, 500), 6) as saved from c""",
)
def consolidation(spark, d):
    live = facts(spark, d).where(F.coalesce("archive_status", F.lit("live")) == "live")
    c = live.groupBy("profile_id", F.floor(F.col("n_chars") / 500).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("fact_id", F.struct("importance", -F.col("fact_id"))).alias("gist"), F.sum("n_chars").alias("chars")
    )
    return c.where("n >= 2").select("profile_id", "cluster", "n", "gist", F.round(1 - 500.0 / F.greatest("chars", F.lit(500)), 6).alias("saved"))


@query(
    "q233_cycle_report",
    f"with {FACTS_SQL} select count(*) as facts, count(*) filter (where confidence < 0.6 and access_count < 10) as demoted, count(*) filter (where importance >= 0.8) as promoted, count(distinct sha256(content)) as distinct_contents from facts",
)
def cycle_report(spark, d):
    f = facts(spark, d)
    return f.agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if((F.col("confidence") < 0.6) & (F.col("access_count") < 10)).alias("demoted"),
        F.count_if(F.col("importance") >= 0.8).alias("promoted"),
        F.countDistinct(F.sha2("content", 256)).alias("distinct_contents"),
    )


@query(
    "q242_temporal_contradictions",
    "select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and cast(a.o_orderdate as date) = cast(b.o_orderdate as date) where a.o_orderstatus <> b.o_orderstatus",
)
def contradictions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    b = o.select("o_custkey", "day", F.col("o_orderkey").alias("b"), F.col("o_orderstatus").alias("s"))
    return o.join(b, ["o_custkey", "day"]).where("o_orderkey < b and o_orderstatus <> s").select(F.col("o_orderkey").alias("a"), "b")


@query(
    "q145_ensemble",
    """with b as (select event_type, (1 + count(*) filter (where value >= 50)) / (2 + count(*)) as p from events group by 1)
       select event_id, round(0.4 / (1 + exp(-(value - 50) / 20)) + 0.6 * p, 6) as score from events join b using (event_type)""",
)
def ensemble(spark, d):
    """A logistic stand-in for the learned ranker, mixed with the posterior mean of the event's arm."""
    e = table(spark, d, "events")
    b = e.groupBy("event_type").agg(((1 + F.count_if(F.col("value") >= 50)) / (2 + F.count(F.lit(1)))).alias("p"))
    return e.join(b, "event_type").select("event_id", F.round(0.4 / (1 + F.exp(-(F.col("value") - 50) / 20)) + 0.6 * F.col("p"), 6).alias("score"))
