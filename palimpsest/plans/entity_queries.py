"""Names in documents: similar pairs, and mentions resolved to entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import entities as E
from palimpsest.plans.registry import query
from palimpsest.session import checkpointed
from palimpsest.sources.tables import table

#: Capitalised words of nine letters or more are mentions; those in two documents or more are known entities, with their plural as an alias.
_MENTIONS_SQL = "m as materialized (select w, count(distinct doc_id) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) as w from documents) where length(w) <= 100 group by 1)"


def mentions(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{8,}"), 0)).alias("w"))
    return words.where(F.length("w") <= 100).groupBy("w").agg(F.count_distinct("doc_id").alias("n"))


@query(
    "q193_similar_names",
    f"with {_MENTIONS_SQL}, l as (select distinct lower(w) as w from m) select a.w as a, b.w as b, round(jaro_winkler_similarity(a.w, b.w), 6) as similarity from l a join l b on a.w < b.w where jaro_winkler_similarity(a.w, b.w) >= 0.85",
)
def similar_names(spark, d):
    """All pairs of names of at least 0.85, found by their starts and rare letters."""
    names = mentions(spark, d).select(F.lower("w").alias("name"))
    found = E.similar_names(names, names, ordered=True)
    return found.select(F.col("name").alias("a"), F.col("other").alias("b"), F.round("score", 6).alias("similarity"))


@query(
    "q195_entity_links",
    f"""with recursive {_MENTIONS_SQL}, k as (select low, min((rank, id)) as k from (select lower(w) as low, 0 as rank, 'e-' || w as id from m where n >= 2 union all select lower(w) || 's', 1, 'e-' || w from m where n >= 2) group by 1),
        x as (select w, k[2] as id, case when k[1] = 0 then 'name' else 'alias' end as how, 1.0::double as score from m join k on low = lower(w)),
        r as materialized (select w, lower(w) as low from m where lower(w) not in (select low from k)),
        s as (select r.low, min((-round(jaro_winkler_similarity(r.low, k.low), 9), k[1], k[2])) as b from (select distinct low from r) r, k where jaro_winkler_similarity(r.low, k.low) >= 0.85 group by 1),
        f as (select w, b[3] as id, 'fuzzy' as how, -b[1] as score from r join s using (low)),
        o as materialized (select w, low from r where low not in (select low from s)),
        g as materialized (select a.low as x, b.low as y from (select distinct low from o) a, (select distinct low from o) b where a.low <> b.low and jaro_winkler_similarity(a.low, b.low) >= 0.85),
        c as (select distinct low as node, low as seen from o union select c.node, g.y from c join g on g.x = c.seen),
        h as (select node, min(seen) as head from c group by 1)
        select w as mention, id as entity_id, how, round(score, 6) as score from x union all select w, id, how, round(score, 6) from f
        union all select w, 'new-' || substr(md5(head), 1, 16), 'new', 1.0 from o join h on node = low""",
)
def entity_links(spark, d):
    m = checkpointed(mentions(spark, d))
    known = m.where("n >= 2").select(F.concat(F.lit("e-"), "w").alias("entity_id"), F.col("w").alias("name"))
    aliases = known.select("entity_id", F.concat("name", F.lit("s")).alias("alias"))
    return E.resolve(m.select(F.col("w").alias("mention")), known, aliases).withColumn("score", F.round("score", 6))
