"""The driver's tables, and the domain views that are derived from them with fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import tasks_for

#: All time-relative queries take this instant for now.
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as atomic facts: owner, scope, lifecycle columns and a creation time made from the id."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("fact_id"),
        F.col("source").alias("profile_id"),
        F.col("text").alias("content"),
        F.col("lang").alias("fact_type"),
        F.when(i % 10 == 0, "global").when(i % 10 == 1, "shared").otherwise("personal").alias("scope"),
        F.array(F.concat(F.lit("src"), ((i + 1) % 20).cast("string"))).alias("shared_with"),
        F.when(i % 17 == 0, "archived").when(i % 23 != 0, "live").alias("archive_status"),
        F.when(i % 29 == 0, 1).when(i % 31 != 0, 0).alias("quarantined"),
        ((i % 10) / 10).alias("importance"),
        (0.5 + (i % 50) / 100).alias("confidence"),
        (i % 100).alias("access_count"),
        F.timestamp_seconds(F.lit(1704067200) + i * 977 % 2678400).alias("created_at"),
        F.length("text").cast("long").alias("n_chars"),
    )


FACTS_SQL = """facts as (
  select doc_id as fact_id, source as profile_id, text as content, lang as fact_type,
         case when doc_id % 10 = 0 then 'global' when doc_id % 10 = 1 then 'shared' else 'personal' end as scope,
         ['src' || ((doc_id + 1) % 20)] as shared_with,
         case when doc_id % 17 = 0 then 'archived' when doc_id % 23 <> 0 then 'live' end as archive_status,
         case when doc_id % 29 = 0 then 1 when doc_id % 31 <> 0 then 0 end as quarantined,
         (doc_id % 10) / 10 as importance, 0.5::double + (doc_id % 50) / 100 as confidence, doc_id % 100 as access_count,
         make_timestamp((1704067200 + doc_id * 977 % 2678400) * 1000000) as created_at, length(text) as n_chars
  from documents
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier-part edges of lineitem: src (supplier), dst (part, negative ids), weight (number of lines), edge_type."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst"))
    # Nearly every line is a pair of its own. Dealt first, none of the tasks has more pairs to hold on larger tables.
    pairs = lines.repartition(edge_tasks(spark, sf_dir), "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    kind = F.when(F.col("dst") % 7 == 0, "supersedes").when(F.col("dst") % 5 != 0, "related")
    return pairs.select("src", "dst", "weight", kind.alias("edge_type"))


def edge_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for a step over all edges; the number of lines comes from the files' footers."""
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


EDGES_SQL = """edges as (
  select l_suppkey as src, -l_partkey as dst, count(*) as weight,
         case when l_partkey % 7 = 0 then 'supersedes' when l_partkey % 5 <> 0 then 'related' end as edge_type
  from lineitem group by l_suppkey, l_partkey
)"""


def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bi-temporal rows: valid from the order to its last shipment, some open, some expired by the system."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.join(last, o.o_orderkey == last.l_orderkey, "left").select(
        k.alias("fact_id"),
        F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("profile_id"),
        F.col("o_orderdate").alias("valid_from"),
        F.when(k % 5 != 0, F.col("shipped")).alias("valid_until"),
        F.col("o_orderdate").alias("system_created_at"),
        F.when(k % 4 == 0, F.col("shipped") + F.expr("interval 30 days")).alias("system_expired_at"),
    )


VALIDITY_SQL = """validity as (
  select o_orderkey as fact_id, 'src' || (o_custkey % 20) as profile_id, o_orderdate as valid_from,
         case when o_orderkey % 5 <> 0 then shipped end as valid_until, o_orderdate as system_created_at,
         case when o_orderkey % 4 = 0 then shipped + interval 30 days end as system_expired_at
  from orders left join (select l_orderkey, max(l_shipdate) as shipped from lineitem group by 1) on o_orderkey = l_orderkey
)"""


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tool events: one session for each user and day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created_at"), "user_id", F.concat_ws("/", "user_id", day).alias("session_id"),
        F.col("event_type").alias("tool_name"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EVENTS_SQL = """tool_events as (
  select event_id, ts as created_at, user_id, user_id || '/' || strftime(ts, '%Y-%m-%d') as session_id,
         event_type as tool_name, value, cast(json_extract_string(props, '$.k') as int) as k
  from events
)"""


def retention_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts with the columns that retention needs."""
    f = facts(spark, sf_dir)
    return f.select(
        "fact_id", "access_count", "importance", (F.col("fact_id") % 4).alias("confirmation_count"),
        ((F.col("fact_id") % 7) / 7).alias("emotional_salience"), ((F.col("fact_id") % 11) / 10).alias("trust_score"),
        ((F.lit(1706745600) - F.unix_timestamp("created_at")) / 3600).alias("hours"),
    )


RETENTION_SQL = f"""{FACTS_SQL}, retention_input as (
  select fact_id, access_count, importance, fact_id % 4 as confirmation_count, (fact_id % 7) / 7 as emotional_salience,
         (fact_id % 11) / 10 as trust_score, (1706745600 - epoch(created_at)) / 3600 as hours
  from facts
)"""
