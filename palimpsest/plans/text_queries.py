"""Text, date, JSON and hash queries."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import temporal as D
from palimpsest.functions import textual as T
from palimpsest.plans.registry import query
from palimpsest.session import tasks_for
from palimpsest.sources.tables import AS_OF, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_WORDS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9](?:[a-z0-9_''-]*[a-z0-9])?'), lambda x: x not in ({_STOP}))"


@query("q184_tokens", f"select conv_id, turn, cast(len(w) as int) as n_words, array_to_string(w[1:5], ' ') as head from (select conv_id, turn, {_WORDS} as w from conversations)")
def tokens(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    return w.select("conv_id", "turn", F.size("w").alias("n_words"), F.array_join(F.slice("w", 1, 5), " ").alias("head"))


@query("q185_sentences", "select item_id, cast(len(s) as int) as sentences, s[1] as first from (select item_id, list_filter(string_split_regex(text, '[.!?]+\\s+'), lambda x: trim(x) <> '') as s from benchmark)")
def sentences(spark, d):
    s = table(spark, d, "benchmark").select("item_id", F.filter(F.split("text", r"[.!?]+\s+"), lambda x: F.trim(x) != "").alias("s"))
    return s.select("item_id", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first"))


@query("q186_dates", "select doc_id, cast(len(regexp_extract_all(text, '[0-9]+')) as int) as numbers, regexp_extract(text, '[0-9]+', 0) as first from documents")
def numbers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.regexp_extract("text", "[0-9]+", 0).alias("first"))


@query(
    "q187_turn_chunks",
    """with n as (select conv_id, count(*) as n from conversations group by 1), c as (select conv_id, n, unnest(range(0, greatest(1, cast(ceil((n - 1) / 3.0) as bigint)))) as chunk from n)
       select c.conv_id, chunk, string_agg(role, ',' order by turn) as roles from c join (select *, row_number() over (partition by conv_id order by turn) - 1 as i from conversations) t on t.conv_id = c.conv_id and i >= chunk * 3 and i < chunk * 3 + 4 group by 1, 2""",
)
def turn_chunks(spark, d):
    """Chunks of four turns that overlap by one."""
    own, all_of = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    t = table(spark, d, "conversations").select("conv_id", "turn", "role", (F.row_number().over(own) - 1).alias("i"), F.count(F.lit(1)).over(all_of).alias("n"))
    last = F.greatest(F.lit(1), F.ceil((F.col("n") - 1) / 3.0)) - 1
    first = F.floor(F.col("i") / 3)
    chunks = F.array_distinct(F.array(F.least(first, last), F.when((F.col("i") % 3 == 0) & (F.col("i") > 0), first - 1).otherwise(F.least(first, last))))
    t = t.withColumn("chunk", F.explode(chunks)).where((F.col("i") >= F.col("chunk") * 3) & (F.col("i") < F.col("chunk") * 3 + 4))
    g = t.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", "chunk", F.array_join(F.col("x.role"), ",").alias("roles"))


@query(
    "q189_type_router",
    """select doc_id, case when regexp_matches(lower(text), '\\b(yesterday|today|last week|ago)\\b') then 'episodic' when regexp_matches(lower(text), '\\b(think|believe|prefer|like|love|hate)\\b') then 'opinion'
       when regexp_matches(lower(text), '\\b(before|after|until|since|when)\\b') then 'temporal' else 'semantic' end as kind from documents""",
)
def type_router(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fact_type(F.col("text")).alias("kind"))


@query("q196_jaccard", f"with w as (select conv_id, turn, list_distinct({_WORDS}) as w from conversations) select a.conv_id, a.turn, round(case when len(list_distinct(list_concat(a.w, b.w))) = 0 then 0 else len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) end, 6) as similarity from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def jaccard(spark, d):
    w = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.words(F.col("text"))).alias("w"))
    n = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query(
    "q199_timestamps",
    "select event_id, make_timestamp(epoch_us(date_trunc('second', ts)) - case when event_id % 3 = 2 then 7200000000 else 0 end) as at from events where event_id % 4 <> 3 union all select event_id, date_trunc('day', ts) from events where event_id % 4 = 3",
)
def timestamps(spark, d):
    """Text of four shapes, with T, with a space, with an offset and without a time, read back as instants."""
    e = table(spark, d, "events")
    shape = F.when(F.col("event_id") % 4 == 3, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    shape = shape.when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
    return e.select("event_id", D.parsed(shape).alias("at"))


@query(
    "q200_age_text",
    f"""with s as (select event_id, epoch(timestamp '{AS_OF}') - floor(epoch(ts)) as s from events)
        select event_id, case when s < 60 then 'just now' when s < 3600 then n || ' minute' when s < 86400 then n || ' hour' when s < 604800 then n || ' day' when s < 2592000 then n || ' week' else n || ' month' end
          || case when s < 60 then '' else case when n = 1 then '' else 's' end || ' ago' end as age
        from (select event_id, s, cast(round_even(s / case when s < 3600 then 60 when s < 86400 then 3600 when s < 604800 then 86400 when s < 2592000 then 604800 else 2592000 end, 0) as bigint) as n from s)""",
)
def ages(spark, d):
    seconds = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", D.age_text(seconds).alias("age"))


@query("q202_topic_signature", f"select item_id, substr(sha256(array_to_string(list_sort(list_distinct({_WORDS})), ' ')), 1, 16) as signature from benchmark")
def topic_signature(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.signature(T.words(F.col("text"))).alias("signature"))


@query(
    "q203_redaction",
    r"""select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', '[SSN]', 'g'), '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b', '[IP]', 'g'), '\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b', '[PHONE]', 'g')) as redacted_sha256 from documents""",
)
def redaction(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query("q203_counted_redaction")
def counted_redaction(spark, d):
    """Every document's redacted text, as a digest, and how much was taken out. DuckDB's patterns know no look-behind, so a test holds it against Python's."""
    out = T.redacted_counted(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), "redactions")


@query(
    "q204_trigram_index",
    """with g as (select distinct p_partkey, substr(lower(p_name), cast(i as int), 3) as g from (select p_partkey, p_name, unnest(range(1, length(p_name) - 1)) as i from part)),
       q as (select distinct substr('almond', cast(i as int), 3) as g from (select unnest(range(1, 5)) as i)) select p_partkey, count(*) as hits from g join q using (g) group by 1 having count(*) >= 1""",
)
def trigram_index(spark, d):
    g = table(spark, d, "part").select("p_partkey", F.explode(T.trigrams(F.col("p_name"))).alias("g"))
    q = spark.range(1).select(F.explode(T.trigrams(F.lit("almond"))).alias("g"))
    return g.join(q, "g").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 1")


@query("q206_block_hygiene", "select doc_id, substr(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), 1, 120) as block from documents")
def hygiene(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tidy(F.col("text"), 120).alias("block"))


@query("q207_non_answers", "select conv_id, turn from conversations where role = 'assistant' and (length(text) < 40 or regexp_matches(lower(text), 'i (do not|don''t) know|no information|cannot answer'))")
def non_answers(spark, d):
    weak = (F.length("text") < 40) | F.lower("text").rlike("i (do not|don't) know|no information|cannot answer")
    return table(spark, d, "conversations").where((F.col("role") == "assistant") & weak).select("conv_id", "turn")


@query("q209_cache_key", "select event_id, sha256(event_type || '|' || user_id || '|' || props) as key from events")
def cache_key(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", "user_id", "props"), 256).alias("key"))


@query(
    "q210_hash_chain",
    """with recursive h as (select user_id, event_id, sha256(event_type || user_id || event_id) as h, row_number() over (partition by user_id order by ts, event_id) as rn from events),
       w as (select user_id, rn, event_id, sha256('genesis' || h) as link from h where rn = 1 union all select h.user_id, h.rn, h.event_id, sha256(w.link || h.h) from w join h on h.user_id = w.user_id and h.rn = w.rn + 1)
       select event_id, link from w""",
)
def hash_chain(spark, d):
    """Each row's link hashes the link before it, so that a change of any earlier row shows. One pass over the sorted rows of a user, of which the last link is kept."""

    def linked(batches):
        user, link = None, "genesis"
        for batch in batches:
            links = []
            for own, h in zip(batch["user_id"], batch["h"], strict=True):
                link = hashlib.sha256(((link if own == user else "genesis") + h).encode()).hexdigest()
                user = own
                links.append(link)
            yield pd.DataFrame({"event_id": batch["event_id"], "link": links})

    h = F.sha2(F.concat("event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", h.alias("h"))
    return e.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(linked, "event_id long, link string")


@query("q212_json", "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1")
def json_access(spark, d):
    return table(spark, d, "events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "q198_text_dates",
    """with o as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 8 as k from orders)
       select o_orderkey, (case k when 0 then d when 1 then d when 2 then date_trunc('month', d) when 3 then d - 3 when 4 then d + interval 2 month when 5 then d - 1 when 6 then d + 40 when 7 then null end)::date::varchar as referenced,
              (case k when 6 then d when 7 then d when 4 then null end)::date::varchar as starts, (case k when 6 then d + 40 when 7 then d + 14 end)::date::varchar as ends from o""",
)
def text_dates(spark, d):
    """Notes of orders in eight wordings, read as of the order's day; of two dates the one in figures counts first."""
    from palimpsest.functions.dates import spoken_of

    k, day = F.col("o_orderkey") % 8, F.to_date("o_orderdate")
    at = lambda form, c=day: F.date_format(c, form)
    notes = [
        F.concat(F.lit("Ordered on "), at("MMMM d, yyyy"), F.lit(".")), F.concat(F.lit("order of "), at("M/d/yyyy")), F.concat(F.lit("one of "), at("MMM yyyy"), F.lit("'s orders")), F.lit("It came 3 days ago"),
        F.lit("to be paid in 2 months"), F.lit("seen Yesterday"), F.concat(F.lit("open from "), at("d MMMM yyyy"), F.lit(" to "), at("yyyy-MM-dd", F.date_add(day, 40))), F.lit("kept for 2 weeks"),
    ]
    text = F.get(F.array(*notes), k.cast("int"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    orders = orders.repartition(tasks_for(spark, orders.count()), "o_orderkey")
    # inline() takes the three dates from one reading of a text; as fields of a column each would be a reading of its own.
    found = orders.select("o_orderkey", F.inline(F.array(spoken_of(text, day))))
    return found.select("o_orderkey", *[F.col(c).cast("string").alias(c) for c in ("referenced", "starts", "ends")])
