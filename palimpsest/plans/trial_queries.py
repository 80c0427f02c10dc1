"""Trials of rankings: Thompson choices and paired decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import trials as T
from palimpsest.plans.registry import query
from palimpsest.sources.tables import table

_STRATUM = "event_type || '/' || case when hour(ts) between 5 and 11 then 'morning' when hour(ts) between 12 and 16 then 'afternoon' when hour(ts) between 17 and 20 then 'evening' else 'night' end"
_52 = "4503599627370496::double"


def _digits(key: str, at: int) -> str:
    return f"('0x' || substr(md5({key}), {at}, 13))::bigint"


def strata(spark, d):
    h = F.hour("ts")
    part = F.when(h.between(5, 11), "morning").when(h.between(12, 16), "afternoon").when(h.between(17, 20), "evening").otherwise("night")
    return table(spark, d, "events").withColumn("stratum", F.concat_ws("/", "event_type", part))


@query(
    "q146_thompson_choices",
    f"""with p as (select event_id as play, {_STRATUM} as stratum, user_id % 8 as arm, value from events),
        post as (select stratum, arm, least(1000, 1 + count(*) filter (where value >= 50))::double as a, least(1000, 1 + count(*) filter (where value < 50))::double as b from p group by 1, 2),
        s as (select p.play, p.stratum, arms.arm, coalesce(a, 1) as a, coalesce(b, 1) as b from p, (select unnest(range(8)) as arm) arms left join post on post.stratum = p.stratum and post.arm = arms.arm),
        g as (select play, stratum, arm, side, shape - 1::double / 3 as d, play || ':' || arm || '|' || side as k from (select play, stratum, arm, 'a' as side, a as shape from s union all select play, stratum, arm, 'b', b from s)),
        t as (select *, sqrt(-2 * ln(({_digits("k || ':42:' || i", 1)} + 0.5::double) / {_52})) * cos({_digits("k || ':42:' || i", 14)} * (2 * pi() / {_52})) as x, ({_digits("k || '/42/' || i", 1)} + 0.5::double) / {_52} as u from g, unnest(range(6)) r(i)),
        v as (select *, (1 + x / sqrt(9 * d)) ** 3 as v from t),
        f as (select play, stratum, arm, side, coalesce(any_value(d) * arg_min(v, i) filter (where v > 0 and ln(u) < 0.5 * x * x + d - d * v + d * ln(greatest(v, 1e-300))), any_value(d)) as y from v group by 1, 2, 3, 4),
        b as (select play, stratum, arm, round(max(y) filter (where side = 'a') / sum(y), 9) as sample from f group by 1, 2, 3)
        select play, stratum, arg_max(arm, (sample, -arm)) as arm, max(sample) as sample from b group by 1, 2""",
)
def thompson_choices(spark, d):
    """The arm that every event's stratum would play, by one seeded draw of each of eight arms."""
    e = strata(spark, d)
    cap = lambda c: F.least(F.lit(1000).cast("long"), 1 + F.count_if(c))
    posteriors = e.groupBy("stratum", (F.col("user_id") % 8).alias("arm")).agg(cap(F.col("value") >= 50).alias("alpha"), cap(F.col("value") < 50).alias("beta"))
    found = T.thompson(e.select(F.col("event_id").alias("play"), "stratum"), posteriors, list(range(8)))
    return found.withColumn("arm", F.col("arm").cast("long"))


def _critical_sql(alpha: float) -> str:
    z, terms = T.expansion(alpha)
    return f"({z!r}::double" + "".join(f" + {t!r}::double / (n - 1) ** {i}" for i, t in enumerate(terms, 1)) + ")"


@query(
    "q148_paired_decisions",
    f"""with o as (select event_type as experiment, user_id || '/' || strftime(ts, '%Y-%m-%d') as q, case when cast('0x' || substr(sha256(cast(event_id as varchar)), 1, 8) as bigint) % 2 = 0 then 'active' else 'candidate' end as arm, event_id, value / 100 as score from events),
        e as (select experiment, q, arg_max(score, event_id) filter (where arm = 'active') as x, arg_max(score, event_id) filter (where arm = 'candidate') as y, count(*) filter (where arm = 'active') as nx, count(*) filter (where arm = 'candidate') as ny from o group by 1, 2),
        s as (select experiment, sum(nx)::bigint as n_active, sum(ny)::bigint as n_candidate, count(y - x) as n, coalesce(avg(y - x), 0) as m, coalesce(stddev_samp(y - x), 0) as sd from e group by 1),
        t as (select *, case when sd = 0 then case when m > 0 then 'inf'::double when m < 0 then '-inf'::double else 0 end else m / (sd / sqrt(n)) end as t from s),
        c as (select *, case when n = 0 then null when least(n_active, n_candidate) >= 8 and greatest(n_active, n_candidate) > 2 * least(n_active, n_candidate) then 'unbalanced_arms' when n < 100 then 'accumulating'
                when n < 885 and m > 0.08 and t > {_critical_sql(T.STRONG_ALPHA)} then 'phase_a_strong_signal' when n < 885 then 'phase_a_continue' when m >= 0.02 and t > {_critical_sql(2 * T.ALPHA)} then 'phase_b_promote' else 'phase_b_reject' end as criterion from t)
        select experiment, n_active, n_candidate, n as n_pairs, round(m, 6) as effect, round(sd, 6) as std, round(t, 5) as t_stat, criterion,
               case when criterion in ('phase_a_strong_signal', 'phase_b_promote') then 'promote' when criterion = 'phase_b_reject' then 'reject' else 'continue' end as decision from c""",
)
def paired_decisions(spark, d):
    """Each event type as an experiment, a user's day as a query, arms by hash."""
    arm = F.when(F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 2 == 0, "active").otherwise("candidate")
    o = table(spark, d, "events").select(F.col("event_type").alias("experiment"), F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("query_id"), arm.alias("arm"), F.col("event_id").alias("arrived"), (F.col("value") / 100).alias("score"))
    rounded = {"effect": F.round("effect", 6), "std": F.round("std", 6), "t_stat": F.round("t_stat", 5)}
    return T.decisions(o).withColumns(rounded)
