"""Graph queries over supplier-part edges and the nation graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import communities as C
from palimpsest.operators import graphs as G
from palimpsest.operators import pruning as P
from palimpsest.plans.registry import query
from palimpsest.sources.tables import EDGES_SQL, EVENTS_SQL, edge_tasks, edges, table, tool_events

_WHOLE = f"{EDGES_SQL}, e as (select src, dst, weight from edges)"
_BOTH = "b as (select src, dst, max(weight) as weight from (select src, dst, weight from e union all select dst, src, weight from e) where src <> dst group by 1, 2)"


def whole(spark, d):
    return edges(spark, d).select("src", "dst", "weight")


@query("q150_graph_assembly", f"with {EDGES_SQL}, u as (select src, dst, weight from edges union all select src, dst, weight + 1 from edges where weight % 2 = 0) select src, dst, max(weight) as weight from u group by 1, 2 union all select s_suppkey, null, 0 from supplier where s_suppkey not in (select src from edges)")
def assembly(spark, d):
    e = edges(spark, d).select("src", "dst", "weight")
    # Both weights of a pair come from its one row, so they meet where the pair was counted.
    weights = F.filter(F.array("weight", F.when(F.col("weight") % 2 == 0, F.col("weight") + 1)), lambda w: w.isNotNull())
    merged = e.select("src", "dst", F.explode(weights).alias("weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    lone = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src")).join(e, "src", "left_anti")
    return merged.union(lone.select("src", F.lit(None).cast("long"), F.lit(0).cast("long")))


def _pagerank_sql(rounds: int) -> str:
    steps = ["nodes as (select src as node from e union select dst from e)", "n as (select count(*) as n from nodes)", "sh as (select src, dst, weight / sum(weight) over (partition by src) as share from e)", "r0 as (select node, 1.0::double / n as rank from nodes, n)"]
    for i in range(rounds):
        steps.append(f"l{i} as materialized (select coalesce(sum(rank), 0) as loose from r{i} where node not in (select src from e))")
        steps.append(
            f"r{i + 1} as materialized (select node, 0.85 * (coalesce(got, 0) + loose / n) + 0.15 / n as rank from nodes left join (select dst, sum(share * rank) as got from sh join r{i} on src = node group by dst) on dst = node, l{i}, n)"
        )
    return f"with {_WHOLE}, " + ", ".join(steps) + f" select node, round(rank, 8) as rank from r{rounds}"


@query("q151_pagerank", _pagerank_sql(20))
def pagerank(spark, d):
    return G.pagerank(whole(spark, d), tasks=edge_tasks(spark, d)).select("node", F.round("rank", 8).alias("rank"))


@query("q109_top_by_pagerank", _pagerank_sql(20).replace("select node, round(rank, 8) as rank from r20", "select node, round(rank, 6) as rank from r20 order by round(rank, 6) desc, node limit 20"))
def top_by_pagerank(spark, d):
    return G.pagerank(whole(spark, d), tasks=edge_tasks(spark, d)).select("node", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "node").limit(20)


@query("q152_degree_centrality", f"with {EDGES_SQL}, n as (select src as node from edges union all select dst from edges) select node, count(*) as degree, round(count(*) / (select count(distinct node) - 1 from n), 6) as centrality from n group by 1")
def degree(spark, d):
    ends = edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node"))
    counts = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    others = max(counts.count() - 1, 1)
    return counts.withColumn("centrality", F.round(F.col("degree") / F.lit(others), 6))


def _lpa_sql(rounds: int) -> str:
    steps = ["l0 as (select distinct src as node, src as label from b)"]
    for i in range(rounds):
        steps.append(f"v{i} as (select b.src as node, label, sum(weight) as w from b join l{i} on b.dst = l{i}.node group by 1, 2)")
        steps.append(f"l{i + 1} as materialized (select node, arg_min(label, (-w, label)) as label from v{i} group by 1)")
    return f"with {_WHOLE}, {_BOTH}, " + ", ".join(steps) + f" select node, label from l{rounds}"


@query("q154_label_propagation", _lpa_sql(4))
def label_propagation(spark, d):
    return G.label_propagation(whole(spark, d), 4, tasks=edge_tasks(spark, d))


@query("q155_leiden")
def leiden(spark, d):
    """Communities of largest modularity over all edges. SQL can't express the rounds; tests hold them against a sequential form."""
    return C.leiden(whole(spark, d), max_levels=4, max_rounds=6)


@query(
    "q158_breadth_first",
    f"""with recursive {_WHOLE}, {_BOTH}, w as (select 1::bigint as node, 0 as hops union select b.dst, hops + 1 from w join b on b.src = w.node where hops < 3) select node, min(hops) as hops from w group by 1""",
)
def breadth_first(spark, d):
    return G.reached(whole(spark, d), spark.createDataFrame([(1,)], "node long"), 3, tasks=edge_tasks(spark, d))


def _components_sql(rounds: int) -> str:
    steps = ["c0 as (select distinct src as node, src as component from b)"]
    for i in range(rounds):
        steps.append(f"c{i + 1} as materialized (select b.src as node, least(min(m.component), min(o.component)) as component from b join c{i} m on m.node = b.dst join c{i} o on o.node = b.src group by 1)")
    return f"with {_WHOLE}, {_BOTH}, " + ", ".join(steps) + f" select node, component from c{rounds}"


@query("q159_components", _components_sql(12))
def components(spark, d):
    return G.components(whole(spark, d), tasks=edge_tasks(spark, d))


_NATION = "e as (select n_nationkey as src, (n_nationkey * 2) % 25 as dst, 1 as weight from nation)"


def nation_edges(spark, d):
    n = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(n.alias("src"), (n * 2 % 25).alias("dst"), F.lit(1).alias("weight"))


def _betweenness_sql(depth: int) -> str:
    steps = ["l0 as (select distinct src::bigint as s, src::bigint as v, 1.0::double as paths from b)", "n0 as (select s, v from l0)"]
    for i in range(depth):
        steps.append(
            f"l{i + 1} as materialized (select s, dst as v, sum(paths) as paths from l{i} join b on b.src = v where (s, dst) not in (select s, v from n{i}) group by 1, 2), n{i + 1} as materialized (select s, v from n{i} union select s, v from l{i + 1})"
        )
    steps.append(f"d{depth} as (select s, v, paths, 0.0::double as d from l{depth})")
    for i in range(depth, 1, -1):
        steps.append(
            f"d{i - 1} as materialized (select l.s, l.v, l.paths, coalesce(sum(l.paths / w.paths * (1 + w.d)), 0) as d from l{i - 1} l left join (select d{i}.*, b.src as u from d{i} join b on b.dst = d{i}.v) w on w.s = l.s and w.u = l.v group by 1, 2, 3)"
        )
    every = " union all ".join(f"select v, d from d{i}" for i in range(1, depth + 1))
    return f"with {_NATION}, {_BOTH}, " + ", ".join(steps) + f" select v::bigint as node, round(sum(d) / 2, 6) as score from ({every}) group by 1"


@query("q153_betweenness", _betweenness_sql(5))
def betweenness(spark, d):
    return G.betweenness(nation_edges(spark, d), 5).select("node", F.round("score", 6).alias("score"))


@query(
    "q163_blast_radius",
    f"""with recursive {EDGES_SQL}, e as (select src, dst, weight from edges where weight >= 2), {_BOTH}, w as (select 3::bigint as node, 0 as hops union select b.dst, hops + 1 from w join b on b.src = w.node where hops < 2) select node, min(hops) as hops from w group by 1""",
)
def blast_radius(spark, d):
    return G.reached(edges(spark, d).where("weight >= 2"), spark.createDataFrame([(3,)], "node long"), 2, tasks=edge_tasks(spark, d))


def _spread_sql(rounds: int) -> str:
    steps = ["k as (select src, dst, weight / sum(weight) over (partition by src) as w from b)", "a0 as (select 1 as node, 1.0::double as a)"]
    for i in range(rounds):
        steps.append(
            f"t{i} as (select node, round(sum(a), 9) as a from (select node, 0.5 * a as a from a{i} union all select dst, 0.8 * w * a from k join a{i} on src = node) group by 1), a{i + 1} as materialized (select node, a from t{i} order by a desc, node limit 10)"
        )
    return f"with {_WHOLE}, {_BOTH}, " + ", ".join(steps) + f" select node, round(1 / (1 + exp(-(a - 0.2))), 6) as activation from a{rounds}"


@query("q126_spreading_activation", _spread_sql(3))
def spreading(spark, d):
    return G.spread(whole(spark, d), spark.createDataFrame([(1, 1.0)], "node long, activation double"), tasks=edge_tasks(spark, d))


@query(
    "q160_edge_pruning",
    f"""with {EDGES_SQL} select count(*) filter (where src = dst) as loops, count(*) filter (where weight < 2) as light, count(*) filter (where src not in (select s_suppkey from supplier where s_suppkey % 9 <> 0)) as orphans from edges""",
)
def pruning(spark, d):
    live = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("src"), F.lit(1).alias("live"))
    e = edges(spark, d).join(live, "src", "left")
    return e.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count_if(F.col("weight") < 2).alias("light"), F.count_if(F.col("live").isNull()).alias("orphans"))


_ORDERS = 1_000_000_000


@query(
    "q160_prune_counts",
    f"""with recursive {EDGES_SQL}, chain as (select {_ORDERS} + o_orderkey as src, {_ORDERS} + lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst from orders),
        e as (select src * 1000000 - dst as edge_id, src, dst, edge_type, weight::double as weight from edges union all select {5 * _ORDERS} + src * 1000000 - dst, src, dst, edge_type, weight - 1 from edges where weight % 2 = 0
              union all select -src, src, dst, 'supersedes', 9 from chain where dst is not null),
        live as (select s_suppkey as node from supplier where s_suppkey % 9 <> 0 union all select -p_partkey from part union all select {_ORDERS} + o_orderkey from orders where o_orderkey % 17 <> 0),
        m as (select *, case when weight < 2 then 'light' when src not in (select node from live) or dst not in (select node from live) then 'orphan' when src = dst then 'loop' end as reason from e),
        dup as (select *, row_number() over (partition by src, dst, edge_type order by weight desc, edge_id) as rn from m where reason is null),
        one as (select * from dup where rn = 1), up as (select dst as node, min(src) as head from one where edge_type = 'supersedes' group by 1 having count(*) = 1),
        walk as (select node, head from up where head not in (select node from up) union all select up.node, walk.head from up join walk on up.head = walk.node),
        inner_ as (select edge_id, head, dst, weight from one join walk on one.src = walk.node where edge_type = 'supersedes'),
        rest as (select edge_id, src, dst, edge_type, weight, false as added from one where edge_id not in (select edge_id from inner_)
                 union all select 0, head, i.dst, 'supersedes', max(weight), true from inner_ i where not exists (select 1 from one r where r.src = i.head and r.dst = i.dst and r.edge_type = 'supersedes') group by head, i.dst),
        hub as (select *, row_number() over (partition by src order by weight desc, edge_id) as a, row_number() over (partition by dst order by weight desc, edge_id) as b from rest)
        select reason, count(*) as n from (select reason from m where reason is not null union all select 'duplicate' from dup where rn > 1 union all select 'chain' from inner_
          union all select case when a > 100 or b > 100 then 'hub' when added then 'added' else 'kept' end from hub) group by 1""",
)
def prune_counts(spark, d):
    """A dry run over supplier-part edges, weaker copies of some, and each customer's orders, which supersede the one before."""
    e = edges(spark, d)
    own = e.select((F.col("src") * 1_000_000 - F.col("dst")).alias("edge_id"), "src", "dst", "edge_type", F.col("weight").cast("double").alias("weight"))
    weaker = own.where("weight % 2 = 0").withColumns({"edge_id": F.col("edge_id") + 5 * _ORDERS, "weight": F.col("weight") - 1})
    o = table(spark, d, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = o.select((_ORDERS + F.col("o_orderkey")).alias("src"), (_ORDERS + before).alias("dst")).where("dst is not null")
    chain = chain.select((-F.col("src")).alias("edge_id"), "src", "dst", F.lit("supersedes").alias("edge_type"), F.lit(9.0).alias("weight"))
    live = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("node")).union(table(spark, d, "part").select(-F.col("p_partkey"))).union(o.where("o_orderkey % 17 <> 0").select(_ORDERS + F.col("o_orderkey")))
    return P.counts(P.marked(own.unionByName(weaker).unionByName(chain), live, min_weight=2.0))


@query(
    "q161_temporal_edges",
    """with n as (select o_custkey, o_orderkey, lead(o_orderkey) over w as next, (epoch(lead(o_orderdate) over w) - epoch(o_orderdate)) / 86400 as days from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
       select o_orderkey as src, next as dst, round(exp(-days / 30), 6) as weight from n where next is not null and days <= 90""",
)
def temporal_edges(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = (F.unix_timestamp(F.lead("o_orderdate").over(w)) - F.unix_timestamp("o_orderdate")) / 86400
    n = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), days.alias("days"))
    return n.where("dst is not null and days <= 90").select("src", "dst", F.round(F.exp(-F.col("days") / 30), 6).alias("weight"))


@query(
    "q162_hebbian_links",
    f"""with {EVENTS_SQL}, t as (select distinct session_id, event_id % 40 as f from tool_events), p as (select a.f as a, b.f as b, count(*) as n from t a join t b on a.session_id = b.session_id and a.f < b.f group by 1, 2)
        select a, b, round(least(1.0, 0.1 + 0.05 * n) * exp(-0.01 * (a + b)), 6) as weight from p where least(1.0, 0.1 + 0.05 * n) * exp(-0.01 * (a + b)) >= 0.05""",
)
def hebbian(spark, d):
    from palimpsest.operators.mining import co_occurrence

    t = tool_events(spark, d).withColumn("f", F.col("event_id") % 40)
    weight = F.least(F.lit(1.0), 0.1 + 0.05 * F.col("n")) * F.exp(-0.01 * (F.col("a") + F.col("b")))
    p = co_occurrence(t, "session_id", "f").withColumn("weight", weight).where("weight >= 0.05")
    return p.select("a", "b", F.round("weight", 6).alias("weight"))


@query(
    "q164_execution_flows",
    "with recursive e as (select n_nationkey::bigint as src, (n_nationkey // 2)::bigint as dst from nation where n_nationkey > 0), w as (select src as root, src as node, 0 as hops from e where src not in (select dst from e) union select w.root, e.dst, hops + 1 from w join e on e.src = w.node where hops < 4) select root, count(distinct node) as reached from w group by 1",
)
def flows(spark, d):
    """Entry points, which nothing calls, and how much they reach in four calls."""
    n = F.col("n_nationkey")
    e = table(spark, d, "nation").where("n_nationkey > 0").select(n.cast("long").alias("src"), F.floor(n / 2).alias("dst"))
    roots = e.select(F.col("src").alias("root")).join(e.select(F.col("dst").alias("root")), "root", "left_anti").distinct()
    found = front = roots.select("root", F.col("root").alias("node"))
    for _ in range(4):
        front = front.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        found = found.union(front)
    return found.distinct().groupBy("root").agg(F.count(F.lit(1)).alias("reached"))


@query(
    "q166_coupling",
    f"with {EDGES_SQL} select s_nationkey as a, cast(-dst % 10 as int) as b, count(*) as n from edges join supplier on s_suppkey = src group by 1, 2",
)
def coupling(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("a"))
    return edges(spark, d).join(s, "src").groupBy("a", (-F.col("dst") % 10).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
