"""Odd rows and sizes on which queries once differed from their SQL or outgrew a machine."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from palimpsest.plans import catalog


def against_sql(spark, tmp_path, name, **tables):
    """The query's and its SQL's rows over tables (rows, schema) as sorted lists."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.SQL[name]).df()
    columns = list(want.columns)
    assert sorted(got.columns) == sorted(columns)
    return [sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).values.tolist()), key=repr) for f in (got, want)]


@pytest.mark.parametrize("name", ["q190_signals", "q191_emotion"])
def test_words_end_at_letters_with_accents(spark, tmp_path, name):
    texts = ["noñcodota", "la ñno que", "no", "no_", "éalways good", "goodé bad!", "wrong9", "not.", None, "loveê hate love"]
    got, want = against_sql(spark, tmp_path, name, conversations=([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    assert got == want


def test_look_ahead_keeps_fractions_of_seconds(spark, tmp_path):
    """0.2 s apart across a full second is not yet one second later; a day and 0.3 s is out of reach."""
    times = ["2024-01-01 00:00:00.900000", "2024-01-01 00:00:01.100000", "2024-01-01 00:00:01.900000", "2024-01-02 00:00:01.200000", "2024-01-02 00:00:01.950000"]
    rows = [(i, t, 1, "view", 60.0, '{"k": 1}') for i, t in enumerate(times)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string")
    frame.selectExpr("event_id", "cast(t as timestamp) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/e")
    rows = spark.read.parquet(f"{tmp_path}/e")
    got, want = against_sql(spark, tmp_path, "q054_look_ahead", events=(rows.rdd, rows.schema))
    assert got == want


def test_plays_of_one_file_are_dealt_to_all_tasks(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators import trials

    plays = spark.range(64).coalesce(1).selectExpr("id as play", "'s' as stratum")
    posteriors = spark.createDataFrame([("s", 0, 3.0, 1.0)], "stratum string, arm int, alpha double, beta double")
    found = trials.thompson(plays, posteriors, [0, 1]).withColumn("task", F.spark_partition_id())
    assert {r["task"] for r in found.collect()} == set(range(4))


def test_blocks_score_some_queries_at_a_time(spark, monkeypatch):
    """However large a block, no matrix of scores is larger than the bound."""
    import numpy as np

    from palimpsest.operators import neighbours

    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rng.integers(-2, 3, (300, 4)))], "fact_id long, embedding array<double>")

    def scorer(q, own):
        score = neighbours.cosines(q, own)

        def bounded(rows):
            found = score(rows)
            assert found.size <= 4096
            return found

        return bounded

    whole = neighbours.best_in_blocks(v.withColumnRenamed("fact_id", "query_id"), v, 5).collect()
    monkeypatch.setattr(neighbours, "SCORES", 4096)
    parts = neighbours.best_in_blocks(v.withColumnRenamed("fact_id", "query_id"), v, 5, scorer).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(parts) == 1500


def test_sides_are_shuffled_once_for_each_group(spark, monkeypatch):
    """Groups are several blocks, so a side is not copied for each block of the other; ties across blocks go to the smaller id."""
    import numpy as np

    from palimpsest.operators import neighbours

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (400, 4)) + np.array([0.1, 1, 0, 0])
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "fact_id long, embedding array<double>")
    copies = []
    dealt = neighbours.dealt
    monkeypatch.setattr(neighbours, "dealt", lambda rows, *a: copies.append(dealt(rows, *a)) or copies[-1])
    monkeypatch.setattr(neighbours, "LEAST", 400)
    got = neighbours.best_in_blocks(v.withColumnRenamed("fact_id", "query_id"), v, 6, query_block=50, item_block=25)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert {(r["query_id"], r["fact_id"]) for r in got.collect()} == {(i, int(j)) for i in range(400) for j in sorted(range(400), key=lambda j: (-s[i, j], j))[:6]}
    assert [c.count() for c in copies] == [400, 400]
    assert neighbours.groups(720_000, 3_000_000, 131_072, 262_144, 24) == (6, 12)
    # Numbers that are floats travel as floats, others stay as they are.
    mixed = neighbours.narrowed(spark.createDataFrame([([1.0, 2.5],), ([0.1, 2.0],), (None,)], "embedding array<double>")).toArrow()
    assert mixed["narrow"].to_pylist() == [[1.0, 2.5], None, None] and mixed["embedding"].to_pylist() == [None, [0.1, 2.0], None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_facts_with_a_partner_search(spark, monkeypatch):
    """Of 40 facts only three share more than .8 of their entities with another."""
    from palimpsest.operators import merging

    words = lambda i: [f"w{i}_{j}" for j in range(6)]
    sets = [words(i) for i in range(37)] + [["a"] * 2, ["a"], [f"w0_{j}" for j in range(6)] + ["more"]]
    rows = [(i, [1.0, i / 40], e, 0.5, 0.5, "2024-01-01") for i, e in enumerate(sets)]
    f = spark.createDataFrame(rows, "fact_id long, embedding array<double>, entities array<string>, importance double, confidence double, created_at string")
    asked = []
    nearest = merging.nearest
    monkeypatch.setattr(merging, "nearest", lambda v, q, k: asked.append(sorted(r[0] for r in q.select("query_id").collect())) or nearest(v, q, k))
    assert sorted((r["canonical_id"], r["merged_id"]) for r in merging.candidates(f, k=39).where("cosine > 0").collect()) == [(37, 38)]
    assert asked == [[0, 37, 38, 39]]


def test_search_over_codes_is_exact_with_few_candidates(spark):
    import numpy as np

    from palimpsest.operators import quantise

    rng = np.random.default_rng(9)
    x = rng.standard_normal((600, 32))
    x[300:400] = x[300]  # copies, more than there are candidates
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "fact_id long, embedding array<double>")
    q = quantise.Quantiser(32, 2, "turbo", sketch=32)
    queries = v.where("fact_id % 20 = 0").selectExpr("fact_id as query_id", "embedding")
    got = {(r["query_id"], r["fact_id"]) for r in quantise.search(queries, quantise.coded(v, q), v, q, 10, 12).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    assert got == {(i, int(j)) for i in range(0, 600, 20) for j in sorted(range(600), key=lambda j: (-s[i, j], j))[:10]}


def test_codes_and_vectors_are_not_shuffled(spark):
    assert "Exchange" not in plan(catalog.QUERIES["q178_quantiser_errors"](spark, "/root/testdata/sf0.001"))


def test_each_pair_of_names_is_compared_once(spark, tmp_path):
    parts = [(i, ("large ring", "large rings", "largest bolt")[i % 3], "b", 1) for i in range(30)]
    got, want = against_sql(spark, tmp_path, "q193_name_matches", part=(parts, "p_partkey long, p_name string, p_brand string, p_size int"))
    assert got == want and len(got) > 100
    assert plan(catalog.QUERIES["q193_name_matches"](spark, str(tmp_path))).count("Aggregate") >= 2  # distinct names come first


def test_pairs_of_messages_and_users_come_from_lists(spark, tmp_path, monkeypatch):
    from palimpsest.plans import joins

    events = [(i, i % 37, ("view", "click")[i % 2]) for i in range(300)]
    tables = {"events": (events, "event_id long, user_id long, event_type string"), "customer": ([(i,) for i in range(150)], "c_custkey long")}
    got, want = against_sql(spark, tmp_path, "q058_read_receipts", **tables)
    assert got == want
    monkeypatch.setattr(joins, "PEERS", 4)
    monkeypatch.setattr(joins, "BROADCAST_LISTS", 2)  # the way for many users
    assert sorted(map(tuple, catalog.QUERIES["q058_read_receipts"](spark, str(tmp_path)).select("msg", "user_id", "state").collect()), key=repr) == want
    assert "Generate explode(ids" in plan(catalog.QUERIES["q058_read_receipts"](spark, str(tmp_path)))


def test_pairs_of_messages_and_users_are_written_small(spark, tmp_path):
    """What repeats is near enough in the rows for Parquet to find: far less than the bits of a user's number for each pair."""
    spark.range(30_000).selectExpr("id as event_id", "id as user_id", "'click' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(500).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    catalog.QUERIES["q058_read_receipts"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.distinct().count() == 500 * 6000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 500 * 6000 * 0.6


def test_similarities_of_many_pairs_are_those_of_each():
    import numpy as np

    from palimpsest.functions.similarity import winkler
    from palimpsest.operators import entities as E

    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"martha", "marhta", "aaaaaaaa"})
    block = E.Block(names)
    rows, cols = (x.ravel() for x in np.meshgrid(*[np.arange(len(names))] * 2))
    rows, cols = rows[rows != cols], cols[rows != cols]
    want = [winkler(names[i], names[j]) for i, j in zip(rows, cols, strict=True)]
    assert E.similarities(block, block, rows, cols).tolist() == want
    kept = {(i, j) for r, c in E.close(block, block, 0.85) for i, j in zip(r.tolist(), c.tolist(), strict=True)}
    assert kept >= {(i, j) for i, j, s in zip(rows.tolist(), cols.tolist(), want, strict=True) if s >= 0.85}


def test_long_and_foreign_names_are_those_of_all_pairs(spark, monkeypatch):
    """Names over a word's bits, many letters, and blocks of few names give the pairs that all pairs do, each once."""
    from palimpsest.functions.similarity import winkler
    from palimpsest.operators import entities as E

    rng = random.Random(7)
    stems = ["наполеон бонапарт", "王小明 王小明", "é" * 9, "abcdefghij" * 7, "martha", "o", "abcdefghij" * 12 + "zz"]
    names = sorted({"".join(c if rng.random() > 0.15 else rng.choice("abcé王ж") for c in rng.choice(stems)) for _ in range(150)})
    frame = spark.createDataFrame([(x,) for x in names], "name string")
    want = {(x, y): winkler(x, y) for x in names for y in names if x < y and winkler(x, y) >= 0.85}
    for block in (E.BLOCK, 40):
        monkeypatch.setattr(E, "BLOCK", block)
        found = E.similar_names(frame, frame, ordered=True)
        got = [(r["name"], r["other"], r["score"]) for r in found.collect()]
        assert sorted(got) == sorted((x, y, s) for (x, y), s in want.items()) and len(want) > 500
    # Names are not dealt once for each block that they meet, and blocks of one table meet once.
    assert not {"CoGroup", "explode"} & set(re.findall(r"CoGroup|explode", plan(found)))
    blocks = -(-len(names) // 40)
    assert E.met(frame, frame, once=True).count() == blocks * (blocks + 1) // 2


def test_best_names_give_out_few_rows(spark):
    """Of many entities that are alike to a name a task gives out the best: the smallest rank and id of the highest score."""
    from palimpsest.operators import entities as E

    left = spark.createDataFrame([("abcdefghijkl",)], "name string")
    right = spark.createDataFrame([("abcdefghijk" + chr(200 + i), (i + 1) % 2, f"e{i:03}") for i in range(200)] + [("abcdefgh", 0, "a")], "name string, rank int, entity_id string")
    best = E.best_names(left, right)
    row = best.first()
    assert (row["name"], row["rank"], row["entity_id"]) == ("abcdefghijkl", 0, "e001") and best.count() == 1
    assert E.similar_names(left, right.select("name")).count() == 201


def test_edges_and_their_operators_get_tasks_by_the_lines(spark, monkeypatch):
    """Ten times the lines are ten times the tasks, not larger ones; the session's own number comes back."""
    from palimpsest import session
    from palimpsest.operators import graphs as G
    from palimpsest.sources.tables import edge_tasks, edges

    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(session, "ROWS_A_TASK", 6000)
    assert edge_tasks(spark, sf) == 10
    assert edges(spark, sf).rdd.getNumPartitions() == 10
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'; create view supplier as select * from '{sf}/supplier.parquet'")
    for name in ("q150_graph_assembly", "q055_graph_expansion", "q154_label_propagation"):
        assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == sorted(con.execute(catalog.SQL[name]).fetchall())
    seen = []
    G.dealt(lambda e: seen.append(spark.conf.get("spark.sql.shuffle.partitions")))(spark.range(1), tasks=10)
    assert seen == ["10"] and spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_orders_of_one_file_are_read_for_dates_by_all_tasks(spark, tmp_path):
    """Each order keeps its one row, one without a key too."""
    import datetime as dt

    rows = [(i if i else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)]
    table = spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1)
    got, want = against_sql(spark, tmp_path, "q198_text_dates", orders=(table.rdd, table.schema))
    assert got == want and len(got) == 40
    assert catalog.QUERIES["q198_text_dates"](spark, str(tmp_path)).rdd.getNumPartitions() == 4
