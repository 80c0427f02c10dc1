"""Pattern mining over event tables, calibration and term labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(events: DataFrame, by: str, min_count: int) -> DataFrame:
    """a, b, n and share: how often tool b follows another tool a, at least min_count times; shares are of these."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    pairs = events.select(F.col("tool_name").alias("a"), F.lead("tool_name").over(w).alias("b")).where("b is not null and a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def sequences(events: DataFrame, by: str, n: int, min_count: int, top: int) -> DataFrame:
    """gram and n: the most frequent runs of n tools without a repeat in a row."""
    w = Window.partitionBy(by).orderBy("created_at", "event_id")
    steps = [F.lead("tool_name", i).over(w).alias(f"t{i}") for i in range(n)]
    changing = [F.col(f"t{i}") != F.col(f"t{i + 1}") for i in range(n - 1)]
    runs = events.select(*steps)
    for c in changing:
        runs = runs.where(c)
    grams = runs.groupBy(F.concat_ws(">", *[f"t{i}" for i in range(n)]).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return grams.where(F.col("n") >= min_count).orderBy(F.desc("n"), "gram").limit(top)


def shares_of_top(events: DataFrame, column: str, top: int, least: float) -> DataFrame:
    """column and share of the top most frequent values, of those shares over least; shares are of the top ones."""
    best = events.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)
    share = best.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return share.where(F.col("share") > least).select(column, F.round("share", 6).alias("share"))


def co_occurrence(rows: DataFrame, basket: str, item: str) -> DataFrame:
    """a, b and n: in how many baskets two items stand together."""
    one = rows.select(basket, item).distinct()
    a, b = one.withColumnRenamed(item, "a"), one.withColumnRenamed(item, "b")
    return a.join(b, basket).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def calibration(rows: DataFrame, bins: int) -> DataFrame:
    """Brier score, expected and maximum calibration error of p against y, in bins of equal width."""
    place = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    by = rows.groupBy(place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum((F.col("p") - F.col("y")) ** 2).alias("squares")
    )
    gap, n = F.abs(F.col("p") - F.col("y")), F.sum("n")
    return by.agg(F.round(F.sum("squares") / n, 6).alias("brier"), F.round(F.sum(F.col("n") * gap) / n, 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"))


def tfidf_labels(terms: DataFrame, top: int) -> DataFrame:
    """community, term and rank: the terms with the highest tf ln(1 + N / (1 + df)) in each community."""
    tf = terms.groupBy("community", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = terms.select("community").distinct().count()
    scored = tf.join(df, "term").withColumn("s", F.round(F.col("tf") * F.log(1 + F.lit(n) / (1 + F.col("df"))), 6))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("s"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("community", "term", F.col("rank").cast("long"))
