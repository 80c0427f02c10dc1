"""The queries opN_<name> over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, collocations, decontaminate, language, licenses, mixing, multiset, near_dedup, suffix_tree, token_files, toxicity, url_filter, vector_codes
from palimpsest.llm.oracles import RULES, SPAM_HOSTS, SQL
from palimpsest.llm.textops import bucket

__all__ = ["QUERIES", "SQL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(names) -> F.Column:
    return F.concat_ws(",", names)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_filter.parts(F.col("url"))
    spam = pages.select(host.alias("h"), path.alias("p")).where(F.regexp_replace("h", r"^(www|m|blog)\.", "").isin(*SPAM_HOSTS))
    listed = spam.select(url_filter.canonical(F.col("h"), F.col("p")).alias("canonical"))
    return url_filter.filter_urls(pages, listed, RULES).drop("possible", "listed")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 10) == 0
    counts = suffix_tree.count(docs.where(~held_out))
    scored = suffix_tree.score(docs, counts, suffix_tree.fit(counts))
    tokens = F.lit(counts.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = bucket(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out))
    found = language.language_column(F.col("text"), model, spark)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(bucket(F.col("doc_id"), 4) != 2)
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_rows(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), share=0.5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.withColumns({"base_labels": joined("base_labels"), "labels": joined("labels")}).drop("spans")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    n_hit = F.aggregate(F.zip_with("froms", "tos", lambda a, b: b - a), F.lit(0), lambda x, y: x + y).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined("items").cast("binary"), 256).alias("items_sha256"),
        (F.size("froms") > 0).alias("contaminated"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    rows = found.rows.select("vec_id", "label", vector_codes.code(4).alias("code"), "error")
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat_format.digests(chat_format.formatted(turns.union(added)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_lm_score": op2_lm_score,
    "op3_language_id": op3_language_id,
    "op4_token_ids": op4_token_ids,
    "op5_license_scan": op5_license_scan,
    "op6_multiset_fingerprint": op6_multiset_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_chat_format": op12_chat_format,
    "op13_collocations": op13_collocations,
}
