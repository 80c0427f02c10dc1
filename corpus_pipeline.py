"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, token files.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the documents its predecessor kept; all but the last
return the columns of documents. run() writes each stage's rows as Parquet in the shared folder and reads
them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language, mixing, near_dedup, token_files
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.textops import bucket
from palimpsest.session import written


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 texts and about 16 MB, for the whole application, so that workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language: those that are und or score under 0.35.

    Null, empty and letterless texts are und and go. Very long texts are judged whole, equal rows alike; ties between
    languages go to the first by name. Labels come from lang, where it is not null; where nothing can be learned every
    document goes. All columns of docs are passed on, whatever their names; an empty table stays one.
    """
    small_batches(spark)
    model = language.fit(docs.where(bucket(F.col("doc_id"), 4) != 2))
    return language.with_known_language(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of copies and near copies (five words, 0.8).

    Null and empty texts are linked with nothing and stay. Of rows with the smallest id the one with the smallest hash of
    its text stays, of repeated rows one. Very long texts are compared whole. All columns are passed on, whatever their
    names; an empty table stays one.
    """
    small_batches(spark)
    return near_dedup.without_near_duplicates(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole item of fewer.

    Null and empty texts have no words and stay; a null item has no windows. Very long texts are scanned whole, repeated
    rows judged alike. All columns are passed on, whatever their names; an empty benchmark drops nothing.
    """
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items, n=10, mode="documents")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics have their target shares of half of the tokens.

    A null source or language is a level of its own; null and empty texts have no tokens and the chance of their cell.
    Whether a document stays hangs on its id alone, so repeated ids stay or go together. Very long texts count whole. All
    columns are passed on, whatever their names; an empty table stays one.
    """
    small_batches(spark)
    return mixing.mixed(docs, share=0.5)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file in ascending id order and returns what is read back from it: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have just the end id. Documents of one id, and repeated rows, are written in the order of their
    texts; very long texts are several blocks. Other columns of docs are left out; an empty table gives no rows.
    """
    small_batches(spark)
    return token_files.token_rows(docs, tokenizer_path(), end_id=2)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
    ("token-ID output", token_output),
]

#: The models and the sampling hash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
