"""A folder of transcripts as a stream: each file is taken in once, whenever it comes and however often the job fails.

Spark's file source keeps which files it has given out, and batches that have ended, under the checkpoint folder. A
batch is written to a folder of its own number, replacing what an attempt that failed has left there, so a restart
neither loses nor repeats items; the tables are the batches' folders together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.sources.files import cues

FILES = "path string, modificationTime timestamp, length long, content binary"
ITEMS = "path string, kind string, content string, dedup_key string, speaker string, speakers array<string>, modified timestamp"
ASIDE = "path string, length long, reason string, modified timestamp"


def arrivals(spark: SparkSession, folder: str, files_per_batch: int = 1000, glob: str = "*.{srt,vtt,txt,SRT,VTT,TXT}") -> DataFrame:
    """The stream of the folder's files: path, modificationTime, length, content."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def told_apart(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable files (path, v, kind, digest, modified) and those to put aside (path, length, reason, modified).

    Put aside are files that are not UTF-8, and subtitles without a single cue. Spark's source passes over files of no bytes.
    """
    kind = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    read = files.select("path", "length", F.col("modificationTime").alias("modified"), kind.alias("kind"), F.substring(F.sha2("content", 256), 1, 32).alias("digest"), F.try_validate_utf8(F.col("content").cast("string")).alias("v"))
    reason = F.when(F.col("v").isNull(), "not UTF-8").when((F.col("kind") != "txt") & ~F.col("v").contains("-->"), "no cue")
    read = read.withColumn("reason", reason)
    return read.where("reason is null").select("path", "v", "kind", "digest", "modified"), read.where("reason is not null").select("path", "length", "reason", "modified")


def items(files: DataFrame) -> DataFrame:
    """The items of readable files: each file's text (kind transcript), and one for each of its speakers (kind speaker)."""
    plain = files.where("kind = 'txt'").select("path", F.col("v").alias("said"), F.array().cast("array<string>").alias("speakers"))
    of = cues(files.where("kind <> 'txt'").select("path", "v"))
    line = F.concat(F.lit("["), F.coalesce("speaker", F.lit("unknown")), F.lit("] "), "text")
    # The cues of one file are one row again; their order is that of their times.
    spoken = of.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", line.alias("line")))).alias("lines"), F.array_sort(F.collect_set("speaker")).alias("speakers"))
    spoken = spoken.select("path", F.array_join("lines.line", "\n").alias("said"), "speakers")
    name, stem = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"([^/]*?)\.\w+$", 1)
    both = files.select("path", "digest", "modified").join(plain.union(spoken), "path")
    whole = both.select("path", F.lit("transcript").alias("kind"), F.concat(F.lit("Meeting transcript ("), name, F.lit("):\n"), "said").alias("content"), F.col("digest").alias("dedup_key"), F.lit(None).cast("string").alias("speaker"), "speakers", "modified")
    one = both.select("*", F.explode("speakers").alias("speaker"))
    about = F.concat("speaker", F.lit(" participated in meeting: "), stem, F.lit(". Transcript file: "), name)
    each = one.select("path", F.lit("speaker").alias("kind"), about.alias("content"), F.concat_ws("-", F.lit("speaker"), "speaker", "digest").alias("dedup_key"), "speaker", "speakers", "modified")
    return whole.union(each)


def take_in(spark: SparkSession, folder: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that takes in all files that are there now, and ends. target gets items/ and aside/, a folder a batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good, bad = told_apart(batch)
        items(good).write.mode("overwrite").parquet(f"{target}/items/batch={number}")
        bad.write.mode("overwrite").parquet(f"{target}/aside/batch={number}")
        batch.unpersist()

    stream = arrivals(spark, folder, files_per_batch).writeStream.foreachBatch(put)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def taken_in(spark: SparkSession, target: str) -> DataFrame:
    """The items so far; of items with one key (one file under two names) the first path's."""
    rows = spark.read.schema(ITEMS).parquet(f"{target}/items/batch=*")
    return rows.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "dedup_key"]), F.struct("path", "kind")).alias("r")).select("dedup_key", "r.*")


def put_aside(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(ASIDE).parquet(f"{target}/aside/batch=*")
