"""Text sources (transcripts, mailboxes, calendars, source code) and bundle sinks, by Spark's own readers and writers."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, start, end, speaker, text of each cue of SRT and VTT files."""
    return cues(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v")))


def cues(files: DataFrame) -> DataFrame:
    """path, start, end, speaker, text of each cue of files (path, v: whole text)."""
    raw = files.select("path", F.regexp_replace("v", "\r", "").alias("v"))
    cue = raw.select("path", F.explode(F.split("v", r"\n{2,}")).alias("cue"))
    stamp = r"([0-9:.,]+) --> ([0-9:.,]+)[^\n]*\n(?s:(.*))"
    body = F.trim(F.regexp_replace(F.regexp_extract("cue", stamp, 3), r"\n", " "))
    rows = cue.where(F.col("cue").rlike("-->")).select("path", F.regexp_extract("cue", stamp, 1).alias("start"), F.regexp_extract("cue", stamp, 2).alias("end"), body.alias("b"))
    speaker = F.regexp_extract("b", r"^(?:<v )?([A-Z][\w .'-]{0,40}?)(?:>|:\s)", 1)
    return rows.select("path", "start", "end", F.nullif(speaker, F.lit("")).alias("speaker"), F.regexp_replace("b", r"^(?:<v )?[A-Z][\w .'-]{0,40}?(?:>|:\s)", "").alias("text"))


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """path, sender, subject, date, body of each message of mbox files."""
    raw = spark.read.text(path, wholetext=True, lineSep=None).select(F.col("_metadata.file_path").alias("path"), F.concat(F.lit("\n"), F.regexp_replace("value", "\r", "")).alias("v"))
    mail = raw.select("path", F.explode(F.split("v", r"\nFrom [^\n]*\n")).alias("m")).where(F.trim("m") != "")
    header = lambda name: F.regexp_extract("m", rf"(?im)^{name}:\s*([^\n]*)", 1)
    return mail.select("path", header("From").alias("sender"), header("Subject").alias("subject"), header("Date").alias("date"), F.regexp_replace(F.regexp_extract("m", r"(?s)\n\n(.*)", 1), r"\s+$", "").alias("body"))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """path, uid, summary, start, end of each event of ICS files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n[ \t]", "").alias("v"))
    event = raw.select("path", F.explode(F.regexp_extract_all("v", F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), 1)).alias("e"))
    field = lambda name: F.regexp_extract("e", rf"(?m)^{name}[^:\n]*:([^\n]*)", 1)
    return event.select("path", field("UID").alias("uid"), field("SUMMARY").alias("summary"), field("DTSTART").alias("start"), field("DTEND").alias("end"))


def python_symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (class, function), name, line and called names of Python files; files that do not parse give no rows."""

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    tree = ast.parse(bytes(content))
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                        calls = {getattr(c.func, "id", getattr(c.func, "attr", "")) for c in ast.walk(node) if isinstance(c, ast.Call)}
                        rows.append((name, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, sorted(calls - {""})))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "calls"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(symbols, "path string, kind string, name string, line int, calls array<string>")


def decoded_vectors(column: Column) -> Column:
    """A vector column stored as JSON text."""
    return F.from_json(column, "array<float>")


def write_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """JSON lines of each table and a manifest (name, rows, digest) whose digest does not depend on the order of rows."""
    manifest = None
    for name, rows in sorted(tables.items()):
        rows.write.json(f"{path}/{name}")
        one = digest(rows).select(F.lit(name).alias("name"), "rows", "digest")
        manifest = one if manifest is None else manifest.union(one)
    manifest.write.json(f"{path}/manifest")
    return manifest


def digest(rows: DataFrame) -> DataFrame:
    """rows and digest: the number of rows and the sum of their hashes, as text."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def verified_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle; ValueError if one does not agree with the manifest."""
    manifest = {r["name"]: r for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/manifest").collect()}
    out = {}
    for name, schema in schemas.items():
        rows = spark.read.schema(schema).json(f"{path}/{name}")
        now = digest(rows).first()
        if name not in manifest or (now["rows"], now["digest"]) != (manifest[name]["rows"], manifest[name]["digest"]):
            raise ValueError(f"{name} does not agree with the manifest")
        out[name] = rows
    return out
