"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII upper case lowered. A window is
n consecutive words of an item; an item of fewer words is one window. Window hashes are looked up first in a
bit table, then in a dict, and every hit is compared word by word before it counts.

The broadcast is bounded: a benchmark of more than broadcast_bytes of text is not broadcast; the documents' windows meet
the items' windows in a shuffled join, and those that meet are compared word by word. Results are the same.

Null or empty texts have no words and no hits; repeated rows are judged alike; very long texts are scanned whole. An item
id that is null is the empty id, repeated item ids are one item with the windows of all its texts. An empty benchmark
gives no hits, an empty table no rows. Columns of docs other than the id and the text are passed on, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import ALNUM, chunks, scan, windows
from palimpsest.session import written

SCAN_TYPE = "n_words long, froms array<int>, tos array<int>, items array<string>"
_TABLE_BITS = 20


def window_index(items: list[tuple[str, str | None]], n: int) -> dict[int, dict[int, dict[bytes, set[str]]]]:
    """length -> hash -> the window's words -> ids of the items that hold it."""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item_id, text in items:
        for _, held in chunks([text]):
            found = scan(held, ALNUM)
            count = len(found.starts)
            length = min(n, count)
            if not length:
                continue
            words = [found.buf[s:e] for s, e in zip(found.starts, found.ends, strict=True)]
            for i, h in enumerate(windows(found.hashes, length).tolist()):
                index[length][h][b" ".join(words[i : i + length])].add(item_id)
    return {length: {h: dict(grams) for h, grams in by.items()} for length, by in index.items()}


def _bit_table(hashes) -> np.ndarray:
    table = np.zeros(1 << _TABLE_BITS, bool)
    if len(hashes):
        table[np.fromiter(hashes, np.uint64, len(hashes)) & np.uint64(len(table) - 1)] = True
    return table


def scan_texts(texts, index) -> pd.DataFrame:
    """One row per text: its words, the merged word spans [from, to) inside window hits, and the items hit."""
    tables = {length: _bit_table(by.keys()) for length, by in index.items()}
    out: list[tuple] = []
    for _, held in chunks(texts):
        words = scan(held, ALNUM)
        bounds = words.first
        hit: dict[int, list[tuple[int, int, set[str]]]] = defaultdict(list)
        for length, by in index.items():
            keys = windows(words.hashes, length)
            at = np.flatnonzero(tables[length][keys & np.uint64((1 << _TABLE_BITS) - 1)])
            doc = np.searchsorted(bounds, at, "right") - 1
            inside = at + length <= bounds[doc + 1]
            for i, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                grams = by.get(int(keys[i]))
                if grams:
                    own = b" ".join(words.buf[s:e] for s, e in zip(words.starts[i : i + length], words.ends[i : i + length], strict=True))
                    if own in grams:
                        hit[d].append((i - int(bounds[d]), length, grams[own]))
        for d in range(len(held)):
            froms: list[int] = []
            tos: list[int] = []
            items: set[str] = set()
            for start, length, ids in sorted(hit.get(d, ()), key=lambda x: x[:2]):
                items |= ids
                if tos and start <= tos[-1]:
                    tos[-1] = max(tos[-1], start + length)
                else:
                    froms.append(start)
                    tos.append(start + length)
            out.append((int(bounds[d + 1] - bounds[d]), froms, tos, sorted(items)))
    return pd.DataFrame(out, columns=["n_words", "froms", "tos", "items"])


def without_spans(text: str | None, froms, tos) -> str | None:
    """text without the bytes from each span's first word to the end of its last."""
    if text is None or not len(froms):
        return text
    data = text.encode("utf-8", "surrogatepass")
    words = scan([data], ALNUM)
    kept, at = [], 0
    for start, end in zip(froms, tos, strict=True):
        kept.append(data[at : words.starts[start]])
        at = int(words.ends[end - 1])
    return (b"".join(kept) + data[at:]).decode("utf-8", "surrogatepass")


def item_rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))


def scanner(items: DataFrame, n: int):
    """The scan of texts against all windows of items (item, text), whose index is broadcast."""
    shared = items.sparkSession.sparkContext.broadcast(window_index([tuple(r) for r in items.collect()], n))

    @F.pandas_udf(SCAN_TYPE)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        return scan_texts(texts, shared.value)

    return scanned


def windows_of(texts, n: int, lengths) -> Iterator[tuple[int, int, int, np.ndarray, list[bytes]]]:
    """(number of the text, its words, length, hashes of all windows of that length, words) of each text."""
    at = 0
    for _, held in chunks(texts):
        found = scan(held, ALNUM)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            words = [found.buf[s:e] for s, e in zip(found.starts[a:b].tolist(), found.ends[a:b].tolist(), strict=True)]
            for length in lengths if lengths is not None else [min(n, b - a)]:
                if 0 < length <= b - a:
                    yield at, b - a, length, windows(found.hashes[a:b], length), words
            at += 1


def shuffled_spans(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """row, froms, tos and items of the rows (row, text) that hold windows of items (item, text), by shuffled joins.

    The rows' windows meet the items' by length and hash; those that meet are compared word by word.
    """

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, _, length, hashes, words in windows_of(batch["text"], n, None):
                grams = [b" ".join(words[k : k + length]) for k in range(len(hashes))]
                yield pd.DataFrame({"length": length, "hash": hashes.astype(np.int64), "gram": grams, "item": batch["item"].iloc[i]})

    known = items.mapInPandas(item_windows, "length int, hash long, gram binary, item string")
    known = written(known.groupBy("length", "hash", "gram").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most n

    def row_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, _, length, hashes, _ in windows_of(batch["text"], n, lengths):
                yield pd.DataFrame({"row": batch["row"].iloc[i], "length": length, "start": np.arange(len(hashes)), "hash": hashes.astype(np.int64)})

    places = rows.mapInPandas(row_windows, "row long, length int, start int, hash long")
    places = places.join(known.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    places = places.groupBy("row").agg(F.collect_list(F.struct("length", "start")).alias("places"))  # no more than a row's words and lengths

    def grams_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, at in zip(batch["row"], batch["text"], batch["places"], strict=True):
                words = [w for _, held in chunks([text]) for w in scan(held, ALNUM).buf.split()]
                spans = [(p["start"], p["length"]) for p in at]
                yield pd.DataFrame({"row": row, "start": [s for s, _ in spans], "length": [k for _, k in spans], "gram": [b" ".join(words[s : s + k]) for s, k in spans]})

    hits = rows.join(places, "row").mapInPandas(grams_of, "row long, start int, length int, gram binary")
    hits = written(hits.join(known.select("length", "gram", "items"), ["length", "gram"]).select("row", "start", "length", "items"), "hits")
    own = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    ordered = hits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))

    @F.pandas_udf("froms array<int>, tos array<int>")
    def merged(spans: pd.Series) -> pd.DataFrame:
        out = []
        for row in spans:
            froms: list[int] = []
            tos: list[int] = []
            for span in row:
                if tos and span["start"] <= tos[-1]:
                    tos[-1] = max(tos[-1], span["end"])
                else:
                    froms.append(span["start"])
                    tos.append(span["end"])
            out.append((froms, tos))
        return pd.DataFrame(out, columns=["froms", "tos"])

    return ordered.select("row", merged("spans").alias("s")).select("row", "s.*").join(own, "row")


def marked(docs: DataFrame, items: DataFrame, n: int, text_col: str, broadcast_bytes: int) -> DataFrame:
    """_row (the columns of docs) and _found (SCAN_TYPE)."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    held = docs.select(F.struct("*").alias("_row"))
    text = F.col("_row")[text_col]
    if size <= broadcast_bytes:
        return held.select("_row", scanner(items, n)(text).alias("_found"))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([int(x) for _, part in chunks(texts) for x in np.diff(scan(part, ALNUM).first)])

    held = written(held.withColumn("_at", F.monotonically_increasing_id()), "documents")
    spans = shuffled_spans(held.select(F.col("_at").alias("row"), text.alias("text")), items, n)
    none = F.array().cast("array<int>")
    return held.join(spans.withColumnRenamed("row", "_at"), "_at", "left").select(
        "_row",
        F.struct(
            counted(text).alias("n_words"), F.coalesce("froms", none).alias("froms"), F.coalesce("tos", none).alias("tos"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ).alias("_found"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """doc id, n_words, froms and tos (word spans inside hits), items (ids of items with occurring windows)."""
    found = marked(docs.select(id_col, text_col), item_rows(items, item_id_col, item_text_col), n, text_col, broadcast_bytes)
    return found.select(F.col("_row")[id_col].alias(id_col), "_found.*")


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    n: int = 10,
    mode: str = "documents",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """docs with all their columns, without hit documents (mode documents) or without hit spans (mode spans)."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    found = marked(docs, item_rows(items, item_id_col, item_text_col), n, text_col, broadcast_bytes)
    if mode == "documents":
        return found.where(F.size("_found.froms") == 0).select("_row.*")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, froms: pd.Series, tos: pd.Series) -> pd.Series:
        return pd.Series([without_spans(*x) for x in zip(texts, froms, tos, strict=True)], dtype=object)

    text = cut(F.col("_row")[text_col], F.col("_found.froms"), F.col("_found.tos"))
    return found.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
