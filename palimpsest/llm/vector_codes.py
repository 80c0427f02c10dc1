"""Vector codes: product quantisation by Lloyd rounds over integers, with Hamerly's two bounds kept beside every part.

A vector is scaled to integers and cut into equal parts; a part's code is its nearest codebook entry, the lower index
of equals. Each vector's row holds, for each part, an upper bound of the distance to its entry and a lower bound of the
distance to the second nearest. After the entries have moved, a part is compared with the whole codebook, in exact
integers, only if its upper bound is not strictly below the lower one (or below half of the way to the next entry).
Bounds are widened by far more than rounding can take from them, so a skipped scan could not have changed a code.

A round is one pass over the rows, which are written again with their bounds; each task adds the sums of its parts to
the same table, so the driver reads at most parts * entries sums a task, added up. Nothing but codebooks reaches the
driver or is broadcast. Ids and labels are never grouped here, so no id or vector is hot.

Left out are vectors that are null or hold null or non-finite components, those whose length is not a positive multiple
of parts, and those of another length than the vector of the smallest id. Null ids come last; equal ids are ordered by
their vectors, so repeated rows give the same codebooks in any order. With fewer vectors than entries, codebooks are
as short as the table; an empty table gives no rows and empty codebooks. Only carried columns come back, beside
assigned and error, which replace columns of those names. A scaled component of 2**29 or more in size would leave 64-bit
distances and raises ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from palimpsest.session import discard, written

LIMIT = 1 << 29
#: Relative widening of bounds, some 4,000 times the rounding of the few operations on them.
SLACK = 1e-12


class Codes(NamedTuple):
    """rows: carried columns, assigned (entry of each part) and error (squared distance); scans: whole scans a pass."""

    rows: DataFrame
    codebooks: np.ndarray
    scans: list[int]

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def is_whole(vector: Column, parts: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.coalesce(finite, F.lit(False))


def code(parts: int) -> Column:
    """Two hexadecimal digits a part."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.col("assigned")[p])), 2, "0") for p in range(parts)])


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to entries of book: products of doubles where they are exact, else of longs."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * largest**2 < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals), and bounds of its distance and of the second nearest one's."""
    d, at = distances(x, book), np.arange(len(x))
    found = d.argmin(1)
    first = np.sqrt(d[at, found].astype(np.float64)) * (1 + SLACK)
    if d.shape[1] == 1:
        return found, first, np.full(len(x), np.inf)
    d[at, found] = np.inf if d.dtype == np.float64 else np.iinfo(np.int64).max
    return found, first, np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)


def half_gaps(books: np.ndarray) -> np.ndarray:
    """Below half of the distance of each entry to the nearest other entry of its codebook."""
    out = np.full(books.shape[:2], np.inf)
    for p, book in enumerate(books):
        d = distances(book, book).astype(np.float64)
        np.fill_diagonal(d, np.inf)
        out[p] = np.sqrt(d.min(1)) / 2 * (1 - SLACK)
    return out


def moved_bounds(upper: np.ndarray, lower: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after entries moved by moves: the own entry's move at most further, the largest other move at most nearer."""
    most = moves.argmax()
    others = np.full(len(moves), moves[most])
    others[most] = np.delete(moves, most).max(initial=0)
    return (upper + moves[at]) * (1 + SLACK), lower - others[at] * (1 + SLACK) - lower * SLACK


def assign(rows: DataFrame, books: np.ndarray, moves: np.ndarray | None) -> DataFrame:
    """rows (carried, vector) or a table of the last pass, with codes, bounds and errors against books, and the tasks' sums."""
    parts, entries, width = books.shape
    carried = rows.schema["carried"].dataType
    spark = rows.sparkSession
    kept = spark.sparkContext.broadcast((books, half_gaps(books), moves))
    types = "vector array<int>, assigned array<int>, upper array<double>, lower array<double>, error long, part int, entry int, n long, scans long, sums array<long>"
    schema = StructType([StructField("carried", carried), *StructType.fromDDL(types).fields])

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        flat = np.ascontiguousarray(values).reshape(len(values), -1)
        offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()).cast(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, gaps, moves = kept.value
        sums, counts, scans = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), np.zeros(parts, np.int64)
        kind = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind = batch.schema.field("carried").type
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts, width)
            if np.abs(x).max(initial=0) >= LIMIT:
                raise ValueError(f"a scaled component is {LIMIT} or more in size")
            at, upper, lower = np.zeros((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts))
            error = np.zeros(n, np.int64)
            if moves is not None:
                for name, into in (("assigned", at), ("upper", upper), ("lower", lower)):
                    into[:] = batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, parts)
            for p in range(parts):
                own, a, u, low, book = x[:, p], at[:, p], upper[:, p], lower[:, p], books[p]
                if moves is None:
                    open_ = np.arange(n)
                else:
                    u[:], low[:] = moved_bounds(u, low, a, moves[p])
                    least = np.maximum(low, gaps[p][a])
                    open_ = np.flatnonzero(~(u < least))
                    u[open_] = np.sqrt(((own[open_] - book[a[open_]]) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
                    open_ = open_[~(u[open_] < least[open_])]
                if len(open_):
                    a[open_], u[open_], low[open_] = nearest(own[open_], book)
                scans[p] += len(open_)
                error += ((own - book[a]) ** 2).sum(1)
                counts[p] += np.bincount(a, minlength=entries)
                for j in range(width):  # sums of one batch are below 2**53
                    sums[p, :, j] += np.bincount(a, weights=own[:, j], minlength=entries).astype(np.int64)
            none = pa.nulls(n, pa.int32())
            columns = [batch.column("carried"), lists(x, pa.int32()), lists(at, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*columns, none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names=NAMES)
        if kind is not None:
            p, e = np.nonzero(counts)
            m = len(p)
            doubles = pa.list_(pa.float64())
            empty = [pa.nulls(m, t) for t in (kind, pa.list_(pa.int32()), pa.list_(pa.int32()), doubles, doubles, pa.int64())]
            first = np.r_[True, p[1:] != p[:-1]]
            whole = [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(np.where(first, scans[p], 0)), lists(sums[p, e], pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *whole], names=NAMES)

    return rows.mapInArrow(run, schema)


NAMES = ["carried", "vector", "assigned", "upper", "lower", "error", "part", "entry", "n", "scans", "sums"]


def totals(table: DataFrame, shape: tuple[int, ...]) -> tuple[dict[tuple[int, int], tuple[int, list[int]]], int]:
    """Count and sums of each used entry, and how many parts were compared with a whole codebook."""
    each = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(shape[2])]
    found = table.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.sum("scans").alias("scans"), *each).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(r[f"s{j}"]) for j in range(shape[2])]) for r in found}, sum(r["scans"] for r in found)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = ("vec_id", "label"), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Codes of all whole vectors by codebooks that start as the parts of the entries smallest ids and take rounds Lloyd rounds."""
    if not 1 <= entries <= 256:
        raise ValueError("codes are bytes: entries must be 1 to 256")
    v = F.col(vector_col)
    whole = vectors.where(is_whole(v, parts)).select(F.col(id_col).alias("id"), F.struct(*carry).alias("carried"), scaled(v, scale).alias("wide"))
    smallest = lambda df: df.select("id", "wide").orderBy(F.asc_nulls_last("id"), "wide").limit(entries).collect()
    start = smallest(whole)
    width = len(start[0]["wide"]) // parts if start else 0
    whole = whole.where(F.size("wide") == width * parts)
    if any(len(r["wide"]) != width * parts for r in start):
        start = smallest(whole)
    books = np.array([r["wide"] for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    if np.abs(books).max(initial=0) >= LIMIT:
        raise ValueError(f"a scaled component is {LIMIT} or more in size")
    if not start:
        return Codes(whole.select("carried.*", F.array().cast("array<int>").alias("assigned"), F.lit(0).cast("long").alias("error")), books, [])
    rows, moves, scans = whole.select("carried", F.transform("wide", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x)).cast("int")).alias("vector")), None, []
    for turn in range(rounds + 1):
        table = written(assign(rows, books, moves), "vector-codes")
        if turn:
            discard(last)  # noqa: F821
        last, rows = table, table.where("part is null").select("carried", "vector", "assigned", "upper", "lower", "error")
        found, scanned = totals(table, books.shape)
        scans.append(scanned)
        if turn < rounds:
            fresh = books.copy()
            for (p, e), (n, sums) in found.items():
                fresh[p, e] = [s // n for s in sums]
            moves, books = np.sqrt(((fresh - books) ** 2).sum(2).astype(np.float64)) * (1 + SLACK), fresh
    return Codes(rows.select("carried.*", "assigned", "error"), books, scans)
