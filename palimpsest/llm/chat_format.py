"""Chat formatting: turns become one training text a conversation, with marks, reversible escapes and a loss mask.

Rows are dealt by ranges of (conversation, turn) and sorted, so that a conversation of any size is formatted by as many
tasks as it needs. Each batch is assembled as columns: the lengths of marks and texts, their cumulative offsets and the
indices that scatter them are numpy arrays, and marks and contents are copied into one preallocated buffer, which is
the Arrow column. No text is joined or escaped by itself; only the places of control strings are looked up, one by one.

A control string inside a role or text gets a backslash after its first character (one more if it has some there
already), and loses one again on the way back; no mark occurs inside an escaped text, so parsing has one result.
Roles that the template does not know are written out.

formatted() writes its rows as Parquet in the shared folder: pieces with the conversation's id, the piece's place (part,
seq), text and loss spans (byte offsets of assistant texts). Most conversations are one piece (whole); those that lie
across tasks, or are longer than piece bytes, have several. Read back, whole pieces are digested where they lie and only
the others are shuffled, to a task that takes a conversation's pieces as a stream: a digest is serial by definition, but
its memory is bounded by a piece. A single text is held whole.

Nulls: a null role or text is empty, a null turn sorts first, null ids make up one conversation. Equal turns of a
conversation are ordered by role and text; repeated rows are turns of their own. An empty table gives no conversations.
Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from palimpsest.llm.textops import assembled
from palimpsest.session import arrow_batches, written

#: What stands before and after a turn of each role. Marks start with < or [ or a blank and hold neither of the first two later on.
TEMPLATE = {"system": ("[SYS] ", " [/SYS]\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]\n")
CONTROL = rb"<(?=(\\*/?s>))|\[(?=(\\*/?(?:SYS|INST|ROLE|TURN)\]))"
TURN = re.compile(rb"\[SYS\] (?P<system>.*?) \[/SYS\]\n|\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) \[/TURN\]\n| (?P<assistant>.*?)</s>", re.S)
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(rb"<\\(?=\\*/?s>)|\[\\(?=\\*/?(?:SYS|INST|ROLE|TURN)\])")
#: A conversation longer than this is given out in pieces.
PIECE = 8 << 20


def escape(text: bytes) -> bytes:
    return _CONTROL.sub(lambda m: m[0] + b"\\", text)


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: m[0][:1], text)


def parse(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn of a formatted text."""
    at = 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        kind = m.lastgroup
        yield (unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind.encode(), unescape(m[kind]))
    if at != len(text):
        raise ValueError("not a formatted text")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    whole = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all turns, the end of each turn in them, and begin and end of each turn's content."""
    n = len(texts)
    data, offsets = _flat(texts)
    names = pc.fill_null(roles, "").dictionary_encode()
    marks, spans = bytearray(), []
    for name in names.dictionary.to_pylist():
        before, after = TEMPLATE.get(name) or (OTHER[0] + escape(name.encode()).decode() + OTHER[1], OTHER[2])
        spans.append((len(marks), len(before.encode()), len(marks) + len(before.encode()), len(after.encode())))
        marks += (before + after).encode()
    slash = len(marks)
    marks += b"\\"
    role = np.array(spans, np.int64).reshape(-1, 4)[names.indices.to_numpy(zero_copy_only=False)]
    # Contents are cut after the first character of each control string; matches across two texts are none.
    hits = np.array([(m.start(), m.end(m.lastindex)) for m in _CONTROL.finditer(data[offsets[0] : offsets[-1]])], np.int64).reshape(-1, 2) + offsets[0]
    owner = np.searchsorted(offsets, hits[:, 0], "right") - 1
    inside = hits[:, 1] <= offsets[owner + 1]
    cuts, owner = hits[inside, 0] + 1, owner[inside]
    # Segments of a turn: mark, content, (backslash, content)..., mark.
    extra = np.bincount(owner, minlength=n)
    count = 3 + 2 * extra
    first = np.cumsum(count) - count
    starts, lengths = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
    base = len(marks)
    starts[first], lengths[first] = role[:, 0], role[:, 1]
    starts[first + count - 1], lengths[first + count - 1] = role[:, 2], role[:, 3]
    pieces = 1 + extra
    start = np.cumsum(pieces) - pieces
    is_first, is_last = np.zeros(int(pieces.sum()), bool), np.zeros(int(pieces.sum()), bool)
    is_first[start], is_last[start + extra] = True, True
    begin, end = np.empty(len(is_first), np.int64), np.empty(len(is_first), np.int64)
    begin[is_first], begin[~is_first], end[is_last], end[~is_last] = offsets[:-1], cuts, offsets[1:], cuts
    where = np.repeat(first + 1, pieces) + 2 * (np.arange(len(begin)) - np.repeat(start, pieces))
    starts[where], lengths[where] = begin + base, end - begin
    slashes = where[~is_first] - 1
    starts[slashes], lengths[slashes] = slash, 1
    out = assembled(np.concatenate([np.frombuffer(bytes(marks), np.uint8), data]), starts, lengths)
    ends = np.cumsum(lengths)
    return out, ends[first + count - 1], np.stack([ends[first], ends[first + count - 2]], 1)


PIECES = "part int, seq long, whole boolean, n_turns long, text string, loss_from array<long>, loss_to array<long>"


def formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", piece: int = PIECE) -> DataFrame:
    """The formatted pieces of all conversations (id, part, seq, whole, n_turns, text, loss_from, loss_to), as written."""
    spark = turns.sparkSession
    kind = turns.schema[id_col].dataType
    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), "role", "text")
    dealt = rows.repartitionByRange("id", "turn").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    schema = StructType([StructField(id_col, kind), *StructType.fromDDL(PIECES).fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size, cut = TaskContext.get().partitionId(), 0, [], 0, True  # cut: the next row may belong to what came before

        def out(batch: pa.RecordBatch, more: bool) -> pa.RecordBatch:
            """Pieces of the conversations of a batch; more: the last one may go on."""
            nonlocal seq, cut
            ids = batch.column("id").to_pylist()
            first = np.array([i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]], np.int64)
            data, ends, content = assemble(batch.column("role"), batch.column("text"))
            offsets = np.r_[0, ends[first[1:] - 1], ends[-1]]
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            loss = np.flatnonzero(pc.equal(pc.fill_null(batch.column("role"), ""), "assistant").to_numpy(zero_copy_only=False))
            owner = np.searchsorted(first, loss, "right") - 1
            at = np.searchsorted(loss, np.r_[first, len(ids)]).astype(np.int32)
            spans = [pa.ListArray.from_arrays(pa.array(at), pa.array(content[loss, k] - offsets[owner])) for k in (0, 1)]
            whole = np.ones(len(first), bool)
            whole[0] &= not cut
            whole[-1] &= not more
            place = pa.array(np.arange(seq, seq + len(first)))
            seq, cut = seq + len(first), more
            counts = pa.array(np.diff(np.r_[first, len(ids)]))
            own = batch.column("id").take(pa.array(first))
            return pa.RecordBatch.from_arrays([own, pa.array(np.full(len(first), part, np.int32)), place, pa.array(whole), counts, text, *spans], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ids = batch.column("id")
            last, n = ids[-1].as_py(), batch.num_rows
            while n and ids[n - 1].as_py() == last:
                n -= 1
            if not n and held[0].column("id")[0].as_py() == last:  # all of one conversation so far
                size += batch.nbytes
                if size > piece:
                    yield out(pa.concat_batches(held), True)
                    held, size = [], 0
                continue
            both = pa.concat_batches(held)
            n += both.num_rows - batch.num_rows
            yield out(both.slice(0, n), False)
            held = [both.slice(n)]
            size = held[0].nbytes
        if held:
            yield out(pa.concat_batches(held), True)

    with arrow_batches(spark):
        return written(dealt.mapInArrow(run, schema), "formatted")


def restored(pieces: DataFrame) -> DataFrame:
    """Every turn of the pieces (id, part, seq, nth, role, text), parsed back."""
    id_col = pieces.columns[0]
    schema = StructType([pieces.schema[id_col], *StructType.fromDDL("part int, seq long, nth long, role string, text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, k, *turn) for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()) for k, turn in enumerate(parse(text))]
            of = pa.array([f[0] for f in found], pa.int64())
            texts = [pa.array([f[k] for f in found], pa.binary()).cast(pa.string()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in (id_col, "part", "seq")), pa.array([f[1] for f in found], pa.int64()), *texts], names=schema.fieldNames())

    return pieces.select(id_col, "part", "seq", "text").mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """A row a conversation, read back from its pieces: turns, code points and digests of its turns and of its loss text."""
    id_col = pieces.columns[0]
    schema = StructType([pieces.schema[id_col], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    columns = [id_col, "text", "loss_from", "loss_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def row() -> tuple:
            return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=schema.fieldNames())

        for batch in batches:
            kind = batch.schema.field(id_col).type
            for own, text, froms, tos in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now is None or own != now[0]:
                    if now:
                        out.append(row())
                    now = [own, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(role + b"\n" + said + b"\n")
                for a, b in zip(froms, tos, strict=True):
                    said = unescape(text[a:b])
                    now[3] += len(said.decode())
                    now[4].update(said)
                now[5] += len(text.decode())
            if out:
                yield batch_of(out)
                out = []
        if now:
            yield batch_of([row()])

    shut = pieces.where("whole").select(*columns).mapInArrow(run, schema)
    cut = pieces.where("not whole").repartition(id_col).sortWithinPartitions(id_col, "part", "seq").select(*columns)
    return shut.unionByName(cut.mapInArrow(run, schema))
