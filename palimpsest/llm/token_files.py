"""Token-id output: documents tokenised in id order and written as frames of range-coded blocks.

A file is a Parquet table of frames (shard, frame, tokens, payload), so that Spark's committers and any file system
it knows hold it. Shards are ranges of ascending ids, one for each partition. A frame holds whole documents, about
FRAME ids, and is read without any other. Its payload:

    magic "PTF2", documents (u32), ids (u64), ids before it in its shard (u64), bytes of its frequencies (u32),
    crc32 of all that follows (u32),
    document ids (i64 each; the lowest number for null), their numbers of ids (u32 each),
    for each block of BLOCK ids its coded bytes (u32) and the crc32 of its ids as u32 (u32),
    the frequencies that every block starts from, the coded blocks.

All numbers are little-endian. Every block is coded from the same fresh state and has its own checksum.

A null or empty text has just the end id. Documents with an equal id are written in the order of their texts. Very
long texts are many blocks of one frame. An empty table gives an empty file and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import rangecoder
from palimpsest.llm.rangecoder import BLOCK
from palimpsest.llm.textops import SPACED, span_hashes
from palimpsest.session import arrow_batches, shared_dir

MAGIC, HEAD = b"PTF2", struct.Struct("<4sIQQII")
#: Ids of a frame, whose blocks are coded side by side.
FRAME = 3584 * BLOCK
#: Slots of the word table, words kept before it starts anew, and bytes of text that are tokenised at once.
SLOT_BITS = 20
SLOTS, WORDS_KEPT, PIECE = 1 << SLOT_BITS, 400_000, 1 << 18
NO_ID = -(2**63)
FILE_TYPE = "shard int, frame int, tokens long, payload binary"
ROW_TYPE = "shard int, at long, doc_id long, n_tokens long, ids_crc32 long"


_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
#: Letters, digits and marks of ASCII; an apostrophe is none, because it can stand in one token with letters.
_KINDS = bytes(1 if 0x61 <= b <= 0x7A else 2 if 0x30 <= b <= 0x39 else 3 if 0x21 <= b <= 0x7E and b != 0x27 else 0 for b in range(256))
_BETWEEN = "\x01"
#: Words of small letters of ASCII and Latin-1; letters that a byte-level vocabulary has for bytes that are no letters in Latin-1.
_SMALL = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_POINTS = np.arange(256, dtype="<u4")
_POINTS[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = 256 + np.arange(0x21 + 0xA1 - 0x7F + 1)
_tokenizers: dict[tuple[str, int], "WordTokenizer"] = {}


def tokenizer_for(path: str, end_id: int) -> "WordTokenizer":
    """The tokenizer of this process for path; the words it knows serve later tasks too."""
    if (path, end_id) not in _tokenizers:
        _tokenizers[(path, end_id)] = WordTokenizer(path, end_id)
    return _tokenizers[(path, end_id)]


def _pieces(texts: list[str | None]) -> Iterator[tuple[bool, list[bytes], list[bool]]]:
    """Texts in lists of about PIECE bytes: whether they may hold special tokens, their bytes, and which of them end a text.

    Longer texts are cut at white space.
    """
    held: list[bytes] = []
    ends: list[bool] = []
    special, size = False, 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        own, at = b"<|" in data, 0
        if held and (own != special or size + len(data) > PIECE):
            yield special, held, ends
            held, ends, size = [], [], 0
        special = own
        while len(data) - at > PIECE:
            cut = max(data.rfind(space, at, at + PIECE) for space in (b" ", b"\n"))
            if cut <= at:
                break
            yield special, [data[at:cut]], [False]
            at = cut
        held.append(data[at:] if at else data)
        ends.append(True)
        size += len(data) - at + 1
    if held:
        yield special, held, ends


class WordTokenizer:
    """Ids of texts by a tokenizer that lowers case and never joins across white space: each distinct word is encoded once.

    Words are known by a 64-bit hash of their bytes. ASCII letters, digits and marks never share a token, nor do two
    digits, so a word is cut between them. Texts that may hold special tokens, which are not lowered, are cut at white
    space only.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        whole = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(_SMALL)]
        as_it_is = self.tokenizer.normalizer.normalize_str(_SMALL) == _SMALL and whole == self._byte_level([_SMALL.encode()])
        self.plain = _PLAIN.fullmatch if as_it_is else lambda word: None
        self._fresh()

    def _fresh(self) -> None:
        self.keys, self.codes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.flat = np.array([self.end_id], np.int32)
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)  # word 0 is the end id

    @staticmethod
    def _byte_level(words: list[bytes]) -> list[str]:
        return _POINTS[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split(chr(_POINTS[0x0A]))

    def _plain_ids(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of words that the model gets as they are, one after another, and how many each has."""
        ids, sizes = [], []
        tokenize = self.tokenizer.model.tokenize
        for word in self._byte_level(words):
            found = tokenize(word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return ids, sizes

    def _other_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode("utf-8", "surrogatepass") for w in words]
        if len(self.between) == 1 and not any(_BETWEEN in t for t in texts):
            ids = self.tokenizer.encode_batch_fast([f" {_BETWEEN} ".join([*texts, ""])], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.int32)
            stop = np.flatnonzero(ids == self.between[0])
            return np.delete(ids, stop), np.diff(stop, prepend=-1) - 1
        parts = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts))

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        plain = np.array([self.plain(w) is not None for w in words], bool)
        for mine, ids_of in ((np.flatnonzero(plain), self._plain_ids), (np.flatnonzero(~plain), self._other_ids)):
            if len(mine):
                self._add(hashes[mine], *ids_of([words[i] for i in mine.tolist()]))

    def _add(self, hashes: np.ndarray, ids, lengths) -> None:
        ids, lengths = np.asarray(ids, np.int32), np.asarray(lengths, np.int64)
        codes = np.arange(len(self.lengths), len(self.lengths) + len(lengths), dtype=np.int32)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        slot, left = hashes >> np.uint64(64 - SLOT_BITS), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]], self.codes[slot[free]] = hashes[free], codes[free]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + np.uint64(1)) & np.uint64(SLOTS - 1)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each hash, and the places of those that are not known."""
        slot = hashes >> np.uint64(64 - SLOT_BITS)
        codes, keys = self.codes[slot], self.keys[slot]
        left = np.flatnonzero(keys != hashes)
        new = []
        while len(left):
            empty = self.keys[slot[left]] == 0
            new.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + np.uint64(1)) & np.uint64(SLOTS - 1)
            same = self.keys[slot[left]] == hashes[left]
            codes[left[same]] = self.codes[slot[left[same]]]
            left = left[~same]
        return codes, np.concatenate(new) if new else left

    def _words(self, special: bool, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, the borders and hashes of their words, and the first word of each text."""
        joined = (b" ".join(texts) + b" ").translate(_SPACES if special else SPACED)
        buf = np.frombuffer(joined, np.uint8)
        gap = buf == 0x20
        edge = np.zeros(len(buf), bool)  # where a word begins though no space stands before
        if not special:
            kind = np.frombuffer(joined.translate(_KINDS), np.uint8)
            edge[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts = np.flatnonzero(~gap[1:] & (gap[:-1] | edge[1:])) + 1
        ends = np.flatnonzero(~gap[:-1] & (gap[1:] | edge[1:])) + 1
        if not gap[0]:
            starts = np.concatenate([[0], starts])
        hashes = np.maximum(span_hashes(buf, starts, ends), np.uint64(1))
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        return joined, np.stack([starts, ends]), hashes, np.searchsorted(starts, at)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text): the ids of texts, each with the end id after it, a part of the texts at a time."""
        open_ids: list[np.ndarray] = []
        for special, held, end in _pieces(texts):
            if len(self.lengths) > WORDS_KEPT:
                self._fresh()
            joined, (starts, ends), hashes, first = self._words(special, held)
            codes, new = self._find(hashes)
            if len(new):
                fresh, at = np.unique(hashes[new], return_index=True)
                at = new[at]
                self._learn([joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], fresh)
                codes[new], _ = self._find(hashes[new])
            closes = first[1:][np.array(end)]
            codes = np.insert(codes, closes, 0)
            lengths = self.lengths[codes]
            upto = np.cumsum(lengths)
            places = np.repeat(self.starts[codes] - (upto - lengths), lengths)
            places += np.arange(len(places))
            ids = self.flat[places]
            if not end[-1]:
                open_ids.append(ids)
                continue
            sizes = np.diff(upto[closes + np.arange(len(closes))], prepend=0)
            if open_ids:
                sizes[0] += sum(map(len, open_ids))
                ids, open_ids = np.concatenate([*open_ids, ids]), []
            yield ids, sizes


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def frame_of(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """The payload of a frame of documents; before: the ids of the shard before it."""
    stored, coded = rangecoder.encode(ids)
    checks = [(len(c), crc(ids[i * BLOCK : (i + 1) * BLOCK])) for i, c in enumerate(coded)]
    body = doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + np.array(checks, "<u4").tobytes() + stored + b"".join(coded)
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), before, len(stored), zlib.crc32(body)) + body


def documents_of(payload: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Document ids, their numbers of ids, the ids before and the ids of a frame; ValueError if it is damaged."""
    magic, n_docs, n_ids, before, n_stored, check = HEAD.unpack_from(payload)
    body = memoryview(payload)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != check:
        raise ValueError("a frame is damaged")
    doc_ids = np.frombuffer(body, "<i8", n_docs)
    sizes = np.frombuffer(body, "<u4", n_docs, 8 * n_docs).astype(np.int64)
    n_blocks = -(-n_ids // BLOCK)
    index = np.frombuffer(body, "<u4", 2 * n_blocks, 12 * n_docs).reshape(-1, 2).astype(np.int64)
    at = 12 * n_docs + 8 * n_blocks + n_stored
    ends = at + np.cumsum(index[:, 0])
    coded = [body[e - n : e] for e, n in zip(ends.tolist(), index[:, 0].tolist(), strict=True)]
    ids = rangecoder.decode(body[at - n_stored : at], coded, n_ids)
    if any(crc(ids[i * BLOCK : (i + 1) * BLOCK]) != c for i, c in enumerate(index[:, 1].tolist())):
        raise ValueError("a block is damaged")
    return doc_ids, sizes, before, ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all texts, each with end_id after it, in ascending order of id_col."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer_for(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        waiting: list[list[np.ndarray]] = [[], [], []]  # document ids, their numbers of ids, the ids
        number = before = held = 0

        def frame() -> pd.DataFrame:
            nonlocal waiting, number, before, held
            parts = [np.concatenate(x) for x in waiting]
            waiting = [[], [], []]
            row = pd.DataFrame([(shard, number, held, frame_of(*parts, before))], columns=["shard", "frame", "tokens", "payload"])
            before, number, held = before + held, number + 1, 0
            return row

        def add(own: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
            nonlocal held
            for into, part in zip(waiting, (own, sizes, ids), strict=True):
                into.append(part)
            held += len(ids)

        for batch in batches:
            own, done = batch["id"].to_numpy(np.int64), 0
            for ids, sizes in words(batch["text"].tolist()):
                own_part, done = own[done : done + len(sizes)], done + len(sizes)
                while held + len(ids) > FRAME:  # as many whole documents as reach FRAME
                    upto = np.cumsum(sizes)
                    n = min(int(np.searchsorted(upto, FRAME - held)) + 1, len(sizes))
                    add(own_part[:n], sizes[:n], ids[: upto[n - 1]])
                    own_part, sizes, ids = own_part[n:], sizes[n:], ids[upto[n - 1] :]
                    yield frame()
                if len(sizes):
                    add(own_part, sizes, ids)
        if held:
            yield frame()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text")
    dealt = own.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    with arrow_batches(docs.sparkSession):
        dealt.mapInPandas(encoded, FILE_TYPE).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document of a file."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, payload in zip(batch["shard"], batch["payload"], strict=True):
                doc_ids, sizes, before, ids = documents_of(payload)
                upto = np.cumsum(sizes)
                crcs = [crc(ids[b - n : b]) for n, b in zip(sizes.tolist(), upto.tolist(), strict=True)]
                yield pd.DataFrame({"shard": shard, "at": before + upto - sizes, "doc_id": doc_ids, "n_tokens": sizes, "ids_crc32": crcs})

    files = spark.read.schema(FILE_TYPE).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("tokens").alias("all"))
    # One row a shard, that is a partition of the writer.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("offset"))
    rows = files.select("shard", "payload").mapInPandas(decoded, ROW_TYPE)
    return rows.join(F.broadcast(shards), "shard").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_rows(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write docs to path (a new one in the shared folder if None) and read the file back."""
    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
