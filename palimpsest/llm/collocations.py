"""Phrase collocations: Apriori passes over the texts, level by level, then the weakest cut of every frequent phrase.

A text is cut into pieces at punctuation and line ends, a piece into words at blanks and tabs; A to Z are lower-cased.
Counts are kept for each language (a null one is `und`). The first pass counts words; those that are frequent in a
language are numbered and broadcast. Pass k counts phrases of k such words by their numbers, a few of them in a long, so
that a row is two or three numbers and known exactly; words that are not numbered are in no frequent phrase. It counts a
phrase only if the two phrases of k - 1 words in it may be frequent, which is asked of a broadcast filter, a bitmap of at
most 32 MB made by Spark's bitmap functions from the level below. Only frequent phrases are written out as words.

Where more than MAX_WORDS words (or MAX_BYTES of them) are frequent, none is broadcast: the passes count 64-bit keys of
language and phrase, and a last pass writes out the phrases whose keys are frequent and counts them by their words. Filters
and keys let all frequent phrases through at every size; what else they let through is counted and then left out, so
counts are exact. Equal phrases are told by their word numbers, not by a hash alone, and added up over the slices of a task
before they leave it, HELD rows at a time; Spark adds these sums up.

Phrases are scored from the level tables: each cut of a phrase joins the counts of its two parts. A phrase lies inside a
longer one of at least its percentage only if that holds for one that is one word longer, for counts do not grow with
length; so each phrase reports its count to its two ends, and no pairs of phrases are made.

Null or empty texts have no words. Repeated rows count each. A text is read whole, in slices of its pieces where it is
longer than a batch; a piece is never cut. An empty table, or one without frequent phrases, gives no rows. Other columns
of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.textops import LOWER, assembled, mix64, span_hashes, windows
from palimpsest.session import arrow_batches, written

BREAK = 0x0A
#: Blanks and tabs part words; punctuation and line ends part pieces.
TABLE = bytes(0x20 if b in (0x20, 0x09) else BREAK if b in b".,;:!?\x0a\x0b\x0c\x0d" else LOWER.get(b, b) for b in range(256))
#: Bits of the filter of a level: 16 a phrase, and at most 32 MB.
MAX_BITS = 1 << 28
SLICE = 4 << 20
#: Frequent words that are numbered and broadcast, and their bytes.
MAX_WORDS, MAX_BYTES = 1 << 20, 16 << 20
#: Rows of phrases that a task holds before it adds them up.
HELD = 400_000


def slices(texts: list[bytes], langs: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text, where each run of one language begins, languages) of about SLICE bytes; texts and pieces end in a break."""
    held, at, own, size = [], [], [], 0
    for text, lang in zip(texts, langs.tolist(), strict=True):
        text = text.translate(TABLE)
        a = 0
        while a < len(text):
            b = len(text) if len(text) - a <= SLICE else text.rfind(BREAK, a, a + SLICE) + 1
            if b <= a:  # a piece longer than a slice
                b = text.find(BREAK, a) + 1 or len(text)
            at.append(size)
            own.append(lang)
            held.append(text[a:b])
            size += b - a + 1
            a = b
            if size >= SLICE:
                yield b"\n".join(held) + b"\n", np.array(at), np.array(own)
                held, at, own, size = [], [], [], 0
    if held:
        yield b"\n".join(held) + b"\n", np.array(at), np.array(own)


def words(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Number of each word's form, the forms, each word's first byte and its piece."""
    buf = np.frombuffer(text, np.uint8)
    out = (buf == 0x20) | (buf == BREAK)
    edge = np.diff(np.r_[True, out].view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    forms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~out])]).dictionary_encode()
    pieces = np.searchsorted(np.flatnonzero(buf == BREAK), starts)
    return forms.indices.to_numpy(), forms.dictionary, starts, pieces


def distinct(hashes: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First place and count of each different row of parts; rows of one hash that differ are told apart."""
    _, first, of, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    if all((p == p[first][of]).all() for p in parts):
        return first, counts
    _, first, counts = np.unique(np.stack(parts, 1), axis=0, return_index=True, return_counts=True)
    return first, counts


def may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bitmap) * 8 - 1)
    found = np.ones(len(hashes), bool)
    for position in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        found &= (bitmap[position >> np.uint64(3)] >> (position & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


class Phrases:
    """The words of a slice, with keys of the phrases that begin at each."""

    def __init__(self, text: bytes, at: np.ndarray, langs: np.ndarray, lang_hashes: np.ndarray, filters: list[np.ndarray]) -> None:
        self.numbers, self.forms, starts, self.pieces = words(text)
        self.offsets = np.frombuffer(self.forms.buffers()[1], np.int32)[: len(self.forms) + 1].astype(np.int64)
        self.data = np.frombuffer(self.forms.buffers()[2] or b"", np.uint8)
        self.lang = langs[np.searchsorted(at, starts, "right") - 1]
        self.plain = span_hashes(self.data, self.offsets[:-1], self.offsets[1:])[self.numbers]
        self.lang_hashes, self.filters = lang_hashes, filters

    def keys(self, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(windows(self.plain, k) + self.lang_hashes[self.lang[: max(0, len(self.plain) - k + 1)]])

    def candidates(self, k: int) -> np.ndarray:
        """Where phrases of k words of one piece begin whose two ends of k - 1 words may be frequent."""
        own = np.arange(max(0, len(self.numbers) - k + 1))
        if k == 1 or not len(own):
            return own
        shorter = may_hold(self.filters[k - 2], self.keys(k - 1))
        return own[shorter[:-1] & shorter[1:] & (self.pieces[: len(own)] == self.pieces[k - 1 :])]

    def counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the candidates."""
        return np.unique(self.keys(k)[self.candidates(k)], return_counts=True)

    def named(self, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Language, words and count of the candidates whose own keys may be frequent."""
        own = self.candidates(k)
        hashes = self.keys(k)[own]
        kept = may_hold(self.filters[k - 1], hashes)
        own, hashes = own[kept], hashes[kept]
        first, counts = distinct(hashes, [self.lang[own], *(self.numbers[own + j] for j in range(k))])
        own = own[first]
        # Forms with blanks between them, from the forms' bytes and one blank after these.
        form = self.numbers[own[:, None] + np.arange(k)]
        begin, length = np.full((len(own), 2 * k - 1), len(self.data), np.int64), np.ones((len(own), 2 * k - 1), np.int64)
        begin[:, ::2], length[:, ::2] = self.offsets[form], self.offsets[form + 1] - self.offsets[form]
        built = assembled(np.r_[self.data, np.uint8(0x20)], begin.ravel(), length.ravel())
        ends = np.r_[0, np.cumsum(length.sum(1))].astype(np.int32)
        return self.lang[own], pa.StringArray.from_buffers(len(own), pa.py_buffer(ends), pa.py_buffer(built)), counts


def read(batch: pa.RecordBatch, filters: list[np.ndarray]) -> Iterator[tuple[Phrases, pa.Array]]:
    """The phrases of each slice of a batch (lang, text), with the languages that they number."""
    known = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    data = known.dictionary.cast(pa.binary()).to_pylist()
    lang_hashes = np.array([span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in data], np.uint64)
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    for text, at, langs in slices(texts, known.indices.to_numpy()):
        yield Phrases(text, at, langs, lang_hashes, filters), known.dictionary


def added_up(tables: list[pa.Table]) -> pa.Table:
    """One row for each phrase of the tables."""
    found = pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
    return found.select(["lang", "k", "phrase", "f_sum"]).rename_columns(["lang", "k", "phrase", "f"])


def summed_up(slices: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of keys and their counts, added up over the slices of a task; what has over HELD // 2 different keys is given out at once."""
    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    rows = 0

    def merged() -> tuple[list[np.ndarray], np.ndarray]:
        parts = [np.concatenate(x) for x in zip(*(p for p, _ in held), strict=True)]
        counts = np.concatenate([f for _, f in held])
        order = np.lexsort(parts)
        parts = [p[order] for p in parts]
        first = np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in parts], axis=0)])
        return [p[first] for p in parts], np.add.reduceat(counts[order], first)

    for parts, counts in slices:
        if not len(counts):
            continue
        held.append((parts, counts))
        rows += len(counts)
        if rows > HELD:
            held = [merged()]
            rows = len(held[0][1])
            if rows > HELD // 2:
                yield held[0]
                held, rows = [], 0
    if held:
        yield merged()


def level(docs: DataFrame, k: int, least: int, filters: list[Broadcast]) -> DataFrame:
    """key of the phrases of k words that occur least times or more (or share their key with others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (phrases.counted(k) for batch in batches for phrases, _ in read(batch, [f.value for f in filters]))
        for (keys,), counts in summed_up(([keys], counts) for keys, counts in slices):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "f"])

    summed = docs.mapInArrow(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))
    with arrow_batches(docs.sparkSession):
        return written(summed.where(F.col("f") >= least).select("key"), f"phrase-keys-{k}")


def names(docs: DataFrame, least: int, filters: list[Broadcast]) -> DataFrame:
    """lang, k, phrase and f of all phrases with f >= least; k = 0 has the count of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for phrases, langs in read(batch, [f.value for f in filters]):
                lang, total = np.unique(phrases.lang, return_counts=True)
                found = [(0, lang, pa.array([""] * len(lang)), total), *((k, *phrases.named(k)) for k in range(1, len(filters) + 1))]
                for k, lang, phrase, counts in found:
                    held.append(pa.table([langs.take(pa.array(lang)), pa.array(np.full(len(lang), k, np.int32)), phrase, pa.array(counts)], names=["lang", "k", "phrase", "f"]))
                    rows += len(lang)
                if rows > HELD:
                    held = [added_up(held)]
                    rows = held[0].num_rows
                    if rows > HELD // 2:
                        yield from held[0].to_batches(10_000)
                        held, rows = [], 0
        if held:
            yield from added_up(held).to_batches(10_000)

    summed = docs.mapInArrow(run, "lang string, k int, phrase string, f long").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    with arrow_batches(docs.sparkSession):
        return written(summed.where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")


def word_slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """Language and form (each different pair once), the pair of each word, its piece, the forms and the languages, of each slice of a batch (lang, text)."""
    known = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
    for text, at, langs in slices(texts, known.indices.to_numpy()):
        numbers, forms, starts, pieces = words(text)
        if len(starts):
            pairs, of = np.unique(langs[np.searchsorted(at, starts, "right") - 1].astype(np.int64) * len(forms) + numbers, return_inverse=True)
            yield np.stack(np.divmod(pairs, len(forms))), of, pieces, forms.cast(pa.string()), known.dictionary


def frequent_words(docs: DataFrame, least: int) -> DataFrame:
    """lang, word and f of the words with f >= least; a null word has the count of all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang, form), of, _, forms, langs in word_slices(batch):
                counts = np.bincount(of)
                present = np.unique(lang)
                totals = np.array([counts[lang == x].sum() for x in present])
                word = pa.concat_arrays([forms.take(pa.array(form)), pa.nulls(len(present), pa.string())])
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(np.r_[lang, present])), word, pa.array(np.r_[counts, totals])], names=["lang", "word", "f"])

    summed = docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    with arrow_batches(docs.sparkSession):
        return written(summed.where((F.col("f") >= least) | F.col("word").isNull()), "frequent-words")


class Numbers:
    """Numbers of the frequent words of each language, and phrases as longs of some numbers each."""

    def __init__(self, found: pa.Table) -> None:
        found = found.sort_by([("lang", "ascending"), ("word", "ascending")]).combine_chunks()
        self.langs, self.words = (found[c].combine_chunks() if found.num_rows else pa.array([], pa.string()) for c in ("lang", "word"))
        self.bits = max(1, (found.num_rows - 1).bit_length())
        self.each = 63 // self.bits
        own, self.first = np.unique(self.langs.to_numpy(zero_copy_only=False), return_index=True) if found.num_rows else ([], [])
        self.of = {str(lang): i for i, lang in enumerate(own)}

    def own(self, lang: str) -> pa.Array:
        i = self.of[lang]
        return self.words[int(self.first[i]) : int(self.first[i + 1]) if i + 1 < len(self.first) else len(self.words)]

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The number of each word, -1 if it has none, and its piece, of each slice of a batch."""
        for (lang, form), of, pieces, forms, langs in word_slices(batch):
            found = np.full(len(lang), -1, np.int64)
            for x in np.unique(lang).tolist():
                if (name := langs[x].as_py()) in self.of:
                    at = np.flatnonzero(lang == x)
                    place = pc.fill_null(pc.index_in(forms.take(pa.array(form[at])), value_set=self.own(name)), -1).to_numpy().astype(np.int64)
                    found[at] = np.where(place < 0, -1, place + int(self.first[self.of[name]]))
            yield found[of], pieces

    def packed(self, numbers: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
        """The phrases of k words that begin at at."""
        return [sum((numbers[at + i] << (self.bits * (i - a)) for i in range(a, min(k, a + self.each))), np.zeros(len(at), np.int64)) for a in range(0, k, self.each)]

    def named(self, columns: list[np.ndarray], k: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of packed phrases."""
        ids = [columns[i // self.each] >> (self.bits * (i % self.each)) & ((1 << self.bits) - 1) for i in range(k)]
        return self.langs.take(pa.array(ids[0])), pc.binary_join_element_wise(*[self.words.take(pa.array(i)) for i in ids], " ")


def packed_hashes(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + c.view(np.uint64) + np.uint64(1))
    return out


def numbered_counts(docs: DataFrame, k: int, numbers: Broadcast, shorter: Broadcast | None, columns: list[str]) -> DataFrame:
    """columns (a packed phrase of k words whose ends may be frequent) and f, its count in a task, or in a part of one."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        own = numbers.value
        for batch in batches:
            for ids, pieces in own.read(batch):
                at = np.arange(max(0, len(ids) - k + 1))
                good = pieces[: len(at)] == pieces[k - 1 :] if len(at) else at
                for i in range(k):
                    good = good & (ids[i : i + len(at)] >= 0)
                at = at[good.astype(bool)]
                if shorter is not None:
                    for end in (0, 1):
                        at = at[may_hold(shorter.value, packed_hashes(own.packed(ids, at + end, k - 1)))]
                if len(at):
                    parts = own.packed(ids, at, k)
                    first, counts = np.unique(parts[0], return_index=True, return_counts=True)[1:] if len(parts) == 1 else distinct(packed_hashes(parts), parts)
                    yield [p[first] for p in parts], counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, counts in summed_up(counted(batches)):
            yield pa.RecordBatch.from_arrays([*(pa.array(p) for p in parts), pa.array(counts)], names=[*columns, "f"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in [*columns, "f"]))


def numbered_level(docs: DataFrame, k: int, least: int, numbers: Broadcast, shorter: Broadcast | None, columns: list[str]) -> DataFrame:
    """columns (a packed phrase of k words) and f of the phrases with f >= least."""
    summed = numbered_counts(docs, k, numbers, shorter, columns).groupBy(*columns).agg(F.sum("f").alias("f"))
    with arrow_batches(docs.sparkSession):
        return written(summed.where(F.col("f") >= least), f"phrases-{k}")


def numbered(docs: DataFrame, least: int, longest: int, found: DataFrame, max_bits: int) -> DataFrame:
    """lang, k, phrase and f as names() gives them, from the frequent words."""
    spark = docs.sparkSession
    some = found.where("word is not null")
    own = Numbers(some.select("lang", "word").toArrow())
    numbers, shorter, tables = spark.sparkContext.broadcast(own), None, []
    each = own.each
    for k in range(2, longest + 1):
        columns = [f"c{i}" for i in range(-(-k // each))]

        def hashed(batches: Iterator[pa.RecordBatch], columns: list[str] = columns) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(packed_hashes([b.column(c).to_numpy() for c in columns]).view(np.int64))], names=["key"])

        def worded(batches: Iterator[pa.RecordBatch], columns: list[str] = columns, k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang, phrase = numbers.value.named([b.column(c).to_numpy() for c in columns], k)
                yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(b.num_rows, k, np.int32)), phrase, b.column("f")], names=["lang", "k", "phrase", "f"])

        rows = numbered_level(docs, k, least, numbers, shorter, columns)
        if rows.isEmpty():
            break
        tables.append(rows.mapInArrow(worded, "lang string, k int, phrase string, f long"))
        if k < longest:
            shorter = spark.sparkContext.broadcast(filter_of(rows.mapInArrow(hashed, "key long"), max_bits))
    out = found.select("lang", F.when(F.col("word").isNull(), 0).otherwise(1).cast("int").alias("k"), F.coalesce("word", F.lit("")).alias("phrase"), "f")
    for rows in tables:
        out = out.union(rows)
    return written(out, "phrases")


def keyed(docs: DataFrame, least: int, longest: int, max_bits: int) -> DataFrame:
    """The same by 64-bit keys, for any number of frequent words."""
    filters: list[Broadcast] = []
    for k in range(1, longest + 1):
        keys = level(docs, k, least, filters)
        filters.append(docs.sparkSession.sparkContext.broadcast(filter_of(keys, max_bits)))
        if keys.isEmpty():
            break
    table = names(docs, least, filters)
    for f in filters:
        f.unpersist()
    return table


def filter_of(table: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """A bitmap of two bits for each key of the table."""
    bits = min(max_bits, max(1 << 15, 1 << (16 * table.count()).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))
    one = table.select(F.explode(places).alias("place")).select(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket"), F.bitmap_bit_position(F.col("place") + 1).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in one.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        a = (r["bucket"] - 1) * 4096
        out[a : a + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(out) - a]
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, max_bits: int = MAX_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's top phrases of 2 to longest words."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words_found = frequent_words(own, least)
    count, size = words_found.agg(F.count("word"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    few = count <= MAX_WORDS and size <= MAX_BYTES
    table = numbered(own, least, longest, words_found, max_bits) if few else keyed(own, least, longest, max_bits)
    n = table.where("k = 0").select("lang", F.col("f").alias("n"))
    frequent = table.where("k > 0")
    found = frequent.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k")
    cut = found.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumn("left", F.expr("substring_index(phrase, ' ', cut)"))
    cut = cut.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    parts = frequent.where(F.col("k") < longest)
    cut = cut.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(n, "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0)) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    weakest = cut.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    ends = F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))
    inside = found.where("k > 2").select("lang", F.explode(ends).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {percent} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
