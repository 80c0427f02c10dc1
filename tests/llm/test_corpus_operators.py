"""Near duplicates, language-model scores, token files, mixing and the pipeline against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, mixing, near_dedup, rangecoder, suffix_tree, token_files
from palimpsest.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- near duplicates ------------------------------------------------------------------------------------------


def brute_components(texts: dict, n: int, percent: int):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, vocabulary, length, size, edits):
    base = [rng.choice(vocabulary) for _ in range(length)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(length)] = rng.choice(vocabulary)
        yield " ".join(own)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_against_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(6) for t in family(rng, vocabulary, rng.randrange(60, 160), 25, 5)]
    texts += [texts[0]] * 8 + [texts[3].upper()] * 2 + [None, None, "", "  ", "two words", "Two  WORDS", "two words more", "x" * 40_000]
    texts += [" ".join(rng.choices(vocabulary, k=30)) for _ in range(60)]
    rng.shuffle(texts)
    numbered = {i * 3 + 1: t for i, t in enumerate(texts)}
    docs = spark.createDataFrame([(i, t, 1, 0.0) for i, t in numbered.items()], "doc_id long, text string, n int, band double")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, n=n).collect()}
    want = brute_components(numbered, n, 80)
    assert got == want
    kept = near_dedup.without_near_duplicates(docs, n=n)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_similarity_without_bias():
    rng = np.random.default_rng(4)
    for size in (12, 200, 3000):
        found = []
        for _ in range(60):
            values = rng.integers(0, 2**63, size, dtype=np.uint64)
            own, shared = size // 10, size - 2 * (size // 10)
            a, b = values[: shared + own], np.concatenate([values[:shared], values[shared + own :]])
            codes = [near_dedup.registers(near_dedup.minima(v)).tobytes() for v in (a, b)]
            found.append(near_dedup.estimate([codes[0]], [codes[1]], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(found) - shared / size) < 0.02


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5), (None, 3)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p if x is not None}
    for _ in range(400):
        changed = False
        for a, b in pairs:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
        if not changed:
            break
    assert found == {x: c for x, c in label.items() if any(x in p and p[0] != p[1] and None not in p for p in pairs)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language model -------------------------------------------------------------------------------------------


def lm_docs():
    rng = random.Random(11)
    vocabulary = ["the", "of", "and", "Ein", "élan"] + [f"{a}{b}{c}" for a in "st" for b in "aeiou" for c in ("n", "rk", "lt")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(300)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "unseen-Word!"), (304, "the " * 4000), (305, "same row"), (305, "same row")]


def test_language_model_counts_and_base_scores(spark):
    rows = lm_docs()
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    train = [r for r in rows if r[0] % 3]
    counts = suffix_tree.count(docs.where("doc_id % 3 <> 0"))
    seen = Counter(w for _, t in train for w in [*words(t), "\n"])
    assert (counts.tokens, counts.types) == (sum(seen.values()), len(seen))
    tree = suffix_tree.fit(counts)
    for share in (1e-6, 0.05):
        got = suffix_tree.score(docs, counts, tree, min_share=share).collect()
        assert len(got) == len(rows)
        by = {r["doc_id"]: r for r in got}
        for i, t in rows:
            own = [*words(t), "\n"]
            base = sum(math.log10((seen[w] + 0.1) / (counts.tokens + 0.1 * (counts.types + 1))) for w in own)
            assert (by[i]["n_tokens"], by[i]["n_known"]) == (len(own), sum(seen[w] > 0 for w in own))
            assert by[i]["base_score"] == pytest.approx(base, rel=1e-9)
            assert by[i]["score"] < 0
        if share == 1e-6:
            first = {i: by[i]["score"] for i, _ in rows}
        else:
            assert {i: by[i]["score"] for i, _ in rows} == pytest.approx(first, rel=1e-5)
    held = [r for r in got if r["doc_id"] % 3 == 0 and r["doc_id"] < 300]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert suffix_tree.score(docs.limit(0), counts, tree).count() == 0


def brute_tree(texts, divergence=0.001, evidence=3.0, novelty=4.0):
    """Probability of a symbol after a context, by the definition: counts of all contexts, states, and smoothing by suffixes."""
    depth, follows = suffix_tree.DEPTH, {}
    for t in texts:
        data = suffix_tree.stream(suffix_tree.tokens(t))
        for i in range(depth, len(data)):
            for k in range(depth + 1):
                follows.setdefault(data[i - k : i], Counter())[data[i]] += 1
    states = {b""}
    for context, found in follows.items():
        total = sum(found.values())
        if context and total >= 2:
            before = follows[context[1:]]
            all_before = sum(before.values())
            gain = sum(n / total * math.log(n / total / (before[x] / all_before)) for x, n in found.items())
            if gain >= divergence and gain * total >= evidence:
                states.update(context[i:] for i in range(len(context)))

    def chance(context, symbol):
        while context not in states:
            context = context[1:]
        found = follows.get(context, Counter())
        suffix = chance(context[1:], symbol) if context else 1 / 256
        return (found[symbol] + novelty * len(found) * suffix) / (sum(found.values()) + novelty * len(found)) if found else suffix

    return chance


def test_suffix_tree_against_brute_force(spark):
    rows = [r for r in lm_docs() if r[0] != 304]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = suffix_tree.count(docs.where("doc_id % 3 <> 0"))
    chance = brute_tree([t for i, t in rows if i % 3])
    tree = suffix_tree.fit(counts)
    assert 50 < sum(len(x.contexts) for x in tree.levels)
    for r in suffix_tree.score(docs, counts, tree).where("doc_id % 5 = 0").collect():
        data = suffix_tree.stream(suffix_tree.tokens(dict(rows)[r["doc_id"]]))
        want = sum(math.log10(chance(data[i - suffix_tree.DEPTH : i], data[i])) for i in range(suffix_tree.DEPTH, len(data)))
        assert r["score"] == pytest.approx(want, rel=1e-6), r["doc_id"]


@pytest.mark.parametrize("min_share", (1e-3, 0.02, 1.0))
def test_size_of_the_cached_tree_does_not_change_scores(spark, min_share, monkeypatch):
    monkeypatch.setattr(suffix_tree, "LIMIT", 400)
    docs = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    counts = suffix_tree.count(docs.where("doc_id % 3 <> 0"))
    whole, cut = suffix_tree.fit(counts), suffix_tree.fit(counts, min_share=min_share)
    assert whole.whole and not cut.whole
    want, got = (sorted((r["doc_id"], r["score"]) for r in suffix_tree.score(docs, counts, t).collect()) for t in (whole, cut))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


@pytest.mark.parametrize("cached", (0, 40), ids=["no cache", "small cache"])
def test_tree_needs_no_tables_of_its_levels(spark, cached, monkeypatch):
    """Counts are written once and texts once, whatever the depth; a cut cache leaves the scores."""
    docs = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    names, written = [], suffix_tree.written
    monkeypatch.setattr(suffix_tree, "written", lambda df, name: names.append(name) or written(df, name))
    counts = suffix_tree.count(docs.where("doc_id % 3 <> 0"))
    want = sorted((r["doc_id"], r["score"]) for r in suffix_tree.score(docs, counts, suffix_tree.fit(counts)).collect())
    names.clear()
    monkeypatch.setattr(suffix_tree, "WHOLE", 0)
    monkeypatch.setattr(suffix_tree, "CACHED", cached)
    tree = suffix_tree.fit(counts)
    got = sorted((r["doc_id"], r["score"]) for r in suffix_tree.score(docs, counts, tree).collect())
    assert names == ["scored"] and not tree.whole and len(tree.keys) <= cached
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_groups_are_never_parted(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 56, 3000)
    keys[:1200] = (keys[:1200] & ~np.int64(0xFFFFFF00)) | 0x61626300  # one large group
    keys[1200:] = (keys[1200:] & ~np.int64(0xFFFFFF00)) | (rng.integers(0, 40, 1800) << 8)
    pivots = (keys >> 8) & 0xFFFFFF
    keys = keys[np.argsort(pivots, kind="stable")]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 70]), pa.array(np.arange(len(keys))[i : i + 70])], names=["gram", "n"]) for i in range(0, len(keys), 70)]
    for chunk in (10, 100, 1000, 1 << 19):
        monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
        parts = list(suffix_tree.groups(iter(batches)))
        assert (np.concatenate([k for k, _ in parts]) == keys).all() and (np.concatenate([n for _, n in parts]) == np.arange(len(keys))).all()
        own = [set(((k >> 8) & 0xFFFFFF).tolist()) for k, _ in parts]
        assert sum(map(len, own)) == len(set(pivots.tolist())) and (len(parts) > 1) == (chunk < 3000)
    assert not list(suffix_tree.groups(iter([])))


def test_streams_of_long_texts_are_whole(monkeypatch):
    texts = ["ab cde " * n for n in (1, 0, 40, 3, 90)] + ["x" * 300, "yy zz", None]
    whole, = suffix_tree.streams_of(texts)
    keys, hashes = suffix_tree.gram_keys(whole)[0], suffix_tree.word_hashes(whole)[0]
    for limit in (30, 64, 200):
        monkeypatch.setattr(suffix_tree, "LIMIT", limit)
        parts = list(suffix_tree.streams_of(texts))
        assert len(parts) > 3 and sum(len(p.closes) for p in parts) == len(texts)
        assert (np.concatenate([suffix_tree.gram_keys(p)[0] for p in parts]) == keys).all()
        assert (np.concatenate([suffix_tree.word_hashes(p)[0] for p in parts]) == hashes).all()


def test_tree_alone_beats_the_unigram_on_held_out_texts(spark):
    from palimpsest.llm.queries import op2_lm_score

    held = op2_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    counts = suffix_tree.count(docs.limit(0))
    row = suffix_tree.score(docs, counts, suffix_tree.fit(counts)).first()
    assert row["n_known"] == 0 and row["score"] == pytest.approx(-4 * math.log10(256))


def test_tree_gives_distributions(spark):
    docs = spark.createDataFrame(lm_docs(), "doc_id long, text string")
    tree = suffix_tree.fit(suffix_tree.count(docs))
    assert sum(len(x.contexts) for x in tree.levels[1:]) > 5
    for context in (b"\t" * suffix_tree.DEPTH, b"the of ", b"zzzzzzz", b"nd the "):
        base = sum(b << (8 * (i + 1)) for i, b in enumerate(reversed(context[-suffix_tree.DEPTH :])))
        p = 10 ** suffix_tree.log10_probabilities(tree, np.arange(256, dtype=np.int64) + base)
        assert p.sum() == pytest.approx(1.0, abs=1e-9)


# --- token files ----------------------------------------------------------------------------------------------


def test_range_coder_round_trip():
    rng = np.random.default_rng(6)
    block = rangecoder.BLOCK
    frames = [rng.zipf(1.3, n).clip(0, 49_000).astype(np.int32) for n in (0, 1, 2, 63, 64, 65, block - 1, block, block + 1, 5 * block + 7)]
    frames += [np.full(3 * block, 7, np.int32), np.tile(np.arange(50, dtype=np.int32), 300), rng.integers(0, 65535, 9000).astype(np.int32)]
    for ids in frames:
        stored, coded = rangecoder.encode(ids)
        back = rangecoder.decode(memoryview(stored), coded, len(ids))
        assert len(back) == len(ids) and (back == ids).all() and len(coded) == -(-len(ids) // block)
    stored, coded = rangecoder.encode(frames[9])
    for i, own in enumerate(coded[:-1]):  # every block can be read without the others
        assert (rangecoder.decode(memoryview(stored), [own], block) == frames[9][i * block : (i + 1) * block]).all()
    assert sum(map(len, rangecoder.encode(frames[10])[1])) < 3 * 120 and sum(map(len, rangecoder.encode(frames[11])[1])) < 2000


def test_frequencies_of_one_frame_fill_their_rows():
    ids = np.random.default_rng(9).zipf(1.2, 30_000).clip(0, 40_000).astype(np.int32)
    stored, found, entry = rangecoder.measured(ids)
    again = rangecoder.stored_frequencies(memoryview(stored))
    assert (again.entries == found.entries).all() and (again.bits == found.bits).all() and (again.of == found.of).all()
    assert len(found.slots()) == (1 << found.bits).sum()
    assert ((found.entries & rangecoder._WIDTH)[entry] > 0).all()


def test_token_files_are_small():
    """Bytes an id, all that a file holds counted: under the entropy of single ids, and under zlib on the same ids."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    parts = list(token_files.WordTokenizer(tokenizer_path(), 2)(texts))
    ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    payload = token_files.frame_of(np.arange(len(sizes)), sizes, ids, 0)
    assert (token_files.documents_of(payload)[3] == ids).all()
    share = np.bincount(ids) / len(ids)
    share = share[share > 0]
    assert len(payload) / len(ids) < -(share * np.log2(share)).sum() / 8
    assert len(payload) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_token_file_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [
        None, "", " ", "Hello, world!", "it's  a test of\x1cspace", "été ÉTÉ ΣΑΣ ς", "<|endoftext|> and x<|startoftext|>y", "日本語 текст 12345 %%%",
        "word " * 30_000, "same", "same", "𝒳 \U0001f600!!", "\0\x01",
    ]
    rows = [(i * 7 % 13, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    found = {r["doc_id"]: r for r in token_files.token_rows(docs, tokenizer_path(), path=str(tmp_path / "t")).collect()}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    at = 0
    for i, t in sorted(rows):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == want, (i, t)
        at += len(ids)
    assert token_files.token_rows(docs.limit(0), tokenizer_path()).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (None, "a"), (1, "c")], "doc_id long, text string")
    assert sorted(r["start"] for r in token_files.token_rows(nulls, tokenizer_path()).collect()) == [0, 2, 4]


def test_token_file_of_many_frames(spark, tmp_path, monkeypatch):
    """Frames hold whole documents, and long texts are tokenised a part at a time."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FRAME", 5000)
    monkeypatch.setattr(token_files, "PIECE", 300)
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["ab", "cd.", "x1", "d'or", "it's", "É"]) for _ in range(rng.choice([0, 1, 50, 3000]))) for _ in range(60)]
    words, tokenizer = token_files.WordTokenizer(tokenizer_path(), 2), Tokenizer.from_file(tokenizer_path())
    ids, sizes = (np.concatenate(x) for x in zip(*words(texts), strict=True))
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids.tolist() == [i for own in want for i in own] and sizes.tolist() == list(map(len, want))


def test_damaged_frames_are_refused():
    ids = np.arange(20_000, dtype=np.int32) % 300
    payload = token_files.frame_of(np.array([5, 6]), np.array([12_000, 8_000]), ids, 77)
    doc_ids, sizes, before, found = token_files.documents_of(payload)
    assert before == 77 and doc_ids.tolist() == [5, 6] and sizes.tolist() == [12_000, 8_000] and (found == ids).all()
    with pytest.raises(ValueError, match="frame"):
        token_files.documents_of(payload[:-9] + b"\0" + payload[-8:])
    head = list(token_files.HEAD.unpack_from(payload))
    body = bytearray(payload[token_files.HEAD.size :])
    body[2 * 12 + 4] ^= 1  # the checksum of the first block
    head[-1] = zlib.crc32(body)
    with pytest.raises(ValueError, match="block"):
        token_files.documents_of(token_files.HEAD.pack(*head) + bytes(body))


# --- mixing ---------------------------------------------------------------------------------------------------


def brute_rake(cells, targets, rounds=200):
    total = sum(cells.values())
    share = {k: v / total for k, v in cells.items() if v}
    for _ in range(rounds):
        for d in range(3):
            sums = Counter()
            for k, v in share.items():
                sums[k[d]] += v
            share = {k: v * targets[d][k[d]] / sums[k[d]] for k, v in share.items()}
    return share


def test_mixing_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 200)) + rng.choice(["", " !!", " | x"]), rng.choice(["en"] * 6 + ["de", None]), rng.choice(["a"] * 5 + ["b", "c"]), 0.5) for i in range(1500)]
    rows += [(9001, None, "en", "a", 0.0), (9002, "", "en", "a", 0.0), (9003, "w", "en", None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight double")
    found = mixing.mix(docs, share=0.4).collect()
    assert len(found) == len(rows)
    cells = Counter()
    for r in found:
        assert r["n_tokens"] == len(words(docs_text := dict((x[0], x[1]) for x in rows)[r["doc_id"]])) or docs_text is None
        cells[(r["source"], r["lang"], r["topic"])] += r["n_tokens"]
    powers, targets = (0.5, 0.5, 0.7), []
    for d in range(3):
        sums = Counter()
        for k, v in cells.items():
            sums[k[d]] += v
        raised = {k: v ** powers[d] for k, v in sums.items() if v}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    want, total = brute_rake(cells, targets), sum(cells.values())
    for r in found:
        key = (r["source"], r["lang"], r["topic"])
        assert r["weight"] == pytest.approx(want.get(key, 0) * total / cells[key] if cells[key] else 0, rel=0.02, abs=1e-6)
    expected = sum(r["n_tokens"] * r["probability"] for r in found)
    assert expected == pytest.approx(0.4 * total, rel=1e-3)
    assert sum(r["n_tokens"] for r in found if r["kept"]) == pytest.approx(expected, rel=0.1)
    kept = mixing.mixed(docs, share=0.4)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["kept"]}
    assert mixing.mix(docs.limit(0)).count() == 0
    fixed = mixing.mix(docs, share=0.3, shares={"lang": {"en": 1, "de": 1}}).collect()
    by = Counter()
    for r in fixed:
        by[r["lang"]] += r["n_tokens"] * r["weight"]
    assert by["en"] == pytest.approx(by["de"], rel=0.02) and by[None] == 0


@pytest.mark.parametrize("at_once", [200_000, 0])
def test_mixing_makes_up_for_full_cells(spark, monkeypatch, at_once):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", at_once)
    cells = [("a", "en", 1000), ("a", "de", 200), ("b", "en", 200), ("b", "de", 200)]
    rows = [(i, "w " * 10, lang, source) for i, (source, lang) in enumerate((s, x) for s, x, n in cells for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = mixing.mix(docs, share=0.45, shares={"source": {"a": 1, "b": 1}, "lang": {"en": 1, "de": 1}}).collect()
    assert max(r["probability"] for r in found) <= 1
    by = Counter()
    for r in found:
        for d in ("source", "lang", "topic"):
            by[r[d]] += r["n_tokens"] * r["probability"] / (0.45 * 16000)
    assert {k: round(v, 3) for k, v in by.items()} == {"a": 0.5, "b": 0.5, "en": 0.5, "de": 0.5, "short": 1.0}


def test_mixing_by_arrays_and_by_joins_agree(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(i, "w " * rng.randrange(1, 300), rng.choice(["en"] * 7 + ["de", "fr"]), rng.choice(["a"] * 6 + ["b", "c", "d"]), "x") for i in range(600)]
    rows += [(-1, None, None, None, "x"), (-2, "w " * 200_000, "it", "e", "x"), (-2, "w", "it", "e", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")
    found = []
    for at_once in (200_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", at_once)
        found.append(sorted(((r["doc_id"], r["n_tokens"], r["weight"], r["probability"]) for r in mixing.mix(docs, share=0.6).collect()), key=lambda r: r[:2]))
    assert len(found[0]) == len(rows) and max(r[3] for r in found[0]) <= 1
    for one, other in zip(*found, strict=True):
        assert one == pytest.approx(other, rel=1e-3, abs=1e-9)


# --- pipeline -------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after.select(*docs.columns).checkpoint()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert found == {r["doc_id"] for r in docs.collect()}
    kept = spark.read.parquet(f"{sf}/documents.parquet").join(docs.select("doc_id"), "doc_id", "left_semi")
    assert kept.where(F.col("text").isNull()).count() == 0


def test_near_duplicates_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    kept = sorted(r["doc_id"] or 0 for r in near_dedup.without_near_duplicates(docs).collect())
    assert kept == [0, 0, 3]


def test_near_duplicates_with_repeated_ids(spark):
    t, u, v = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(3, t, 1), (5, t, 2), (5, u, 3), (3, t, 4), (7, u, 5), (7, v, 6), (7, None, 7), (8, "", 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, n=4).collect())
    assert got == [(3, 5, 3, True), (3, 5, 3, True), (5, 5, 3, False), (5, 5, 5, True), (7, 0, 7, True), (7, 5, 5, False), (7, 5, 7, True), (8, 0, 8, True), (8, 0, 8, True)]
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.without_near_duplicates(docs, n=4).collect()), key=str)
    assert kept == sorted([(3, t), (5, u), (7, v), (7, None), (8, ""), (8, "")], key=str)


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:-300])), (3, " ".join(long[:120_000]))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
