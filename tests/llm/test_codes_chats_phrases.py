"""Vector codes, chat formatting and phrase collocations against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import chat_format, collocations, vector_codes

# --- vector codes -----------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, assigned string, carried int, error string"


def brute_codes(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows if v is not None and v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    size = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == size]
    width = size // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    return [(r[0], r[2], [m[1] for m in f], sum(m[0] for m in f)) for r, f in zip(kept, found, strict=True)], books


@pytest.mark.parametrize("seed, size, top", [(1, 8, 3), (2, 4, 2), (3, 12, 400_000)])
def test_codes_against_brute_force(spark, seed, size, top):
    """Small whole components make many ties; large ones leave the range in which doubles are exact."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-top, top) / (1024 if top < 10 else 1) for _ in range(size)], rng.choice([None, 1, 2]), "x", 1, "y") for i in range(300)]
    rows += [rows[5], rows[5], (None, rows[7][1], 3, "x", 1, "y"), (900, None, 1, "x", 1, "y"), (901, [], 1, "x", 1, "y"), (902, [0.5] * (size - 1) + [None], 1, "x", 1, "y")]
    rows += [(-3, [0.0] * (size - 1) + [x], 1, "x", 1, "y") for x in (float("nan"), float("inf"), float("-inf"))] + [(903, [1.0] * (size + 4), 1, "x", 1, "y"), (-4, [1.0] * (size + 1), 1, "x", 1, "y")]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = vector_codes.compress(frame, entries=32)
    want, books = brute_codes(rows, 4, 32, 4)
    assert got.codebooks.tolist() == books
    assert got.rows.columns == ["vec_id", "label", "assigned", "error"]
    assert sorted(map(repr, map(tuple, got.rows.collect()))) == sorted(map(repr, want))
    assert got.scans[0] == 4 * len(want)
    assert top == 2 or all(n < 4 * len(want) for n in got.scans[1:])  # single components of four values are all ties, which are always compared again


def test_codes_of_few_or_no_vectors(spark):
    one = vector_codes.compress(spark.createDataFrame([(4, [0.5, -0.25, 0.0, 1.0], None, "x", 1, "y")], VECTORS))
    assert [tuple(r) for r in one.rows.collect()] == [(4, None, [0, 0, 0, 0], 0)] and one.codebooks.tolist() == [[[512]], [[-256]], [[0]], [[1024]]]
    for rows in ([], [(1, None, 1, "x", 1, "y")]):
        none = vector_codes.compress(spark.createDataFrame(rows, VECTORS))
        assert none.rows.columns == ["vec_id", "label", "assigned", "error"] and none.rows.count() == 0
        assert none.digest() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="scaled component"):
        vector_codes.compress(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 1, "x", 1, "y")], VECTORS))


# --- chat formatting --------------------------------------------------------------------------------------------

PARTS = ["<", "[", "/", "s>", "</s>", "<s>", "\\", "[INST]", " [/INST]", "INST]", "[/SYS]\n", "[ROLE] ", "[\\s>", "<\\/s>", "[\\\\TURN]", "é", "\n", " ", "a", "\0", "日本"]


def brute_digest(turns):
    loss = "".join(text or "" for role, text in turns if role == "assistant")
    return len(turns), hashlib.sha256("".join(f"{role or ''}\n{text or ''}\n" for role, text in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "x" * 200_000 + "</s>", *["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(12)]])
            rows.append((conv, rng.choice([turn, turn, 3, None]), rng.choice(["user", "assistant", "system", None, "", "tool", "[/ROLE] <s>"]), text, 1))
    rows += [(77, t, "user" if t % 2 else "assistant", f"turn {t} [INST] é", 1) for t in range(3000)]  # one conversation with most of the rows
    rows += [rows[0], rows[0], rows[3]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(7)
    own: dict = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode())):
        own.setdefault(conv, []).append((role, text))
    for piece, coalesce in ((1 << 30, "true"), (1 << 30, "false"), (10_000, "false")):
        settings = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.execution.arrow.maxRecordsPerBatch": "90" if piece == 10_000 else "1000"}
        for name, value in settings.items():
            spark.conf.set(name, value)
        pieces = chat_format.formatted(frame, piece=piece)
        for name in settings:
            spark.conf.unset(name)
        got = {r[0]: tuple(r)[1:] for r in chat_format.digests(pieces).collect()}
        assert {k: v[:4] for k, v in got.items()} == {k: brute_digest(v) for k, v in own.items()}
        hot = pieces.where("conv_id = 77").select("part").collect()
        assert len({r["part"] for r in hot}) > 1 or coalesce == "true"
        assert piece > 10_000 or len(hot) > 4
        back: dict = {}
        for r in chat_format.restored(pieces).orderBy("part", "seq", "nth").collect():
            back.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
        assert back == {k: [(role or "", text or "") for role, text in v] for k, v in own.items()}
        for r in pieces.collect():
            data = r["text"].encode()
            said = [chat_format.unescape(data[a:b]) for a, b in zip(r["loss_from"], r["loss_to"], strict=True)]
            assert said == [text for role, text in chat_format.parse(data) if role == b"assistant"]


def test_escapes_leave_no_mark_and_come_back():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12))).encode()
        escaped = chat_format.escape(text)
        assert chat_format.unescape(escaped) == text
        assert not any(mark in escaped for mark in (b"</s>", b"<s>", b"[INST]", b"[/INST]", b"[SYS]", b"[/SYS]", b"[ROLE]", b"[/ROLE]", b"[/TURN]"))
    with pytest.raises(ValueError, match="not a formatted text"):
        list(chat_format.parse(b"[INST] a [/INST]x"))


def test_chats_of_an_empty_table(spark):
    none = chat_format.formatted(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert none.count() == 0 and chat_format.digests(none).count() == 0 and chat_format.restored(none).count() == 0


# --- phrase collocations ----------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, least, longest, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        piece = (text or "").translate(LOWER)
        for c in ",;:!?\n\x0b\x0c\r":
            piece = piece.replace(c, ".")
        for own in piece.split("."):
            words = [w for w in own.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out: dict = {}
    for (lang, w), a in found.items():
        if any(o == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (o, v), b in found.items()):
            continue
        score, _, x, y = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), x, y))
    return [(lang, i, w.decode(), -a, x, y, n[lang], -score) for lang, own in out.items() for i, (score, a, w, x, y) in enumerate(sorted(own)[:top], 1)]


@pytest.mark.parametrize("percent, top, max_bits", [(100, 2000, 1 << 29), (70, 2000, 1 << 15), (100, 4, 64)])
def test_phrases_against_brute_force(spark, percent, top, max_bits):
    """The smallest filter lets nearly everything through; counts stay exact."""
    rng = random.Random(percent)
    vocabulary = ["a", "B", "b", "é", "É", "x" * 40, "\0", "日", "-", " ", "c'"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(t, rng.choice(["en", "en", "en", None, "und", "fr"])) for t in texts] + [(None, "en"), ("", "fr"), (" .;\n", "de"), ("one two", "it"), ("a b c d " * 4000, "en")]
    rows += rows[:9]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = [tuple(r) for r in collocations.collocations(frame, least=8, percent=percent, top=top, max_bits=max(max_bits, 1 << 12)).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 8, 5, percent, top))


def test_phrases_of_long_texts_and_empty_tables(spark):
    """A text of several slices, with a piece that is longer than one."""
    text = "a b c. " * 700_000 + "d e " * 1_200_000
    got = {r["phrase"]: (r["a"], r["n"]) for r in collocations.collocations(spark.createDataFrame([(text, "en")], "text string, lang string")).collect()}
    assert got["a b c"] == (700_000, 4_500_000) and got["d e"] == (1_200_000, 4_500_000) and got["d e d e"] == (1_199_999, 4_500_000)
    assert not {"a b", "b c", "c a", "d e d"} & set(got)
    for rows in ([], [("one two three", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


@pytest.mark.parametrize("most, each", [(0, None), (1 << 20, None), (1 << 20, 1), (1 << 20, 2)], ids=["keys", "numbers", "a word a long", "two words a long"])
def test_phrases_by_numbers_and_by_keys(spark, monkeypatch, most, each):
    """Both forms against brute force; phrases of numbers in several longs too."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("a b c d é 日 rare{}".format(rng.randrange(900)).split()) for _ in range(30)) + ". A b", rng.choice(["en", None, "fr"])) for _ in range(90)] + [(None, None), ("", "x")]
    monkeypatch.setattr(collocations, "MAX_WORDS", most)
    if each:
        made = collocations.Numbers.__init__

        def fewer(self, found):
            made(self, found)
            self.each = each

        monkeypatch.setattr(collocations.Numbers, "__init__", fewer)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    if most:
        monkeypatch.setattr(collocations, "names", None)  # no pass gives out the phrases of each task as words
    got = [tuple(r) for r in collocations.collocations(frame, least=7).collect()]
    assert got and sorted(got) == sorted(brute_phrases(rows, 7, 5, 100, 2000))


@pytest.mark.parametrize("each", (63, 2), ids=["one long", "two longs"])
def test_a_task_gives_out_each_phrase_once(spark, each):
    """A task of many batches gives one row for each of its phrases."""
    import pyarrow as pa

    rows = [(["en", "fr"][i % 2], " ".join("a b c d e".split()[i % 5 :] + ["f"] * (i % 3)) + ". ") for i in range(400)]
    own = collocations.Numbers(pa.table({"lang": [x for x in ("en", "fr") for _ in "abcdef"], "word": list("abcdef") * 2}))
    own.each = min(own.each, each)
    columns = [f"c{i}" for i in range(-(-3 // own.each))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
        given = [tuple(r) for r in collocations.numbered_counts(frame, 3, spark.sparkContext.broadcast(own), None, columns).collect()]
    finally:
        spark.conf.set(size, before)
    assert len({r[:-1] for r in given}) == len(given) == 10
    assert sum(r[-1] for r in given) == sum(max(0, len(t[:-2].split()) - 2) for _, t in rows)


def test_sums_of_slices_do_not_depend_on_what_is_held(monkeypatch):
    rng = np.random.default_rng(4)
    slices = [([rng.integers(0, 9, n), rng.integers(-3, 3, n)], rng.integers(1, 50, n)) for n in (0, 1, 40, 7, 0, 90, 3)]
    want = Counter()
    for parts, counts in slices:
        for *key, f in zip(*parts, counts, strict=True):
            want[tuple(key)] += f
    for held in (400_000, 20, 1):
        monkeypatch.setattr(collocations, "HELD", held)
        got, rows = Counter(), 0
        for parts, counts in collocations.summed_up(iter(slices)):
            rows += len(counts)
            for *key, f in zip(*parts, counts, strict=True):
                got[tuple(key)] += f
        assert got == want and (rows == len(want)) == (held == 400_000)
    assert not list(collocations.summed_up(iter([])))
