"""URL filter, licenses, decontamination, language ID, toxicity and fingerprints on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from palimpsest.llm import decontaminate, language, licenses, multiset, textops, toxicity, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


ODD = [None, "", " ", "\n\t", "É à ñ", "a", "A b C", "x" * 50_000, "word " * 20_000, "\0 \x7f", "same text", "same text"]


def test_scan_finds_words_and_equal_hashes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB1é ,\t\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    found = textops.scan([t.encode() for t in texts], textops.ALNUM)
    by_hash: dict[int, str] = {}
    for i, text in enumerate(texts):
        a, b = found.first[i], found.first[i + 1]
        own = [found.buf[s:e].decode() for s, e in zip(found.starts[a:b], found.ends[a:b], strict=True)]
        assert own == words(text)
        for w, h in zip(own, found.hashes[a:b].tolist(), strict=True):
            assert by_hash.setdefault(h, w) == w
    assert len(set(by_hash.values())) == len(by_hash)


# --- URL filter -----------------------------------------------------------------------------------------------

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    return host.translate(LOWER), path


def test_url_filter_against_brute_force(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.Example.NET/en/1", "http://example.net", "http://example.net/de/", "http://xexample.net/en/",
        "http://www.example.com/de/x?q=1#f", "http://example.com/de", "ftp://b.org/fr/://", "http://bad.org/p.html", "http://WWW.bad.org/p/", "http://bad.org/q",
        "http://net/", "http://net?x/", "http://bad.org/p.html", "http://a.b/c#d/e",
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, block int")
    listed = spark.createDataFrame([("bad.org/p",), ("bad.org/p",), (None,), ("gone.example/x",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, listed, RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = url_parts(u)
        fits = [
            (len(rule), action, rule)
            for action, rule in RULES
            for name, _, prefix in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix)
        ]
        canonical = re.sub(r"^www\.", "", host) + re.sub(r"(\.html|/+)$", "", path) if host else None
        best = max(fits, default=None)
        verdict = best[1] if best else "block" if canonical == "bad.org/p" else "allow"
        assert got[i] == (host, path, best[2] if best else None, verdict), u


def test_url_filter_small_filter_gives_the_same_rows(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.example/p{i}") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i % 50}.example/p{i}",) for i in range(0, 400, 3)], "canonical string")
    wide = url_filter.filter_urls(pages, listed, RULES)
    tight = url_filter.filter_urls(pages, listed, RULES, max_bytes=64)
    assert sorted(map(tuple, wide.drop("possible").collect())) == sorted(map(tuple, tight.drop("possible").collect()))
    assert wide.where("verdict = 'block'").count() == len(range(0, 400, 3))
    assert wide.where("possible and not listed").count() < 40
    assert url_filter.filter_urls(pages.limit(0), listed, RULES).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), RULES).where("verdict = 'block'").count() == 0


# --- licenses -------------------------------------------------------------------------------------------------


def brute_base(text):
    own = words(text)
    found = [
        (i, label)
        for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
        for i in range(len(own))
        if own[i : i + len(phrase.split())] == phrase.split()
    ]
    return len(own), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), sorted({x for _, x in found})


def test_licenses_base_against_brute_force(spark):
    texts = [*ODD, "MIT license mit LICENSE", "cc by cc by", "cc-by 4.0", "the Apache\nLicense; GNU, general public licenses", "gnu general public license gnu general public license"]
    docs = spark.createDataFrame([(i, t, 0.5, "l") for i, t in enumerate(texts)], "doc_id long, text string, score double, labels string")
    for r in licenses.license_scan(docs).collect():
        n, n_base, first, last, labels = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, n_base, first, last, labels)
        assert set(labels) <= set(r["labels"])
        assert (r["score"] == 1.0) == (n_base > 0)
    assert licenses.license_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [("under the Apache Licence here", "apache"), ("gnu genral public license", "gpl"), ("GNU General Publc Licence", "gpl"), ("the MIT licence", "mit"), ("BSD license", "bsd")],
)
def test_licenses_with_edits(text, label):
    found = licenses.scan_text(text, licenses.prepared())
    assert found[5] == [label] and 0.8 < found[6] <= 1.0
    span = found[7][0]
    assert words(text)[span["start_word"] : span["end_word"]][-1].startswith("lic")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_fuzzy_licenses_against_brute_force():
    rng = random.Random(4)
    ready = licenses.prepared()
    pool = [w for notice in licenses.NOTICES for w in notice[0].split()] + ["the", "licence", "of", "bsdlicense"]
    for _ in range(150):
        own = []
        for _ in range(rng.randrange(1, 4)):
            own += rng.choices(pool, k=rng.randrange(3)) + rng.choice(licenses.NOTICES)[0].split()
        text = list(" ".join(own))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "x", " ", "e"])
        found = words("".join(text))
        got = licenses.scan_text("".join(text), ready)
        near = set()
        for notice in ready:
            for i in range(len(found)):
                for j in range(i + 1, min(len(found), i + 12) + 1):
                    off = edit_distance(" ".join(found[i:j]).encode(), notice.phrase)
                    if off <= notice.edits and (off == 0 or notice.edits or not notice.exact):
                        near.add(notice.label)
        assert got[5] == sorted(near)
        for span in got[7]:
            own = " ".join(found[span["start_word"] : span["end_word"]]).encode()
            assert any(n.label == span["label"] and edit_distance(own, n.phrase) <= span["edits"] <= n.edits for n in ready), (span, found)


def test_licenses_of_very_long_texts():
    for text, hits in (("gnu general public license " * 38_000, 38_000), ("the gnu genral public licence. " * 33_000, 0)):
        began = time.thread_time()
        found = licenses.scan_text(text, licenses.prepared())
        assert found[1] == hits and found[5] == ["gpl"] and len(found[7]) >= 33_000 and found[7][-1]["end_word"] >= found[0] - 1
        assert time.thread_time() - began < 6


def test_licenses_leave_other_texts_alone():
    for text in ("it licensed the patent", "apache helicopter", "general public", "by cc", "a permit license"):
        assert licenses.scan_text(text, licenses.prepared())[5] == []


# --- decontamination ------------------------------------------------------------------------------------------


def brute_hits(text, items, n):
    own, hit, ids = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == w[k : k + size]:
                    hit.update(range(i, i + size))
                    ids.add(str(item_id))
    return len(own), len(hit), sorted(ids)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = "a b c d é f1 g".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(1, 9))) for i in range(20)] + [(20, None), (21, ""), (22, "Only One"), (22, "only one")]
    texts = [*(text(rng.randrange(40)) for _ in range(60)), None, "", "ONLY, one!", "only"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for bound in (16 << 20, 60):
        found = decontaminate.contamination(docs, bench, n=4, broadcast_bytes=bound).collect()
        assert len(found) == len(texts)
        for r in found:
            n_hit = sum(b - a for a, b in zip(r["froms"], r["tos"], strict=True))
            assert (r["n_words"], n_hit, r["items"]) == brute_hits(texts[r["doc_id"]], items, 4)
        kept = decontaminate.decontaminated(docs, bench, n=4, broadcast_bytes=bound)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items, 4)[1]}
        cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, bench, n=4, mode="spans", broadcast_bytes=bound).collect()}
        assert len(cut) == len(texts) and cut[len(texts) - 4] is None and cut[len(texts) - 2] == "!"
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(froms) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_of_very_long_texts_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, long, "a"), (1, long, "b"), (None, "w5 w6 w7 w8", "c")], "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(None, "w5 w6 w7 w8"), ("q", "w99998 w99999")], "item_id string, text string")
    for bound in (16 << 20, 5):
        found = sorted((r["doc_id"] or 0, r["n_words"], r["froms"], r["tos"], r["items"]) for r in decontaminate.contamination(docs, bench, n=4, broadcast_bytes=bound).collect())
        assert found == [(0, 4, [0], [4], [""])] + [(1, 100_000, [5, 99_998], [9, 100_000], ["", "q"])] * 2


# --- language -------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away from there with that thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann schnell nach hause",
    "fr": "le renard brun saute par dessus le chien paresseux et puis il rentre à la maison très vite",
}


def test_language_identification(spark):
    rng = random.Random(1)
    rows = []
    for lang, text in SAMPLES.items():
        own = text.split()
        rows += [(len(rows) + i, " ".join(rng.choices(own, k=12)), lang, "s") for i in range(40)]
    rows += [(9000, None, "en", "s"), (9001, "1234 !!", "en", "s"), (9002, "der hund", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs.where("doc_id % 2 = 0 and doc_id < 9000"))
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    right = [found[i]["lang_pred"] == lang for i, _, lang, _ in rows if i % 2 and i < 9000]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[9000]["lang_pred"] == found[9001]["lang_pred"] == "und" and found[9000]["score"] == 0
    kept = language.with_known_language(docs, model)
    assert kept.columns == docs.columns and {9000, 9001}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_language_weights_equal_the_kernel_form():
    texts = [(lang, " ".join(np.random.default_rng(i).choice(t.split(), 10))) for i in range(12) for lang, t in SAMPLES.items()]
    grams = [language.presence(t) for _, t in texts]
    model = language.fit_arrays([x for x, _ in texts], grams, 4, 0.1)
    marks = [i for x in model.languages for i in [j for j, (y, _) in enumerate(texts) if y == x][:4]]
    kernel = lambda a, b: len(np.intersect1d(a, b)) / (len(a) * len(b)) ** 0.5
    kzz = np.array([[kernel(grams[i], grams[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(kzz)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kxz = np.array([[kernel(g, grams[j]) for j in marks] for g in grams])
    phi = kxz @ root
    y = np.where(np.array([x for x, _ in texts])[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    want = phi @ np.linalg.solve(phi.T @ phi + 0.1 * np.eye(phi.shape[1]), phi.T @ y)
    scorer = language.Scorer(model)
    assert np.allclose(scorer._scores(grams), want, atol=1e-4)
    assert scorer([t for _, t in texts])["lang_pred"].tolist() == [model.languages[i] for i in want.argmax(axis=1)]


def test_language_sample_takes_each_row_once(spark):
    rows = [(1, "der hund", "de", 0)] * 200 + [(i, f"the dog {i}", "en", 0) for i in range(2000)] + [(1, "die katze", "de", 0), (None, "x", "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rank int")
    found = language.sample(docs, "doc_id", "text", "lang", 100).collect()
    assert sorted(r["text"] for r in found if r["lang"] == "de") == ["der hund", "die katze"]
    own = [r["rank"] for r in found if r["lang"] == "en"]
    assert sorted(own) == list(range(1, 101)) and len({r["text"] for r in found}) == 102
    assert sorted(map(tuple, language.sample(docs, "doc_id", "text", "lang", 100).collect())) == sorted(map(tuple, found))


def test_language_of_odd_rows(spark):
    rows = [(i, t, "xx", "de") for i, t in enumerate([*ODD, "der hund " * 50_000, "語" * 5, "語" * 5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, lang string")
    model = language.fit(spark.createDataFrame([(1, "der hund", "de"), (2, "the dog", "en"), (3, "語文 語", "zh")], "doc_id long, text string, lang string"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows) and found[len(ODD)][0] == "de" and found[len(ODD) + 1] == found[len(ODD) + 2] and found[len(ODD) + 1][0] == "zh"
    assert all(found[i] == ("und", 0.0) for i, t in enumerate(ODD) if not any(c.isalpha() for c in t or ""))
    assert language.identify(docs.limit(0), model).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------


def test_toxicity_catches_learned_stems(spark):
    rng = random.Random(2)
    plain = [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(1200):
        toxic = i % 4 == 0
        text = rng.choices(plain, k=30)
        if toxic:
            text[3], text[9] = rng.choice(["grobix", "grobia", "flumpo", "idiot"]), "grobi" + rng.choice("abcde")
        rows.append((i, " ".join(text), int(toxic)))
    rows += [(5000, None, 0), (5001, "", 0), (5002, "x" * 30_000, 0), (5002, "x" * 30_000, 0)]
    docs = spark.createDataFrame([r[:2] + (0.1,) for r in rows], "doc_id long, text string, features double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3 and r[0] < 5000], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels, trees=5).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    held = [(r["predicted"], rows[r["doc_id"]][2]) for r in found if r["doc_id"] < 1200 and r["doc_id"] % 3 == 0]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert {r["predicted"] for r in found if r["doc_id"] >= 5000} == {0}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels, trees=2).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------------------


def test_fingerprints_and_edited_texts(spark):
    texts = {i: t for i, t in enumerate([*ODD, "one.\ntwo.\nthree.", "three.\none.\ntwo.", "one.\ntwo.\nfour.", "é" * 7])}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, next string")
    for ranges in (1, 3, 40):
        got = {r["doc_id"]: r for r in multiset.edited_fingerprints(docs, ranges=ranges).collect()}
        assert len(got) == len(texts)
        order = sorted(texts, reverse=True)
        for at, i in enumerate(order):
            own, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            assert got[i]["n_chars"] == len(own)
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    base = len(ODD)
    assert got[base]["fingerprint"] == got[base + 1]["fingerprint"] != got[base + 2]["fingerprint"]
    assert got[10]["fingerprint"] == got[11]["fingerprint"]
    assert multiset.edited_fingerprints(docs.limit(0)).count() == 0
    one = multiset.edited_fingerprints(docs.where("doc_id = 6"), ranges=4).first()
    assert one["near_next"] == 1.0


def test_fingerprints_combine(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a.\nb.\nb.", "c.", "b.\nc.\na.\nb.")], "x string, y string, both string")
    fp = {c: multiset.fingerprint(F.col(c)) for c in row.columns}
    found = row.select(
        (multiset.combine(fp["x"], fp["y"]) == fp["both"]).alias("sum"), (multiset.combine(fp["both"], fp["y"], -1) == fp["x"]).alias("difference")
    ).first()
    assert found["sum"] and found["difference"]


def test_paragraphs_are_added_as_rows(spark):
    """Sums over rows are those of the expression, also with more paragraphs than a packed lane could hold; only texts are shuffled."""
    from pyspark.sql import functions as F

    texts = [*(t or "" for t in ODD), "", "\n\n", "one. two! three?\nfour", "the same line\n" * 80_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = multiset.summed(rows.select("id", F.array("text", F.lit("a.\nb."), "text").alias("texts")), ["id"])
    want = rows.select("id", multiset.fingerprint(F.col("text")).alias("fp"), multiset.fingerprint(F.lit("a.\nb.")).alias("other"))
    found = {(r["id"], r["which"]): r["fp"] for r in got.collect()}
    assert len(found) == 3 * len(texts)
    for r in want.collect():
        assert found[r["id"], 0] == found[r["id"], 2] == r["fp"] and found[r["id"], 1] == r["other"]
    plan = multiset.edited_fingerprints(rows.withColumnRenamed("id", "doc_id"), ranges=3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(place" not in plan and plan.count("Generate explode(split(") == 1


def test_likeness_of_half_shared_texts(spark):
    """The error of the likeness of two texts of 40 paragraphs that share 20, against the exact 0.5."""
    from pyspark.sql import functions as F

    x, y = (F.concat_ws("\n", F.transform(F.sequence(F.lit(a), F.lit(a + 39)), lambda i: F.concat_ws(" ", "id", i))) for a in (0, 20))
    pairs = spark.range(1000).select(x.alias("x"), y.alias("y"))
    near = pairs.select(multiset.likeness(multiset.fingerprint(F.col("x")), multiset.fingerprint(F.col("y"))).alias("s"))
    error = near.agg(F.sqrt(F.avg((F.col("s") - 0.5) ** 2))).first()[0]
    assert multiset.LANES >= 60 and error < 0.1025


def plain_lanes(text):
    """Sums of each lane over the paragraphs of a text, by plain Python around Spark's own 64-bit hash."""
    import xxhash

    hashed = lambda data, seed: xxhash.xxh64(data, seed=seed).intdigest()
    sums = [0] * multiset.LANES
    for p in filter(None, re.split(multiset.PARAGRAPH_END, text or "")):
        a = hashed(p.encode(), 42)
        b = hashed((1).to_bytes(4, "little"), a)
        for k in range(multiset.WORDS):
            word = hashed(k.to_bytes(4, "little"), hashed((a if k % 2 else b).to_bytes(8, "little"), 42))
            for i in range(3):
                sums[3 * k + i] += (word >> (multiset.FIELD * i) & 30) - 15
    return sums


def test_lane_sums_and_likeness_against_plain_sums(spark):
    texts = ["one line.\nanother line. And a third!\n", "x\n" * 50, "", "x\ny\nx\n\n\nz", "another line.\nx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    want = [plain_lanes(t) for t in texts]
    got = {r["doc_id"]: r["l"] for r in rows.select("doc_id", multiset.lanes(multiset.fingerprint(F.col("text"))).alias("l")).collect()}
    assert [got[i] for i in range(5)] == want

    def near(x, y):
        size = (sum(v * v for v in x) * sum(v * v for v in y)) ** 0.5
        return 1.0 if x == y else max(0.0, sum(a * b for a, b in zip(x, y, strict=True)) / size) if size else 0.0

    for found in (multiset.edited_fingerprints(rows, ranges=3).collect(), multiset.edited_fingerprints(rows, ranges=1).collect()):
        for r in found:
            i = r["doc_id"]
            own, after = texts[i], texts[i - 1] if i else texts[-1]
            half = len(own) // 2
            assert r["near_next"] == pytest.approx(near(want[i], plain_lanes(after)))
            assert r["near_edited"] == pytest.approx(near(want[i], plain_lanes(own[: len(own) - half] + after[:half])))


def test_likeness_of_repeated_lines(spark, monkeypatch):
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(5000, 4000), (8000, 4000), (17_000, 3)], "a int, b int")
    near = multiset.likeness(*[multiset.fingerprint(F.repeat(F.lit("the same line\n"), F.col(c))) for c in "ab"])
    assert [r[0] for r in pairs.select(near).collect()] == pytest.approx([1.0, 1.0, 1.0])
    docs = spark.createDataFrame([(i, f"text {i}\n" * (i % 7)) for i in range(60)], "doc_id long, text string")
    by_broadcast = sorted(map(tuple, multiset.edited_fingerprints(docs, ranges=9).collect()))
    monkeypatch.setattr(multiset, "BROADCAST_CHARS", -1)
    assert sorted(map(tuple, multiset.edited_fingerprints(docs, ranges=9).collect())) == by_broadcast
