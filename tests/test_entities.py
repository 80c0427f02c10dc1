"""Similar names against all pairs, and the steps of entity resolution."""

from __future__ import annotations

import random

import pytest

from palimpsest.functions.similarity import jaro
from palimpsest.operators import entities as E


def winkler(x, y):
    s = jaro(x, y)
    same = next((i for i in range(4) if x[i : i + 1] != y[i : i + 1] or not x[i : i + 1]), 4)
    return s + 0.1 * same * (1 - s) if s > 0.7 else s


def variants(rng, words, n):
    """Names with letters changed, dropped, doubled or exchanged, at their start too."""
    out = set()
    while len(out) < n:
        w = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w)) if w else 0
            kind = rng.randrange(4)
            if kind == 0 and w:
                w[i] = rng.choice("abcdeé z")
            elif kind == 1 and w:
                del w[i]
            elif kind == 2:
                w.insert(i, rng.choice("abcdeé z"))
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        out.add("".join(w))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.85, 0.95, 0.75])
def test_similar_names_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(int(threshold * 100))
    names = variants(rng, ["alexander", "ann", "bo", "catherine", "de la cruz", "zzzz", "aaaaaaaa", "mississippi", "x"], 160)
    left, right = names[::2] + ["same"], names[1::2] + ["same", "same"]
    frame = lambda n: spark.createDataFrame([(x,) for x in [*n, None, ""]], "name string")
    got = {(r["name"], r["other"]): r["score"] for r in E.similar_names(frame(left), frame(right), threshold).collect()}
    want = {(a, b): winkler(a, b) for a in left for b in right if a and b and a != b and winkler(a, b) >= threshold}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[p] == pytest.approx(want[p]) for p in want)
    with pytest.raises(ValueError, match="threshold"):
        E.similar_names(frame(left), frame(right), 0.5)


def test_resolution_in_order(spark):
    entities = spark.createDataFrame([("e1", "Alexander"), ("e2", "Catherine"), ("e3", "Alexandre")], "entity_id string, name string")
    aliases = spark.createDataFrame([("e2", "Kitty", 1.0, "user"), ("e1", "Catherine", 1.0, "user")], "entity_id string, alias string, confidence double, source string")
    said = ["alexander", " Catherine ", "KITTY", "Alexanders", "Kittyy", "Zebedee", "Zebedeee", "zebedee", "Quux", "she", "12.5", "ab", "x" * 101, None, "", "Quux"]
    rows = {r["mention"]: r for r in E.resolve(spark.createDataFrame([(m,) for m in said], "mention string"), entities, aliases.select("entity_id", "alias")).collect()}
    short = {m: (r["entity_id"], r["how"]) for m, r in rows.items()}
    fresh = short["Zebedee"][0]
    assert short == {
        "alexander": ("e1", "name"), " Catherine ": ("e2", "name"), "KITTY": ("e2", "alias"), "Alexanders": ("e1", "fuzzy"), "Kittyy": ("e2", "fuzzy"),
        "Zebedee": (fresh, "new"), "Zebedeee": (fresh, "new"), "zebedee": (fresh, "new"), "Quux": (short["Quux"][0], "new"),
    }
    assert fresh.startswith("new-") and short["Quux"][0] != fresh
    assert rows["Alexanders"]["score"] == pytest.approx(max(winkler("alexanders", x) for x in ("alexander", "alexandre")))
    learned = {(r["entity_id"], r["alias"], r["source"]) for r in E.with_aliases(E.resolve(spark.createDataFrame([(m,) for m in said], "mention string"), entities, aliases.select("entity_id", "alias")), aliases).collect()}
    assert {("e1", "Alexanders", "jaro_winkler"), ("e2", "Kittyy", "jaro_winkler"), ("e2", "Kitty", "user"), (fresh, "Zebedeee", "canonical")} <= learned and len(learned) == 7


def test_merging_entities(spark):
    entities = spark.createDataFrame([("e1", "A"), ("e2", "B")], "entity_id string, name string")
    aliases = spark.createDataFrame([("e1", "a2", 1.0, "user"), ("e2", "A2", 0.9, "user"), ("e2", "b2", 0.9, "user")], "entity_id string, alias string, confidence double, source string")
    facts = spark.createDataFrame([(1, ["e2", "e1"]), (2, ["e2", "e3", "e2"]), (3, ["e3", "e3"]), (4, None)], "fact_id long, entities array<string>")
    left, names, own = E.merged(entities, aliases, facts, "e1", "e2")
    assert [tuple(r) for r in left.collect()] == [("e1", "A")]
    assert {(r["entity_id"], r["alias"], r["source"]) for r in names.collect()} == {("e1", "A2", "merge_from:e2"), ("e1", "b2", "merge_from:e2"), ("e1", "B", "merge")}
    assert {r["fact_id"]: r["entities"] for r in own.collect()} == {1: ["e1"], 2: ["e1", "e3"], 3: ["e3", "e3"], 4: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "entity_id string, name string")
    aliases = spark.createDataFrame([], "entity_id string, alias string")
    assert E.resolve(spark.createDataFrame([], "mention string"), none, aliases).count() == 0
    one = E.resolve(spark.createDataFrame([("Ada",)], "mention string"), none, aliases).first()
    assert one["how"] == "new"
