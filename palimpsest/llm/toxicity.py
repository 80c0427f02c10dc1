"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities and counts of lexicon words and stems, how near they stand to a second-person
pronoun, and the rates of capitals, exclamation marks, other punctuation and obfuscated words. The lexicon is a
short fixed list and what is learned: words and stems whose document frequency among toxic training texts
is far above that among the others. Training rows are dealt by a hash of their id: half give the lexicon, a quarter
the trees, a quarter the calibration, so that none is fitted on what it has seen.

Bounds: at most about max_rows labelled rows are fitted (a share of them by hash of the id when there are more),
and at most lexicon_size terms are kept. Every row is scored on its whole text. Null and empty texts have zero
features and get the score of such texts. Without toxic and other training rows in every part the
score is the share of toxic rows (0 without any row). Repeated rows are scored alike; of
labels that contradict each other for an id, toxic holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textops import ALNUM
from palimpsest.session import checkpointed

SEED_LEXICON = frozenset(
    b"idiot idiots stupid moron morons scum trash loser losers clown pathetic worthless disgusting dumb imbecile".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton vous votre ti tú usted ustedes vosotros".encode().split()
)
STEMS = (4, 5, 6, 7)
NEAR = 5
#: Characters that stand for letters in obfuscated words, and those put between letters.
LEET = bytes.maketrans(b"013457@$", b"oieastas")
PUT_BETWEEN = b"*._-"
NAMES = (
    "seed_density", "word_density", "stem_density", "seed_count", "word_count", "stem_count", "near_second_person",
    "capitals", "exclamations", "punctuation", "obfuscated", "hidden_count", "hits_density",
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() for b in range(256)])


def terms(data: bytes) -> set[tuple[int, bytes]]:
    """(0, word) and (length, stem) of a text, ASCII upper case lowered."""
    words = set(data.translate(ALNUM).split())
    return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in STEMS if len(w) > n}


def features(data: bytes, words_of: set[bytes], stems_of: dict[int, set[bytes]]) -> list[float]:
    words = data.translate(ALNUM).split()
    n = max(1, len(words))
    seeds = [i for i, w in enumerate(words) if w in SEED_LEXICON]
    known = [i for i, w in enumerate(words) if w in words_of]
    stems = [i for i, w in enumerate(words) if any(w[:k] in s for k, s in stems_of.items() if len(w) >= k)]
    hits = sorted({*seeds, *known, *stems})
    near = 0.0
    if hits:
        persons = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        if len(persons):
            at = np.searchsorted(persons, hits)
            after, before = persons[np.minimum(at, len(persons) - 1)], persons[np.maximum(at - 1, 0)]
            near = float(np.mean(np.minimum(np.abs(after - hits), np.abs(before - hits)) <= NEAR))
    raw = np.frombuffer(data, np.uint8)
    letters, size = max(1, int(_LETTER[raw].sum())), max(1, len(raw))
    plain = data.lower().translate(LEET, PUT_BETWEEN).translate(ALNUM).split()
    hidden = sum(w in SEED_LEXICON or w in words_of for w in plain) - len({*seeds, *known})
    odd = sum(1 for w in data.split() if not w[1:-1].isalnum() and w[1:-1].isascii() and len(w) > 3)
    return [
        100 * len(seeds) / n, 100 * len(known) / n, 100 * len(stems) / n,
        float(np.log1p(len(seeds))), float(np.log1p(len(known))), float(np.log1p(len(stems))), near,
        float(_UPPER[raw].sum()) / letters, data.count(b"!") / size, float(_MARK[raw].sum()) / size,
        odd / n, float(np.log1p(max(0, hidden))), 100 * len(hits) / n,
    ]


def _bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def learn_lexicon(train: DataFrame, size: int, least_share: float = 0.004, odds: float = 3.0) -> list[tuple[int, bytes]]:
    """Terms that at least least_share (and 3) of the toxic texts hold and whose log-odds are at least odds."""
    positives, negatives = train.agg(F.sum(F.col("label")), F.sum(1 - F.col("label"))).first()
    if not positives or not negatives:
        return []

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                found[int(label)].update(terms(_bytes(text)))
                if len(found[0]) + len(found[1]) > 500_000:
                    yield table(found)
                    found = Counter(), Counter()
        yield table(found)

    def table(found) -> pd.DataFrame:
        both = list(found[0].keys() | found[1].keys())
        return pd.DataFrame(
            {"n": [t[0] for t in both], "term": [t[1] for t in both], "clean": [found[0][t] for t in both], "toxic": [found[1][t] for t in both]}
        )

    counts = train.select("text", "label").mapInPandas(counted, "n int, term binary, clean long, toxic long")
    counts = counts.groupBy("n", "term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + 0.5) / (positives + 1.0)) - F.log((F.col("clean") + 0.5) / (negatives + 1.0))
    kept = counts.where(F.col("toxic") >= max(3.0, least_share * positives)).where(ratio >= odds)
    kept = kept.orderBy(F.col("toxic").desc(), "n", "term").limit(size)
    return [(int(r["n"]), bytes(r["term"])) for r in kept.collect()]


def with_features(rows: DataFrame, lexicon: list[tuple[int, bytes]]) -> DataFrame:
    """rows and their array<double> column features, from their column text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = {t for n, t in shared.value if n == 0}
        stems = {n: {t for k, t in shared.value if k == n} for n in STEMS}
        stems = {n: s for n, s in stems.items() if s}
        for texts in batches:
            yield pd.Series([features(_bytes(t), words, stems) for t in texts], dtype=object)

    return rows.withColumn("features", vector("text"))


def toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    max_rows: int = 20_000,
    lexicon_size: int = 2_000,
    trees: int = 20,
    depth: int = 3,
) -> DataFrame:
    """id, score (0 to 1) and predicted for every row of docs, learned from labelled (id_col, label_col in 0, 1)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
    total = marks.count()
    unit = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    picked = checkpointed(marks.where(unit < max_rows / max(total, 1)))
    train = docs.join(F.broadcast(picked), "id").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)))
    lexicon = learn_lexicon(train.where("part < 2"), lexicon_size)
    known = checkpointed(with_features(train.where("part >= 2"), lexicon).select("part", "label", array_to_vector("features").alias("features")))
    seen = {(r["part"], r["label"]): r["n"] for r in known.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")).collect()}

    scored = with_features(docs, lexicon).select("id", array_to_vector("features").alias("features"))
    if all(seen.get((p, y)) for p in (2, 3) for y in (0, 1)):
        known = known.coalesce(4)  # at most about max_rows rows
        gbt = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=11)
        model = gbt.fit(known.where("part = 2"))
        margin = vector_to_array("probability")[1]
        held = model.transform(known.where("part = 3")).select(margin.alias("margin"), F.col("label").cast("double").alias("label"))
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
        scored = calibration.transform(model.transform(scored).select("id", margin.alias("margin")))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated")))
    else:
        positives = sum(n for (_, y), n in seen.items() if y)
        score = F.lit(positives / max(1, sum(seen.values())))
    return scored.select(F.col("id").alias(id_col), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
