"""Language identification by string kernels.

Two texts are as alike as the character n-grams (1 to 3) that both contain, whatever their counts: the blended
spectrum presence kernel |A and B| / sqrt(|A| |B|). Landmarks give a Nystrom approximation of it, one ridge
regression per language against the rest is fitted on the Nystrom features, and since all of these are
products, the fitted model is one matrix of n-grams by languages; a batch of texts is scored by the product of its
sparse presence matrix with that.

Bounds: at most per_class labelled rows of each language are fitted, and of these at most landmarks_per_class
are landmarks; both are taken in the order of a hash of id and text, so that a rerun gives the same model, and rows that
agree in id, text and language count once. Of repeated ids with different texts each text counts.

A null text, or one without a letter, is und with score 0, as is every text if nothing was learned. Ties
between languages go to the first in alphabetical order. Repeated rows are judged alike. Very long texts are judged whole:
their distinct n-grams count, whatever their length. Other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import checkpointed

UNKNOWN = "und"
#: Numbers of the product that scores n-grams at once: n-grams times languages.
BATCH = 4 << 20
_is_letter: np.ndarray | None = None


class Model(NamedTuple):
    """Languages, n-grams and the weight of each n-gram for each language."""

    languages: list[str]
    features: np.ndarray
    weights: np.ndarray


def _letters() -> np.ndarray:
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _is_letter


def presence(text: str | None) -> np.ndarray:
    """The distinct n-grams of a whole text, as sorted numbers of 21 bits a letter; none if it has no letter."""
    if not isinstance(text, str):
        return np.empty(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[points], points, 0).astype(np.int64)
    if not c.any():
        return np.empty(0, np.int64)
    c = np.concatenate([[0], c, [0]])
    c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]  # what is no letter is one gap
    two = (c[:-1] + 1) << 21 | c[1:]
    grams = np.concatenate([c, two, two[:-1] << 21 | c[2:]])
    grams.sort()
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])]


def fit_arrays(langs: list[str], grams: list[np.ndarray], landmarks_per_class: int, ridge: float) -> Model:
    """The model of labelled presence sets; the first landmarks_per_class of each language are the landmarks."""
    keep = [i for i, g in enumerate(grams) if len(g)]
    langs, grams = [langs[i] for i in keep], [grams[i] for i in keep]
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    marks = [i for x in languages for i in [j for j, y in enumerate(langs) if y == x][:landmarks_per_class]]
    features = np.unique(np.concatenate([grams[i] for i in marks]))

    def matrix(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(features)), np.float32)
        for k, i in enumerate(rows):
            at = np.searchsorted(features, grams[i])
            at = at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == grams[i])]
            out[k, at] = len(grams[i]) ** -0.5
        return out

    z = matrix(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.concatenate([(matrix(list(range(a, min(a + 256, len(grams))))) @ z.T).astype(np.float64) @ root for a in range(0, len(grams), 256)])
    y = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weights = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    return Model(languages, features, (z.T @ (root @ weights)).astype(np.float32))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_class: int) -> DataFrame:
    """lang, rank and text of at most per_class different rows of each language, first in the order of a hash of id and text.

    Rows that agree in id, text and language are one. Only hashes under a border are gathered by language: about
    twice per_class of each, by its approximate number of different rows.
    """
    keyed = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    keyed = keyed.where("id is not null and lang is not null and text is not null").withColumn("hash", F.xxhash64("id", "text"))
    sizes = checkpointed(keyed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("rows")))
    unit = F.shiftrightunsigned(F.xxhash64("hash"), 11) / F.lit(float(1 << 53))
    near = keyed.select("lang", "hash").join(F.broadcast(sizes), "lang").where(unit * F.col("rows") <= 2 * per_class + 200)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("hash"), "hash")
    picked = near.groupBy("lang", "hash").agg(F.lit(1)).select("lang", "hash", F.row_number().over(order).alias("rank"))
    picked = checkpointed(picked.where(F.col("rank") <= per_class))
    found = keyed.select("lang", "hash", "text").join(F.broadcast(picked), ["lang", "hash"])
    return found.groupBy("lang", "rank").agg(F.min("text").alias("text"))


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_class: int = 400,
    landmarks_per_class: int = 64,
    ridge: float = 0.1,
) -> Model:
    """Learn from the non-null lang_col and text_col of labelled."""

    @F.pandas_udf("array<long>")
    def grams(texts: pd.Series) -> pd.Series:
        return pd.Series([presence(t) for t in texts], dtype=object)

    rows = sample(labelled, id_col, text_col, lang_col, per_class).select("lang", "rank", grams("text").alias("grams")).toPandas()
    rows = rows.sort_values(["lang", "rank"])
    return fit_arrays(rows["lang"].tolist(), [np.asarray(g, np.int64) for g in rows["grams"]], landmarks_per_class, ridge)


class Scorer:
    """A model ready for texts; its last row is one of zeros, for unknown n-grams."""

    def __init__(self, model: Model):
        self.languages, self.features = np.array([*model.languages, UNKNOWN], object), model.features
        self.weights = np.vstack([model.weights, np.zeros((1, model.weights.shape[1]), np.float32)])

    def _scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """The product of the texts' presence matrix, in compressed rows, with the weights."""
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        each = np.concatenate(grams)
        at = np.minimum(np.searchsorted(self.features, each), len(self.features) - 1)
        rows = np.where(self.features[at] == each, at, len(self.features))
        sums = np.add.reduceat(self.weights[rows], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
        return sums / np.sqrt(sizes)[:, None]

    def __call__(self, texts) -> pd.DataFrame:
        """lang_pred and score of each text."""
        best, sure = np.full(len(texts), len(self.languages) - 1), np.zeros(len(texts))
        places: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            scores = self._scores(held)
            likely = np.exp(5 * (scores - scores.max(axis=1, keepdims=True)))
            best[places] = scores.argmax(axis=1)
            sure[places] = likely.max(axis=1) / likely.sum(axis=1)

        for i, text in enumerate(texts if len(self.languages) > 1 else ()):
            grams = presence(text)
            if len(grams):
                places.append(i)
                held.append(grams)
                size += len(grams)
            if size * self.weights.shape[1] > BATCH:
                settle()
                places, held, size = [], [], 0
        if held:
            settle()
        return pd.DataFrame({"lang_pred": self.languages[best], "score": sure})


def language_column(text: Column, model: Model, spark) -> Column:
    """A struct column (lang_pred, score) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield scorer(texts.tolist())

    return predicted(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) for every row of docs."""
    found = language_column(F.col(text_col), model, docs.sparkSession)
    return docs.select(F.col(id_col), found.alias("_found")).select(id_col, "_found.*")


def with_known_language(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.35) -> DataFrame:
    """docs with all their columns, without rows that are und or score under min_score."""
    name = "_language_" + "_".join(sorted(docs.columns))[:40]
    found = docs.withColumn(name, language_column(F.col(text_col), model, docs.sparkSession))
    return found.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= min_score)).drop(name)
