"""Toxicity: linear classifiers learned from toxic examples and unlabelled text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import map_slices, ship, text_or_empty

_LETTERS = re.compile(r"[^\W\d_]+")
# Held-out fold of the ids; fixed values.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def features(text: str) -> np.ndarray:
    """The distinct words of a text, runs of letters in lower case, as 32-bit hashes."""
    words = set(_LETTERS.findall(text.lower()))
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in words), dtype=np.uint32, count=len(words))


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and the shape of the classifiers."""

    positives: int = 4_000
    unlabelled: int = 12_000
    words: int = 300
    classifiers: int = 3
    steps: int = 400
    rate: float = 0.05
    decay: float = 2e-4


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray  # classifier x word
    bias: np.ndarray

    def score(self, text: str) -> float:
        """Mean probability over the classifiers."""
        if not len(self.bias):
            return 0.0
        found = features(text)
        at = np.searchsorted(self.words, found)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == found)]
        margin = self.bias + self.weights[:, at].sum(axis=1)
        return float(np.mean(1 / (1 + np.exp(-np.clip(margin, -50, 50)))))


EMPTY = Model(np.empty(0, np.uint32), np.empty((0, 0)), np.empty(0))


def _informative(pos: list[np.ndarray], unl: list[np.ndarray], most: int) -> np.ndarray:
    """The words whose document shares differ most between the two samples, in standard errors."""
    words, inverse = np.unique(np.concatenate(pos + unl), return_inverse=True)
    n_pos = sum(map(len, pos))
    in_pos = np.bincount(inverse[:n_pos], minlength=len(words))
    in_unl = np.bincount(inverse[n_pos:], minlength=len(words))
    both = (in_pos + in_unl) / (len(pos) + len(unl))
    gap = in_pos / len(pos) - in_unl / len(unl)
    z = np.abs(gap) / np.sqrt(both * (1 - both) * (1 / len(pos) + 1 / len(unl)) + 1e-12)
    z[in_pos + in_unl < 5] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(words[best[z[best] > 4]])


def _table(rows: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(words)), dtype=np.float32)
    for i, row in enumerate(rows):
        at = np.searchsorted(words, row)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == row)]
        out[i, at] = 1
    return out


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, settings: Settings) -> Model:
    """Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss.

    R_u(-) counts the toxic texts among the unlabelled as clean; the part that they can add is taken out
    again by the class prior. Where the difference falls below zero, which only overfitting brings about,
    the step goes back up instead. Each classifier sees its own resample of both samples.
    """
    if not pos or not unl or not prior:
        return EMPTY
    words = _informative(pos, unl, settings.words)
    if not len(words):
        return EMPTY
    all_pos, all_unl = _table(pos, words), _table(unl, words)
    weights, biases = [], []
    for seed in range(settings.classifiers):
        random = np.random.default_rng(seed)
        x_pos = all_pos[random.integers(0, len(pos), len(pos))]
        x_unl = all_unl[random.integers(0, len(unl), len(unl))]
        w = np.zeros(len(words) + 1)
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, settings.steps + 1):
            p_pos = 1 / (1 + np.exp(-np.clip(x_pos @ w[:-1] + w[-1], -30, 30)))
            p_unl = 1 / (1 + np.exp(-np.clip(x_unl @ w[:-1] + w[-1], -30, 30)))
            clean = -np.log1p(-p_unl).mean() + prior * np.log1p(-p_pos).mean()

            def pull(x: np.ndarray, by: np.ndarray) -> np.ndarray:
                return np.append(by @ x, by.sum()) / len(x)

            toxic_part = prior * pull(x_pos, p_pos - 1)
            clean_part = pull(x_unl, p_unl) - prior * pull(x_pos, p_pos)
            slope = toxic_part + clean_part if clean >= 0 else -clean_part
            slope[:-1] += settings.decay * w[:-1]
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            w -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights.append(w[:-1])
        biases.append(w[-1])
    return Model(words, np.array(weights), np.array(biases))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from rows outside the held-out fold: labelled toxic documents against all documents as
    unlabelled, at most as many of each as `settings` says, those with the least hash of their id. Only the
    hashes of their distinct words reach the driver. The class prior is the share of toxic ones among all
    labelled rows of the same folds, so labels should be spread like the documents. Without any labelled toxic document all scores are 0.
    """
    marks = labels.where("toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    prior = marks.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    ship(docs.sparkSession)

    def sample(rows: DataFrame, n: int) -> list[np.ndarray]:
        @F.pandas_udf("binary")
        def hashed(texts: pd.Series) -> pd.Series:
            return pd.Series([features(t).tobytes() for t in texts])

        picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select(hashed("text").alias("f"))
        return [np.frombuffer(bytes(r.f), dtype=np.uint32) for r in picked.collect()]

    texts = docs.select("doc_id", text_or_empty().alias("text")).where("doc_id is not null")
    # The ids of the samples are picked first, so that no other text is sorted.
    toxic = marks.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.positives)
    other = texts.select("doc_id").where(~held_out(F.col("doc_id")))
    other = other.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.unlabelled).distinct()
    return fit(
        sample(texts.join(F.broadcast(toxic), "doc_id", "left_semi"), settings.positives),
        sample(texts.join(F.broadcast(other), "doc_id", "left_semi"), settings.unlabelled),
        float(prior), settings,
    )


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Only the text decides the score. NULL and empty texts get the score of a text without known words.
    Rows are independent, repeated rows give repeated results, other columns are not read. A row without an
    id is not held out.
    """

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "doc_id": batch.column("doc_id"),
            "score": [model.score(t) for t in batch.column("text").to_pylist()],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_slices(
        docs.select("doc_id", text_or_empty().alias("text")), rows, f"doc_id {kind}, score double"
    )
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
