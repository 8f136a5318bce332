"""Quality rules: share of the characters that stand in repeated word n-grams and repeated lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import SPACES, WORDS, map_slices, ship, text_or_empty

SYMBOLS = "#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Limits:
    """Largest accepted shares. Only repeats count, not the first occurrence of an n-gram or line.

    The limits leave room for a short text that has one boilerplate line at its head and its foot.
    """

    # n-gram length in words and share of the characters.
    ngrams: tuple[tuple[int, float], ...] = ((5, 0.35), (6, 0.34), (7, 0.33), (8, 0.32), (9, 0.31), (10, 0.30))
    line_chars: float = 0.30
    lines: float = 0.50
    min_words: int = 50
    repeat_percent: int = 50


def _in_repeats(grams: np.ndarray, n: int, n_words: int, first: bool) -> np.ndarray | None:
    """Mask of the words inside an n-gram that occurs at least twice, its first occurrence included
    or not; None if there is none."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return None
    again = np.append(False, same)
    hits = order[again | np.append(same, False)] if first else order[again]
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, limits: Limits) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ngram shares, line chars share, lines share)."""
    words = WORDS.findall(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))

    seen: set[str] = set()
    n_lines = n_dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            if line in seen:
                n_dup_lines += 1
                dup_chars += len(line) - sum(map(line.count, SPACES))
            else:
                seen.add(line)

    n_repeat = 0
    shares = [0.0] * len(limits.ngrams)
    if n >= 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
        # Word triples by exact numbers: first the pairs are numbered, then pair and word.
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        triples = pairs[:-1] * len(number) + ids[2:]
        mask = _in_repeats(triples, 3, n, first=True)
        if mask is not None:
            n_repeat = int(mask.sum())
            shares = _ngram_shares(words, ids, word_chars, limits)
    return (
        n, word_chars, n_symbols, n_dup_lines, n_repeat, shares,
        dup_chars / word_chars if word_chars else 0.0,
        n_dup_lines / n_lines if n_lines else 0.0,
    )


def _ngram_shares(words: list[str], ids: np.ndarray, word_chars: int, limits: Limits) -> list[float]:
    """Rolling hashes: the hash of n words is the one of n - 1 words times a base plus the next word.

    Word numbers are scrambled first, so equal hashes mean equal n-grams but for a chance of about
    (n-grams)^2 / 2^64. Once no n-gram repeats, no longer one does either.
    """
    n_words = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    wanted = dict(limits.ngrams)
    found = {}
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        h *= _BASE
        h ^= h >> np.uint64(32)
        grams = h
        for n in range(2, max(wanted, default=1) + 1):
            if len(grams) < 2:
                break
            grams = grams[:-1] * _BASE + h[n - 1:]
            if n in wanted:
                mask = _in_repeats(grams, n, n_words, first=False)
                if mask is None:
                    break
                found[n] = int(lengths[mask].sum()) / word_chars
    return [found.get(n, 0.0) for n, _ in limits.ngrams]


def score_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per row of `docs`: its measures, whether the base rules reject it, and the verdict.

    A NULL or empty text has no words, so the base rules reject it. Every row is measured by
    itself: repeated rows give repeated results, an empty table an empty one. Other columns are
    not read, so their names do not matter.
    """

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        found = [measure(t or "", limits) for t in batch.column("text").to_pylist()]
        out: dict[str, list] = {"doc_id": batch.column("doc_id")}
        for i, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
            out[name] = [f[i] for f in found]
        out["base_failed"] = [
            f[0] < limits.min_words or 100 * f[4] > limits.repeat_percent * f[0] for f in found
        ]
        out["kept"] = [
            not bad
            and all(share <= most for share, (_, most) in zip(f[5], limits.ngrams))
            and f[6] <= limits.line_chars
            and f[7] <= limits.lines
            for bad, f in zip(out["base_failed"], found)
        ]
        out["top_ngram_share"] = [max(f[5], default=0.0) for f in found]
        out["dup_line_share"] = [f[6] for f in found]
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(
        docs.select("doc_id", text_or_empty().alias("text")),
        rows,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, top_ngram_share double, dup_line_share double",
    )


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns as they are.

    The verdict is an Arrow UDF next to the row, so that nothing is shuffled.
    """

    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        found = (measure(t or "", limits) for t in texts)
        return pd.Series([
            f[0] >= limits.min_words
            and 100 * f[4] <= limits.repeat_percent * f[0]
            and all(share <= most for share, (_, most) in zip(f[5], limits.ngrams))
            and f[6] <= limits.line_chars
            and f[7] <= limits.lines
            for f in found
        ], dtype=bool)

    return docs.where(good(text_or_empty()))
