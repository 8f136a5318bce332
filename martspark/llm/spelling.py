"""Spelling variants: words one code point apart, found by products of letter-count blocks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import ship, slices
from martspark.session import stage

# Fixed by the contract: the letters of a run, after A-Z are lower-cased.
_LETTERS = "a-zÀ-ÿ"
# Every 31st (document, word) loses a code point.
_SLIP = 31
MIN_LENGTH = 7
MIN_COUNT = 2
# A form occurs at least this many times as often as its variant.
RATIO = 10

# Distinct words that a task counts before it hands them on.
_COUNTED = 200_000
# Words and code points of a group above which it is split by the place of the edit.
GROUP_WORDS = 1024
_GROUP_CHARS = 1 << 23
# Rows of a block of small groups that meet in one product, and code points that a step holds.
_BLOCK = 256
_STEP_CHARS = 1 << 22
_ROWS_PER_TASK = 100_000


def _runs(shortest: int) -> re.Pattern:
    return re.compile(f"[{_LETTERS}]{{{shortest},}}")


def _with_slip(run: str, seed: int) -> str:
    """The run, without one code point if the checksum of `<id>:<run>` says so; `seed` is that of `<id>:`."""
    h = zlib.crc32(run.encode(), seed)
    if h % _SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(
    docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, n): the words of whole texts with their occurrences, slips included.

    A NULL text has no words; a NULL id counts as an empty one. Repeated rows count each. A task counts
    its own words before the shuffle, so a frequent word travels once per task.
    """
    ship(docs.sparkSession)
    # A slip takes one code point off, so shorter runs cannot become words.
    pattern = _runs(min_length)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())}
            )

        for batch in slices(batches):
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                seed = zlib.crc32(f"{doc or ''}:".encode())
                # Lower-casing bytes changes A-Z only.
                for run, n in Counter(pattern.findall(value.encode().lower().decode())).items():
                    word = _with_slip(run, seed)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) >= _COUNTED:
                    yield counted()
                    total.clear()
        if total:
            yield counted()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key(a: Column, b: Column, m: Column) -> Column:
    """Hash of what two words share whose edit lies in [a, b) of a shorter word of m code points."""
    tail = m - b
    return F.xxhash64(F.substring("word", F.lit(1), a), F.substring("word", F.length("word") - tail + 1, tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the edit in the left and in the right half of its interval [a, b)."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    side = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
    cut = rows.select("word", "n", "m", F.explode(side).alias("s")).select("word", "n", "m", "s.a", "s.b")
    return cut.withColumn("key", _key(F.col("a"), F.col("b"), F.col("m")))


def blocks(words: DataFrame, min_length: int = MIN_LENGTH, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n, m, a, b, key): words put with all those that can be one edit away.

    Two words one edit apart agree before and behind the edit. With the edit in the interval [a, b) of the
    shorter word, of m code points, they share the first a and the last m - b code points, and `key` is their
    hash. A group holds words of the adjacent lengths m and m + 1. One of more than `group_words` words is split
    by halving its interval, until it is small or the interval is one place; a group of one place has at most
    91 words of m code points and 91 * 91 of the next length, since words are made of 91 letters at most.
    Halving is exact: a pair's edit lies in one of the halves. The interval of a group follows from its
    size over all words, so a frequent stem costs more rounds, not more words in a task.
    """
    chars = F.length("word")
    both = F.explode(F.filter(F.array(chars, chars - 1), lambda m: m >= min_length)).alias("m")
    rows = _halves(
        words.select("word", "n", both).select("*", F.lit(0).alias("a"), F.col("m").alias("b"))
    )
    group = ["m", "a", "b", "key"]
    ready = None
    while True:
        rows = stage(rows, "variant-rows")
        sizes = rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("rows"), F.sum(F.length("word")).alias("chars"),
            F.count_if(F.length("word") == F.col("m")).alias("shorter"),
        )
        splits = (F.col("b") - F.col("a") > 1) & (
            (F.col("rows") > group_words) | (F.col("chars") > _GROUP_CHARS)
        )
        # Pairs of the longer words are found in the groups of their own length.
        useful = sizes.where("rows > 1 AND shorter > 0").select(*group, splits.alias("large"))
        marked = stage(rows.join(useful, group), "variant-groups")
        small = marked.where(~F.col("large")).drop("large")
        ready = small if ready is None else ready.unionByName(small)
        large = marked.where("large").drop("large")
        if large.isEmpty():
            return ready.select("word", "n", *group)
        rows = _halves(large)


def _letter_counts(words: list[str], kind) -> np.ndarray:
    """A row of letter counts per word; the letters are single bytes in Latin-1."""
    flat = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * 256 + flat, minlength=len(words) * 256).reshape(len(words), 256)
    return counts[:, counts.any(axis=0)].astype(kind)


def _spelled(words: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(words), width), dtype=np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w.encode("latin-1"), dtype=np.uint8)
    return out


def near_in_block(words: list[str], m: int, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> Iterator[tuple]:
    """(i, j) index arrays of the words of m and of m or m + 1 code points that are one edit apart.

    The Gram matrix of the letter counts gives all squared distances: a replaced letter makes 2, an added
    one 1. Pairs of one group at most 2 apart are compared by letter. A pair whose first difference lies
    outside the interval of its group is left to the group that has it there, so each pair comes once.
    """
    # Products of counts are exact: below 2^24 in single, below 2^53 in double precision.
    counts = _letter_counts(words, np.float32 if m < 4000 else np.float64)
    square = (counts * counts).sum(axis=1)
    longer = np.array([len(w) > m for w in words])
    index = np.arange(len(words))
    short = index[~longer]
    rows = max(1, _STEP_CHARS // max(1, len(words)))
    for start in range(0, len(short), rows):
        own = short[start: start + rows]
        distance = square[own, None] + square[None, :] - 2 * (counts[own] @ counts.T)
        close = (distance <= 2) & (group[own, None] == group[None, :])
        close &= longer[None, :] | (index[None, :] > own[:, None])
        i, j = np.nonzero(close)
        i = own[i]
        step = max(1, _STEP_CHARS // (m + 1))
        for first in range(0, len(i), step):
            yield _verified(words, m, a, b, longer, i[first: first + step], j[first: first + step])


def _verified(words, m, a, b, longer, i, j) -> tuple[np.ndarray, np.ndarray]:
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    spelled = _spelled([words[u] for u in used], m + 1)
    x, y = spelled[place[: len(i)]], spelled[place[len(i):]]
    differs = x[:, :m] != y[:, :m]
    some = differs.any(axis=1)
    first = np.where(some, differs.argmax(axis=1), m)
    replaced = ~longer[j] & (differs.sum(axis=1) == 1)
    behind = (x[:, :m] != y[:, 1:]) & (np.arange(m) >= first[:, None])
    added = longer[j] & ~behind.any(axis=1)
    at = np.minimum(first, m - 1)
    good = (replaced | added) & (a[i] <= at) & (at < b[i])
    return i[good], j[good]


def near_pairs(rows: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, in both directions, from `blocks`."""
    ship(rows.sparkSession)
    order = ["m", "a", "b", "key"]
    arrow = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = [h[0] for h in held]
        n = np.array([h[1] for h in held])
        a, b = np.array([h[3] for h in held]), np.array([h[4] for h in held])
        group = np.array([h[6] for h in held])
        for i, j in near_in_block(words, held[0][2], a, b, group):
            one, two = np.concatenate([i, j]), np.concatenate([j, i])
            if len(one):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([words[k] for k in one], pa.string()),
                        pa.array([words[k] for k in two], pa.string()),
                        pa.array(n[two], pa.int64()),
                    ],
                    schema=arrow,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, number, chars = None, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(6)]
            for row in zip(*columns):
                if row[2:] != last:
                    # Whole groups of one length fill a block.
                    if held and (len(held) >= _BLOCK or chars >= _STEP_CHARS or row[2] != last[0]):
                        yield from solve(held)
                        held, chars = [], 0
                    last, number = row[2:], number + 1
                held.append((*row, number))
                chars += len(row[0])
        if held:
            yield from solve(held)

    # A row costs far more time than bytes, so the partitions follow the rows.
    tasks = rows.count() // _ROWS_PER_TASK + 1
    sorted_rows = rows.select("word", "n", *order).repartition(tasks, *order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, by doubling.

    A form occurs `RATIO` times as often as its word, so a chain has at most 19 links and five rounds end it.
    """
    roots = stage(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = roots.join(further, "root", "left")
        if stepped.where(F.col("next").isNotNull()).isEmpty():
            return roots
        roots = stage(stepped.select("word", F.coalesce("next", "root").alias("root")), "variant-roots")


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    group_words: int = GROUP_WORDS,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts and the spelling each one varies.

    Words are near if one inserted, deleted or replaced code point makes one the other. The form is the near
    word of largest n (ties: the smallest), if it occurs `ratio` times as often; the root is where the forms lead.
    Empty tables, NULL and blank texts give no words; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("the ratio must be at least 2, or forms could lead in a circle")
    words = stage(vocabulary(docs, min_length, min_count, id_col, text), "vocabulary")
    pairs = near_pairs(blocks(words, min_length, group_words))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    often = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = stage(
        found.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(often, F.col("best.near")).alias("form"),
            F.when(often, -F.col("best.less")).alias("form_n"),
        ),
        "variant-forms",
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
