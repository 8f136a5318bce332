"""Winnowing: rolling hashes of word pieces, the least of each window kept with its place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.llm.common import text_or_empty
from martspark.operators.scale import count_below

# Units are words; longer runs without white space are cut into pieces of this many characters.
_LONGEST = 64
_SPACE = r"[\x20\x09-\x0D]+"
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
# Documents of a range, and ranges at most; their ends are known to the driver and to every task.
_RANGE_ROWS = 10_000
_RANGES = 1 << 16
# Packed: the hash above the place counted backwards, so the least value is the rightmost least hash.
_PLACES = 1 << 31


def _shifted(array: Column, shift: int, join) -> Column:
    """`join(x[i], x[i + shift])` for every i that has both."""
    n = F.greatest(F.size(array) - F.lit(shift), F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(shift + 1), n), join)


def fingerprint(df: DataFrame, text: str, into: str, k: int = 4, window: int = 4) -> DataFrame:
    """Adds `into`: the selected hashes of a text column, packed with their places, in the order of the text.

    A hash covers `k` units, a power of two: the hash of a gram comes from those of its halves by one
    multiplication, so the steps grow with log k. Of every `window` (2 or more) consecutive hashes the least
    is kept, the rightmost on ties; a run of k + window - 1 units that two texts share gives them a hash in
    common. A text with fewer than k units has one hash of all, one with fewer than `window` hashes keeps the
    least; a NULL or blank text has an empty fingerprint. Equal texts have equal fingerprints.

    Each step is a column of its own, since it reads the one before it several times.
    """
    if k < 2 or k & (k - 1) or window < 2:
        raise ValueError("k must be a power of two, the window at least 2")
    keep = [c for c in df.columns if c != into]
    names = (f"{into}__{i}" for i in range(100))

    def add(frame: DataFrame, value: Column) -> tuple[DataFrame, Column]:
        name = next(names)
        return frame.withColumn(name, value), F.col(name)

    mask = F.lit(_PRIME).cast("bigint")
    # Cutting at white space is the fast way where no run is too long.
    df, words = add(df, F.split(F.coalesce(F.col(text), F.lit("")), _SPACE))
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{_LONGEST}}}"), F.lit(0))
    long = F.exists(words, lambda w: F.length(w) > _LONGEST)
    units = F.when(long, pieces).otherwise(F.filter(words, lambda w: w != ""))
    df, unit = add(df, F.transform(units, lambda u: F.xxhash64(u).bitwiseAND(mask)))
    gram, n = unit, 1
    while 2 * n < k:
        df, gram = add(df, _shifted(gram, n, _joined(n)))
        n *= 2

    # The last doubling also packs the hash with its place.
    count = F.greatest(F.size(gram) - F.lit(n), F.lit(0))
    last = _joined(n)
    packed = F.transform(
        F.slice(gram, F.lit(1), count), lambda x, i: _pack(last(x, F.get(gram, i + F.lit(n))), i)
    )
    whole = F.array(_pack(F.xxhash64(unit).bitwiseAND(mask), F.lit(0)))
    packed = F.when(F.size(unit) >= k, packed).when(F.size(unit) > 0, whole).otherwise(unit)
    df, packed = add(df, packed)
    count = F.greatest(F.size(packed) - F.lit(window - 1), F.lit(0))
    least = F.transform(
        F.slice(packed, F.lit(1), count),
        lambda x, i: F.least(x, *[F.get(packed, i + F.lit(j)) for j in range(1, window)]),
    )
    chosen = (
        F.when(F.size(packed) >= window, F.array_distinct(least))
        .when(F.size(packed) > 0, F.array(F.array_min(packed)))
        .otherwise(packed)
    )
    return df.withColumn(into, chosen).select(*keep, into)


def _joined(n: int):
    """Hash of a gram from its first part and a second part of n units."""
    power = F.lit(pow(_BASE, n, _PRIME)).cast("bigint")
    prime = F.lit(_PRIME).cast("bigint")
    return lambda x, y: (x * power + y) % prime


def _pack(value: Column, place: Column) -> Column:
    return value * F.lit(_PLACES) + (F.lit(_PLACES - 1) - place.cast("bigint"))


def hashes(chosen: Column) -> Column:
    """The set of hashes of a fingerprint, without their places."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31)))


def listed(chosen: Column) -> Column:
    """A fingerprint as text, in the order of the text: hash * 2^31 + (2^31 - 1 - place)."""
    return F.array_join(chosen.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two sets; 1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def in_order(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, part, rank): documents cut into ranges of ids, each with the document before its first.

    Ranges come from approximate quantiles of the ids, so they hold about equally many documents wherever the
    ids lie. Their number follows the rows: one for each `_RANGE_ROWS`, at least four per shuffle partition and
    at most `_RANGES`, beyond which they grow. Rank 1 marks the documents of a range and rank 0 the one
    borrowed from the range before it; the first range borrows the very last document. Texts are shuffled
    once, here. Ids are numbers; NULL ids count as the least, and rows of one id share a range.
    """
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(least, docs.count() // _RANGE_ROWS), max(least, _RANGES))
    rows = docs.select(F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("bigint").alias("k"), F.col(key).alias("id"),
                       text_or_empty().alias("text"))
    ids = rows.select("k")
    # At most _RANGES numbers come to the driver.
    cuts = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    part = count_below(F.lit(np.array(cuts, dtype=np.int64)), len(cuts).bit_length(), F.col("k")) if cuts else F.lit(0)
    # One row per range.
    ends = ids.groupBy(part.alias("part")).agg(F.max("k").alias("last"))
    order = Window.orderBy("part")
    borrowed = ends.select(
        "part",
        F.coalesce(
            F.lag("last").over(order), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ).alias("k"),
    )
    own = rows.withColumns({"part": part, "rank": F.lit(1)})
    extra = rows.join(F.broadcast(borrowed), "k").select(*rows.columns, "part", F.lit(0).alias("rank"))
    return own.unionByName(extra).repartition("part")


def edited_fingerprints(docs: DataFrame, k: int = 4, window: int = 4) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    The edited text is the document with its last floor(n / 2) characters replaced by as many of the next
    document, in descending order of ids; the first document follows the last. Rows with the same id follow
    each other by their text's hash. A single document is followed by itself.
    """
    placed = fingerprint(in_order(docs), "text", "fp", k, window)
    order = Window.partitionBy("part").orderBy("rank", "k", F.xxhash64("text"))
    n = F.length("text")
    pairs = placed.withColumns({
        "next_text": F.lag("text").over(order),
        "next_fp": F.lag("fp").over(order),
    }).where("rank = 1")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    ).select("id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp", "edited")
    both = fingerprint(edited, "edited", "edited_fp", k, window)
    sets = both.withColumns({"own": hashes(F.col("fp")), "new": hashes(F.col("edited_fp")), "near": hashes(F.col("next_fp"))})
    return sets.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        listed(F.col("fp")).alias("fingerprint"),
        listed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("near")).alias("near_next"),
    )
