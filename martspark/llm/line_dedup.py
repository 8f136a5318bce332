"""Line dedup: equal lines by hash, lines one word apart by a join of their deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import fresh, ship, text_or_empty
from martspark.llm.pii import replaced
from martspark.session import stage

_SPACE = r"[\x20\x09-\x0D]+"
_WORD_CHAR = r"[^\x20\x09-\x0D]"
_SALT = 7919
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FULL = -1  # place of the variant that deletes nothing
# Shorter lines count as repeated only if they are equal.
MIN_WORDS = 8
_ROWS = 200_000
# Marks of wanted texts: at most so many bits, a million numbers.
_BITS = 1 << 26


def _key() -> Column:
    """What tells texts apart: the id, and the text, as rows may share an id. Inside a struct NULL equals NULL."""
    return F.struct(F.col("doc_id").alias("doc"), F.xxhash64(text_or_empty()).alias("h"))


def _lines(docs: DataFrame) -> DataFrame:
    """(id, words) of the lines that have a word; the place in the id counts all lines of the text from 0."""
    rows = docs.select(_key().alias("key"), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    words = F.filter(F.split("line", _SPACE), lambda w: w != "")
    # Asked of the line, as a condition on the words would cut it a second time.
    return rows.where(F.col("line").rlike(_WORD_CHAR)).select(_id(F.col("pos")), words.alias("words"))


def _id(pos: Column) -> Column:
    """Of a line, in the order in which lines stand."""
    return F.struct(F.col("key.doc").alias("doc"), pos.alias("pos"), F.col("key.h").alias("h")).alias("id")


def _key_of_line() -> Column:
    return F.struct("id.doc", "id.h").alias("key")


def _picked(lines: Column, places: Callable[[Column], Column]) -> Column:
    """The lines at some places. The list of one element holds the lines, so that a text is cut only once."""
    return F.transform(
        F.array(lines), lambda held: F.transform(places(held), lambda p: F.get(held, p))
    )[0]


def _hashed(lines: DataFrame, *more: Column) -> DataFrame:
    return lines.select(
        F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(_SALT), "words").alias("h2"),
        "id", *more,
    )


def _half(n: Column) -> Column:
    """A little under half of n, in steps of 4, so that lines one word apart mostly agree."""
    return F.floor(n / 8).cast("int") * 4


def _ends(words: Column) -> Column:
    """Hashes of the first and last words, as many as `_half` says of the line and of one a word shorter.

    Two lines one word apart share the first or the last of them: the other word lies in one half only. Both have
    MIN_WORDS words, so a half is never that of a shorter line; an empty one would be shared by all lines.
    """
    n = F.size(words)
    keys = []
    for length in (_half(n), _half(F.greatest(n - 1, F.lit(MIN_WORDS)))):
        keys.append(F.xxhash64(F.lit(0), length, F.slice(words, F.lit(1), length)))
        keys.append(F.xxhash64(F.lit(1), length, F.slice(words, n - length + 1, length)))
    return F.when(n >= MIN_WORDS, F.array_distinct(F.array(*keys))).otherwise(F.array().cast("array<bigint>"))


def _variants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All variants of numbered lines with one word left out, and the line itself, as hashes.

    The hash of a line without word i comes from the rolling hashes before and after it.
    """
    power = np.ones(1, np.uint64)
    for frame in frames:
        made: list[tuple] = []
        size = 0
        for number, line in zip(frame["number"], frame["line"]):
            words = line.encode("utf-8", "surrogatepass").split()
            n = len(words)
            h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
            with np.errstate(over="ignore"):
                while len(power) < n:
                    power = np.append(power, power * _BASE ** np.uint64(len(power)))
                terms = h * power[n - 1:: -1]
                whole = terms.sum(dtype=np.uint64)
                before = np.cumsum(terms) - terms
                # What stands after the word is shifted up, as what stands before it is already.
                without = before + (whole - before - terms) * _BASE
                made.append((number, np.append(without, whole * _BASE)))
            size += n + 1
            if size > _ROWS:
                yield _rows(made)
                made, size = [], 0
        if made:
            yield _rows(made)


def _rows(made: list[tuple]) -> pd.DataFrame:
    sizes = np.array([len(v) for _, v in made])
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    place[ends - 1] = _FULL
    return pd.DataFrame({
        "v": np.concatenate([v for _, v in made]).view(np.int64),
        "place": place.astype(np.int32),
        "n": np.repeat(sizes - 1, sizes).astype(np.int32),
        "number": np.repeat(np.array([r for r, _ in made], dtype=np.int64), sizes),
    })


def _one_apart(a: Column, b: Column) -> Column:
    """Two arrays of words are one word apart: changed, or inserted in one of them."""
    n, m = F.size(a), F.size(b)
    short = F.least(n, m)
    differs = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x != y)
    at = F.coalesce(F.nullif(F.array_position(differs, True), F.lit(0)), (short + 1).cast("bigint")).cast("int")

    def rest(words: Column, start: Column) -> Column:
        return F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))

    return (
        F.when(n == m, rest(a, at + 1) == rest(b, at + 1))
        .when(n == m + 1, rest(a, at + 1) == rest(b, at))
        .when(m == n + 1, rest(a, at) == rest(b, at + 1))
        .otherwise(False)
    )


def _near_earlier(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(id) of the distinct lines that are one word apart from an earlier line."""
    # Only lines that share an end with another line can be one word apart.
    ends = distinct.where(F.size("ends") > 0).select("id", "h1", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("end")
    wanted = stage(
        ends.join(shared, "end", "left_semi").select("id").distinct()
        .groupBy(_key_of_line()).agg(F.sort_array(F.collect_list("id.pos")).alias("wanted")), "lines-wanted",
    )
    texts = docs.select(_key().alias("key"), text_or_empty().alias("text"))
    texts = _with_some_key(texts, wanted).dropDuplicates(["key"])
    asked = stage(
        texts.join(wanted, "key").select(
            "key", "wanted", _picked(F.split("text", "\n", -1), lambda _: F.col("wanted")).alias("lines")
        ), "lines-asked",
    )
    lines = _numbered(
        asked.select("key", F.explode(F.arrays_zip(F.col("wanted").alias("pos"), "lines")).alias("l")).select(
            _id(F.col("l.pos")), F.col("l.lines").alias("line")
        )
    )
    ship(docs.sparkSession)
    variants = stage(
        lines.select("number", "line").mapInPandas(_variants, "v bigint, place int, n int, number bigint"), "line-variants"
    )
    # Changed: the same variant with the word left out at the same place of equally long lines.
    changed = variants.where(F.col("place") >= 0)
    same = changed.select(F.xxhash64("v", "place", "n").alias("c"), "number")
    least = same.groupBy("c").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    pairs = same.join(least.where("first < last").drop("last"), "c").where("first < number").select("number", "first")
    # Inserted: a whole line that equals a variant of a line with a word more.
    whole = variants.where(F.col("place") == _FULL).select("v", "number")
    longer = changed.groupBy("v").agg(F.min("number").alias("first"))
    shorter = whole.groupBy("v").agg(F.min("number").alias("first"))
    pairs = (
        pairs.unionByName(whole.join(longer, "v").where("first < number").select("number", "first"))
        .unionByName(changed.select("v", "number").join(shorter, "v").where("first < number").select("number", "first"))
        .distinct()
    )
    words = F.filter(F.split("line", _SPACE), lambda w: w != "")
    texts = lines.select("number", "id", words.alias("words"))
    checked = (
        pairs.join(texts, "number").withColumnRenamed("words", "mine")
        .join(texts.select(F.col("number").alias("first"), "words"), "first")
    )
    return checked.where(_one_apart(F.col("mine"), F.col("words"))).select("id").distinct()


def _with_some_key(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose `key` may be among the keys: all that are, and a few others.

    A bit for each key, sixteen times as many as there are keys up to _BITS, is broadcast as 64-bit numbers, so that texts
    without a wanted line are mostly not shuffled. Beyond that number of keys more rows pass; none is lost.
    """
    bits = min(_BITS, 1 << (16 * keys.count()).bit_length())
    slot = F.pmod(F.xxhash64("key"), F.lit(bits))
    bit = F.expr(f"shiftleft(1L, int(pmod(xxhash64(key), {bits}L) % 64))")
    marks = keys.groupBy(F.floor(slot / 64).alias("number")).agg(F.bit_or(bit).alias("marks"))
    found = rows.withColumn("number", F.floor(slot / 64)).join(F.broadcast(marks), "number")
    return found.where(F.col("marks").bitwiseAND(bit) != 0).select(*rows.columns)


def _numbered(lines: DataFrame) -> DataFrame:
    """(number, id, line): numbers in the order of the ids, so that a line is one number where its variants are shuffled.

    The lines are written in ranges of ids; a number is that of the file and the row in it.
    """
    written = stage(lines.repartitionByRange("id").sortWithinPartitions("id"), "lines-ordered")
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return written.select((F.shiftleft(file, 40) + F.col("_metadata.row_index")).alias("number"), "id", "line")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, removed): per text the places of its lines that repeat an earlier one, in order.

    Lines are compared as words; the earliest is the one with the least (doc_id, place). A line goes if an
    equal line stands earlier, or, from MIN_WORDS words on, a line from which it differs by one changed,
    inserted or missing word (itself kept or not). Documents without such lines are left out. Lines without
    a word, so also NULL and empty texts, are never repeated. Rows with the same doc_id and text are taken for
    copies of one document; different texts with one doc_id are compared like documents, their lines in the
    order of (doc_id, place, hash of the text). NULL is an id like others and comes first. Other columns are
    not read.

    Every line is reduced to hashes before it is shuffled, and copies of a line meet only as partial minima.
    The words of a line one word apart from another are all equal but in one half, so only lines that share
    a half with a different line get a deletion neighbourhood. Members of a group of equal variants are
    compared with its earliest only, never with each other: in a group of equal places all are one word
    apart.
    """
    # Texts are cut into lines once; what follows reads the hashes.
    hashed = stage(_hashed(_lines(docs), _ends(F.col("words")).alias("ends")), "line-hashes")
    distinct = stage(
        hashed.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("ends").alias("ends")), "lines"
    )
    firsts = distinct.select("h1", "h2", F.col("id").alias("first"))
    again = hashed.select("h1", "h2", "id").join(firsts, ["h1", "h2"]).where("id != first").select("id")
    gone = again.unionByName(_near_earlier(docs, distinct))
    return gone.groupBy(_key_of_line()).agg(F.sort_array(F.collect_set("id.pos")).alias("removed")).select(
        "key", F.col("key.doc").alias("doc_id"), "removed"
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the lines that `repeated_lines` names, and `n_chars` of what is left.

    A document may become empty; it stays as a row. A NULL text stays NULL. Columns and their order stay.
    """
    key = fresh(docs, "id")
    row = docs.select(_key().alias(key), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    removed = repeated_lines(docs).select(F.col("key").alias(key), "removed")
    kept = F.array_join(_picked(
        F.split(F.col("r.text"), "\n", -1),
        lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")),
    ), "\n")
    new = row.join(removed, key, "left").select(
        "r", F.when(F.col("removed").isNull(), F.col("r.text")).otherwise(kept).alias("t")
    )
    return replaced(new, docs)


def line_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` with its number of lines, of removed lines, and the removed places as text."""
    counts = docs.select(
        _key().alias("key"), F.size(F.filter(F.split(text_or_empty(), "\n", -1), lambda x: x.rlike(_WORD_CHAR))).alias("n_lines")
    )
    removed = repeated_lines(docs).drop("doc_id")
    return counts.join(removed, "key", "left").select(
        F.col("key.doc").alias("doc_id"),
        F.col("n_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
    )
