"""Shards of nearly equal bytes: sampled splitters, range partitions, overfull ranges divided again."""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martspark.llm.common import text_or_empty
from martspark.session import stage

SHARDS = 40
# Fixed by the contract: what a record takes besides its text.
OVERHEAD = 16
LAW = "bytes"

# Keys drawn in a round, about; every range holds some of them.
SAMPLE = 8192
_RANGES = 2048
# Records of a range whose running size one task may sum up.
RANGE_ROWS = 20_000
# A record or group of equal texts above this share of a shard is dealt out by itself or may be cut.
_SHARE = 0.01

_Key = tuple[int, int, int]
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def records(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, h, d, r, file, row), written once: what the choice of shards needs, without texts.

    (h, d, r) is the key of the ranges: hashes of the text, of the id and of the place in the written table. So
    equal texts lie side by side, and yet even rows that are equal in all columns can be told apart. A NULL
    text counts as an empty one and a NULL id is a value like others; `keep` names columns to carry along.
    """
    value = text_or_empty(text)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(value) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(value).alias("text_crc32"),
        F.xxhash64(value).alias("h"),
        F.xxhash64(F.col(id_col)).alias("d"),
        *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)],
    )
    return _placed(stage(slim, "records")).withColumn("r", F.xxhash64("file", "row"))


def _placed(written: DataFrame) -> DataFrame:
    """Adds (file, row), the file of a written table and the row in it: fixed at every reading.

    The random part of a file's name is left out, so a table written again from the same input has the same places.
    """
    name = F.regexp_replace("_metadata.file_name", "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")
    return written.select("*", name.alias("file"), F.col("_metadata.row_index").alias("row"))


def _key() -> Column:
    return F.struct("h", "d", "r")


def _array(kind: str, values: Sequence) -> Column:
    """A list of the driver as one constant."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _at_most(sorted_values: Column, count: int, value: Column) -> Column:
    """How many of some ascending constants are at most `value`: found by halving."""
    steps = [1 << b for b in reversed(range(count.bit_length()))]

    def step(at: Column, width: Column) -> Column:
        # Beyond the last constant `get` is NULL, and the place stays.
        return F.when(F.get(sorted_values, at + width - 1) <= value, at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if count else F.lit(0)


def range_of(keys: Sequence[_Key]) -> Column:
    """The range of a row between ascending keys: the number of keys at most its own."""
    given = _array("array<struct<h:bigint,d:bigint,r:bigint>>", [dict(zip("hdr", k)) for k in keys])
    return _at_most(given, len(keys), _key())


def splitters(rows: DataFrame, total: int, number: int, salt: int, sample: int = SAMPLE) -> list[_Key]:
    """Up to `number` keys that cut the rows into ranges of about equal size.

    A row is drawn with a probability in proportion to its size; the draw is a hash, so it is the same when a
    task runs again. About `sample` keys reach the driver, however many rows there are.
    """
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(sample / max(total, 1)))
    draw = F.pmod(F.xxhash64("h", "d", "r", F.lit(salt)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    keys = sorted(tuple(k) for k in rows.where(draw < chance).select("h", "d", "r").collect())
    step = max(1, -(-len(keys) // number))
    return sorted({keys[i] for i in range(step - 1, len(keys), step)})


def _sizes(rows: DataFrame, cuts: Sequence[_Key]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range between the cuts."""
    sums = rows.groupBy(range_of(cuts).alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return {r["part"]: (r["size"], r["n"]) for r in sums.collect()}


def _room(total: int, taken: Sequence[int]) -> list[float]:
    """What each shard takes of `total` bytes so that all come to the same level, those already above it none."""
    left, level = float(total), 0.0
    filled = sorted(taken)
    for i, t in enumerate(filled, 1):
        level = (left + sum(filled[:i])) / i
        if i == len(filled) or level <= filled[i]:
            break
    return [max(0.0, level - t) for t in taken]


def _level(total: int, taken: Sequence[int]) -> float:
    """The bytes of the shards that are not above the others once all rows are placed."""
    return max(r + t for r, t in zip(_room(total - sum(taken), taken), taken) if r or t == min(taken))


def _deal(sizes: dict, shards: int) -> tuple[dict, list[int]]:
    """Units to the emptiest shard, largest first: the shard of each, and the bytes of the shards."""
    heap = [(0, s) for s in range(shards)]
    places = {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        taken, s = heapq.heappop(heap)
        places[key] = s
        heapq.heappush(heap, (taken + sizes[key], s))
    return places, [t for t, _ in sorted(heap, key=lambda x: x[1])]


def _deal_large(rows: DataFrame, total: int, shards: int) -> tuple[dict, dict, list[int]]:
    """Shards of the groups of equal texts that stay whole, those of large single records, bytes of the shards.

    Groups and records above a hundredth of a shard, at most 100 of either per shard, come to the driver with their
    sizes. The largest groups that still leave the shards equal stay whole.
    """
    share = total / shards
    limit = _SHARE * share
    group = rows.groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > limit)
    groups = {(q["h"],): q["size"] for q in group.collect()}
    large = rows.where(F.col("size") > limit).select("h", "d", "r", "size").collect()
    records = {(q["h"], q["d"], q["r"]): q["size"] for q in large}
    places, taken = _deal(records, shards)
    level = (1 + _SHARE) * _level(total, taken)

    def excess(filled: Sequence[int]) -> float:
        return sum(max(0.0, t - level) for t in filled)

    whole: dict = {}
    cap = share
    while cap > limit:
        kept = {k: v for k, v in groups.items() if v <= cap}
        rest = {k: v for k, v in records.items() if k[:1] not in kept}
        tried, filled = _deal({**kept, **rest}, shards)
        if excess(filled) <= excess(taken):
            whole = {k[0]: tried[k] for k in kept}
            places, taken = {k: tried[k] for k in rest}, filled
            break
        cap /= 2
    return whole, places, taken


def boundaries(rows: DataFrame, total: int, targets: Sequence[float], group: float, range_rows: int = RANGE_ROWS,
               sample: int = SAMPLE) -> list[_Key | None]:
    """For each ascending target in bytes the least key behind it; None where it is behind all rows.

    Sampled splitters cut the rows into ranges, whose sizes are then summed exactly. Only a range in which a target
    lies matters any further: while it has more than `range_rows` rows it is overfull and is divided again by a
    sample of its own, all of them in the same pass. In a range that is small enough the running size gives the place
    of the target. A boundary within a group of equal texts of up to `group` bytes moves to the group's nearer edge.
    """
    active = rows
    found: dict[int, _Key | None] = {}
    # Of each open range: first key, key behind it, bytes before it, its targets.
    open_ranges = [(None, None, 0, list(enumerate(targets)))]
    size, salt = total, 0
    final: list[tuple] = []
    while open_ranges:
        edges = sorted({k for low, high, _, _ in open_ranges for k in (low, high) if k is not None})
        cuts = sorted({*edges, *splitters(active, size, _RANGES, salt, sample)})
        sums = _sizes(active, cuts)
        following = []
        for low, high, before, wanted in open_ranges:
            first = 0 if low is None else bisect_right(cuts, low)
            last = len(cuts) if high is None else bisect_right(cuts, high) - 1
            at = before
            todo = list(wanted)
            for part in range(first, last + 1):
                own, n = sums.get(part, (0, 0))
                here = [w for w in todo if w[1] < at + own]
                todo = todo[len(here):]
                if here:
                    left = cuts[part - 1] if part else None
                    right = cuts[part] if part < len(cuts) else None
                    (final if n <= range_rows else following).append((left, right, at, here, own))
                at += own
            if todo and high is not None:
                raise AssertionError("a target lies outside the range it was found in")
            for i, _ in todo:
                found[i] = None
        open_ranges = [f[:4] for f in following]
        size, salt = sum(f[4] for f in following), salt + 1
        active = _inside(rows, following)
    found.update(_exact(rows, final, group))
    return [found[i] for i in range(len(targets))]


def _inside(rows: DataFrame, ranges: Sequence[tuple]) -> DataFrame:
    """The rows of some ranges [low, high), with the number of the range."""
    edges = sorted({k for low, high, *_ in ranges for k in (low, high) if k is not None})
    number = {(bisect_right(edges, low) if low is not None else 0): i for i, (low, *_) in enumerate(ranges)}
    parts = [number.get(p, -1) for p in range(len(edges) + 1)]
    return rows.withColumn("part", F.get(_array("array<int>", parts), range_of(edges))).where("part >= 0")


def _exact(rows: DataFrame, ranges: Sequence[tuple], group: float) -> dict[int, _Key | None]:
    """The boundary keys of targets inside ranges of a few rows each.

    The running size gives the row in which a target falls. Then the groups of these rows, one for each target, are
    summed over all ranges, as a group may go on beyond its range.
    """
    if not ranges:
        return {}
    starts = [int(before) for _, _, before, _, _ in ranges]
    goals = [[{"i": i, "target": float(t)} for i, t in wanted] for _, _, _, wanted, _ in ranges]
    order = Window.partitionBy("part").orderBy("h", "d", "r")
    begin = F.get(_array("array<bigint>", starts), F.col("part")) + F.sum("size").over(order) - F.col("size")
    here = F.get(_array("array<array<struct<i:int,target:double>>>", goals), F.col("part"))
    running = _inside(rows, ranges).select("part", "h", "d", "r", "size", begin.alias("begin"))
    hits = running.select("*", F.explode(here).alias("goal")).where(
        "begin <= goal.target AND goal.target < begin + size"
    ).collect()

    keys = sorted((q["h"], q["d"], q["r"]) for q in hits)
    own = {q["h"] for q in hits}
    groups = rows.where(F.col("h").isin(list(own)))
    below = range_of(keys).alias("below")
    sums = {h: [0] * (len(keys) + 1) for h in own}
    for q in groups.groupBy("h", below).agg(F.sum("size").alias("size")).collect():
        sums[q["h"]][q["below"]] = q["size"]
    found = {}
    for q in hits:
        key, target = (q["h"], q["d"], q["r"]), q["goal"]["target"]
        # Bytes of the group in front of the row, and in all.
        front = sum(sums[q["h"]][: bisect_left(keys, key) + 1])
        whole = sum(sums[q["h"]])
        if whole <= group:
            first = q["begin"] - front
            found[q["goal"]["i"]] = (q["h"], _LEAST, _LEAST) if first + whole / 2 >= target else _behind(q["h"])
        else:
            found[q["goal"]["i"]] = key if q["begin"] + q["size"] / 2 >= target else _behind(*key)
    return found


def _behind(h: int, d: int | None = None, r: int | None = None) -> _Key | None:
    """The least key behind a group, or behind a row; None behind all keys."""
    if r is not None and r < _MOST:
        return h, d, r + 1
    if d is not None and d < _MOST:
        return h, d + 1, _LEAST
    return (h + 1, _LEAST, _LEAST) if h < _MOST else None


def assign_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    sample: int = SAMPLE,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, kept columns): every row in one of `shards` of nearly equal bytes.

    Records and groups of equal texts above a hundredth of a shard are dealt out first, largest first; the others
    fill the shards up to one level by ranges of their key. So shards differ by about a hundredth, unless single records
    exceed a whole shard. Equal texts share a shard unless keeping their group whole would make the shards unequal.
    `slot` numbers the rows of a shard from 0. An empty table gives no rows, and with fewer rows than shards
    some stay empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = records(docs, id_col, text, keep)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    whole, single, taken = _deal_large(rows, total, shards)
    limit = _SHARE * total / shards
    groups, keys = sorted(whole), sorted(single)
    given = _array("array<bigint>", groups)
    at = _at_most(given, len(groups), F.col("h")) - 1
    of_group = F.when(F.get(given, at) == F.col("h"), F.get(_array("array<int>", [whole[k] for k in groups]), at))
    of_record = F.when(
        F.col("size") > limit, F.get(_array("array<int>", [single[k] for k in keys]), range_of(keys) - 1)
    )
    dealt = F.coalesce(of_group, of_record)
    rest = total - sum(taken)
    room = _room(rest, taken)
    targets = [sum(room[: s + 1]) for s in range(shards - 1)]
    near = _SHARE * _level(total, taken)
    cuts = boundaries(rows.where(dealt.isNull()), rest, targets, near, range_rows, sample) if rest else []
    # Shards without room share a boundary with the next; no row lies behind a boundary that is None.
    shard = F.coalesce(dealt, range_of(sorted(c for c in cuts if c is not None)))
    kept = [F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)]
    columns = ["doc_id", "size", "text_crc32", "shard"]
    assigned = rows.withColumn("shard", shard).select(*columns, *[f"kept_{i}" for i in range(len(keep))])
    return _numbered(assigned).select(*columns, "slot", *kept)


def _numbered(assigned: DataFrame) -> DataFrame:
    """Adds `slot`: each written file holds its rows by shard, so a slot is the row in the file, shifted.

    The shift comes from one count per file and shard; the rows are neither shuffled nor ranked.
    """
    written = _placed(stage(assigned.sortWithinPartitions("shard"), "shards"))
    own = written.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    return written.join(own.select("shard", "file", shift), ["shard", "file"]).withColumn(
        "slot", (F.col("row") + F.col("shift")).cast("long")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes the documents with all their columns as one folder `shard=...` per shard."""
    clash = [c for c in docs.columns if c.lower() == "shard"]
    if clash:
        raise ValueError(f"the documents have a column {clash[0]} already")
    carried = assign_shards(docs, shards, id_col, text, keep=docs.columns)
    names = len(docs.columns)
    carried = carried.toDF("doc_id_", "size_", "crc_", "shard", "slot_", *[f"kept_{i}" for i in range(names)])
    out = carried.select("shard", *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
    out.write.partitionBy("shard").parquet(path)


def report(assigned: DataFrame) -> DataFrame:
    """The rows of `assign_shards` with the law they follow; a shard more is not part of it."""
    return assigned.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
