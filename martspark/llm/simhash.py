"""SimHash near-duplicates: a self-join of the binary trie of the fingerprints, and its components."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import map_slices, ship, signed, text_or_empty
from martspark.llm.components import connected
from martspark.session import stage

BITS = 64
HALF = BITS // 2
SEED = 42  # of XXH64; fixed value
# A cell of the trie is cut further while it holds more fingerprints than this.
_CELL = 1 << 15
# Node pairs that are taken down together, and leaf pairs compared at once.
_FRONT = 1 << 18
_SMALL = 64


def simhash(text: str, k: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the k-word shingles, repeats counted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda at, n: at + 1 + n))
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0] + [e + 1 for e in ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:])]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > n
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed 64-bit number; 0 for texts without words."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        return {
            "doc_id": batch.column("doc_id"),
            "fp": [signed(simhash(t, k)) for t in batch.column("text").to_pylist()],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", text_or_empty().alias("text")), rows, f"doc_id {kind}, fp bigint")


def _masks(width: int, errors: int) -> list[int]:
    """All numbers of `width` bits with at most `errors` ones, 0 first."""
    return [
        sum(1 << i for i in places)
        for n in range(errors + 1)
        for places in itertools.combinations(range(width), n)
    ]


def _turned(key: np.ndarray, turn: int) -> np.ndarray:
    """The halves of the bits swapped if `turn` is 1."""
    h = np.uint64(HALF)
    return (key << h) | (key >> h) if turn else key


class _Sets:
    """Least member of the set of each of n numbers, as pairs come in."""

    def __init__(self, n: int) -> None:
        self.least = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.least[a], self.least[b]
            apart = x != y
            a, b = a[apart], b[apart]
            np.minimum.at(self.least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while (jump := self.least[self.least]).tobytes() != self.least.tobytes():
                self.least = jump


def _descend(x: np.ndarray, y: np.ndarray, alike: bool, top: int, errors: int, first: int) -> Iterator[tuple]:
    """Places (i, j) of fingerprints x[i], y[j] within `errors` bits, at most `first` in the first half.

    x and y are sorted, so a node of their tries is a range. Pairs of nodes go down the bits together
    with the number of bits in which they differ so far; pairs over the budget of their depth go no
    further. Small pairs of nodes are compared directly. `alike` joins x with itself, each pair once.
    """
    if not len(x) or not len(y):
        return
    stack = [(top, np.array([[0], [len(x)], [0], [len(y)], [0]]), np.array([alike]))]
    while stack:
        depth, front, same = stack.pop()
        if front.shape[1] > _FRONT:
            stack += [
                (depth, front[:, i: i + _FRONT], same[i: i + _FRONT]) for i in range(0, front.shape[1], _FRONT)
            ]
            continue
        xl, xh, yl, yh, diff = front
        leaf = ((xh - xl) * (yh - yl) <= _SMALL) | (depth == BITS)
        if leaf.any():
            yield from _compare(x, y, front[:, leaf], same[leaf], errors, first)
            front, same = front[:, ~leaf], same[~leaf]
            xl, xh, yl, yh, diff = front
        if not front.shape[1]:
            continue
        keep, one = np.uint64(((1 << depth) - 1) << (BITS - depth)), np.uint64(1 << (BITS - 1 - depth))
        xm = np.clip(np.searchsorted(x, (x[xl] & keep) | one), xl, xh)
        ym = np.clip(np.searchsorted(y, (y[yl] & keep) | one), yl, yh)
        most = first if depth < HALF else errors
        parts = [
            (np.stack([xl, xm, yl, ym, diff]), same, np.ones(len(xl), bool)),
            (np.stack([xm, xh, ym, yh, diff]), same, np.ones(len(xl), bool)),
            (np.stack([xl, xm, ym, yh, diff + 1]), np.zeros(len(xl), bool), diff < most),
            (np.stack([xm, xh, yl, ym, diff + 1]), np.zeros(len(xl), bool), (diff < most) & ~same),
        ]
        below, alikes = [], []
        for part, part_same, good in parts:
            good = good & (part[0] < part[1]) & (part[2] < part[3])
            below.append(part[:, good])
            alikes.append(part_same[good])
        stack.append((depth + 1, np.concatenate(below, axis=1), np.concatenate(alikes)))


def _compare(x, y, front, same, errors: int, first: int) -> Iterator[tuple]:
    """The close pairs among the leaf pairs of `front`, some at a time."""
    xl, xh, yl, yh, _ = front
    width = yh - yl
    sizes = (xh - xl) * width
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 22), side="right")))
        node = np.repeat(np.arange(start, stop), sizes[start:stop])
        inside = np.arange(len(node)) - (ends[node] - sizes[node] - base)
        i, j = xl[node] + inside // width[node], yl[node] + inside % width[node]
        apart = x[i] ^ y[j]
        close = (np.bitwise_count(apart) <= errors) & (np.bitwise_count(apart >> np.uint64(HALF)) <= first)
        close &= ~same[node] | (i < j)
        yield i[close], j[close]
        start = stop


def _links_of_cell(cell: pd.DataFrame, errors: int) -> pd.DataFrame:
    """Edges that connect what is linked in a cell: its own fingerprints with each other and with visitors."""
    first = errors // 2
    turn, depth = int(cell["turn"].iloc[0]), int(cell["depth"].iloc[0])
    keys = _turned(cell["fp"].to_numpy().astype(np.int64).view(np.uint64), turn)
    own = np.sort(keys[cell["own"].to_numpy()])
    guests = np.sort(keys[~cell["own"].to_numpy()])
    sets = _Sets(len(own) + len(guests))
    for i, j in _descend(own, own, True, depth, errors, first):
        sets.join(i, j)
    # Guests come from other cells, so their first bits differ: they start at the root.
    for i, j in _descend(guests, own, False, 0, errors, first):
        sets.join(len(own) + i, j)
    both = _turned(np.concatenate([own, guests]), turn).view(np.int64)
    moved = np.flatnonzero(sets.least != np.arange(len(both)))
    return pd.DataFrame({"a": both[moved], "b": both[sets.least[moved]]})


def linked(keys: DataFrame, max_distance: int) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints `fp` as their links within `max_distance` bits do.

    At most max_distance // 2 of the differing bits lie in one of the two halves. So the trie is joined
    with itself twice, over the bits as they are and with the halves swapped, each time with that budget
    in the first half and the whole one below. Cells at a depth that follows the number of fingerprints
    are joined in one task each; a cell with more than _CELL fingerprints is cut further down the first
    half. A fingerprint also visits the cells within the budget that come after its own. Within a cell
    only a spanning forest of the links is kept, so a dense group gives as many edges as members.
    """
    ship(keys.sparkSession)
    first = max_distance // 2
    depth = min(HALF, max(1, math.ceil(math.log2(max(keys.count(), 1) / (_CELL / 4)))))
    turned = F.shiftleft("fp", HALF).bitwiseOR(F.shiftrightunsigned("fp", HALF))
    own = keys.select(
        "fp", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("key")),
                                F.struct(F.lit(1).alias("turn"), turned.alias("key")))).alias("k")
    ).select("fp", "k.*").withColumn("cell", F.shiftrightunsigned("key", BITS - depth))
    sizes = own.groupBy("turn", "cell").agg(F.count(F.lit(1)).alias("n"))
    deeper = F.least(F.lit(HALF - depth), F.ceil(F.log2(F.col("n") / _CELL)).cast("int") + 2)
    large = stage(sizes.where(F.col("n") > _CELL).select("turn", "cell", deeper.alias("more")), "trie-cells")

    # What a fingerprint visits: all cells within the budget, its own among them.
    masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(m.bit_count()).alias("used"))
                      for m in _masks(depth, first)])
    visits = own.withColumn("v", F.explode(masks)).select(
        "fp", "turn", "key", F.col("cell").bitwiseXOR(F.col("v.m")).alias("cell"), "v.m", "v.used"
    )
    plain = visits.join(large, ["turn", "cell"], "left_anti").select(
        "fp", "turn", F.lit(depth).alias("depth"), "cell",
        F.when(F.col("m") == 0, 0).when(F.col("cell") > F.col("cell").bitwiseXOR(F.col("m")), 1).alias("order"),
    )
    deep = visits.join(large, ["turn", "cell"]).mapInPandas(
        lambda frames: _deeper(frames, depth, first), "fp bigint, turn int, depth int, cell bigint, order int"
    )
    cells = plain.unionByName(deep).where("order is not null").select(
        "fp", "turn", "depth", "cell", (F.col("order") == 0).alias("own")
    )
    return cells.groupBy("turn", "depth", "cell").applyInPandas(
        lambda cell: _links_of_cell(cell, max_distance), "a bigint, b bigint"
    )


def _deeper(frames: Iterator[pd.DataFrame], depth: int, first: int) -> Iterator[pd.DataFrame]:
    """Visits of a large cell, led on to the cells below it."""
    for frame in frames:
        for (more, used), rows in frame.groupby(["more", "used"]):
            low = np.array(_masks(int(more), first - int(used)), dtype=np.uint64)
            key = rows["key"].to_numpy().view(np.uint64)
            at = key >> np.uint64(BITS - depth - int(more))
            mask = (rows["m"].to_numpy().view(np.uint64) << np.uint64(more))[:, None] | low[None, :]
            cell = at[:, None] ^ mask
            yield pd.DataFrame({
                "fp": np.repeat(rows["fp"].to_numpy(), len(low)),
                "turn": np.repeat(rows["turn"].to_numpy(), len(low)),
                "depth": np.int32(depth + int(more)),
                "cell": cell.ravel().view(np.int64),
                "order": pd.array(np.where(mask == 0, 0, np.where(cell > at[:, None], 1, -1)).ravel(), dtype="Int32"),
            }).query("order >= 0")


def near_duplicates(docs: DataFrame, k: int = 3, max_distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the least doc_id that its links reach, itself included.

    Fingerprints at `max_distance` or fewer differing bits are linked, whatever the texts; NULL, empty and
    blank texts have fingerprint 0 and link like any other. Equal fingerprints are joined only once, so
    copies cost no pairs. Repeated rows are repeated in the result, an empty table gives none; other
    columns are not read.
    """
    prints = stage(fingerprints(docs, k), "simhash")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-distinct")
    roots = connected(linked(distinct.select("fp"), max_distance)).withColumnsRenamed({"node": "fp"})
    groups = distinct.join(roots, "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_print = groups.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3, max_distance: int = 3) -> DataFrame:
    """The rows of `docs` whose doc_id is the least of their group, all columns as they are.

    Rows with the same id are one document and stay together; rows without an id stay.
    """
    gone = near_duplicates(docs, k, max_distance).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
