"""Building blocks that stay distributed when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.session import stage, stage_dealt


# Rows of one key that a task may take before the key is spread.
ROWS_PER_TASK = 1_000_000
_NULL_SALTS = 65_536


@dataclass(frozen=True)
class Salted:
    """Rows with a `_salt` beside their own columns, and the keys that have more than one salt."""

    rows: DataFrame
    on: tuple[str, ...]
    columns: tuple[str, ...]
    large: DataFrame


def _salted(left: DataFrame, on: Sequence[str], rows_per_task: int, salt_by: Sequence[str] | None) -> Salted:
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()

    sizes = left.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = F.broadcast(sizes.where(F.col("_rows") > rows_per_task).select(
        *on, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts")
    ))
    salts = F.when(known, F.coalesce("_salts", F.lit(1))).otherwise(F.lit(_NULL_SALTS))
    row_salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by or left.columns]), salts).cast("int")
    rows = left.join(hot, on, "left").select(*left.columns, row_salt.alias("_salt"))
    return Salted(rows, tuple(on), tuple(left.columns), hot)


def deal(
    left: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK, rows_per_file: int = 250_000
) -> Salted:
    """The left side of many salted joins on the same key, written once in files by key and salt.

    Each of the joins then shuffles its right side only, however many rows the left has.
    """
    salted = _salted(left, list(on), rows_per_task, None)
    files = max(left.sparkSession.sparkContext.defaultParallelism, -(-left.count() // rows_per_file))
    most = int(left.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    rows = stage_dealt(salted.rows, "dealt", [*on, "_salt"], min(files, most))
    return replace(salted, rows=rows, large=F.broadcast(stage(salted.large, "large-keys")))


def salted_join(
    left: DataFrame | Salted,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi join of a skewed `left` with a `right` that is unique on `on`.

    A key with more than `rows_per_task` left rows is spread over as many salts as that takes, its
    right row repeated once per salt, so the limit of a task does not move with the size of the
    table. NULL keys match nothing and are spread too. The salt is a hash of the row, so a
    recomputed task puts each row in the same place; let `left` carry a row key, as fully equal
    rows get equal salts. With `salt_by`, such a key, the other columns of `left` are not read where
    they are not used later. The large keys, at most one in `rows_per_task` rows, are broadcast: a
    shuffle for them would bring all rows of a large key, or without one, to one task. A `left` that
    `deal` has written on the same key is not shuffled again.
    """
    on = list(on)
    salted = left if isinstance(left, Salted) else _salted(left, on, rows_per_task, salt_by)
    if list(salted.on) != on:
        raise ValueError(f"dealt by {salted.on}, joined on {on}")
    every_salt = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(salted.large, on, "left").select(*right.columns, F.explode(every_salt).alias("_salt"))
    joined = salted.rows.join(salted_right, [*on, "_salt"], how)
    extra = [c for c in right.columns if c not in on] if how in ("inner", "left") else []
    return joined.select(*salted.columns, *extra)


_COARSE, _FINE = 32, 32


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    place: str,
    name: str = "position",
    total: str | None = None,
    range_rows: int = 100_000,
) -> DataFrame:
    """0-based position of each row among the rows of its `keys`, in `order`.

    `place` is the integer column that leads `order` (ascending). A group with more than
    `range_rows` rows, or the whole table without keys, is cut at about a thousand approximate
    quantiles of `place`, so ranges are equally filled wherever the values lie; rows with the same
    place stay together. Each range is numbered by itself and shifted by the rows before it.
    `total` names a column with the group size.
    """
    keys = list(keys)
    parts = _COARSE * _FINE
    quantiles = F.percentile_approx(place, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts")
    size = F.count(F.lit(1)).alias("_n")
    if keys:
        renamed = {k: f"_large_{k}" for k in keys}
        large = df.groupBy(*keys).agg(size).where(F.col("_n") > range_rows).withColumnsRenamed(renamed)
        same = _all_equal([(k, f"_large_{k}") for k in keys])
        cuts = df.join(large.drop("_n"), same).groupBy(*renamed.values()).agg(size, quantiles)
        known = df.join(cuts, same, "left").drop(*renamed.values())
    else:
        whole = df.agg(size, quantiles).first()
        kind = df.schema[place].dataType
        given = F.array(*[F.lit(c).cast(kind) for c in whole["_cuts"] or []]).cast(T.ArrayType(kind))
        known = df.withColumns({"_n": F.lit(whole["_n"]), "_cuts": given})

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < F.col(place)))

    # First among every 32nd cut, then among the cuts that follow it.
    known = known.withColumn(
        "_block", below(F.filter("_cuts", lambda _, i: (i + 1) % _FINE == 0))
    )
    inner = below(F.slice("_cuts", F.col("_block") * _FINE + 1, F.lit(_FINE - 1)))
    part = F.when(F.col("_cuts").isNotNull(), F.col("_block") * _FINE + inner).otherwise(F.lit(0))
    known = known.withColumn("_part", part).drop("_block")

    inside = Window.partitionBy(*keys, "_part")
    numbered = known.withColumn("_inside", F.row_number().over(inside.orderBy(*order)))
    if total:
        numbered = numbered.withColumn(total, F.coalesce("_n", F.count(F.lit(1)).over(inside)))

    cut = known.where(F.col("_cuts").isNotNull())
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *[F.col(k).alias(f"_shift_{k}") for k in [*keys, "_part"]], F.sum("_size").over(earlier).alias("_shift")
    )
    if not keys:
        # One row per range, so that the numbered rows are not shuffled once more.
        shifts = F.broadcast(shifts)
    here = _all_equal([(k, f"_shift_{k}") for k in [*keys, "_part"]])
    return numbered.drop("_cuts").join(shifts, here, "left").select(
        *df.columns,
        (F.coalesce("_shift", F.lit(0)) + F.col("_inside") - 1).cast("long").alias(name),
        *([F.col(total)] if total else []),
    )


def _all_equal(pairs: Sequence[tuple[str, str]]) -> Column:
    """All pairs of columns hold the same value, or are both NULL."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


_SLICES = 64


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each group in `order`, with their 1-based `_place`.

    No group is ever ranked whole in one task: where Spark itself does not apply the rank filter on
    the input side of the shuffle, the rows are ranked within slices of the group first.
    """
    ranked_first = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > ranked_first:
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SLICES)))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = sliced.withColumn("_place", F.row_number().over(within)).where(F.col("_place") <= n)
        df = df.drop("_slice", "_place")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n)


def last_n_per_group(df: DataFrame, key: str | Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last `n` rows of each group along `order` (make `order` unique for a fixed result)."""
    keys = [key] if isinstance(key, str) else list(key)
    return first_n_per_group(df, keys, [F.col(c).desc() for c in order], n).drop("_place")


def count_below(cuts: Column, steps: int, value: Column) -> Column:
    """How many of an ascending array of fewer than 2^steps numbers are below `value`: found by halving."""

    def step(at: Column, width: Column) -> Column:
        # Beyond the last cut `get` is NULL, and the place stays.
        return F.when(F.get(cuts, at + width - 1) < value, at + width).otherwise(at)

    return F.aggregate(F.lit([1 << b for b in reversed(range(steps))]), F.lit(0), step)


# Cuts of an interval in a round, and values of an interval that are read at once.
_CUTS = 1000
FEW = 20_000


def order_statistics(
    df: DataFrame, columns: Sequence[str], ranks: Callable[[int], Sequence[int]], few: int = FEW
) -> dict[str, tuple[int, dict[int, float]]]:
    """For each column its number of known values, and the values at the given 0-based ranks among them, ascending.

    `ranks` names the ranks wanted for a number of values; NULL and NaN are no values. Selection by narrowing: approximate
    percentiles cut an interval, then the values between two cuts and those equal to a cut are counted exactly. A rank
    that falls on a cut is found; one between two cuts goes on with their interval, which has about a thousandth of the
    rows, until that holds at most `few` values, which are read. The rounds follow the logarithm of the rows; all columns and
    ranks share their passes, and no values are sorted or summed up in one task.
    """
    pairs = [F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    values = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.m", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    # Of each open interval: column, the cuts around it, the values before it, the ranks in it.
    spans: list[tuple] = [(i, None, None, 0, None) for i in range(len(columns))]
    size: dict[int, int] = {}
    found: list[dict[int, float]] = [{} for _ in columns]
    while spans:
        inside = values.withColumn("s", _span_of(spans)).where("s IS NOT NULL")
        share = F.percentile_approx("v", [i / _CUTS for i in range(_CUTS + 1)], 10 * _CUTS)
        measured = {r["s"]: r for r in inside.groupBy("s").agg(F.count(F.lit(1)).alias("n"), share.alias("cuts")).collect()}
        if not size:
            size = {i: measured[i]["n"] if i in measured else 0 for i in range(len(columns))}
            spans = [(i, None, None, 0, sorted(set(ranks(size[i])))) for i in range(len(columns))]
        small = [s for s in measured if measured[s]["n"] <= few and spans[s][4]]
        if small:
            rows = inside.where(F.col("s").isin(small)).groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).collect()
            read: dict[int, list] = {}
            for r in sorted(rows, key=lambda r: r["v"]):
                read.setdefault(r["s"], []).append((r["v"], r["n"]))
            for s, counted in read.items():
                m, _, _, before, wanted = spans[s]
                _take(counted, before, wanted, found[m])
        large = [s for s in measured if s not in small and spans[s][4]]
        following = []
        if large:
            cuts = [sorted(set(measured[s]["cuts"])) if s in large else [] for s in range(len(spans))]
            own = F.get(F.array(*[F.lit(c) if c else F.array().cast("array<double>") for c in cuts]), F.col("s"))
            below = count_below(own, (_CUTS + 1).bit_length(), F.col("v"))
            # Even zones lie between cuts, odd ones are the values equal to one.
            zone = (below * 2 + F.coalesce((F.get(own, below) == F.col("v")).cast("int"), F.lit(0))).alias("zone")
            zones = inside.where(F.col("s").isin(large)).groupBy("s", zone).agg(F.count(F.lit(1)).alias("n"))
            for s, counted in _grouped(zones.collect()).items():
                m, low, high, at, wanted = spans[s]
                for z, n in counted:
                    here = [r for r in wanted if at <= r < at + n]
                    if here and z % 2:
                        found[m].update({r: cuts[s][z // 2] for r in here})
                    elif here:
                        left = cuts[s][z // 2 - 1] if z else low
                        right = cuts[s][z // 2] if z // 2 < len(cuts[s]) else high
                        following.append((m, left, right, at, here))
                    at += n
        spans = following
    return {c: (size[i], found[i]) for i, c in enumerate(columns)}


def _span_of(spans: Sequence[tuple]) -> Column:
    """The number of the open interval that a value lies in, without its ends; NULL outside all of them."""
    out = None
    for i, (m, low, high, *_) in enumerate(spans):
        here = F.col("m") == m
        here = here if low is None else here & (F.col("v") > F.lit(low))
        here = here if high is None else here & (F.col("v") < F.lit(high))
        out = F.when(here, i) if out is None else out.when(here, i)
    return out


def _grouped(rows: Sequence) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["zone"]):
        out.setdefault(r["s"], []).append((r["zone"], r["n"]))
    return out


def _take(counted: Sequence[tuple[float, int]], before: int, wanted: Sequence[int], into: dict[int, float]) -> None:
    """The values at some ranks, from ascending values with their counts."""
    at = before
    for value, n in counted:
        into.update({r: value for r in wanted if at <= r < at + n})
        at += n


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row (metric, edges) per column that has values.

    The built-in exact percentile keeps every distinct value of a column in one task; here the order statistics come from
    `order_statistics`, in a few passes over `df`, so hand in a staged frame if it is expensive.
    """
    probs = [float(p) for p in probabilities]

    def ranks(n: int) -> list[int]:
        low = [int(p * (n - 1)) for p in probs] if n else []
        return [r for k in low for r in (k, min(k + 1, n - 1))]

    rows = []
    for column, (n, at) in order_statistics(df, columns, ranks).items():
        if n:
            places = [p * (n - 1) for p in probs]
            edges = [at[int(x)] + (at[min(int(x) + 1, n - 1)] - at[int(x)]) * (x - int(x)) for x in places]
            rows.append((column, [float(e) for e in edges]))
    # One row per column.
    return df.sparkSession.createDataFrame(rows, "metric string, edges array<double>")
