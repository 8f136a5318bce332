"""Daily totals kept up to date: a load reads its own days, not the fact table.

The store holds the loaded facts by day, and two tables of partial results (totals per user, activity per month, hour and
service) on three levels. A day's part comes from the facts of that day, a month's from its days, a year's
from its months, and the totals of all time from the years. A load therefore touches its days, at most 31 daily parts for
each of its months and 12 monthly ones for each of its years, whether the days are new or long past.

Nothing is overwritten. Parts go to folders of their own, and the last step appends to the journal which folder holds which
period from now on. A load that ends before that step has not happened and can be repeated; readers see the state of the
last finished load. The journal has a few rows per load, so the driver reads it; loads come one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators.features import user_totals
from martspark.operators.marts import activity
from martspark.session import stage
from martspark.sources.tables import latest_per_key

# Characters of a period's name on each level; rows without time make a period of their own on all of them.
LEVELS = {"day": 10, "month": 7, "year": 4}
NO_TIME = "none"
_JOURNAL = "version long, kind string, level string, period string, load string, folder string"


@dataclass(frozen=True)
class Rollup:
    """A partial result: how it comes from facts, by which keys parts are merged, and how."""

    first: Callable[..., DataFrame]
    keys: Sequence[str]
    merge: dict[str, Callable[[str], Column]]

    def merged(self, parts: DataFrame, *also: str) -> DataFrame:
        return parts.groupBy(*also, *self.keys).agg(*[f(c).alias(c) for c, f in self.merge.items()])


ROLLUPS = {
    "users": Rollup(
        user_totals, ("user_id",),
        {"first_trans_date": F.min, "last_trans_date": F.max, "frequency": F.sum, "monetary": F.sum},
    ),
    "activity": Rollup(activity, ("month", "hour", "trans_service"), {"count": F.sum}),
}


class _State:
    """The journal as read: the folder of each load and day, and of each part."""

    def __init__(self, spark: SparkSession, store: str):
        spark.createDataFrame([], _JOURNAL).write.mode("ignore").parquet(f"{store}/journal")
        rows = spark.read.schema(_JOURNAL).parquet(f"{store}/journal").collect()
        rows.sort(key=lambda r: r["version"])
        self.version = max((r["version"] for r in rows), default=0)
        self.facts: dict[str, dict[str, str]] = {}
        self.parts: dict[tuple[str, str], dict[str, str]] = {}
        loads = {r["load"]: r["version"] for r in rows if r["kind"] == "facts"}
        for r in rows:
            if r["kind"] != "facts":
                self._set(self.parts.setdefault((r["kind"], r["level"]), {}), r["period"], r["folder"])
            elif loads[r["load"]] == r["version"] and r["folder"]:
                self.facts.setdefault(r["load"], {})[r["period"]] = r["folder"]

    @staticmethod
    def _set(known: dict[str, str], period: str, folder: str | None) -> None:
        if folder is None:
            known.pop(period, None)
        else:
            known[period] = folder


def _day(ts: str) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NO_TIME))


def _by_period(df: DataFrame, folder: str, column: str) -> None:
    """One folder per period; a period with very many rows is written by several tasks."""
    df.hint("rebalance", F.col(column)).write.partitionBy(column).parquet(folder)


def _read(spark: SparkSession, folders: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of some folders with `period` and `version`, which stand in their paths; no other folder is listed."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    path = F.col("_metadata.file_path")
    return reader.parquet(*sorted(folders)).select(
        "*",
        F.regexp_extract(path, r"/(?:_day|period)=([^/]+)/[^/]*$", 1).alias("period"),
        F.regexp_extract(path, r"/v(\d+)-[0-9a-f]{8}/[^/]+/[^/]*$", 1).cast("long").alias("version"),
    )


def load_facts(rows: DataFrame, store: str, load: str, ts: str = "trans_timestamp", key: str = "trans_id") -> list[str]:
    """Takes a load of transactions into the store and returns the days whose parts were made anew.

    A load that comes again under its name stands in for its first delivery, whatever days either has. A transaction
    that several loads deliver for the same day counts once, as the latest of them says; `key` is not NULL.
    """
    spark = rows.sparkSession
    state = _State(spark, store)
    version = state.version + 1
    mark = f"v{version}-{uuid.uuid4().hex[:8]}"
    journal: list[tuple] = []

    own = f"{store}/facts/{mark}"
    _by_period(rows.withColumn("_day", _day(ts)), own, "_day")
    held = spark.read.schema(T.StructType([T.StructField("_day", T.StringType())])).parquet(own)
    days = [r["_day"] for r in held.distinct().collect()]
    replaced = state.facts.pop(load, {})
    if days:
        state.facts[load] = {d: f"{own}/_day={d}" for d in days}
    # An empty load is noted too, since it replaces what came before under its name.
    journal += [(version, "facts", "day", d, load, f) for d, f in state.facts.get(load, {}).items()] or [
        (version, "facts", "day", None, load, None)
    ]

    touched = sorted({*days, *replaced})
    found = {f: d for folders in state.facts.values() for d, f in folders.items() if d in touched}
    if found:
        # A load has each transaction once, unless a row repeats within it.
        facts = stage(latest_per_key(_read(spark, list(found), rows.schema), key, ["version"]), "touched-days")
    for kind, rollup in ROLLUPS.items():
        for level, width in LEVELS.items():
            periods = sorted({d[:width] for d in touched})
            if level == "day":
                sources = found
            else:
                sources = {f: p for p, f in state.parts[(kind, _below(level))].items() if p[:width] in periods}
            into = f"{store}/{kind}/{level}/{mark}"
            if sources and level == "day":
                _by_period(rollup.first(facts, "period"), into, "period")
            elif sources:
                parts = _read(spark, list(sources)).withColumn("period", F.substring("period", 1, width))
                _by_period(rollup.merged(parts, "period"), into, "period")
            filled = {p[:width] for p in sources.values()}
            known = state.parts.setdefault((kind, level), {})
            for p in periods:
                folder = f"{into}/period={p}" if p in filled else None
                state._set(known, p, folder)
                journal.append((version, kind, level, p, load, folder))
    spark.createDataFrame(journal, _JOURNAL).coalesce(1).write.mode("append").parquet(f"{store}/journal")
    return touched


def _below(level: str) -> str:
    names = list(LEVELS)
    return names[names.index(level) - 1]


def read_rollup(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """The result over all time, as if it came from all facts: one part per year is merged."""
    years = _State(spark, store).parts.get((kind, "year"), {})
    if not years:
        raise ValueError(f"no facts have been loaded to {store}")
    return ROLLUPS[kind].merged(spark.read.parquet(*sorted(years.values())))


__all__ = ["LEVELS", "NO_TIME", "ROLLUPS", "Rollup", "load_facts", "read_rollup"]
