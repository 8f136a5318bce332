"""Writing, sharing, conforming and changing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators.scale import salted_join
from martspark.schemas import LENGTH


def _fitted(f: T.StructField) -> Column:
    value = F.col(f.name).try_cast(f.dataType)
    return F.when(F.length(value) <= f.metadata[LENGTH], value) if LENGTH in f.metadata else value


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of `schema` in its order and types; a value of another type or a text longer than declared is NULL."""
    return df.select(*[_fitted(f).alias(f.name) for f in schema.fields])


def conform_losses(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: per column the values that `conform` turns into NULL, and the NULLs that the schema forbids."""

    def lost(f: T.StructField) -> Column:
        missing = _fitted(f).isNull()
        return F.col(f.name).isNotNull() & missing if f.nullable else missing

    return df.agg(*[F.count_if(lost(f)).alias(f.name) for f in schema.fields])


def write_mart(
    df: DataFrame,
    path: str,
    schema: T.StructType | None = None,
    mode: str = "overwrite",
    allow_losses: bool = False,
) -> int:
    """Writes a mart table as Parquet and returns its rows, counted while writing.

    Values that do not fit the declared type or length or a NULL where none may be stop the write before
    it begins, unless `allow_losses`. They are counted in a pass of its own, which reads only the columns
    that can have any: those of another type than declared, those with a declared length, and those that
    must not be NULL but can be.
    """
    if schema is not None and not allow_losses:
        given = df.schema
        doubtful = [
            f for f in schema.fields
            if given[f.name].dataType != f.dataType or LENGTH in f.metadata
            or (given[f.name].nullable and not f.nullable)
        ]
        losses = conform_losses(df, T.StructType(doubtful)).first().asDict() if doubtful else {}
        if any(losses.values()):
            raise ValueError(f"values that do not fit {path}: { {c: n for c, n in losses.items() if n} }")
    seen = Observation()
    out = conform(df, schema) if schema is not None else df
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """Shares a frame by name within the session."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def persist_stage(df: DataFrame) -> DataFrame:
    """Keeps a frame for a few reuses in one application; select its columns first."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def append_rows(df: DataFrame, path: str, key: str = "uuid") -> int:
    """Appends the rows whose `key` the Parquet table does not have yet; returns their number.

    A repeated call after a failure adds nothing twice.
    """
    spark = df.sparkSession
    df.limit(0).write.mode("ignore").parquet(path)  # an empty table, if there is none yet
    known = spark.read.schema(T.StructType([df.schema[key]])).parquet(path)
    return write_mart(rows_not_in(df.dropDuplicates([key]), known, key), path, mode="append")


def rows_not_in(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in a (usually much larger) table.

    The table is first reduced to the keys in question. That join may broadcast the rows if they
    are few, where an anti join against the table would always shuffle it.
    """
    present = table.select(key).join(rows.select(key), key, "left_semi")
    return rows.join(present, key, "left_anti").select(*rows.columns)


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key."""
    rest = [c for c in df.columns if c != key]
    # The order columns lead the struct; ties fall to the remaining columns, so the result is fixed.
    lead = [*order, *[c for c in rest if c not in order]]
    best = df.groupBy(key).agg(F.max(F.struct(*lead)).alias("_row"))
    return best.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(base: DataFrame, updates: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """`base` with the rows of `updates` put in by key.

    A NULL or absent column of an update keeps the old value. `order` picks the latest update
    per key; without it `updates` must be unique on the key. Few updates are broadcast, so that
    the base is not shuffled, which a full outer join would do.
    """
    changes = latest_per_key(updates, key, order) if order else updates
    carried = [c for c in base.columns if c != key and c in changes.columns]
    new = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in carried])
    changed = base.join(new, key, "left").select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in carried else F.col(c) for c in base.columns]
    )
    added = rows_not_in(changes.select(key, *carried), base, key)
    return changed.unionByName(added, allowMissingColumns=True)


def cascade_delete(
    tables: dict[str, DataFrame],
    root: str,
    deleted: DataFrame,
    key: str,
    children: Mapping[str, Sequence[tuple[str, str]]],
) -> dict[str, DataFrame]:
    """The tables without the `deleted` keys of `root` and without their descendants.

    `children` maps a child table to its (parent table, foreign key column) pairs; a row goes with the
    first of its parents that goes. Each table's own key is `key`. A child meets each parent in one
    join, which spreads a parent with very many children.
    """
    gone = {root: deleted.select(key).distinct()}
    kept = {}
    for name in parents_first(root, children):
        columns = tables[name].columns
        if name == root:
            kept[name] = tables[name].join(gone[root], key, "left_anti").select(*columns)
            continue
        marked, goes = tables[name], F.lit(False)
        for i, (parent, fk) in enumerate(children[name]):
            if parent in gone:
                doomed = gone[parent].select(F.col(key).alias(fk), F.lit(True).alias(f"_gone_{i}"))
                marked = salted_join(marked, doomed, [fk], "left")
                goes = goes | F.col(f"_gone_{i}").isNotNull()
        kept[name] = marked.where(~goes).select(*columns)
        gone[name] = marked.where(goes).select(key)
    return {**tables, **kept}


def parents_first(root: str, children: Mapping[str, Sequence[tuple[str, str]]]) -> list[str]:
    """The root and what hangs on it, each table after all of its parents that hang on the root."""
    below = [root]
    for name in below:
        below += [c for c, links in children.items() if c not in below and any(p == name for p, _ in links)]
    order = [root]
    while len(order) < len(below):
        ready = [
            c for c in below
            if c not in order and all(p in order for p, _ in children[c] if p in below)
        ]
        if not ready:
            raise ValueError(f"tables that refer to each other: {sorted(set(below) - set(order))}")
        order += ready
    return order


def touch(df: DataFrame, changed: Column, now: Column | None = None, column: str = "updated_at") -> DataFrame:
    """Sets the change time on the rows that changed."""
    moment = now if now is not None else F.current_timestamp()
    return df.withColumn(column, F.when(changed, moment).otherwise(F.col(column)))


__all__ = [
    "append_rows", "cascade_delete", "conform", "conform_losses", "latest_per_key",
    "persist_stage", "publish_view", "rows_not_in", "touch", "upsert", "write_mart",
]
