"""Tables as lists of files: a change rewrites the files that hold its rows and swaps the list.

A store is a folder with the data files of some tables and, for each version, one small manifest (table, file) of all files
that make up the tables. A change finds the files that hold its keys by a semi join on the key column alone, writes
their rows anew into a folder of its own, and ends by writing the next manifest, a single file. Until then the version
before is in force, so a change that ends early has not happened, and a change of several tables is seen whole or not at
all. Files of older versions stay where they are, for readers that began before. Changes come one after the other.

The list of files is kept by the driver, as every reader of Parquet files does; rows never are.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators.scale import salted_join
from martspark.session import stage
from martspark.sources.tables import latest_per_key, parents_first, rows_not_in, upsert

_MANIFEST = "table string, file string"
# Keys up to which an append asks the files' key filters instead of reading the key column.
ASKED = 1000
_ROWS_PER_FILE = 1_000_000


class FileTables:
    """The tables of a store as of its latest version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        kind = T._parse_datatype_string(f"{_MANIFEST}, version long")
        # An empty manifest makes the store; later ones are folders beside it.
        spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifest/version=0")
        manifests = spark.read.schema(kind).parquet(f"{self.path}/manifest")
        self.version = manifests.agg(F.max("version")).first()[0] or 0
        self.files: dict[str, list[str]] = {}
        if self.version:
            one = spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={self.version}")
            for r in one.collect():
                self.files.setdefault(r["table"], []).append(r["file"])

    def read(self, table: str, files: Sequence[str] | None = None) -> DataFrame:
        """A table, or some of its files."""
        known = self.files[table] if files is None else files
        schema = self.spark.read.parquet(self.files[table][0]).schema
        return self.spark.read.schema(schema).parquet(*known) if known else self.spark.createDataFrame([], schema)

    def new_folder(self, table: str) -> str:
        return f"{self.path}/{table}/v{self.version + 1}-{uuid.uuid4().hex[:8]}"

    def commit(self, changes: Mapping[str, tuple[Sequence[str], str | None]]) -> FileTables:
        """The store after some tables lost the first and gained the files of the second of each pair."""
        files = dict(self.files)
        for table, (gone, folder) in changes.items():
            left = set(gone)
            files[table] = [f for f in files.get(table, []) if f not in left] + (self._listed(folder) if folder else [])
        rows = [(t, f) for t, names in sorted(files.items()) for f in names]
        out = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        # Fails if another change took the same number.
        out.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={self.version + 1}")
        return FileTables(self.spark, self.path)

    def _listed(self, folder: str) -> list[str]:
        return sorted(unquote(f) for f in self.spark.read.parquet(folder).inputFiles())


def _write(df: DataFrame, folder: str, key: str | None = None, rows_per_file: int | None = None) -> str:
    """Writes files, with a bloom filter on the key in each of their row groups and the rows in its order."""
    writer = (df if key is None else df.sortWithinPartitions(key)).write
    if key is not None:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        # A question has up to ASKED keys, so each must be mistaken far less often than once in ASKED.
        writer = writer.option(f"parquet.bloom.filter.fpp#{key}", "0.00001")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        writer = writer.option("parquet.bloom.filter.max.bytes", str(8 << 20))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(folder)
    return folder


def create_table(store: FileTables, table: str, df: DataFrame, key: str | None = None, rows_per_file: int | None = None) -> FileTables:
    """Makes a table of the rows, or replaces it."""
    folder = _write(df, store.new_folder(table), key, rows_per_file)
    return store.commit({table: (store.files.get(table, []), folder)})


def _files(marked: DataFrame) -> list[str]:
    return sorted(unquote(r["_file"]) for r in marked.select("_file").distinct().collect())


def files_with(df: DataFrame, keys: DataFrame, key: str) -> list[str]:
    """The files of a frame as read from them that hold one of some keys; only the key column is read."""
    marked = df.select(key, F.input_file_name().alias("_file"))
    return _files(marked.join(keys.select(key), key, "left_semi"))


def upsert_files(store: FileTables, table: str, updates: DataFrame, key: str, order: Sequence[str] | None = None) -> FileTables:
    """The store after `tables.upsert` on one of its tables.

    Only files that hold a changed key are read whole and rewritten, the new keys with them; a key without a row
    is in none of these, nor anywhere else. Other files keep their names.
    """
    changes = stage(latest_per_key(updates, key, order) if order else updates, "changes")
    base = store.read(table)
    hit = files_with(base, changes, key)
    rows = upsert(store.read(table, hit), changes, key).select(*base.columns)
    folder = _write(rows, store.new_folder(table), key)
    return store.commit({table: (hit, folder)})


def cascade_files(
    store: FileTables, root: str, deleted: DataFrame, key: str, children: Mapping[str, Sequence[tuple[str, str]]]
) -> FileTables:
    """The store after `tables.cascade_delete`: without the `deleted` keys of `root` and without their descendants.

    Per table one pass over its key columns marks the doomed rows with their files; these files alone are rewritten, and
    all tables change with one manifest. A table without doomed rows keeps all its files.
    """
    gone = {root: stage(deleted.select(key).distinct(), "gone")}
    changes = {}
    for name in parents_first(root, children):
        base = store.read(name).withColumn("_file", F.input_file_name())
        links = [(p, fk) for p, fk in children.get(name, ()) if p in gone] if name != root else [(root, key)]
        narrow = base.select("_file", *dict.fromkeys([key, *[fk for _, fk in links]]))
        doomed = None
        for parent, fk in links:
            parents = gone[parent].select(F.col(key).alias("_parent"), F.lit(True).alias("_gone"))
            met = salted_join(narrow.withColumn("_parent", F.col(fk)), parents, ["_parent"], "inner").select(key, "_file")
            doomed = met if doomed is None else doomed.unionByName(met)
        doomed = stage(doomed.distinct(), "doomed")
        hit = _files(doomed)
        gone[name] = doomed.select(key)
        if hit:
            rows = store.read(name, hit).join(gone[name], key, "left_anti")
            changes[name] = (hit, _write(rows.select(*store.read(name).columns), store.new_folder(name)))
    return store.commit(changes) if changes else store


def append_new(store: FileTables, table: str, rows: DataFrame, key: str) -> FileTables:
    """The store after an append of the rows whose key the table does not have yet.

    Up to `ASKED` keys are asked for by value: the key filters that `create_table` and this function write into the
    files then leave only the row groups that may hold one of them. More keys are met with the key column.
    A repeated call adds nothing twice.
    """
    spark = store.spark
    if table not in store.files:
        return create_table(store, table, rows.dropDuplicates([key]), key)
    fresh = stage(rows.dropDuplicates([key]).select(*store.read(table).columns), "appended")
    asked = [r[0] for r in fresh.where(F.col(key).isNotNull()).select(key).limit(ASKED + 1).collect()]
    known = store.read(table).select(key)
    setting = "spark.sql.parquet.pushdown.inFilterThreshold"
    before = spark.conf.get(setting)
    if len(asked) <= ASKED:
        known = known.where(F.col(key).isin(asked))
    # Above this number Spark would push down only the least and the greatest key.
    spark.conf.set(setting, str(ASKED))
    try:
        added = stage(rows_not_in(fresh, known, key), "added")
    finally:
        spark.conf.set(setting, before)
    if added.isEmpty():
        return store
    # Many small appends should not leave many files each.
    few = added.coalesce(-(-added.count() // _ROWS_PER_FILE))
    return store.commit({table: ([], _write(few, store.new_folder(table), key))})


__all__ = ["FileTables", "append_new", "cascade_files", "create_table", "files_with", "upsert_files"]
