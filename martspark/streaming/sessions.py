"""Session statistics kept up to date from a stream of message changes.

The state is a Parquet log of changed sessions, one folder per micro-batch. A repeated batch
overwrites its own folder, so a restart after a lost executor or driver counts nothing twice;
reading takes the newest entry of each session.

`compact` keeps the log short: it writes the state as a snapshot and notes in a manifest beside the log which batches
that covers. Readers follow the manifest, so covered folders can go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martspark.sources.tables import latest_per_key


def stream_session_stats(
    changes: DataFrame, delay: str = "1 hour", event_time: str = "created_at", arrival: str | None = None
) -> DataFrame:
    """Running (chat_session_id, message_count, last_message_at) of a stream of changes.

    `changes` has uuid, chat_session_id, created_at and op, "insert" or "delete". A change that
    is delivered again within `delay` of its arrival counts once. The watermark is on the arrival,
    the column `arrival` set at ingestion or else the time of the micro-batch, so no change is too
    old to count, however long ago its message was written. Use update mode.
    """
    arrived = F.current_timestamp() if arrival is None else F.col(arrival).cast("timestamp")
    timed = changes.withColumns({event_time: F.col(event_time).cast("timestamp"), "_arrived": arrived})
    once = timed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["uuid", "op"])
    inserted = F.col("op") == "insert"
    return once.groupBy("chat_session_id").agg(
        F.sum(F.when(inserted, 1).otherwise(-1)).alias("message_count"),
        F.max(F.when(inserted, F.col(event_time))).alias("last_message_at"),
    )


def stream_touch(changes: DataFrame, key: str, event_time: str, name: str = "updated_at") -> DataFrame:
    """Running (key, updated_at): the time of the latest change of each row. Use update mode."""
    return changes.groupBy(key).agg(F.max(F.col(event_time).cast("timestamp")).alias(name))


def write_updates(
    updates: DataFrame, folder: str, checkpoint: str, name: str | None = None, key: str | None = None,
    compact_every: int | None = None, **trigger,
) -> StreamingQuery:
    """Starts a query that logs the changed rows of each micro-batch under `folder`.

    With `compact_every` the log is compacted after every so many batches, by `key`.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, folder, key)

    if compact_every and key is None:
        raise ValueError("compaction needs the key of the rows")
    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.foreachBatch(save).trigger(**(trigger or {"availableNow": True})).start()


def current_state(spark: SparkSession, folder: str, key: str, snapshot: str | None = None) -> DataFrame:
    """The newest logged row of each key; with a snapshot, given or named by the manifest, only later batches are read."""
    if snapshot is None:
        covered, snapshot = _manifest(spark, folder)[-1]
        return _newest(spark, folder, key, snapshot, covered).drop("batch")
    return _newest(spark, folder, key, snapshot).drop("batch")


def write_snapshot(spark: SparkSession, folder: str, key: str, target: str, snapshot: str | None = None) -> None:
    """Writes the state as of the batches logged so far, from an older snapshot if there is one.

    Batch folders up to the snapshot's last batch are no longer read with it.
    """
    _newest(spark, folder, key, snapshot).write.parquet(target)


_MANIFEST = "covered long, snapshot string"


def _manifest(spark: SparkSession, folder: str) -> list[tuple[int, str | None]]:
    """(last covered batch, snapshot) of the compactions so far, ascending; the first entry covers nothing."""
    path = _path(spark, f"{folder}.manifest")
    rows = []
    if path[1].exists(path[0]):
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}.manifest").collect()
    return [(-1, None), *sorted((r["covered"], r["snapshot"]) for r in rows)]


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system: Spark itself neither lists nor removes folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, folder: str) -> list[int]:
    place, system = _path(spark, folder)
    names = [f.getPath().getName() for f in system.listStatus(place)]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def compact(spark: SparkSession, folder: str, key: str) -> int:
    """Covers the batches of a log by a snapshot and removes what no reader needs; returns the last covered batch.

    The newest batch is left out, as a restart may run it again. The manifest entry, one file, is written when the
    snapshot is complete: a compaction that ends before it has not happened, one that ends after it leaves folders that
    the next one removes. Folders and snapshots stay for one more compaction, so a reader that began before this one
    still finds what its manifest names. One compaction runs at a time.
    """
    done = _manifest(spark, folder)
    covered, snapshot = done[-1]
    open_batches = [b for b in _batches(spark, folder) if b > covered]
    if len(open_batches) > 1:
        upto = open_batches[-2]
        target = f"{folder}.snapshots/upto={upto}-{uuid.uuid4().hex[:8]}"
        _newest(spark, folder, key, snapshot, covered, upto).write.parquet(target)
        entry = spark.createDataFrame([(upto, target)], _MANIFEST).coalesce(1)
        entry.write.mode("append").parquet(f"{folder}.manifest")
        done.append((upto, target))
    if len(done) > 1:
        before = done[-2][0]
        old = [f"{folder}/batch={b}" for b in _batches(spark, folder) if b <= before]
        for gone in old + [target for _, target in done[:-2] if target]:
            place, system = _path(spark, gone)
            system.delete(place, True)
    return done[-1][0]


def _newest(
    spark: SparkSession, folder: str, key: str, snapshot: str | None, covered: int | None = None, upto: int | None = None
) -> DataFrame:
    log = spark.read.parquet(folder)
    if upto is not None:
        log = log.where(F.col("batch") <= upto)
    if snapshot is not None:
        base = spark.read.parquet(snapshot)
        if covered is None:
            covered = base.agg(F.max("batch")).first()[0]
        # A literal, so that the folders of the older batches are not even listed for reading.
        log = base.unionByName(log.where(F.col("batch") > covered))
    return latest_per_key(log, key, ["batch"])
