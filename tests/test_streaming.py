import datetime as dt

import pytest
from pyspark.sql import functions as F

from martspark.operators.chat import session_stats
from martspark.session import stage_path
from martspark.streaming import sessions as live

CHANGES = "uuid string, chat_session_id long, created_at timestamp, op string"
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def run(spark, source, folder, checkpoint):
    changes = spark.readStream.schema(CHANGES).parquet(source)
    query = live.write_updates(live.stream_session_stats(changes), folder, checkpoint)
    query.awaitTermination()
    state = live.current_state(spark, folder, "chat_session_id")
    return {r["chat_session_id"]: (r["message_count"], r["last_message_at"]) for r in state.collect()}


def test_counts_over_restarts_equal_the_batch_result(spark):
    source, folder, checkpoint = (stage_path(spark, n) for n in ("changes", "state", "checkpoint"))
    first = [("a", 1, at(0), "insert"), ("b", 1, at(1), "insert"), ("c", 2, at(1), "insert"), ("a", 1, at(0), "insert")]
    spark.createDataFrame(first, CHANGES).write.parquet(source)
    assert run(spark, source, folder, checkpoint) == {1: (2, at(1)), 2: (1, at(1))}

    second = [("d", 1, at(2), "insert"), ("b", 1, at(1), "insert"), ("c", 2, at(3), "delete")]
    spark.createDataFrame(second, CHANGES).write.mode("append").parquet(source)
    assert run(spark, source, folder, checkpoint) == {1: (3, at(2)), 2: (0, at(1))}

    inserts = spark.read.parquet(source).where("op = 'insert' AND chat_session_id = 1").dropDuplicates(["uuid"])
    assert session_stats(inserts).first()["message_count"] == 3


def test_a_repeated_batch_changes_nothing(spark):
    folder = stage_path(spark, "state")
    row = spark.createDataFrame([(1, 2)], "chat_session_id long, message_count long")
    for _ in range(2):
        row.write.mode("overwrite").parquet(f"{folder}/batch=0")
    row.withColumn("message_count", F.lit(5).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch=10")
    row.withColumn("message_count", F.lit(3).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch=2")
    state = live.current_state(spark, folder, "chat_session_id")
    assert [tuple(r) for r in state.collect()] == [(1, 5)]


def test_a_snapshot_stands_for_the_older_batches(spark):
    folder, first, second = (stage_path(spark, n) for n in ("state", "snapshot", "snapshot"))

    def log(batch, *rows):
        spark.createDataFrame(list(rows), "k long, n long").write.parquet(f"{folder}/batch={batch}")

    def state(snapshot=None):
        return sorted(map(tuple, live.current_state(spark, folder, "k", snapshot).collect()))

    log(0, (1, 1), (2, 1))
    log(1, (1, 2))
    live.write_snapshot(spark, folder, "k", first)
    log(2, (1, 3), (3, 1))
    assert state() == state(first) == [(1, 3), (2, 1), (3, 1)]
    live.write_snapshot(spark, folder, "k", second, first)
    log(3, (2, 9))
    assert state() == state(second) == [(1, 3), (2, 9), (3, 1)]
    plan = live.current_state(spark, folder, "k", second)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_changes_weeks_late_count(spark):
    """Three batches: a delete of an old message, then an insert older than everything seen."""
    source, folder, checkpoint = (stage_path(spark, n) for n in ("changes", "state", "checkpoint"))
    old, new = at(0), at(60 * 24 * 30)
    batches = [
        [("a", 1, old, "insert"), ("b", 2, new, "insert")],
        [("c", 1, new, "insert"), ("a", 1, old, "delete")],
        [("d", 2, at(5), "insert"), ("d", 2, at(5), "insert"), ("c", 1, new, "insert")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(source)
        state = run(spark, source, folder, checkpoint)
    assert state == {1: (1, new), 2: (2, new)}


def log_of(spark, batches):
    folder = stage_path(spark, "log")
    for b, rows in batches.items():
        spark.createDataFrame(rows, "k long, n long").write.parquet(f"{folder}/batch={b}")
    return folder


def now(spark, folder):
    return sorted(map(tuple, live.current_state(spark, folder, "k").collect()))


def test_compaction_changes_no_state_and_bounds_the_folders(spark):
    folder = stage_path(spark, "log")
    want = {}
    for b in range(14):
        rows = [(b % 3, b), (100 + b, b)]
        want.update(rows)
        spark.createDataFrame(rows, "k long, n long").write.parquet(f"{folder}/batch={b}")
        if b % 4 == 3:
            before = live.current_state(spark, folder, "k")
            assert live.compact(spark, folder, "k") == b - 1
            # A reader that began before still finds its files.
            assert sorted(map(tuple, before.collect())) == sorted(want.items())
        assert now(spark, folder) == sorted(want.items())
    # Those since the last compaction, its own newest, and those that only the last one covered.
    assert live._batches(spark, folder) == list(range(7, 14))
    assert live.compact(spark, folder, "k") == 12
    assert live._batches(spark, folder) == [11, 12, 13] and now(spark, folder) == sorted(want.items())
    place, system = live._path(spark, f"{folder}.snapshots")
    assert len(system.listStatus(place)) == 2
    # Nothing new to cover; what is left of the former goes.
    assert live.compact(spark, folder, "k") == 12 and now(spark, folder) == sorted(want.items())


def test_a_compaction_that_ends_early(spark, monkeypatch):
    folder = log_of(spark, {b: [(1, b), (b, b)] for b in range(2, 7)})
    state = now(spark, folder)
    real = live._newest

    class Lost(RuntimeError):
        pass

    def fails(*args):
        real(*args).write.parquet(stage_path(spark, "lost"))
        raise Lost

    monkeypatch.setattr(live, "_newest", fails)
    with pytest.raises(Lost):
        live.compact(spark, folder, "k")
    monkeypatch.undo()
    assert now(spark, folder) == state and live._batches(spark, folder) == [2, 3, 4, 5, 6]
    # Ends between manifest and removal.
    monkeypatch.setattr(live, "_batches", lambda *_: [2, 3, 4, 5, 6])
    live.compact(spark, folder, "k")
    monkeypatch.undo()
    assert now(spark, folder) == state
    spark.createDataFrame([(1, 70)], "k long, n long").write.parquet(f"{folder}/batch=7")
    live.compact(spark, folder, "k")
    assert live._batches(spark, folder) == [6, 7] and now(spark, folder) == sorted([*[r for r in state if r[0] != 1], (1, 70)])


def test_the_newest_batch_may_run_again_after_a_compaction(spark):
    folder = log_of(spark, {0: [(1, 0)], 1: [(2, 1)], 2: [(1, 2)]})
    assert live.compact(spark, folder, "k") == 1
    spark.createDataFrame([(1, 2)], "k long, n long").write.mode("overwrite").parquet(f"{folder}/batch=2")
    assert now(spark, folder) == [(1, 2), (2, 1)]


def test_compaction_while_a_stream_stops_and_starts(spark):
    """Batches of one file each, compacted after every second, over two runs: the same as the batch result."""
    source, folder, checkpoint = (stage_path(spark, n) for n in ("changes", "state", "checkpoint"))

    def arrive(first, last):
        rows = [(f"u{i}", i % 4, at(i), "insert") for i in range(first, last)]
        spark.createDataFrame(rows, CHANGES).repartition(5).write.mode("append").parquet(source)

    def follow():
        changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        live.write_updates(
            live.stream_session_stats(changes), folder, checkpoint, key="chat_session_id", compact_every=2
        ).awaitTermination()
        state = live.current_state(spark, folder, "chat_session_id").collect()
        return {r["chat_session_id"]: r["message_count"] for r in state}

    arrive(0, 40)
    assert follow() == {k: 10 for k in range(4)}
    arrive(40, 100)
    assert follow() == {k: 25 for k in range(4)}
    assert len(live._batches(spark, folder)) <= 5


def test_compaction_needs_a_key(spark):
    with pytest.raises(ValueError):
        live.write_updates(spark.readStream.format("rate").load(), "a", "b", compact_every=3)
