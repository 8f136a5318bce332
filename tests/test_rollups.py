"""Totals kept up to date load by load."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from martspark.operators import features, marts
from martspark.session import stage_path
from martspark.sources import rollups

SCHEMA = "trans_id long, user_id int, trans_timestamp timestamp_ntz, trans_amount double, trans_service string"


def at(day, hour=0):
    return dt.datetime.fromisoformat(day) + dt.timedelta(hours=hour)


def rows_of(start, n, *days):
    return [
        (start + i, i % 4, None if d is None else at(d, i % 24), None if i % 5 == 0 else float(i % 7), str(i % 3))
        for i in range(n) for d in [days[i % len(days)]]
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(df):
    return sorted(map(tuple, df.collect()), key=str)


def same_as_all(spark, store, rows):
    facts = frame(spark, rows)
    for kind, full in (("users", features.user_totals(facts)), ("activity", marts.activity(facts))):
        got = rollups.read_rollup(spark, store, kind)
        assert got.columns == full.columns
        assert state(got) == state(full)


def journal(spark, store):
    return spark.read.parquet(f"{store}/journal").collect()


def test_late_repeated_and_replaced_loads(spark):
    store = stage_path(spark, "store")
    a = rows_of(0, 40, "2023-12-30", "2024-02-01", "2024-02-02")
    b = rows_of(100, 30, "2023-12-31", "2023-02-01", None)
    assert rollups.load_facts(frame(spark, a), store, "a") == ["2023-12-30", "2024-02-01", "2024-02-02"]
    same_as_all(spark, store, a)
    assert rollups.load_facts(frame(spark, b), store, "b") == ["2023-02-01", "2023-12-31", "none"]
    same_as_all(spark, store, a + b)
    rollups.load_facts(frame(spark, a), store, "a")
    same_as_all(spark, store, a + b)

    # The load comes again with other days: those it had before are made anew without it.
    c = rows_of(0, 10, "2025-05-05")
    assert len(rollups.load_facts(frame(spark, c), store, "a")) == 4
    same_as_all(spark, store, b + c)
    rollups.load_facts(frame(spark, []), store, "a")
    same_as_all(spark, store, b)


def test_a_row_of_two_loads_counts_once_as_the_later_one_says(spark):
    store = stage_path(spark, "store")
    rollups.load_facts(frame(spark, [(1, 1, at("2024-01-01"), 5.0, "a"), (2, 1, at("2024-01-01"), 1.0, "a")]), store, "a")
    rollups.load_facts(frame(spark, [(1, 1, at("2024-01-01"), 7.0, "a")] * 2), store, "b")
    same_as_all(spark, store, [(1, 1, at("2024-01-01"), 7.0, "a"), (2, 1, at("2024-01-01"), 1.0, "a")])


def test_a_load_reads_and_writes_only_its_own_periods(spark):
    store = stage_path(spark, "store")
    rollups.load_facts(frame(spark, rows_of(0, 90, "2022-01-01", "2023-03-01", "2023-03-02", "2023-04-01")), store, "a")
    before = {(r["kind"], r["level"], r["period"]): r["folder"] for r in journal(spark, store)}
    rollups.load_facts(frame(spark, rows_of(500, 8, "2023-03-02")), store, "b")
    new = [r for r in journal(spark, store) if r["version"] == 2]
    assert {(r["kind"], r["level"], r["period"]) for r in new} == {
        ("facts", "day", "2023-03-02"),
        *[(k, level, p) for k in rollups.ROLLUPS for level, p in (("day", "2023-03-02"), ("month", "2023-03"), ("year", "2023"))],
    }
    files = rollups.read_rollup(spark, store, "users").inputFiles()
    assert any(before[("users", "year", "2022")] in f for f in files)
    assert not any(before[("users", "year", "2023")] in f for f in files)


def test_a_load_that_ends_early_has_not_happened(spark, monkeypatch):
    store = stage_path(spark, "store")
    a, b = rows_of(0, 20, "2024-01-01", "2024-01-02"), rows_of(50, 20, "2024-01-02", "2024-01-03")
    rollups.load_facts(frame(spark, a), store, "a")
    real = rollups._by_period

    def fails(df, folder, column):
        if "/activity/month/" in folder:
            raise RuntimeError("lost")
        real(df, folder, column)

    monkeypatch.setattr(rollups, "_by_period", fails)
    with pytest.raises(RuntimeError):
        rollups.load_facts(frame(spark, b), store, "b")
    monkeypatch.undo()
    same_as_all(spark, store, a)
    rollups.load_facts(frame(spark, b), store, "b")
    same_as_all(spark, store, a + b)


def test_an_empty_store(spark):
    store = stage_path(spark, "store")
    with pytest.raises(ValueError):
        rollups.read_rollup(spark, store, "users")
    assert rollups.load_facts(frame(spark, []), store, "a") == []
    with pytest.raises(ValueError):
        rollups.read_rollup(spark, store, "users")


def test_a_crowded_day_is_written_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = stage_path(spark, "store")
        day = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        many = spark.range(60_000).select(
            F.col("id").alias("trans_id"), F.col("id").cast("int").alias("user_id"), day.alias("trans_timestamp"),
            F.rand(1).alias("trans_amount"), F.sha2(F.col("id").cast("string"), 256).alias("trans_service"),
        )
        rollups.load_facts(many, store, "a")
        facts = next(r["folder"] for r in journal(spark, store) if r["kind"] == "facts")
        assert len(spark.read.parquet(facts).inputFiles()) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
