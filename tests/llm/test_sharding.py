"""Shards: the laws they follow, on tables with odd, hot and repeated rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from martspark.llm import sharding
from martspark.llm.queries import op12_sharding

CLASH = ("shard_", "slot", "size", "h", "d", "r", "file", "row", "part", "kept_0", "i", "below")


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in CLASH}) if clash else df


def rows_of(n, seed=1):
    """A third of the rows are copies of one text, some have one id, one text is very long."""
    rng = random.Random(seed)
    rows = [(i, "hot copy" * 3 if i % 3 == 0 else "é" * rng.randrange(60) + str(rng.randrange(n))) for i in range(n)]
    rows += [(-1, "one id and text")] * (n // 10) + [(None, None), (None, ""), (-2, None), (-3, "中" * 9000)]
    return rows


def checked(rows, got, shards):
    sizes = Counter()
    slots = defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < shards
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
    assert all(s == set(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == len(rows)
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    return [sizes[s] for s in range(shards)]


@pytest.mark.parametrize("sample,range_rows", [(sharding.SAMPLE, sharding.RANGE_ROWS), (200, 20)])
def test_shards_have_equal_bytes(spark, sample, range_rows):
    rows = rows_of(9000)
    got = sharding.assign_shards(frame(spark, rows).repartition(5), 7, sample=sample, range_rows=range_rows).collect()
    sizes = checked(rows, got, 7)
    mean = sum(sizes) / 7
    assert max(sizes) <= 1.02 * mean and min(sizes) >= 0.98 * mean
    # Only groups that are too large for a shard, or a large part of one, are split.
    places, total = defaultdict(set), Counter()
    for r in got:
        places[r["text_crc32"]].add(r["shard"])
        total[r["text_crc32"]] += r["size"]
    assert all(len(places[c]) == 1 for c in places if total[c] < 0.2 * mean)
    assert any(len(p) > 1 for p in places.values())


def test_ranges_are_found_by_halving(spark):
    keys = sorted({(random.Random(i).randrange(-50, 50), i % 3, 0) for i in range(40)})
    df = spark.createDataFrame([(h, d, 0) for h in range(-52, 52) for d in range(3)], "h long, d long, r long")
    for part in (keys, keys[:1], keys[:2], []):
        for r in df.withColumn("part", sharding.range_of(part)).collect():
            assert r["part"] == sum(k <= (r["h"], r["d"], 0) for k in part)


def test_rooms_fill_to_one_level():
    assert sharding._room(10, [0, 0]) == [5, 5]
    assert sharding._room(10, [4, 0, 30]) == [3, 7, 0]
    assert sharding._room(0, [4, 1]) == [0, 0]


def test_one_record_larger_than_all_others(spark):
    rows = [(1, "x" * 100_000)] + [(i, "y" * (i % 7)) for i in range(2, 500)]
    sizes = checked(rows, sharding.assign_shards(frame(spark, rows), 4).collect(), 4)
    assert max(sizes) == 100_016
    rest = sorted(sizes)[:3]
    assert rest[2] - rest[0] < 200


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_shards(spark, n):
    rows = [(i, "ab") for i in range(n)]
    got = sharding.assign_shards(frame(spark, rows), 40).collect()
    checked(rows, got, 40)
    assert len({r["shard"] for r in got}) <= n


def test_all_rows_are_the_same(spark):
    rows = [(5, "same text")] * 5000
    sizes = checked(rows, sharding.assign_shards(frame(spark, rows), 8, sample=100, range_rows=50).collect(), 8)
    assert max(sizes) - min(sizes) <= 2 * 25


def test_the_same_table_gives_the_same_shards(spark):
    docs = frame(spark, rows_of(2000)).repartition(4, "doc_id")
    a, b = (sorted(map(str, sharding.assign_shards(docs, 5).select("doc_id", "text_crc32", "shard").collect())) for _ in range(2))
    assert a == b


def test_written_shards_hold_all_columns(spark, tmp_path):
    rows = rows_of(300)
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").columns == docs.columns and back.drop("shard").exceptAll(docs).isEmpty()
    assert back.count() == len(rows) and back.select("shard").distinct().count() == 3
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("SHARD", F.lit(1)), str(tmp_path / "two"))


def test_query_on_the_given_documents(spark, sf_dir):
    df = op12_sharding(spark, sf_dir)
    assert dict(df.dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint",
        "grown_shard": "int",
    }
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in ("Python", "Pandas", "Arrow", "ExistingRDD") if node in plan]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = df.collect()
    sizes = checked(rows, got, 40)
    largest = max(r["size"] for r in got)
    assert max(sizes) <= max(largest, 1.01 * sum(sizes) / 40 + 100) and {r["law"] for r in got} == {"bytes"}
