"""The building blocks for skewed data, checked against plain joins, sorts and numpy."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from martspark.operators import scale
from martspark.operators.scale import deal, exact_quantiles, last_n_per_group, positions, salted_join


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows on key 7, some on no key, some on a key without a partner."""
    key = (
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") % 500)
    )
    return spark.range(20_000).select("id", key.alias("k"), (F.col("id") % 13).alias("v"))


@pytest.fixture(scope="module")
def dims(spark):
    return spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 10).alias("d"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(facts, dims, how):
    def content(df):
        return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)

    salted = salted_join(facts, dims, ["k"], how, rows_per_task=1000)
    assert content(salted) == content(facts.join(dims, "k", how))


def test_salted_join_spreads_the_hot_key_and_no_key(spark, facts, dims):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[0] for r in salted_join(facts, dims, ["k"], "left", rows_per_task=200)
                 .groupBy(F.spark_partition_id()).count().select("count").collect()]
        plain = [r[0] for r in facts.join(dims, "k", "left")
                 .groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == sum(plain) == 20_000
    assert max(plain) > 6_000 and max(sizes) < 5_000


def test_salted_join_moves_its_rows_once_and_by_salt(spark, facts, dims):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(salted_join(facts, dims, ["k"], "left"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    # By the key alone all rows of a large key, or without one, would meet in one task.
    assert len(joins) == 1 and "_salt" in joins[0]


def test_salted_join_by_a_row_key_reads_no_other_columns(spark, tmp_path, dims):
    path = str(tmp_path / "facts")
    spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("long text").alias("text")).write.parquet(path)
    joined = salted_join(spark.read.parquet(path), dims, ["k"], "left", rows_per_task=100, salt_by=["id"])
    assert "text" not in plan_of(joined.select("id", "d"))
    assert joined.where("text = 'long text' AND d = k * 10").count() == 1000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_dealt_rows_join_as_before_without_a_shuffle(spark, facts, dims, how):
    dealt = deal(facts, ["k"], rows_per_task=1000, rows_per_file=500)
    assert len(dealt.rows.inputFiles()) >= 20 and dealt.large.collect() == [(7, 7)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("dealt")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_join(dealt, dims, ["k"], how)
        left = plan_of(joined).split("SortMergeJoin")[1].split("SortMergeJoin")[0]
        left = left[: left.index("FileScan")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "Exchange" not in left
    assert sorted(map(str, joined.collect())) == sorted(map(str, facts.join(dims, "k", how).select(joined.columns).collect()))
    with pytest.raises(ValueError, match="joined on"):
        salted_join(dealt, dims, ["d"], how)


@pytest.mark.parametrize("range_rows", [100, 0, 1_000_000])
def test_positions_of_hot_small_and_unknown_groups(facts, range_rows):
    out = positions(facts, ["k"], [F.col("id")], "id", total="n", range_rows=range_rows).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r["id"]):
        expected = seen.get(r["k"], 0)
        assert r["position"] == expected
        seen[r["k"]] = expected + 1
    assert all(r["n"] == seen[r["k"]] for r in out) and len(out) == 20_000


def test_positions_without_key_move_the_rows_once(spark, facts):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(positions(facts, [], [F.col("id")], "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_positions_without_key(facts):
    out = positions(facts, [], [F.col("id")], "id").select("id", "position").collect()
    assert all(r["id"] == r["position"] for r in out) and len(out) == 20_000


def test_positions_of_equal_unknown_and_no_rows(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (None, "z"), (9, "c")], "n int, t string")
    out = positions(df, [], [F.col("n"), F.col("t")], "n").orderBy("position")
    assert [r["t"] for r in out.collect()] == ["z", "a", "b", "c"]
    assert positions(df.limit(0), [], [F.col("n")], "n").count() == 0
    assert positions(df.limit(0), ["t"], [F.col("n")], "n", total="total").count() == 0


def test_positions_spread_the_hot_group(spark, facts):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = positions(facts, ["k"], [F.col("id")], "id", range_rows=500)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        plan = plan_of(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 5_000 and sum(sizes) == 20_000
    assert plan.count("_part") and "NestedLoop" not in plan


def test_last_n_keeps_all_of_small_groups(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "k int, t int")
    assert sorted(map(tuple, last_n_per_group(df, "k", ["t"], 2).collect())) == [(1, 2), (1, 3), (2, 9)]


def test_last_n_limits_before_the_shuffle(facts):
    plan = plan_of(last_n_per_group(facts, "k", ["id"], 5))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_last_n_with_a_large_n_ranks_slices_first(facts):
    n = 1500
    got = last_n_per_group(facts, "k", ["id"], n)
    by_key = {}
    for r in facts.collect():
        by_key.setdefault(r["k"], []).append(r["id"])
    expected = {(k, i) for k, ids in by_key.items() for i in sorted(ids)[-n:]}
    assert {(r["k"], r["id"]) for r in got.collect()} == expected
    assert "_slice" in plan_of(got)


def quantiles(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return exact_quantiles(df, ["x"], probs).first()["edges"]


PROBS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_quantiles_equal_numpy(spark, values):
    np.testing.assert_allclose(quantiles(spark, values, PROBS), np.quantile(values, PROBS), rtol=1e-12, atol=1e-9)


def test_quantiles_of_many_skewed_rows(spark):
    n = 300_000
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pow(F.rand(3), 6) * 1000)
    df = spark.range(n).select(value.alias("x"), F.col("id").cast("double").alias("y")).persist()
    got = {r["metric"]: r["edges"] for r in exact_quantiles(df, ["x", "y"], PROBS).collect()}
    xs = np.array([r[0] for r in df.select("x").collect()])
    np.testing.assert_allclose(got["x"], np.quantile(xs, PROBS), rtol=1e-12)
    np.testing.assert_allclose(got["y"], np.quantile(np.arange(n), PROBS), rtol=1e-12)
    df.unpersist()


def test_quantiles_leave_out_nulls(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]).first()["edges"] == [2.0]


COLUMNS = {
    "all_equal": "7.5D",
    "all_distinct": "id * 1.5D - 1000",
    "two_valued": "double(id % 3 = 0)",
    "one_outlier": "if(id = 5, 1e300, id % 10)",
    "heavy_top": "least(double(id), 300D)",
    "partly_null": "CASE WHEN id % 4 = 0 THEN double(id) WHEN id % 4 = 1 THEN double('NaN') END",
    "no_values": "double(NULL)",
}


def test_selection_narrows_until_few_values_are_left(spark, monkeypatch):
    """Several rounds on columns of all kinds; what reaches the driver is bounded, and no plan has a window or a sort."""
    n = 30_000
    df = spark.range(n).selectExpr(*[f"{c} AS {name}" for name, c in COLUMNS.items()]).repartition(4).persist()
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    read, plans = [], []
    real = type(df).collect

    def collect(self):
        rows = real(self)
        read.append(len(rows))
        plans.append(plan_of(self))
        return rows

    monkeypatch.setattr(scale, "_CUTS", 20)
    monkeypatch.setattr(type(df), "collect", collect)
    stats = scale.order_statistics(df, list(COLUMNS), lambda m: [int(p * (m - 1)) for p in probs] if m else [], few=50)
    monkeypatch.undo()
    assert len(read) >= 6 and max(read) <= 50 * 7 * len(probs)
    assert not any("Window" in p or "SortExec" in p or "SortMergeJoin" in p for p in plans)
    whole = {name: [] for name in COLUMNS}
    for r in df.collect():
        for name in COLUMNS:
            if r[name] is not None and r[name] == r[name]:
                whole[name].append(r[name])
    for name, values in whole.items():
        values.sort()
        m = len(values)
        assert stats[name] == (m, {int(p * (m - 1)): values[int(p * (m - 1))] for p in probs} if m else {})
    df.unpersist()


def test_columns_without_values_have_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert [tuple(r) for r in exact_quantiles(df, ["x", "y"], [0.0, 0.5]).collect()] == [("y", [1.0, 1.0])]
    assert exact_quantiles(df.limit(0), ["x", "y"], [0.5]).count() == 0


@pytest.mark.parametrize("ids", [
    [*range(20_000), 10**15],
    [-(2**63), *range(-5000, 5000), 2**63 - 1],
])
def test_positions_with_ids_far_apart(spark, ids):
    """The ranges follow the rows, not the width between the ids, so an outlier does not empty them."""
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    out = positions(df, [], [F.col("id")], "id").withColumn("task", F.spark_partition_id()).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["position"])] == sorted(ids)
    assert [r["position"] for r in sorted(out, key=lambda r: r["id"])] == list(range(len(ids)))
