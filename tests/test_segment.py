import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from martspark.operators import segment
from martspark.operators.features import FEATURES
from martspark.schemas import CLUSTER_NAMES

SCHEMA = "user_id long, frequency long, monetary double, recency int"


def brute_ward(points, weights, k):
    """Merge the cheapest pair of all, again and again."""
    groups = [([i], np.array(p, float), float(w)) for i, (p, w) in enumerate(zip(points, weights))]
    while len(groups) > k:
        def cost(pair):
            (_, a, n), (_, b, m) = groups[pair[0]], groups[pair[1]]
            return n * m / (n + m) * ((a - b) ** 2).sum()

        i, j = min(itertools.combinations(range(len(groups)), 2), key=cost)
        (x, a, n), (y, b, m) = groups[i], groups[j]
        merged = (x + y, (a * n + b * m) / (n + m), n + m)
        groups = [g for t, g in enumerate(groups) if t not in (i, j)] + [merged]
    return {frozenset(g[0]) for g in groups}


def as_groups(labels):
    return {frozenset(np.flatnonzero(labels == c)) for c in np.unique(labels)}


@pytest.mark.parametrize("seed", range(8))
def test_ward_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(rng.integers(3, 50), 3)) * rng.uniform(0.2, 4, size=3)
    weights = rng.integers(1, 6, size=len(points))
    assert as_groups(segment.ward_labels(points, weights, 3)) == brute_ward(points, weights, 3)


def blobs(spark, n, seed=5):
    """Three well separated groups of users, shares 60 / 30 / 10 percent."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, size=n, p=[0.6, 0.3, 0.1])
    centre = np.array([[50, 2000, 20], [200, 9000, 2], [5, 100, 200]])[kind]
    noise = rng.normal(size=(n, 3)) * [6, 200, 1]
    f, m, r = (centre + noise).T
    rows = [(i, int(max(f[i], 0)), float(m[i]), int(abs(r[i]))) for i in range(n)]
    truth = {i: ("Loyal Users", "Top Users", "At-Risk Users")[kind[i]] for i in range(n)}
    return spark.createDataFrame(rows, SCHEMA), truth


@pytest.mark.parametrize("n", [1000, 2048, 2049, 10_000])
@pytest.mark.parametrize("outlier", [False, True])
def test_finds_separated_groups_at_any_size(spark, n, outlier):
    df, truth = blobs(spark, n)
    if outlier:
        far = spark.createDataFrame([(n, 260, 13_000.0, 2)], SCHEMA)
        df, truth = df.unionByName(far), truth | {n: "Top Users"}
    found = {r["user_id"]: r["cluster"] for r in segment.segment_customers(df).collect()}
    assert found == truth


def test_many_users_and_a_hot_row(spark):
    """Half of the users share one feature row; the summary stays small and nobody is lost."""
    rows, _ = blobs(spark, 3000)
    same = spark.range(3000, 6000).select(
        F.col("id").alias("user_id"), F.lit(50).cast("long").alias("frequency"),
        F.lit(2000.0).alias("monetary"), F.lit(20).alias("recency"),
    )
    out = segment.segment_customers(rows.unionByName(same))
    assert out.count() == 6000
    assert out.where(F.col("cluster").isNull()).count() == 0
    hot = out.where(F.col("user_id") >= 3000).select("cluster").distinct().collect()
    assert [r[0] for r in hot] == ["Loyal Users"]


def adjusted_rand(a, b):
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)

    def pairs(x):
        return (x * (x - 1) / 2).sum()

    joint, rows, cols, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), len(a)
    expected = rows * cols / (n * (n - 1) / 2)
    return (joint - expected) / ((rows + cols) / 2 - expected)


def test_summary_agrees_with_the_exact_result(spark):
    df, _ = blobs(spark, 2000, seed=9)
    rows = sorted(map(tuple, df.collect()))
    points = np.array([r[1:] for r in rows], float)
    exact = segment.ward_labels((points - points.mean(0)) / points.std(0), np.ones(len(points)), 3)
    summary = {r["user_id"]: r["cluster"] for r in segment.segment_customers(df).collect()}
    assert adjusted_rand(exact, np.array([summary[r[0]] for r in rows])) > 0.95


def test_same_result_for_any_row_order(spark):
    df, _ = blobs(spark, 400)
    first = segment.segment_customers(df).collect()
    second = segment.segment_customers(df.orderBy(F.rand(1)).repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, second))


def test_fewer_users_than_clusters(spark):
    df = spark.createDataFrame([(1, 9, 90.0, 0), (2, 1, 1.0, 60)], SCHEMA)
    found = dict(map(tuple, segment.segment_customers(df).collect()))
    assert found == {1: "Top Users", 2: "Loyal Users"}


def test_unknown_features_and_no_users(spark):
    df = spark.createDataFrame([(1, 9, 90.0, 0), (2, 1, None, 60)], SCHEMA)
    assert [r["user_id"] for r in segment.segment_customers(df).collect()] == [1]
    assert segment.segment_customers(spark.createDataFrame([], SCHEMA)).count() == 0


def test_users_without_transactions(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    trans = "trans_id long, user_id int, trans_timestamp timestamp_ntz, trans_amount double"
    none = spark.createDataFrame([], trans)
    assert {r["cluster"] for r in segment.clustered_users(users, none).collect()} == {"Unknown"}
    import datetime as dt

    some = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 5.0)], trans)
    assert dict(map(tuple, segment.clustered_users(users, some).collect())) == {1: "Top Users", 2: None}


def test_assign_cluster(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0, 0.0), (2, -1.0, -1.0, 1.0), (3, None, 0.0, 0.0)],
                               "user_id int, frequency double, monetary double, recency double")
    model = list(zip(CLUSTER_NAMES, [(1, 1, 0), (0, 0, 0), (-1, -1, 1)]))
    out = segment.assign_cluster(df, model, FEATURES)
    assert [r["cluster"] for r in out.orderBy("user_id").collect()] == ["Top Users", "At-Risk Users", None]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
