"""Vector search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from martspark.operators import vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, queries, k, with_self=False):
    known = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if v and None not in v and any(v)]
    known.sort(key=lambda x: x[0])
    ids = np.array([i for i, _ in known])
    x = np.array([v / np.linalg.norm(v) for _, v in known])
    out = []
    for q in queries:
        if q not in ids:
            continue
        similar = np.round(x @ x[list(ids).index(q)], vectors.DIGITS)
        order = [j for j in np.argsort(-similar, kind="stable") if with_self or ids[j] != q][:k]
        out += [(q, int(ids[j]), r) for r, j in enumerate(order, 1)]
    return sorted(out)


def found(df):
    return sorted((r["query"], r["id"], r["rank"]) for r in df.collect())


def clustered(n, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return [(i, (centres[i % 12] + 0.15 * rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("k,block,with_self", [(1, 1024, False), (7, 16, False), (7, 64, True), (40, 1024, False)])
def test_equal_to_all_products(spark, k, block, with_self):
    """A third of the vectors are equal, some have no direction, and queries among all of them."""
    rows = clustered(900)
    rows = [(i, rows[0][1]) if i % 3 == 0 else (i, v) for i, v in rows]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] + [0.0] * 7), (1004, [None] * 8), (-4, [-1.0] + [0.0] * 7)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "shell", "part", "rank", "query")})
    queries = [i for i, _ in rows if i % 10 == 0 or i >= 1000 or i < 0]
    got = vectors.topk_cosine(df.repartition(3), df.where(F.col("vec_id").isin(queries)), k, with_self=with_self, block=block)
    assert found(got) == brute(rows, queries, k, with_self)


def test_more_results_asked_than_rows(spark):
    rows = clustered(5)
    assert found(vectors.topk_cosine(frame(spark, rows), frame(spark, rows[:2]), 10)) == brute(rows, [0, 1], 10)


def test_nothing_to_find(spark):
    none, zero = frame(spark, []), frame(spark, [(1, [0.0, 0.0])])
    assert vectors.topk_cosine(none, none).count() == 0
    assert vectors.topk_cosine(zero, frame(spark, [(2, [1.0, 0.0])])).count() == 0
    assert vectors.topk_cosine(frame(spark, [(2, [1.0, 0.0])]), zero).count() == 0


def test_an_index_serves_several_searches_and_other_queries(spark):
    rows = clustered(400)
    index = vectors.build_index(frame(spark, rows), block=32)
    sizes = index.blocks.select(F.size("ids").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert sizes[1] == 400 and sizes[0] <= 64
    for picked in ([3, 5], list(range(0, 400, 7))):
        asked = frame(spark, [rows[i] for i in picked])
        assert found(vectors.topk_cosine(index, asked, 5)) == brute(rows, picked, 5)


def test_most_shells_are_ruled_out(spark, monkeypatch):
    """In clusters, the last round looks at few of the rows, and at none twice."""
    looks = []
    real = vectors._plan

    def plan(index, queries, done, budget):
        visits = real(index, queries, done, budget)
        looks.append((index, visits))
        return visits

    monkeypatch.setattr(vectors, "_plan", plan)
    monkeypatch.setattr(vectors, "_SEEN", (40, 200))
    rows = clustered(6000)
    asked = frame(spark, rows[:30])
    assert found(vectors.topk_cosine(frame(spark, rows), asked, 5)) == brute(rows, range(30), 5)
    seen = [(r["query"], r["shell"]) for _, v in looks for r in v.select("query", "shell").collect()]
    assert len(seen) == len(set(seen))
    size = dict(looks[0][0].rows[:, :2].tolist())
    assert sum(size[s] for _, s in seen) < 0.35 * 30 * 6000
