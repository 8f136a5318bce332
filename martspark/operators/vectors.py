"""Exact nearest vectors by cosine, through an index of cells and shells that rules out what cannot be near.

Products of blocks of vectors are numpy work in Arrow batches: as SQL expressions they would take a lambda call for each
number. The functions that run in tasks stand inside the operators, so that executors need nothing but numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.operators.scale import first_n_per_group
from martspark.session import stage

# The centroids are fitted on at most so many rows, those with the least hashes of their ids.
SAMPLE = 8192
# At most so many cells, each cut into shells by the angle to its centroid.
CELLS = 512
SHELLS = 8
# Vectors of a block; a block of rows meets a block of queries in one product.
BLOCK = 1024
# Rows that a query has seen after the first and the second round; the third one takes what is left.
_SEEN = (1024, 16_384)
# Similarities are compared to so many digits: equal vectors in different blocks may differ behind them.
DIGITS = 9
_ROUNDS = 8


@dataclass(frozen=True)
class VectorIndex:
    """Where every vector is: `blocks` (shell, part, ids, vectors), written once, and what a search needs to know of the shells.

    `centroids` has a row per cell. For each shell: its cell, the least and greatest angle of its vectors to the
    centroid, and its rows. All of it but the blocks is bounded by `CELLS` and `SHELLS`.
    """

    blocks: DataFrame
    centroids: np.ndarray
    cell: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    rows: np.ndarray
    kind: str


def _units(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): vectors of length 1 as doubles; a NULL, empty or zero vector or one with a NULL has no direction and is left out."""
    wide = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = wide.withColumn("norm", norm).where("norm > 0 AND NOT isnan(norm)")
    return found.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of a bounded sample; starts from evenly spaced rows, so it is the same every time."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(_ROUNDS):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def build_index(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cells: int = CELLS, shells: int = SHELLS,
    sample: int = SAMPLE, block: int = BLOCK,
) -> VectorIndex | None:
    """The index of a table of vectors; None if none of them has a direction.

    Every row is assigned to its nearest centroid and to a shell of equal width between the least and the greatest angle
    in the cell. A shell is dealt out to blocks by the hash of the id, so a cell that holds a third of all
    vectors, even equal ones, is many blocks of bounded size. The sample moves the cells only: results are exact.
    """
    units = stage(_units(vectors, id_col, vector), "unit-vectors")
    kind = units.schema["id"].dataType.simpleString()
    picked = units.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    if not picked:
        return None
    given = np.array([p["v"] for p in picked])
    number = max(1, min(cells, len(given) // 8, int(units.count() ** 0.5 / 2)))
    centroids = _fit(given, number)

    def assign(batches):
        for batch in batches:
            lists = batch.column("v")
            rows = lists.flatten().to_numpy().reshape(len(lists), -1)
            product = rows @ centroids.T
            cell = product.argmax(axis=1)
            angle = np.arccos(np.clip(product[np.arange(len(rows)), cell], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float64())], names=["id", "v", "cell", "angle"]
            )

    placed = stage(units.mapInArrow(assign, f"id {kind}, v array<double>, cell int, angle double"), "assigned-vectors")
    width = placed.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    inside = F.floor((F.col("angle") - F.col("low")) / (F.col("high") - F.col("low")) * shells).cast("int")
    shell = F.when(F.col("high") > F.col("low"), F.least(inside, F.lit(shells - 1))).otherwise(F.lit(0))
    shelled = placed.join(F.broadcast(width), "cell").select(
        "id", "v", "angle", (F.col("cell") * shells + shell).alias("shell")
    )
    known = shelled.groupBy("shell").agg(
        F.min("angle").alias("least"), F.max("angle").alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    # One row per shell, at most cells * shells.
    known = sorted(known.collect(), key=lambda r: r["shell"])
    parts = {r["shell"]: -(-r["n"] // block) for r in known}
    count = F.get(F.lit([parts.get(s, 1) for s in range(number * shells)]), F.col("shell"))
    part = F.pmod(F.xxhash64("id"), count).cast("int").alias("part")
    blocks = shelled.groupBy("shell", part).agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"))
    return VectorIndex(
        stage(blocks.select("shell", "part", "ids", F.flatten("vectors").alias("vectors")), "vector-blocks"),
        centroids,
        np.array([r["shell"] // shells for r in known]),
        np.array([r["least"] for r in known]),
        np.array([r["greatest"] for r in known]),
        np.array([[r["shell"], r["n"], parts[r["shell"]]] for r in known]),
        kind,
    )


def _plan(index: VectorIndex, queries: DataFrame, done: int, budget: int | None) -> DataFrame:
    """(query, qv, worst, shell, parts): the shells that each query looks at in a round.

    A vector x of a shell lies at an angle between `least` and `greatest` to the centroid c, so by the triangle inequality
    its angle to q is at least |angle(q, c) - angle(c, x)| for the nearest such angle. Shells are taken in the order of that
    bound until they hold `budget` rows, those of earlier rounds (`done` rows) left out; one whose bound is above
    the angle of the worst result so far cannot add any.
    """
    centroids, cell, least, greatest = index.centroids, index.cell, index.least, index.greatest
    number, rows, parts = index.rows.T
    # Rounding: angles from products near 1 are known to about 1e-8, results are compared to DIGITS digits.
    slack = 1e-6

    def run(batches):
        for batch in batches:
            lists = batch.column("qv")
            q = lists.flatten().to_numpy().reshape(len(lists), -1)
            angle = np.arccos(np.clip(q @ centroids.T, -1.0, 1.0))[:, cell]
            bound = np.maximum(np.maximum(angle - greatest, least - angle), 0.0)
            order = np.argsort(bound, axis=1, kind="stable")
            before = np.cumsum(rows[order], axis=1) - rows[order]
            fresh = before >= done
            if budget is not None:
                fresh &= before < budget
            worst = batch.column("worst").to_numpy(zero_copy_only=False)
            limit = np.where(np.isnan(worst), np.inf, np.arccos(np.clip(worst, -1.0, 1.0)) + slack)
            fresh &= np.take_along_axis(bound, order, axis=1) <= limit[:, None]
            at, place = np.nonzero(fresh)
            chosen = order[at, place]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(at)) for c in ("query", "qv", "worst")],
                    pa.array(number[chosen], pa.int32()),
                    pa.array(parts[chosen], pa.int32()),
                ],
                names=["query", "qv", "worst", "shell", "parts"],
            )

    return queries.select("query", "qv", "worst").mapInArrow(
        run, f"query {index.kind}, qv array<double>, worst double, shell int, parts int"
    )


def _look(index: VectorIndex, visits: DataFrame, k: int, block: int, with_self: bool) -> DataFrame:
    """(query, id, similarity): the k best rows of each block that a query looks at.

    Queries of a shell are dealt out to blocks as the rows are, and each block of queries goes to each block of rows of its
    shell: an equi join of blocks, in which every pair of blocks is one product of bounded size.
    """
    sizes = visits.groupBy("shell").agg(F.count(F.lit(1)).alias("visits"))
    dealt = visits.join(F.broadcast(sizes), "shell").withColumn(
        "bunch", F.pmod(F.xxhash64("query"), F.ceil(F.col("visits") / block)).cast("int")
    )
    bunches = dealt.groupBy("shell", "bunch").agg(
        F.first("parts").alias("parts"), F.collect_list("query").alias("queries"), F.collect_list("worst").alias("worsts"),
        F.flatten(F.collect_list("qv")).alias("qvs"),
    )
    spread = bunches.select("shell", "queries", "worsts", "qvs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = spread.join(index.blocks, ["shell", "part"]).select("queries", "worsts", "qvs", "ids", "vectors")
    kind, dims, digits = index.kind, index.centroids.shape[1], DIGITS
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries, worst, qvs, ids, vectors = (c[i].values for c in batch.columns)
                q = qvs.to_numpy().reshape(-1, dims)
                x = vectors.to_numpy().reshape(-1, dims)
                similarity = np.round(q @ x.T, digits)
                named, own = ids.to_numpy(zero_copy_only=False), queries.to_numpy(zero_copy_only=False)
                if not with_self:
                    similarity[own[:, None] == named[None, :]] = -np.inf
                floor = np.nan_to_num(worst.to_numpy(zero_copy_only=False), nan=-2.0)
                # By similarity, then by id; rows that are no better than the k results known so far stay behind.
                order = np.argsort(named, kind="stable")
                best = np.argsort(-similarity[:, order], axis=1, kind="stable")[:, :k]
                values = np.take_along_axis(similarity[:, order], best, axis=1)
                at, place = np.nonzero(values >= floor[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own[at], schema.field(0).type),
                        pa.array(named[order][best[at, place]], schema.field(1).type),
                        pa.array(values[at, place], pa.float64()),
                    ],
                    schema=schema,
                )

    return pairs.mapInArrow(run, "query bigint, id bigint, similarity double").select(
        F.col("query").cast(kind).alias("query"), F.col("id").cast(kind).alias("id"), "similarity"
    )


def topk_cosine(
    vectors: DataFrame | VectorIndex,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector: str = "embedding",
    with_self: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """(query, id, similarity, rank): the k vectors nearest to each query by cosine, exactly.

    Ids are integers and unique, all vectors have the same length. Ranks go by similarity (to nine digits), then by id. A
    query does not find itself unless `with_self`. Vectors without direction are neither queries nor results. Three
    rounds: the shells nearest to a query, those that hold the next few thousand rows, then all that the triangle
    inequality does not rule out given the k-th best result so far.
    """
    spark = queries.sparkSession
    index = vectors if isinstance(vectors, VectorIndex) else build_index(vectors, id_col, vector, block=block)
    units = _units(queries, id_col, vector)
    result = f"query {units.schema['id'].dataType.simpleString()}, id bigint, similarity double, rank int"
    if index is None:
        return spark.createDataFrame([], result)
    asked = stage(units.select(F.col("id").alias("query"), F.col("v").alias("qv")), "vector-queries")
    found, best = None, None
    done = 0
    for budget in (*[max(s, 2 * k) for s in _SEEN], None):
        if best is None:
            open_queries = asked.withColumn("worst", F.lit(float("nan")))
        else:
            worst = best.where(F.col("rank") == k).select("query", F.col("similarity").alias("worst"))
            open_queries = asked.join(worst, "query", "left").fillna(float("nan"), ["worst"])
        visits = stage(_plan(index, open_queries, done, budget), "vector-visits")
        seen = _look(index, visits, k, block, with_self)
        both = seen if found is None else seen.unionByName(found)
        order = [F.desc("similarity"), F.col("id")]
        ranked = first_n_per_group(both, ["query"], order, k).withColumnRenamed("_place", "rank")
        best = stage(ranked, "vector-results")
        found, done = best.drop("rank"), budget
    return best.where(F.col("similarity") > float("-inf")).select("query", "id", "similarity", "rank")
