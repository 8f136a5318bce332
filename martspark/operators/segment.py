"""Customer segments: hierarchical clustering of a bounded summary, made and applied on Spark."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.operators.features import FEATURES, moments, staged_features, z_scores
from martspark.operators.scale import exact_quantiles
from martspark.schemas import CLUSTER_NAMES, UNKNOWN_CLUSTER
from martspark.session import stage

# Grid of the summary: cuts per feature at equal shares of the users, and at equal widths on the
# asinh scale between the extremes, so that one outlier cannot press the bulk into one cell.
# At most (2 * _CUTS + 1)^3 cells, whatever the number of users.
_CUTS = 7
_CORE = 0.5
_DIGITS = 9


def _grid(features: DataFrame, given: dict, columns: Sequence[str]) -> dict[str, list[float]]:
    """The cuts of each feature, ascending."""
    shares = [i / (_CUTS + 1) for i in range(_CUTS + 2)]
    cuts = {}
    for row in exact_quantiles(features, columns, shares).collect():  # one row per feature
        low, *inner, high = row["edges"]
        mean, std = given[f"mean_{row['metric']}"], given[f"std_{row['metric']}"] or 1.0
        ends = np.arcsinh((np.array([low, high]) - mean) / std / _CORE)
        wide = np.linspace(*ends, _CUTS + 2)[1:-1]
        even = mean + std * _CORE * np.sinh(wide)
        cuts[row["metric"]] = sorted({*map(float, inner), *map(float, even)})
    return cuts


def _cell(column: str, cuts: Sequence[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column)))


def ward_labels(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Cluster number 0..k-1 of each weighted point, merged by least growth of variance.

    Follows chains of nearest neighbours until two are each other's nearest, so each of the
    n - 1 merges costs a few vector operations over n points.
    """
    n = len(points)
    centre = points.astype(float).copy()
    weight = weights.astype(float).copy()
    alive = np.ones(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        tip = chain[-1]
        cost = ((centre - centre[tip]) ** 2).sum(axis=1) * (weight * weight[tip] / (weight + weight[tip]))
        cost[~alive] = np.inf
        cost[tip] = np.inf
        near = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            other = chain[-2]
            del chain[-2:]
            merges.append((float(cost[other]), tip, other))
            both = weight[tip] + weight[other]
            centre[tip] = (centre[tip] * weight[tip] + centre[other] * weight[other]) / both
            weight[tip] = both
            alive[other] = False
        else:
            chain.append(near)

    # Apply the cheapest n - k merges; the order among the tied ones is that of their making.
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        parent[root(b)] = root(a)
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def name_clusters(
    centroids: DataFrame, columns: Sequence[str] = FEATURES, names: Sequence[str] = CLUSTER_NAMES
) -> DataFrame:
    """Adds `cluster` to one row per cluster: best customers first.

    Best is high (frequency + monetary - recency) of the standardized centroid `z_*`.
    """
    frequency, monetary, recency = (F.col(f"z_{c}") for c in columns)
    # One row per cluster, so a single window partition is fine.
    best = Window.orderBy((frequency + monetary - recency).desc(), F.col("cluster_id"))
    ranked = centroids.withColumn("_rank", F.row_number().over(best))
    label = F.coalesce(
        F.get(F.array(*[F.lit(n) for n in names]), F.col("_rank") - 1),
        F.concat(F.lit("Cluster "), F.col("_rank").cast("string")),
    )
    return ranked.withColumn("cluster", label).drop("_rank")


def segment_customers(
    features: DataFrame,
    k: int = 3,
    columns: Sequence[str] = FEATURES,
    names: Sequence[str] = CLUSTER_NAMES,
    staged: bool = False,
) -> DataFrame:
    """(user_id, cluster) for every user whose features are all known.

    Users are counted into the cells of a fixed grid and the cells' weighted means are clustered,
    in the same way for any number of users. Only the cells reach the driver, and the users take
    their cell's cluster in a broadcast join of that size.

    The features are read several times and must not change in between, so they are staged, unless
    the caller says that they come from a staged table already.
    """
    spark = features.sparkSession
    known = features.select("user_id", *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    known = known if staged else stage(known, "segment-features")
    given = moments(known, columns)
    if given["n"] == 0:
        return known.select("user_id", F.lit(None).cast("string").alias("cluster"))

    z = z_scores(given, columns)
    grid = _grid(known, given, columns)
    cells = [f"cell_{c}" for c in columns]
    keyed = [_cell(c, grid[c]).alias(cell) for c, cell in zip(columns, cells)]
    points = (
        known.select(*keyed, *[z[c].alias(f"z_{c}") for c in columns])
        .groupBy(*cells)
        .agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"z_{c}"), _DIGITS).alias(f"z_{c}") for c in columns])
        .orderBy(*cells)
        .collect()
    )
    labels = ward_labels(
        np.array([[p[f"z_{c}"] for c in columns] for p in points]),
        np.array([p["n"] for p in points]),
        k,
    )
    schema = T.StructType(
        [T.StructField(cell, T.IntegerType()) for cell in cells]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(f"z_{c}", T.DoubleType()) for c in columns]
        + [T.StructField("cluster_id", T.IntegerType())]
    )
    summary = spark.createDataFrame(
        [(*p, int(label)) for p, label in zip((tuple(p) for p in points), labels)], schema
    )
    centroids = summary.groupBy("cluster_id").agg(
        *[(F.sum(F.col(f"z_{c}") * F.col("n")) / F.sum("n")).alias(f"z_{c}") for c in columns]
    )
    named = name_clusters(centroids, columns, names).select("cluster_id", "cluster")
    lookup = summary.join(named, "cluster_id").select(*cells, "cluster")
    return known.select("user_id", *keyed).join(F.broadcast(lookup), cells, "left").select("user_id", "cluster")


def assign_cluster(
    features: DataFrame, centroids: Sequence[tuple[str, Sequence[float]]], columns: Sequence[str] = FEATURES
) -> DataFrame:
    """Adds `cluster`, the nearest of a few fixed centroids in the given columns.

    A frozen model is a handful of numbers, so it travels inside the expression: no join. Ties
    go to the earlier centroid, unknown features give no cluster.
    """
    candidates = []
    for i, (name, place) in enumerate(centroids):
        distance = sum(
            ((F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(columns, place)),
            F.lit(0.0),
        )
        candidates.append(F.struct(distance.alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    nearest = F.array_min(F.array(*candidates))
    return features.withColumn("cluster", F.when(nearest["d"].isNotNull(), nearest["name"]))


def attach_cluster(users: DataFrame, clusters: DataFrame) -> DataFrame:
    """Users with their cluster, NULL for users without one."""
    return users.join(clusters.select("user_id", "cluster"), "user_id", "left")


def with_cluster(users: DataFrame) -> DataFrame:
    return users.where(F.col("cluster").isNotNull())


def cluster_or_unknown(users: DataFrame, features: DataFrame) -> DataFrame:
    """Users with `cluster`; all of them "Unknown" if nobody has any transaction."""
    nobody = features.agg((F.count(F.lit(1)) == 0).alias("nobody")).scalar()
    fallback = F.when(nobody, F.lit(UNKNOWN_CLUSTER))
    return users.withColumn("cluster", F.coalesce(fallback, F.col("cluster")))


def _segmented(features: DataFrame) -> DataFrame:
    return segment_customers(features, staged=True)


def clustered_users(
    users: DataFrame, trans: DataFrame, label: Callable[[DataFrame], DataFrame] = _segmented
) -> DataFrame:
    """Transactions to features to segments, joined to the users.

    `label` gives (user_id, cluster) of a frame of features, for instance by a frozen model.
    """
    features = staged_features(trans)
    return cluster_or_unknown(attach_cluster(users, label(features)), features)
