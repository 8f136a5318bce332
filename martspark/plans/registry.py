"""The register of queries: name to Spark query, and name to the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.operators import features, marts, segment
from martspark.plans import samples as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function name; `uses` names the shared subqueries of the SQL."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = s.with_tables(uses, sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Float sums depend on the order of the rows, so results are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.staged_features(s.order_trans(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the cluster of a fixed model, so that SQL can say the same."""
    scored = features.standardize(features.staged_features(s.fact_trans(spark, sf_dir)))
    model = segment.assign_cluster(scored, s.FROZEN_MODEL, [f"z_{c}" for c in features.FEATURES])
    return segment.attach_cluster(s.dim_users(spark, sf_dir), model)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.service_count(s.fact_trans(spark, sf_dir), s.mcc_lookup(spark, sf_dir))
