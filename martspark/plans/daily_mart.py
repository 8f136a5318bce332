"""The daily job: features, segments, the six mart tables and their checks in one session."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.functions.scalars import month_start
from martspark.operators import marts, quality
from martspark.operators.features import rfm_scores, staged_rfm, user_totals
from martspark.operators.segment import _segmented, attach_cluster, cluster_or_unknown
from martspark.schemas import CLUSTER_NAMES, MART
from martspark.session import stage
from martspark.sources.rollups import read_rollup
from martspark.sources.tables import write_mart

USER_COLUMNS = ("user_id", "age", "gender", "city", "state", "latitude", "longitude")


def mart_tables(users: DataFrame, trans: DataFrame, lookup: DataFrame, as_of=None, label=_segmented) -> dict[str, DataFrame]:
    """The six mart tables and rfm_scores, ready to be written.

    The transactions are scanned twice: for the per-user totals and for the activity counts.
    Both, and the clustered users, are staged, as several tables read them.
    """
    totals = stage(user_totals(trans), "user-totals")
    counts = stage(marts.activity(trans), "activity")
    return tables_of_totals(users, totals, counts, lookup, as_of, label)


def tables_of_totals(
    users: DataFrame, totals: DataFrame, counts: DataFrame, lookup: DataFrame, as_of=None, label=_segmented
) -> dict[str, DataFrame]:
    """The same from staged totals per user and staged activity counts."""
    features = staged_rfm(totals)
    clustered = stage(
        cluster_or_unknown(
            attach_cluster(users.select(*USER_COLUMNS), label(features)), features
        ),
        "clustered-users",
    )
    recent = counts.where(F.col("month") >= month_start(as_of)).agg(F.sum("count")).scalar()
    return {
        "age_count": marts.age_count(clustered),
        "gender_count": marts.gender_count(clustered),
        "service_count": marts.services_of_activity(counts, lookup),
        "user_geo": marts.user_geo(clustered),
        "trans_by_day": marts.hours_of_activity(counts),
        "stats": marts.stats_row(clustered, totals, recent),
        "rfm_scores": rfm_scores(features),
    }


def run_daily(
    spark: SparkSession, users: DataFrame, trans: DataFrame, lookup: DataFrame, target: str, as_of=None,
    label=_segmented,
) -> DataFrame:
    """Writes all tables under `target` and returns (table, rows) as written.

    Raises if a mart table is empty; a missing segment only shows in check_mart.
    """
    return _write_mart(spark, mart_tables(users, trans, lookup, as_of, label), target)


def run_daily_from_store(
    spark: SparkSession, users: DataFrame, store: str, lookup: DataFrame, target: str, as_of=None, label=_segmented
) -> DataFrame:
    """The daily run over the rollups of a store (`sources.rollups`): no fact is read again."""
    totals = stage(read_rollup(spark, store, "users"), "user-totals")
    counts = stage(read_rollup(spark, store, "activity"), "activity")
    return _write_mart(spark, tables_of_totals(users, totals, counts, lookup, as_of, label), target)


def _write_mart(spark: SparkSession, tables: dict[str, DataFrame], target: str) -> DataFrame:
    def write(name: str) -> int:
        return write_mart(tables[name], f"{target}/{name}", MART.get(name))

    # The tables are independent and mostly small, so their jobs may overlap.
    with ThreadPoolExecutor(len(tables)) as pool:
        rows = dict(zip(tables, pool.map(write, tables)))
    quality.raise_on_failure(check_mart(spark, target).where(F.col("severity") == "fail"), "mart")
    return spark.createDataFrame(list(rows.items()), "table string, rows long")


def read_mart(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{target}/{name}") for name, schema in MART.items()}


def check_mart(spark: SparkSession, target: str) -> DataFrame:
    """(check, subject, ok, severity): no table is empty, every segment occurs."""
    tables = read_mart(spark, target)
    filled = quality.check_not_empty(tables).select(
        F.lit("not_empty").alias("check"),
        F.col("table").alias("subject"),
        "ok",
        F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("fail")).alias("severity"),
    )
    found = quality.check_expected_values(tables["age_count"], "cluster", CLUSTER_NAMES).select(
        F.lit("expected_cluster").alias("check"),
        F.col("value").alias("subject"),
        F.col("found").alias("ok"),
        "severity",
    )
    return quality.union_all(filled, found)
