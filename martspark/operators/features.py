"""Per-customer recency, frequency and monetary features, their scores and z-scores."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.scalars import days_between, month_start
from martspark.operators.scale import exact_quantiles
from martspark.session import stage

FEATURES = ("frequency", "monetary", "recency")
RECENT_DAYS = 30


def as_of_date(df: DataFrame, ts: str = "trans_timestamp") -> DataFrame:
    """One row: the last moment in the data, the reference point of recency."""
    return df.agg(F.max(ts).alias("as_of"))


def with_recency(df: DataFrame, as_of: Column, last: str = "last_trans_date") -> DataFrame:
    return df.withColumn("recency", days_between(F.col(last), as_of))


def user_totals(trans: DataFrame, *also: str) -> DataFrame:
    """Per user (and per further columns): first and last transaction, number of known amounts, their sum."""
    return trans.groupBy(*also, "user_id").agg(
        F.min("trans_timestamp").alias("first_trans_date"),
        F.max("trans_timestamp").alias("last_trans_date"),
        F.count("trans_amount").alias("frequency"),
        F.sum("trans_amount").alias("monetary"),
    )


def rfm_from_totals(totals: DataFrame, as_of: Column) -> DataFrame:
    return with_recency(totals.drop("first_trans_date"), as_of)


def rfm_features(trans: DataFrame) -> DataFrame:
    """user_id, last_trans_date, frequency (known amounts), monetary, recency in days.

    Lazy: besides the aggregation a second scan reads the time column for the reference date.
    """
    return rfm_from_totals(user_totals(trans), as_of_date(trans).scalar())


def staged_rfm(totals: DataFrame) -> DataFrame:
    """The features from staged user totals: the latest of the last transactions is the reference.

    That date is read at once, so that the many expressions built on recency hold a plain value.
    """
    as_of = totals.agg(F.max(F.to_date("last_trans_date")).alias("as_of")).first()["as_of"]
    return rfm_from_totals(totals, F.lit(as_of).cast("date"))


def staged_features(trans: DataFrame) -> DataFrame:
    """rfm_features for several readers, from a single scan of the transactions."""
    return staged_rfm(stage(user_totals(trans), "user-totals"))


def user_spend(trans: DataFrame) -> DataFrame:
    return trans.groupBy("user_id").agg(F.sum("trans_amount").alias("total_spent"))


def avg_clv(trans: DataFrame) -> DataFrame:
    """Mean spend of the users that have transactions, 0.0 if there are none."""
    return user_spend(trans).agg(F.coalesce(F.avg("total_spent"), F.lit(0.0)).alias("avg_clv"))


def since_month_start(
    trans: DataFrame, as_of: Column | date | datetime | str | None = None, ts: str = "trans_timestamp"
) -> DataFrame:
    """Rows since the first day of the month of `as_of` (today by default)."""
    return trans.where(F.col(ts) >= month_start(as_of))


def moments(df: DataFrame, columns: Sequence[str] = FEATURES) -> dict[str, float]:
    """The row count `n`, and mean_* and std_* (of the population) of the columns, read at once."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first().asDict()


def z_scores(given: dict[str, float], columns: Sequence[str] = FEATURES) -> dict[str, Column]:
    """The z-score of each column as an expression; a constant column gives 0."""
    return {c: (F.col(c) - F.lit(given[f"mean_{c}"])) / F.lit(given[f"std_{c}"] or 1.0) for c in columns}


def standardize(df: DataFrame, columns: Sequence[str] = FEATURES, prefix: str = "z_") -> DataFrame:
    """Adds z-scores with the population deviation.

    The moments are one row, read first: as numbers they keep the expressions built on the
    scores small, where a subquery would be repeated in each of them.
    """
    scores = z_scores(moments(df, columns), columns)
    return df.withColumns({f"{prefix}{c}": z for c, z in scores.items()})


def quantile_edges(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k + 1 edges of k equally filled bins: (metric, edges) per column that has values."""
    return exact_quantiles(df, columns, [i / k for i in range(k + 1)])


def quantile_score(df: DataFrame, columns: str | Sequence[str], k: int = 5) -> DataFrame:
    """Adds `<column>_score`, the number 1..k of the equal-frequency bin of each value.

    Bins are closed on the right and the lowest value is in bin 1. Equal edges collapse and
    the remaining bins are numbered without gaps. The edges take a few passes over `df`: hand in a
    staged frame when `df` is expensive.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    edges = {r["metric"]: r["edges"] for r in quantile_edges(df, columns, k).collect()}
    scores = {}
    for c in columns:
        given = edges.get(c, [])
        inner = [high for low, high in zip(given, given[1:k]) if high > low]
        above = sum(((F.col(c).cast("double") > F.lit(e)).cast("int") for e in inner), F.lit(1))
        scores[f"{c}_score"] = F.when(F.col(c).isNotNull(), above)
    return df.withColumns(scores)


def recency_score(df: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """1 for customers away longer than `days`, else 5 (also when recency is unknown)."""
    return df.withColumn("recency_score", F.when(F.col("recency") > days, 1).otherwise(5))


def rfm_scores(features: DataFrame) -> DataFrame:
    """Features plus frequency_score, monetary_score and recency_score."""
    return recency_score(quantile_score(features, ["frequency", "monetary"]))
