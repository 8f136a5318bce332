"""The aggregated tables of the data mart and the headline statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.scalars import as_column, floor_div, hour_of
from martspark.functions.text import code_number
from martspark.operators.features import since_month_start, user_totals


def age_count(users: DataFrame) -> DataFrame:
    return users.groupBy("age", "cluster").agg(F.count("user_id").alias("count"))


def gender_count(users: DataFrame) -> DataFrame:
    return users.groupBy("gender", "cluster").agg(F.count("user_id").alias("count"))


def with_hour(df: DataFrame, ts: str = "trans_timestamp") -> DataFrame:
    return df.withColumn("hour", hour_of(ts))


def trans_by_hour(trans: DataFrame) -> DataFrame:
    return with_hour(trans).groupBy("hour").agg(F.count("trans_id").alias("count")).orderBy("hour")


def activity(trans: DataFrame, *also: str) -> DataFrame:
    """Transactions per month, hour and service (and further columns): small, and enough for three mart numbers.

    The daily job stages it, so that services, hours and the month's transactions take one
    scan of the fact table together.
    """
    ts = F.col("trans_timestamp")
    keys = F.trunc(ts, "month").alias("month"), hour_of(ts).alias("hour"), "trans_service"
    return trans.groupBy(*also, *keys).agg(F.count("trans_id").alias("count"))


def hours_of_activity(counts: DataFrame) -> DataFrame:
    return counts.groupBy("hour").agg(F.sum("count").alias("count")).orderBy("hour")


def clean_lookup(raw: DataFrame) -> DataFrame:
    """Code and description of a raw category table."""
    return raw.select("mcc", F.col("irs_description").alias("description"))


def label_or_code(label: Column | str = "description", code: Column | str = "service") -> Column:
    return F.coalesce(as_column(label), as_column(code))


def code_counts(trans: DataFrame) -> DataFrame:
    return trans.groupBy(F.col("trans_service").alias("service")).agg(F.count("trans_id").alias("count"))


def describe_codes(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Code counts with the description of the code, matched as a number; NULL if there is none."""
    numbered = counts.withColumn("_code", code_number("service"))
    named = lookup.select(F.col("mcc").cast("bigint").alias("_code"), "description")
    return numbered.join(named, "_code", "left").drop("_code")


def service_totals(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """Code counts summed per described service, most used first.

    Several codes may share a description, hence the second sum.
    """
    described = describe_codes(counts, lookup)
    totals = described.groupBy(label_or_code().alias("service")).agg(F.sum("count").alias("count"))
    return totals.orderBy(F.desc("count"), "service")


def service_count(trans: DataFrame, lookup: DataFrame) -> DataFrame:
    """Transactions per described service.

    Counting by code comes before the join, so the join sees one row per code instead of one
    per transaction.
    """
    return service_totals(code_counts(trans), lookup)


def services_of_activity(counts: DataFrame, lookup: DataFrame) -> DataFrame:
    codes = counts.groupBy(F.col("trans_service").alias("service")).agg(F.sum("count").alias("count"))
    return service_totals(codes, lookup)


def user_geo(users: DataFrame) -> DataFrame:
    return users.select("longitude", "latitude", "city", F.col("state").alias("country"), "cluster")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def stats_row(users: DataFrame, totals: DataFrame, new_transactions: Column) -> DataFrame:
    """The statistics row from the users, the per-user totals and the month's transactions.

    returning_users is the mart's placeholder, a quarter of the users; active_returning_users
    counts users with transactions on at least two days.
    """
    came_back = F.to_date("first_trans_date") < F.to_date("last_trans_date")
    facts = totals.agg(
        F.coalesce(F.avg("monetary"), F.lit(0.0)).alias("avg_clv"),
        F.count_if(came_back).alias("active_returning_users"),
    )
    return facts.withColumn("new_users", row_count(users).scalar()).select(
        "new_users",
        floor_div("new_users", 4).alias("returning_users"),
        F.coalesce(new_transactions, F.lit(0)).alias("new_transactions"),
        "avg_clv",
        "active_returning_users",
    )


def dashboard_stats(users: DataFrame, trans: DataFrame, as_of=None) -> DataFrame:
    """One row: new_users, returning_users, new_transactions, avg_clv, active_returning_users.

    One aggregation per user, and a scan of the time column with the month filter pushed down.
    """
    recent = row_count(since_month_start(trans, as_of)).scalar()
    return stats_row(users, user_totals(trans), recent)


def revenue_by_quarter(trans: DataFrame) -> DataFrame:
    ts = F.col("trans_timestamp")
    return trans.groupBy(F.year(ts).alias("year"), F.quarter(ts).alias("quarter")).agg(
        F.sum("trans_amount").alias("revenue")
    )


def users_by_country(geo: DataFrame) -> DataFrame:
    return geo.groupBy("country").agg(F.count(F.lit(1)).alias("users"))
