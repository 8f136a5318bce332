"""Dashboard reads over the mart tables and the shapes the charts take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.scalars import age_bin, age_bin_rank, axis_text, default_if_empty, round2
from martspark.operators.scale import positions

NO_CLUSTER = "No Cluster"


def order_by(df: DataFrame, columns: Sequence[str], desc: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() if desc else F.col(c).asc() for c in columns])


def top_services(services: DataFrame, n: int = 7) -> DataFrame:
    """The n most used services; equal counts in order of name."""
    return services.orderBy(F.desc("count"), "service").limit(n).select("service", "count")


def top_service(services: DataFrame) -> DataFrame:
    best = top_services(services, 1)
    return best.select(F.col("service").alias("most_used_service"), F.col("count").alias("usage_count"))


def first_row(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).limit(1)


def average_clv(stats: DataFrame) -> DataFrame:
    return first_row(stats, "avg_clv").select(round2("avg_clv").alias("average_clv"))


def gender_distribution(genders: DataFrame) -> DataFrame:
    totals = genders.groupBy("gender").agg(F.sum("count").alias("count"))
    return totals.orderBy(F.desc("count"), "gender")


def geo_points(geo: DataFrame) -> DataFrame:
    return geo.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())


def filter_cluster(df: DataFrame, cluster: str | None = None) -> DataFrame:
    return df if cluster is None else df.where(F.col("cluster") == cluster)


def to_pie(df: DataFrame, label: str, value: str = "count") -> DataFrame:
    return df.select(F.col(label).alias("id"), F.col(label).alias("label"), F.col(value).alias("value"))


def share_of_total(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds `percentage` of the column total, one decimal; 0 when the total is not positive."""
    total = df.agg(F.sum(value)).scalar()
    part = F.round(F.col(value) * F.lit(100.0) / F.col("_total"), 1)
    return df.withColumn("_total", total).withColumn(
        "percentage", F.when(F.col("_total") > 0, part).otherwise(F.lit(0.0))
    ).drop("_total")


def series_by_hour(hours: DataFrame) -> DataFrame:
    """One series of (x, y) points in order of the hour. A day bounds the points to 24."""
    points = F.array_sort(F.collect_list(F.struct("hour", F.col("count").alias("y"))))
    return hours.where(F.col("hour").isNotNull()).agg(
        F.lit("Transactions").alias("id"),
        F.transform(points, lambda p: F.struct(axis_text(p["hour"]).alias("x"), p["y"].alias("y"))).alias("data"),
    )


def age_distribution(ages: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Users per cluster and age bin as rows (id, x, y, rank); empty bins are left out.

    `rank` is the bin's place on the axis, 0 for ages off the axis (dropped by default).
    """
    binned = ages.select(
        default_if_empty("cluster", NO_CLUSTER).alias("id"), age_bin("age").alias("x"), "count"
    )
    totals = binned.groupBy("id", "x").agg(F.sum("count").alias("y")).where(F.col("y") != 0)
    ranked = totals.withColumn("rank", age_bin_rank("x"))
    return ranked if keep_unknown else ranked.where(F.col("rank") > 0)


def age_series(ages: DataFrame) -> DataFrame:
    """One row per cluster with its points in axis order (at most one per age bin).

    A cluster whose ages are all off the axis keeps its row, with no points.
    """
    points = F.array_sort(F.collect_list(F.when(F.col("rank") > 0, F.struct("rank", "x", "y"))))
    return age_distribution(ages, keep_unknown=True).groupBy("id").agg(
        F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("data")
    )


def bar_keys(df: DataFrame, index: str = "service", ignore_suffix: str = "Color") -> list[str]:
    """Names of the measure columns of a wide table."""
    return [c for c in df.columns if c != index and not c.endswith(ignore_suffix)]


def to_wide(df: DataFrame, index: str, key: str, value: str, keys: Sequence) -> DataFrame:
    """One row per `index` and one summed column per entry of `keys`."""
    return df.groupBy(index).pivot(key, list(keys)).agg(F.sum(value))


def _truthy(df: DataFrame, column: str) -> Column:
    """The value as text, NULL where a chart would take it for missing: 0, NaN or ""."""
    value = F.col(column)
    kind = df.schema[column].dataType.typeName()
    if kind == "string":
        return F.nullif(value, F.lit(""))
    empty = value == 0
    if kind in ("double", "float"):
        empty = empty | F.isnan(value)
    return F.when(~empty, value)


def generic_series(df: DataFrame, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows (id, position, x, y) of one series for a table of unknown shape.

    x is the first non-missing of `x`, `hour` and the row's position along the integer column
    `order`; y the first of `y`, `count`, and else `value`.
    """
    numbered = positions(df, [], [F.col(order)], order)
    xs = [_truthy(df, c).cast("string") for c in (x, "hour") if c in df.columns]
    ys = [_truthy(df, c).cast("double") for c in (y, "count") if c in df.columns]
    if "value" in df.columns:
        ys.append(F.col("value").cast("double"))
    return numbered.select(
        F.lit("Data").alias("id"),
        "position",
        F.coalesce(*xs, F.col("position").cast("string")).alias("x"),
        F.coalesce(*ys, F.lit(None).cast("double")).alias("y"),
    )
