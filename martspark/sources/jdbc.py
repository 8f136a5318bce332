"""Database sources and sinks over JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    query: str | None = None,
    table: str | None = None,
    props: Mapping[str, str] | None = None,
    partition_column: str | None = None,
    lower=None,
    upper=None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options for a table or a query (as a derived table, so it can be partitioned)."""
    if (query is None) == (table is None):
        raise ValueError("give either query or table")
    split = (partition_column, lower, upper, num_partitions)
    if any(s is not None for s in split) and any(s is None for s in split):
        raise ValueError("partition_column, lower, upper and num_partitions go together")
    options = {
        "url": url,
        "dbtable": table if table is not None else f"({query}) AS source",
        "fetchsize": str(fetch_size),
        **(props or {}),
    }
    if partition_column is not None:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(num_partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, query: str | None = None, **how) -> DataFrame:
    """A query or table (`table=`) of a database; see jdbc_options.

    Without a partition column the whole result comes through a single connection, which only
    suits small tables. Filters and column choices made on the frame are sent to the database.
    """
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **how)).load()


def partition_bounds(spark: SparkSession, url: str, table: str, column: str, props=None) -> tuple:
    """Smallest and largest value of a numeric column, for a partitioned read."""
    query = f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"
    row = read_jdbc(spark, url, query, props=props).first()
    return row["low"], row["high"]


def jdbc_writer_options(
    url: str, table: str, props: Mapping[str, str] | None = None, batch_size: int = 10_000
) -> dict[str, str]:
    """Writer options; an overwrite empties the table and keeps its declared columns."""
    return {
        "url": url,
        "dbtable": table,
        "truncate": "true",
        "batchsize": str(batch_size),
        **(props or {}),
    }


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "overwrite",
    props: Mapping[str, str] | None = None,
    connections: int = 8,
) -> None:
    """Writes a mart table over `connections` connections; computing it keeps all its tasks."""
    options = jdbc_writer_options(url, table, props)
    df.repartition(connections).write.format("jdbc").options(**options).mode(mode).save()
