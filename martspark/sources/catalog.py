"""The session's tables described as frames: columns, declared references, schema text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.schemas import FOREIGN_KEYS, ForeignKey

# Where Spark keeps the default that a column was declared with.
_DEFAULT = "CURRENT_DEFAULT"
_COLUMNS = (
    "table string, type string, column string, data_type string, nullable boolean, default string, position int"
)


def _listed(spark: SparkSession, database: str | None) -> list[tuple[str, str, str]]:
    """(name, kind, full name) of the tables and views of a database, by default the current one."""
    found = []
    for t in spark.catalog.listTables(database):
        full = t.name if t.isTemporary or not database else f"{database}.{t.name}"
        found.append((t.name, "view" if t.isTemporary else t.tableType.lower(), full))
    return sorted(found)


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    return spark.createDataFrame([t[:2] for t in _listed(spark, database)], "table string, type string")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Columns of all tables and views, with declared defaults and positions from 1. Reads metadata only."""
    rows = [
        (name, kind, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get(_DEFAULT), i)
        for name, kind, full in _listed(spark, database)
        for i, f in enumerate(spark.table(full).schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, _COLUMNS)


def catalog_relationships(spark: SparkSession, keys: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """The declared foreign keys."""
    rows = [(k.child, k.child_column, k.parent, k.parent_column) for k in keys]
    return spark.createDataFrame(
        rows, "foreign_table string, foreign_column string, primary_table string, primary_column string"
    )


def catalog_join(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their columns, including tables without any."""
    return tables.join(columns.drop("type"), "table", "left")


def schema_text(columns: DataFrame) -> DataFrame:
    """(table, description): one line per column, in order of position."""
    null = F.when(F.col("nullable"), F.lit(" (NULL)")).otherwise(F.lit(" (NOT NULL)"))
    line = F.concat(F.lit("  - "), "column", F.lit(": "), "data_type", null)
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return columns.groupBy("table", "type").agg(F.transform(lines, lambda x: x["line"]).alias("lines")).select(
        "table",
        F.concat(
            F.lit("Table: "), "table", F.lit("\nType: "), "type", F.lit("\nColumns:\n"), F.array_join("lines", "\n")
        ).alias("description"),
    )


def describe_schema(
    spark: SparkSession, database: str, keys: Iterable[ForeignKey] = FOREIGN_KEYS
) -> DataFrame:
    """One row: the schema of the session's tables and their references as text."""
    columns = catalog_columns(spark)
    tables = schema_text(columns).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "description"))),
                                 lambda x: x["description"]), "\n\n").alias("tables")
    )
    known = columns.select(F.col("table").alias("t"), F.col("column").alias("c"))
    links = catalog_relationships(spark, keys).join(
        known, (F.col("foreign_table") == F.col("t")) & (F.col("foreign_column") == F.col("c")), "left_semi"
    )
    link = F.concat(
        F.lit("  - "), "foreign_table", F.lit("."), "foreign_column", F.lit(" -> "),
        "primary_table", F.lit("."), "primary_column",
    )
    linked = links.agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("links")).scalar()
    return tables.select(
        F.concat(F.lit(f"Database: {database}\n\n"), F.col("tables")).alias("head"), linked.alias("links")
    ).select(
        F.concat(
            "head",
            F.when(F.length("links") > 0, F.concat(F.lit("\n\nRelationships:\n"), "links")).otherwise(F.lit("")),
        ).alias("description")
    )


def fallback_query(tables: list[str], n: int = 10) -> str:
    """What to run when a question gave no usable statement: a look at the first table."""
    return f"SELECT * FROM {tables[0]} LIMIT {n}" if tables else "SELECT 1 AS status"
