"""File sources: the CSV star schema, the category lookup and the chat tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.functions.scalars import parse_timestamp
from martspark.operators.marts import clean_lookup
from martspark.schemas import CHAT, FACT_TRANS, FACT_TRANS_RAW, MCC_CODES_RAW

CORRUPT = "_corrupt_record"


def read_csv_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType, keep_corrupt: bool = False
) -> DataFrame:
    """A CSV table with a header line and a declared schema.

    With `keep_corrupt` a line that does not fit is kept, its text in `_corrupt_record`.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def read_fact_parts(
    spark: SparkSession, path: str | list[str], schema: T.StructType = FACT_TRANS_RAW
) -> DataFrame:
    """All part files of the fact table (a glob, folder or list) as one table, timestamps parsed.

    Text that is no timestamp becomes NULL; `bad_timestamps` counts those rows.
    """
    raw = read_csv_table(spark, path, schema)
    return raw.withColumn("trans_timestamp", parse_timestamp("trans_timestamp"))


def bad_timestamps(raw: DataFrame, column: str = "trans_timestamp") -> Column:
    """Condition on raw rows: a text is given, but it is no timestamp."""
    return F.col(column).isNotNull() & parse_timestamp(column).isNull()


def read_mcc(spark: SparkSession, path: str) -> DataFrame:
    return clean_lookup(read_csv_table(spark, path, MCC_CODES_RAW))


@dataclass(frozen=True)
class ChatTables:
    users: DataFrame
    chat_sessions: DataFrame
    messages: DataFrame
    message_images: DataFrame
    chat_participants: DataFrame


def read_chat(spark: SparkSession, folder: str) -> ChatTables:
    """The chat tables, one Parquet table per name under `folder`."""
    return ChatTables(
        **{name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in CHAT.items()}
    )


def rows_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    """A handful of rows known to the program, such as one statistics row."""
    return spark.createDataFrame(list(rows), schema)


__all__ = [
    "CORRUPT", "ChatTables", "FACT_TRANS", "bad_timestamps", "read_chat", "read_csv_table",
    "read_fact_parts", "read_mcc", "rows_frame",
]
