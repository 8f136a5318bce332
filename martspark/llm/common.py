"""What the text operators share: the definition of a word, and Arrow batches in pieces of bounded size."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A word is a longest run without ASCII white space; bytes.split() cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
SPACES = " \t\n\x0b\x0c\r"

# Rows of a batch that Python holds as objects at a time.
_SLICE_ROWS = 256


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="package-")  # on the driver; Spark serves it to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root, base = os.path.split(package)
        context.addPyFile(shutil.make_archive(f"{folder}/{base}", "zip", root, base))
        _SHIPPED.add(context.applicationId)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _SLICE_ROWS):
            yield batch.slice(start, _SLICE_ROWS)


def map_slices(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str
) -> DataFrame:
    """`fn` turns a few rows into columns; rows are independent, so a lost task is simply run again."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def signed(value: int) -> int:
    """An unsigned 64-bit number as the signed one with the same bits."""
    return value - (1 << 64) if value >> 63 else value
