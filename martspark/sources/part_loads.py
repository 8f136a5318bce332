"""Part files loaded as they arrive: each once, with the lines that do not fit kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.functions.scalars import parse_timestamp
from martspark.schemas import FACT_TRANS, FACT_TRANS_RAW
from martspark.sources.files import CORRUPT
from martspark.sources.tables import rows_not_in

QUARANTINE = "file string, text string, reason string, batch long"


def _reason(key: str) -> Column:
    """Why a line cannot be loaded; NULL if it can."""
    return F.when(F.col(CORRUPT).isNotNull(), F.lit("does not fit the columns")).when(
        F.col(key).isNull(), F.lit(f"no {key}")
    )


def load_parts(
    spark: SparkSession,
    source: str,
    table: str,
    quarantine: str,
    checkpoint: str,
    raw: T.StructType = FACT_TRANS_RAW,
    loaded: T.StructType = FACT_TRANS,
    key: str = "trans_id",
    ts: str = "trans_timestamp",
    files_per_batch: int = 1000,
) -> int:
    """Loads the part files under `source` that no earlier call has loaded; returns the number of batches it took.

    The files seen are kept in `checkpoint`, so a call reads new files only, however many there were before. A batch
    writes folders of its own under `table` and `quarantine`, which it overwrites if it runs again after a failure, so no
    row counts twice. A part that comes again under another name adds nothing, since rows with a known key are left
    out; only the key column of the table is read for that. A line that does not fit the declared columns or has no key goes to
    `quarantine` with its file and its text; text that is no timestamp becomes NULL, as in `read_fact_parts`.
    """
    # The table as it is before the first batch.
    spark.createDataFrame([], loaded).write.mode("ignore").parquet(f"{table}/batch=-1")
    spark.createDataFrame([], T.StructType(T._parse_datatype_string(QUARANTINE).fields[:-1])).write.mode("ignore").parquet(
        f"{quarantine}/batch=-1"
    )
    lines = (
        spark.readStream.schema(T.StructType([*raw.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("maxFilesPerTrigger", files_per_batch)
        # A part may be older than those already loaded.
        .option("maxFileAge", "36500d")
        .option("recursiveFileLookup", True)
        .csv(source)
        .withColumns({"_file": F.col("_metadata.file_path"), "_reason": _reason(key)})
    )
    names = [f.name for f in raw.fields]
    batches = []

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bad = batch.where(F.col("_reason").isNotNull()).select(
            F.col("_file").alias("file"), F.coalesce(CORRUPT, F.to_csv(F.struct(*names))).alias("text"),
            F.col("_reason").alias("reason"),
        )
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        good = batch.where(F.col("_reason").isNull()).select(*names).withColumn(ts, parse_timestamp(ts))
        # Rows of this batch itself do not count as known when it runs again.
        known = read_loaded(session, table, loaded).where(F.col("batch") < number)
        fresh = rows_not_in(good.dropDuplicates([key]), known, key)
        fresh.select(*loaded.names).write.mode("overwrite").parquet(f"{table}/batch={number}")
        batches.append(number)

    query = lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    query.trigger(availableNow=True).start().awaitTermination()
    return len(batches)


def read_loaded(spark: SparkSession, table: str, loaded: T.StructType = FACT_TRANS) -> DataFrame:
    """What has been loaded, with the number of the batch."""
    return spark.read.schema(T.StructType([*loaded.fields, T.StructField("batch", T.LongType())])).parquet(table)


def read_quarantine(spark: SparkSession, quarantine: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).parquet(quarantine)


__all__ = ["QUARANTINE", "load_parts", "read_loaded", "read_quarantine"]
