"""Session defaults and the shared folder used for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every entry point wants; executors and memory belong to spark-submit.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_OWN_DIR = "martspark.stage.dir"


def sizing(input_bytes: int) -> dict[str, str]:
    """Partition settings for an input of this size.

    Shuffles start with one partition per 128 MB of input, and AQE merges what turns out small;
    the built-in 200 would mean half a terabyte per task at 100 TB. Splits grow with the cube root
    of the input from 1 TB on, so that neither they nor the number of tasks jump.
    """
    mb = 1 << 20
    partitions = max(200, input_bytes // (128 * mb))
    split = round(128 * mb * max(1.0, input_bytes / (1 << 40)) ** (1 / 3))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * mb),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def build_session(
    app_name: str = "martspark", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above, sized if the input size is known.

    Keyword names use `__` for the dots of a setting.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    extra = {k.replace("__", "."): v for k, v in conf.items()}
    sized = sizing(input_bytes) if input_bytes else {}
    for key, value in {**DEFAULTS, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    A local master, whose tasks all run in one process, gets a temporary folder where none is
    configured. On a cluster that would be another disk on each executor, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get(_OWN_DIR, None)
    if not own:
        own = tempfile.mkdtemp(prefix="martspark-")
        spark.conf.set(_OWN_DIR, own)
    return own


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below a folder of this application, which can go once the application has ended."""
    return f"{stage_dir(spark)}/martspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Cuts the lineage for frames that several later passes read: the passes see one fixed
    result, survive lost executors and prune columns, which a cached frame does not.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, name: str, columns: Sequence[str], files: int) -> DataFrame:
    """Like `stage`, the rows dealt to a number of files by a hash of some columns, and Spark told so.

    A later join on these columns reads the files as they are and shuffles only its other side.
    """
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    # The files lie at a path of their own, so the name can go as soon as the frame knows it.
    writer = df.repartition(files, *columns).write.option("path", stage_path(spark, name))
    writer.bucketBy(files, *columns).saveAsTable(table, format="parquet")
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows
