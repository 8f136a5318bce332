"""Data quality checks. Each returns a small table of findings; nothing raises until asked to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions import text
from martspark.schemas import (
    CONTENT_TYPES,
    MESSAGE_STATUSES,
    PARTICIPANT_ROLES,
    SENDER_TYPES,
    UPLOAD_STATUSES,
)
from martspark.session import stage_path


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def check_not_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, ok) per table."""
    counts = [
        df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()
    ]
    return union_all(*counts).withColumn("ok", F.col("rows") > 0)


def missing_expected(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Expected values that no row has."""
    found = distinct_values(df.where(F.col(column).isin(*values)), column)
    expected = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return expected.join(found, column, "left_anti")


def check_expected_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(value, found, severity) per expected value; a missing one only warns."""
    wanted = df.where(F.col(column).isin(*values))
    found = distinct_values(wanted, column).select(F.col(column).alias("value"), F.lit(True).alias("found"))
    expected = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    present = F.coalesce("found", F.lit(False))
    return expected.join(found, "value", "left").select(
        "value",
        present.alias("found"),
        F.when(present, F.lit("ok")).otherwise(F.lit("warn")).alias("severity"),
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row count. NULL keys are never equal."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def fk_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Foreign key values without a parent row, with the number of child rows (NULLs pass).

    Children are counted per key first: the join sees each key once, however frequent it is. It
    is an outer join, as the optimizer would move an anti join below the counting.
    """
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(pk).alias("_pk"), F.lit(True).alias("_known"))
    joined = used.join(known, F.col(fk) == F.col("_pk"), "left")
    return joined.where(F.col("_known").isNull()).select(fk, "rows")


def check_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: orphan_keys, orphan_rows, ok."""
    return fk_violations(child, parent, fk, pk).agg(
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orphan_rows"),
        (F.count(F.lit(1)) == 0).alias("ok"),
    )


def _counted(df: DataFrame, failures: Mapping[str, Column]) -> DataFrame:
    """(rule, violations, ok) per named condition, in a single pass over `df`."""
    counts = df.agg(*[F.count_if(cond).alias(f"r{i}") for i, cond in enumerate(failures.values())])
    rows = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(failures)
    ])
    return counts.select(F.inline(rows)).withColumn("ok", F.col("violations") == 0)


def check_predicates(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule; as with SQL CHECK an unknown outcome passes."""
    return _counted(df, {name: ~rule for name, rule in rules.items()})


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _counted(df, {c: F.col(c).isNull() for c in columns})


def check_freshness(df: DataFrame, ts: str, max_age_hours: float, as_of: Column | None = None) -> DataFrame:
    """One row: last moment, age_hours at `as_of` (now by default) and whether it is recent."""
    moment = (as_of if as_of is not None else F.current_timestamp()).cast("timestamp")
    age = (F.unix_micros(moment) - F.unix_micros(F.col("latest").cast("timestamp"))) / 3.6e9
    return df.agg(F.max(ts).alias("latest")).select(
        "latest",
        age.alias("age_hours"),
        F.coalesce(age <= max_age_hours, F.lit(False)).alias("ok"),
    )


def chat_rules(table: str) -> dict[str, Column]:
    """The declared value rules of the chat tables."""
    c = F.col
    return {
        "users": {
            "name_length": F.length("name") >= 2,
            "email_shape": text.email_shape("email"),
        },
        "chat_sessions": {"title_length": F.length("title") <= 255},
        "messages": {
            "sender_type": c("sender_type").isin(*SENDER_TYPES),
            "content_type": c("content_type").isin(*CONTENT_TYPES),
            "status": c("status").isin(*MESSAGE_STATUSES),
        },
        "message_images": {"upload_status": c("upload_status").isin(*UPLOAD_STATUSES)},
        "chat_participants": {"role": c("role").isin(*PARTICIPANT_ROLES)},
    }[table]


def validate_contacts(df: DataFrame) -> DataFrame:
    """Adds `failed_rules`, the names of the contact rules each row breaks."""
    fields = ("firstName", "lastName", "email", "contact", "address1", "address2")
    broken = [
        F.when(~text.required(name), F.lit(f"{name} required")) for name in fields
    ]
    broken.append(F.when(text.required("email") & ~text.valid_email("email"), F.lit("invalid email")))
    broken.append(
        F.when(text.required("contact") & ~text.valid_phone("contact"), F.lit("Phone number is not valid"))
    )
    return df.withColumn("failed_rules", F.array_compact(F.array(*broken)))


def raise_on_failure(checks: DataFrame, name: str) -> None:
    """Raises when a finding table has a row that is not ok; all such rows are in the table that the error names."""
    failed = checks.where(~F.col("ok"))
    if failed.isEmpty():
        return
    path = stage_path(checks.sparkSession, f"failed-{name}")
    failed.write.parquet(path)
    written = checks.sparkSession.read.schema(failed.schema).parquet(path)
    shown = [r.asDict() for r in written.limit(20).collect()]
    raise ValueError(
        f"quality check '{name}' failed: {written.count()} findings, all in {path}, {len(shown)} of them: {shown}"
    )
