"""Running questions as SQL and summarising their results."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark.session import stage

PREVIEW_ROWS = 10


def head_n(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def preview(df: DataFrame, n: int = PREVIEW_ROWS, order: list[str] | None = None) -> DataFrame:
    return head_n(df, n, order)


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row; NULL fields are kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def numeric_columns(df: DataFrame, max_columns: int | None = 3) -> list[str]:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return names if max_columns is None else names[:max_columns]


def _summaries(names: list[str]) -> list[Column]:
    """Per column a struct of its name, place, total, average, minimum and maximum."""
    out = []
    for i, name in enumerate(names):
        value = F.col(f"`{name}`").cast("double")
        out.append(F.struct(
            F.lit(name).alias("column"),
            F.lit(i).alias("position"),
            F.sum(value).alias("total"),
            F.avg(value).alias("average"),
            F.min(value).alias("minimum"),
            F.max(value).alias("maximum"),
        ))
    return out


def numeric_summary(df: DataFrame, max_columns: int = 3) -> DataFrame:
    """(column, position, total, average, minimum, maximum) of the first numeric columns.

    One pass; NULLs are skipped and a column without any value gives no row.
    """
    names = numeric_columns(df, max_columns)
    if not names:
        empty = "column string, position int, total double, average double, minimum double, maximum double"
        return df.sparkSession.createDataFrame([], empty)
    summary = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(_summaries(names))])
    rows = F.array(*[F.col(f"c{i}") for i in range(len(names))])
    return summary.select(F.inline(rows)).where(F.col("total").isNotNull())


@dataclass
class QueryResult:
    success: bool
    query: str
    frame: DataFrame | None = None
    columns: tuple[str, ...] = ()
    error: str | None = None


def run_readonly_sql(spark: SparkSession, sql: str, cap: int | None = None) -> QueryResult:
    """A query as a frame of all its rows, of at most `cap` where the caller asks for that, or the error text.

    The text is placed as a subquery, where Spark accepts nothing but a query: statements that
    change data or settings do not even parse.
    """
    statement = sql.strip().removesuffix(";")
    try:
        frame = spark.sql(f"SELECT * FROM (\n{statement}\n) AS question")
    except PySparkException as e:
        return QueryResult(False, sql, error=str(e))
    if cap is not None:
        frame = frame.limit(cap)
    return QueryResult(True, sql, frame, tuple(frame.columns))


def run_within(spark: SparkSession, sql: str, seconds: float, cap: int | None = None) -> QueryResult:
    """The answer of `run_readonly_sql`, worked out within a time; a question that takes longer or fails is a failed result.

    The answer is written to the shared folder, so reading it takes no more of the question's work. Its jobs carry a tag of
    their own and are interrupted by it when the time is over, until none is left; other jobs of the session go on.
    """
    answer = run_readonly_sql(spark, sql, cap)
    if not answer.success:
        return answer
    # Tags of the context, which any thread may ask to end; those of a session are known to its thread alone.
    context, tag = spark.sparkContext, f"question-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        # Asked again and again, as one job of the question may follow another.
        pause = seconds
        while not ended.wait(pause):
            late.set()
            context.cancelJobsWithTag(tag)
            pause = 0.2

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    try:
        watcher.start()
        frame = stage(answer.frame, "answer")
        return QueryResult(True, sql, frame, answer.columns)
    except Exception as e:  # noqa: BLE001, whatever the question runs into is its answer
        if late.is_set():
            return QueryResult(False, sql, columns=answer.columns, error=f"no answer within {seconds:g} s")
        return QueryResult(False, sql, columns=answer.columns, error=str(e).split("\n")[0])
    finally:
        ended.set()
        context.removeJobTag(tag)


def result_lines(df: DataFrame, database: str, query: str, order: list[str] | None = None, n: int = 5) -> DataFrame:
    """Numbered lines describing a query result: its size, n sample rows and number summaries.

    The result is read twice, for one row of totals and for the sample; stage it if it is dear.
    """
    names = numeric_columns(df)
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"), *[c.alias(f"c{i}") for i, c in enumerate(_summaries(names))]
    )
    rows = F.col("rows")
    summarised = [F.col(f"c{i}") for i in range(len(names))]
    any_total = reduce(lambda x, y: x | y, [c["total"].isNotNull() for c in summarised], F.lit(False))

    def line(section: int, no: int, *parts: Column | str, given: Column = F.lit(True)) -> Column:
        text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
        return F.when(
            given, F.struct(F.lit(section).alias("section"), F.lit(no).alias("no"), text.alias("line"))
        )

    def number(c: Column) -> Column:
        return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")

    lines = [
        line(0, 0, f"Database: {database}"),
        line(0, 1, f"Query: {query}"),
        line(1, 0, "Results: ", rows, " rows returned"),
        line(2, 0, "Sample data:", given=rows > 0),
        line(2, 0, "No data returned", given=rows == 0),
        line(4, 0, "  ... and ", rows - n, " more rows", given=rows > n),
        line(5, 0, "Summary statistics:", given=any_total),
        *[
            line(
                6, i, "  ", c["column"], ": Total=", number(c["total"]),
                ", Average=", F.round(c["average"], 2).cast("decimal(38,2)"),
                ", Min=", number(c["minimum"]), ", Max=", number(c["maximum"]),
                given=c["total"].isNotNull(),
            )
            for i, c in enumerate(summarised)
        ],
    ]
    described = totals.select(F.inline(F.array_compact(F.array(*lines))))
    # At most n rows, so collecting them into one list is fine.
    sample = head_n(df, n, order).agg(F.collect_list(F.struct("*")).alias("rows"))
    listed = sample.select(F.posexplode("rows").alias("no", "row")).select(
        F.lit(3).alias("section"),
        "no",
        F.concat(
            F.lit("  Row "), (F.col("no") + 1).cast("string"), F.lit(": "),
            F.to_json("row", {"ignoreNullFields": "false"}),
        ).alias("line"),
    )
    return described.unionByName(listed)


def result_context(df: DataFrame, database: str, query: str, order: list[str] | None = None) -> DataFrame:
    """One row (context): the lines above as one text."""
    lines = result_lines(df, database, query, order)
    ordered = F.array_sort(F.collect_list(F.struct("section", "no", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


def answers_context(spark: SparkSession, answers: Sequence[tuple[str, QueryResult]]) -> DataFrame:
    """One row (context): the results of several (database, answer) pairs in their order, each with a blank
    line behind it. A failed answer gives its error."""
    if not answers:
        return spark.range(1).select(F.lit("No data was retrieved.").alias("context"))
    parts = []
    for no, (database, answer) in enumerate(answers):
        if answer.success:
            part = result_context(answer.frame, database, answer.query)
        else:
            told = f"Database: {database}\nQuery: {answer.query}\nQuery failed: {answer.error}"
            part = spark.range(1).select(F.lit(told).alias("context"))
        parts.append(part.select(F.lit(no).alias("no"), "context"))
    ordered = F.array_sort(F.collect_list(F.struct("no", "context")))
    texts = F.transform(ordered, lambda x: F.concat(x["context"], F.lit("\n")))
    return reduce(DataFrame.unionByName, parts).agg(F.array_join(texts, "\n").alias("context"))
