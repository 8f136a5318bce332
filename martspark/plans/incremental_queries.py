"""Loads one after the other, and results kept up to date between them, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.operators import features, quality
from martspark.plans import daily_mart
from martspark.plans import samples as s
from martspark.plans.mart_queries import _frozen, _WRITTEN
from martspark.plans.registry import query, rounded
from martspark.plans.table_queries import APPENDED, CASCADED, UPSERTED, chat_links, fact_lines, session_changes
from martspark.session import stage, stage_path
from martspark.sources import part_loads, rollups
from martspark.sources.file_tables import FileTables, append_new, cascade_files, create_table, upsert_files


def _store_of_loads(spark: SparkSession, sf_dir: str) -> str:
    """All events in three loads: half of the later days first, then the earlier days late, then the rest along with
    some that are known; the first load is delivered twice, at first without some of its days."""
    store = stage_path(spark, "store")
    facts = s.fact_trans(spark, sf_dir)
    late = F.dayofmonth("trans_timestamp") <= 10
    half = F.col("trans_id") % 2 == 0
    first = facts.where(~late & half)
    rollups.load_facts(first.where(F.dayofmonth("trans_timestamp") != 17), store, "first")
    rollups.load_facts(facts.where(late), store, "late")
    rollups.load_facts(first, store, "first")
    rollups.load_facts(facts.where(~late & (~half | (F.col("trans_id") % 6 == 0))), store, "rest")
    return store


@query(
    "SELECT user_id, last_trans_date, frequency, round(monetary, 2) AS monetary, recency FROM rfm",
    "rfm",
)
def incremental_features(spark, sf_dir):
    """The features from totals that were built up load by load."""
    totals = rollups.read_rollup(spark, _store_of_loads(spark, sf_dir), "users")
    return rounded(features.staged_rfm(stage(totals, "user-totals")), 2, "monetary").select(
        "user_id", "last_trans_date", "frequency", "monetary", "recency"
    )


@query(_WRITTEN, "age_count gender_count service_count trans_by_day dim_users fact_trans")
def incremental_mart(spark, sf_dir) -> DataFrame:
    """The daily job from the parts of three loads; the rows of each table it wrote."""
    return daily_mart.run_daily_from_store(
        spark, s.dim_users(spark, sf_dir), _store_of_loads(spark, sf_dir), s.mcc_lookup(spark, sf_dir),
        stage_path(spark, "mart"), as_of="2024-01-15", label=_frozen,
    )


@query(
    """SELECT date_trunc('month', trans_timestamp)::DATE AS month, CAST(hour(trans_timestamp) AS INTEGER) AS "hour",
              trans_service, count(trans_id) AS count FROM fact_trans GROUP BY 1, 2, 3""",
    "fact_trans",
)
def incremental_activity(spark, sf_dir):
    return rollups.read_rollup(spark, _store_of_loads(spark, sf_dir), "activity")


@query(
    """SELECT event_id AS trans_id, CASE WHEN event_id % 50 <> 7 THEN CAST(user_id AS INTEGER) END AS user_id,
              CASE WHEN event_type <> 'error' AND event_id % 50 <> 7 THEN date_trunc('second', ts) END AS trans_timestamp,
              CASE WHEN event_id % 50 <> 7 THEN value END AS trans_amount,
              CASE WHEN event_id % 50 = 7 THEN 'does not fit the columns' END AS reason
       FROM events"""
)
def load_parts(spark, sf_dir):
    """Part files that arrive in two runs, some lines twice, others with a text for the user: loaded and kept aside."""
    out, table, bad, seen = (stage_path(spark, n) for n in ("parts", "loaded", "quarantine", "seen"))
    lines = fact_lines(spark, sf_dir)
    user = F.when(F.col("trans_id") % 50 == 7, F.concat(F.lit("user "), "user_id")).otherwise(F.col("user_id").cast("string"))
    lines = lines.withColumn("user_id", user)
    # The second run delivers a sixth of the first again, but no line that does not fit.
    runs = F.col("trans_id") % 2 == 0, (F.col("trans_id") % 2 == 1) | ((F.col("trans_id") % 12 == 0) & (F.col("trans_id") % 50 != 7))
    for number, arrived in enumerate(runs):
        lines.where(arrived).write.option("header", True).csv(f"{out}/run{number}")
        part_loads.load_parts(spark, out, table, bad, seen)
    columns = ["trans_id", "user_id", "trans_timestamp", "trans_amount"]
    good = part_loads.read_loaded(spark, table).select(*columns, F.lit(None).cast("string").alias("reason"))
    aside = part_loads.read_quarantine(spark, bad).select(
        F.split("text", ",")[0].cast("long").alias("trans_id"), "reason"
    )
    return good.unionByName(aside, allowMissingColumns=True)


# -- changes by file -----------------------------------------------------------------------------


def _store(spark: SparkSession) -> FileTables:
    return FileTables(spark, stage_path(spark, "tables"))


@query(UPSERTED, "chat_sessions messages")
def upsert_by_file(spark, sf_dir):
    """Session counters replaced in the files that hold the sessions."""
    base, stats = session_changes(spark, sf_dir)
    store = create_table(_store(spark), "chat_sessions", base.repartitionByRange("id"), "id")
    return upsert_files(store, "chat_sessions", stats, "id").read("chat_sessions")


@query(CASCADED, "chat_users chat_sessions messages message_images")
def cascade_by_file(spark, sf_dir):
    """A quarter of the users removed with what hangs on them, all tables at once."""
    base, links = chat_links(spark, sf_dir)
    store = _store(spark)
    for name, df in base.items():
        store = create_table(store, name, df.repartitionByRange("id"))
    after = cascade_files(store, "users", base["users"].where("id % 4 = 1"), "id", links)
    return quality.union_all(*[after.read(name).select(F.lit(name).alias("table"), "id") for name in base])


@query(APPENDED, "messages")
def append_by_filter(spark, sf_dir):
    """User messages first, then all of them, then a few again that are there already."""
    rows = s.messages(spark, sf_dir).select("uuid", "chat_session_id", "sender_type")
    store = _store(spark)
    for part in (rows.where("sender_type = 'user'"), rows, rows.where("chat_session_id % 40 = 3")):
        store = append_new(store, "messages", part, "uuid")
    return store.read("messages")
