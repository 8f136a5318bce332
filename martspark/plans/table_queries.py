"""Sources, sinks, table changes and streams as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.operators import chat, marts, quality, scale
from martspark.plans import samples as s
from martspark.plans.registry import query
from martspark.schemas import CHAT, FOREIGN_KEYS, MART
from martspark.session import stage_path
from martspark.sources import files, tables
from martspark.streaming import sessions as live


# -- sources and sinks ---------------------------------------------------------------------------


@query(
    """SELECT event_id AS trans_id, CAST(user_id AS INTEGER) AS user_id, CAST(user_id % 3 AS INTEGER) AS card_id,
              CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS trans_timestamp,
              value AS trans_amount, event_type AS trans_service
       FROM events"""
)
def read_fact_parts(spark, sf_dir):
    """Events written as CSV part files and loaded back."""
    out = stage_path(spark, "fact-parts")
    fact_lines(spark, sf_dir).write.option("header", True).csv(out)
    return files.read_fact_parts(spark, f"{out}/part-*.csv")


def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of part files; errors carry a text that is no time."""
    stamp = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return s.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trans_id"),
        "user_id",
        (F.col("user_id") % 3).alias("card_id"),
        stamp.alias("trans_timestamp"),
        F.col("value").alias("trans_amount"),
        F.col("event_type").alias("trans_service"),
    )


@query("SELECT CAST(n_nationkey AS BIGINT) AS mcc, n_name AS description FROM nation")
def read_mcc(spark, sf_dir):
    out = stage_path(spark, "codes")
    s.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("mcc"),
        F.col("n_name").alias("edited_description"),
        F.col("n_name").alias("combined_description"),
        F.lit("-").alias("usda_description"),
        F.col("n_name").alias("irs_description"),
        F.lit("Yes").alias("irs_reportable"),
    ).write.option("header", True).csv(out)
    return files.read_mcc(spark, out)


@query(
    """SELECT m.id, m.sender_type, cs.user_id, cs.is_active, CAST(cs.created_at AS DATE) AS day, u.name AS user_name,
              coalesce(i.n, 0) AS n_images, CAST(1 AS BIGINT) AS n_members
       FROM messages m JOIN chat_sessions cs ON m.chat_session_id = cs.id JOIN chat_users u ON u.id = cs.user_id
            LEFT JOIN (SELECT message_id, count(*) AS n FROM message_images GROUP BY 1) i ON i.message_id = m.id""",
    "messages chat_sessions chat_users message_images",
)
def read_chat(spark, sf_dir):
    """The chat tables written in their declared schemas and read back."""
    out = stage_path(spark, "chat")
    given = {
        "users": s.chat_users(spark, sf_dir),
        "chat_sessions": s.chat_sessions(spark, sf_dir),
        "messages": s.messages(spark, sf_dir),
        "message_images": s.message_images(spark, sf_dir),
    }
    sessions = given["chat_sessions"]
    given["chat_participants"] = sessions.select("id", F.col("id").alias("chat_session_id"), "user_id")
    for name, schema in CHAT.items():
        df = given[name]
        padded = df.withColumns({f.name: F.lit(None) for f in schema.fields if f.name not in df.columns})
        tables.write_mart(padded, f"{out}/{name}", schema)
    read = files.read_chat(spark, out)
    owner = read.chat_sessions.select(
        F.col("id").alias("chat_session_id"), "user_id", "is_active", F.to_date("created_at").alias("day")
    )
    names = read.users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    counted = F.count(F.lit(1))
    members = read.chat_participants.groupBy("chat_session_id").agg(counted.alias("n_members"))
    images = read.message_images.groupBy(F.col("message_id").alias("id")).agg(counted.alias("n_images"))
    owned = scale.salted_join(owner, names, ["user_id"], "inner").join(members, "chat_session_id")
    inside = scale.salted_join(read.messages, owned, ["chat_session_id"], "inner").join(images, "id", "left")
    return inside.select(
        "id", "sender_type", "user_id", "is_active", "day", "user_name",
        F.coalesce("n_images", F.lit(0)).alias("n_images"), "n_members",
    )


@query('SELECT "hour", count FROM trans_by_day', "trans_by_day")
def write_mart(spark, sf_dir):
    out = stage_path(spark, "trans_by_day")
    tables.write_mart(marts.trans_by_hour(s.fact_trans(spark, sf_dir)), out, MART["trans_by_day"])
    return spark.read.schema(MART["trans_by_day"]).parquet(out)


APPENDED = "SELECT uuid, chat_session_id, sender_type FROM messages"


@query(APPENDED, "messages")
def append_rows(spark, sf_dir):
    """User messages first, then all of them: those already there are not added again."""
    out = stage_path(spark, "messages")
    rows = s.messages(spark, sf_dir).select("uuid", "chat_session_id", "sender_type")
    tables.append_rows(rows.where(F.col("sender_type") == "user"), out)
    tables.append_rows(rows, out)
    return spark.read.schema(rows.schema).parquet(out)


@query(
    """SELECT event_id, CAST(event_id AS VARCHAR) AS code, TRY_CAST(event_type AS INTEGER) AS kind,
              CAST(user_id AS INTEGER) AS user_id FROM events"""
)
def conform(spark, sf_dir):
    events = s.table(spark, sf_dir, "events")
    loose = events.select(
        "user_id", F.col("event_type").alias("kind"), "event_id", F.col("event_id").alias("code")
    )
    return tables.conform(loose, files.T.StructType.fromDDL("event_id long, code string, kind int, user_id int"))


UPSERTED = """SELECT cs.id, cs.title, coalesce(CAST(st.message_count AS INTEGER), cs.message_count) AS message_count,
          coalesce(st.last_message_at, cs.last_message_at) AS last_message_at
   FROM chat_sessions cs LEFT JOIN (SELECT chat_session_id, count(*) AS message_count, max(created_at) AS last_message_at
                                    FROM messages GROUP BY 1) st ON st.chat_session_id = cs.id"""


@query(UPSERTED, "chat_sessions messages")
def upsert(spark, sf_dir):
    """Session counters replaced by what the messages say."""
    return tables.upsert(*session_changes(spark, sf_dir), "id")


def session_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sessions, and the counters that the messages give some of them."""
    base = s.chat_sessions(spark, sf_dir).select("id", "title", "message_count", "last_message_at")
    stats = chat.session_stats(s.messages(spark, sf_dir)).select(
        F.col("chat_session_id").alias("id"), F.col("message_count").cast("int").alias("message_count"), "last_message_at"
    )
    return base, stats


CASCADED = """WITH gone AS (SELECT id FROM chat_users WHERE id % 4 = 1),
        closed AS (SELECT id FROM chat_sessions WHERE user_id IN (SELECT id FROM gone)),
        seats AS (SELECT 2 * id + g AS id, id AS chat_session_id, user_id + g AS user_id
                  FROM chat_sessions, (VALUES (0), (1)) t(g))
   SELECT 'users' AS "table", id FROM chat_users WHERE id % 4 <> 1
   UNION ALL SELECT 'chat_sessions', id FROM chat_sessions WHERE user_id NOT IN (SELECT id FROM gone)
   UNION ALL SELECT 'messages', id FROM messages WHERE chat_session_id NOT IN (SELECT id FROM closed)
   UNION ALL SELECT 'message_images', id FROM message_images WHERE message_id NOT IN (
     SELECT id FROM messages WHERE chat_session_id IN (SELECT id FROM closed))
   UNION ALL SELECT 'chat_participants', id FROM seats
     WHERE chat_session_id NOT IN (SELECT id FROM closed) AND user_id NOT IN (SELECT id FROM gone)"""


@query(CASCADED, "chat_users chat_sessions messages message_images")
def cascade_delete(spark, sf_dir):
    """A quarter of the users removed with all that hangs on them, their seats in others' sessions too."""
    base, links = chat_links(spark, sf_dir)
    gone = base["users"].where("id % 4 = 1")
    kept = tables.cascade_delete(base, "users", gone, "id", links)
    return quality.union_all(*[df.select(F.lit(name).alias("table"), "id") for name, df in kept.items()])


def chat_links(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, list]]:
    """The keys of the chat tables, and the parents of each."""
    sessions = s.chat_sessions(spark, sf_dir)
    guest = F.explode(F.array(F.lit(0), F.lit(1))).alias("g")
    seats = sessions.select("id", "user_id", guest).select(
        (F.col("id") * 2 + F.col("g")).alias("id"), F.col("id").alias("chat_session_id"),
        (F.col("user_id") + F.col("g")).alias("user_id"),
    )
    base = {
        "users": s.chat_users(spark, sf_dir).select("id"),
        "chat_sessions": sessions.select("id", "user_id"),
        "messages": s.messages(spark, sf_dir).select("id", "chat_session_id"),
        "message_images": s.message_images(spark, sf_dir).select("id", "message_id"),
        "chat_participants": seats,
    }
    links: dict[str, list] = {}
    for link in FOREIGN_KEYS:
        if link.child in base:
            links.setdefault(link.child, []).append((link.parent, link.child_column))
    return base, links


# -- streaming -----------------------------------------------------------------------------------


def _run_stream(updates: DataFrame, key: str, name: str, **how) -> DataFrame:
    spark = updates.sparkSession
    folder, checkpoint = stage_path(spark, name), stage_path(spark, f"{name}-checkpoint")
    live.write_updates(updates, folder, checkpoint, key=key, **how).awaitTermination()
    return live.current_state(spark, folder, key)


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of several micro-batches."""
    df = s.table(spark, sf_dir, name)
    folder = stage_path(spark, f"{name}-stream")
    df.repartition(3).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


STREAMED = """SELECT chat_session_id, CAST(sum(CASE WHEN sender_type = 'system' THEN 0 ELSE 1 END) AS BIGINT) AS message_count,
          max(created_at) AS last_message_at FROM messages GROUP BY 1"""


def _message_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message arrives as an insert, twice; system messages are deleted again."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    offset = F.make_dt_interval(secs=F.col("conv_id") * 60 + F.floor(F.col("turn") / 2))
    ops = F.when(F.col("role") == "system", F.array(F.lit("insert"), F.lit("insert"), F.lit("delete"))).otherwise(
        F.array(F.lit("insert"), F.lit("insert"))
    )
    return _stream(spark, sf_dir, "conversations").select(
        F.concat(F.lit("m-"), number.cast("string")).alias("uuid"),
        F.col("conv_id").alias("chat_session_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + offset).alias("created_at"),
        F.explode(ops).alias("op"),
    )


@query(STREAMED, "messages")
def stream_session_stats(spark, sf_dir):
    return _session_stats(spark, sf_dir)


@query(STREAMED, "messages")
def compacted_session_stats(spark, sf_dir):
    """The same from a log that is compacted after every batch."""
    return _session_stats(spark, sf_dir, compact_every=1)


def _session_stats(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    updates = live.stream_session_stats(_message_changes(spark, sf_dir))
    state = _run_stream(updates, "chat_session_id", "session-stats", **how)
    return state.withColumn("last_message_at", F.col("last_message_at").cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS updated_at FROM events GROUP BY 1")
def stream_touch(spark, sf_dir):
    touched = live.stream_touch(_stream(spark, sf_dir, "events"), "user_id", "ts")
    state = _run_stream(touched, "user_id", "touched")
    return state.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
