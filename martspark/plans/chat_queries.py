"""Chat tables, context windows, routing and chat writes as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.functions import scalars, text
from martspark.operators import chat, quality, scale
from martspark.operators import chat_writes as writes
from martspark.plans import samples as s
from martspark.plans.registry import query
from martspark.session import stage


# -- chat ----------------------------------------------------------------------------------------


@query(
    """SELECT cs.id, cs.uuid, title, message_count, created_at, last_message_at, u.name AS user_name, u.email AS user_email
       FROM chat_sessions cs JOIN chat_users u ON cs.user_id = u.id WHERE is_active""",
    "chat_sessions chat_users",
)
def active_sessions(spark, sf_dir):
    return chat.active_sessions(s.chat_sessions(spark, sf_dir), s.chat_users(spark, sf_dir))


@query("SELECT user_id, count(*) AS total FROM chat_sessions WHERE is_active GROUP BY 1", "chat_sessions")
def active_session_total(spark, sf_dir):
    return chat.active_session_total(s.chat_sessions(spark, sf_dir))


@query("SELECT id, user_id, title FROM chat_sessions WHERE is_active", "chat_sessions")
def active_for_user(spark, sf_dir):
    return chat.active_for_user(s.chat_sessions(spark, sf_dir)).select("id", "user_id", "title")


@query("SELECT min(id) AS id FROM chat_users", "chat_users")
def default_user(spark, sf_dir):
    return chat.default_user(s.chat_users(spark, sf_dir))


_PAGE = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                     ORDER BY last_message_at DESC NULLS LAST, created_at DESC, id) AS place
                   FROM chat_sessions WHERE is_active)
    WHERE place BETWEEN 3 AND 7"""


@query(f"SELECT id, uuid, user_id, created_at, last_message_at FROM ({_PAGE})", "chat_sessions")
def list_sessions(spark, sf_dir):
    page = chat.list_sessions(s.chat_sessions(spark, sf_dir), limit=5, offset=2)
    return page.select("id", "uuid", "user_id", "created_at", "last_message_at")


@query(
    f"""SELECT p.user_id, uuid AS id, CASE WHEN coalesce(title, '') = '' THEN 'New Chat' ELSE title END AS title,
               message_count, created_at, last_message_at, total
        FROM ({_PAGE}) p JOIN (SELECT user_id, count(*) AS total FROM chat_sessions WHERE is_active GROUP BY 1) t
             ON p.user_id = t.user_id""",
    "chat_sessions",
)
def chat_list(spark, sf_dir):
    return chat.chat_list(s.chat_sessions(spark, sf_dir), limit=5, offset=2)


@query(
    """SELECT id, user_id, (place - 1) // 4 AS page FROM (
         SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS LAST, created_at DESC, id) AS place
         FROM chat_sessions WHERE is_active)""",
    "chat_sessions",
)
def pages_by_cursor(spark, sf_dir):
    """All sessions of all users, four at a time, each page behind the last row of the one before."""
    sessions = chat.deal_sessions(s.chat_sessions(spark, sf_dir).select("user_id", "is_active", *chat.CURSOR))
    cursor, pages = None, []
    while True:
        page = stage(chat.sessions_after(sessions, cursor, limit=4), "page")
        if page.isEmpty():
            return quality.union_all(*pages)
        pages.append(page.select("id", "user_id", F.lit(len(pages)).cast("long").alias("page")))
        cursor = stage(chat.page_cursors(page, cursor), "cursors")


@query(
    """SELECT doc_id, CASE WHEN length("text") > 50 THEN substring("text", 1, 50) || '...'
                           WHEN coalesce("text", '') = '' THEN 'New Chat' ELSE "text" END AS title
       FROM documents"""
)
def session_title(spark, sf_dir):
    return s.table(spark, sf_dir, "documents").select("doc_id", chat.session_title("text").alias("title"))


_SESSION_STATS = """
    SELECT chat_session_id, count(*) AS message_count, max(created_at) AS last_message_at FROM messages GROUP BY 1"""


@query(_SESSION_STATS, "messages")
def session_stats(spark, sf_dir):
    return chat.session_stats(s.messages(spark, sf_dir))


@query("SELECT id, chat_session_id, sender_type, created_at FROM messages ORDER BY created_at, id", "messages")
def ordered_messages(spark, sf_dir):
    rows = chat.ordered_messages(s.messages(spark, sf_dir))
    return rows.select("id", "chat_session_id", "sender_type", "created_at")


@query(
    """SELECT id, sender_type, content FROM messages
       WHERE chat_session_id = (SELECT chat_session_id FROM messages ORDER BY created_at DESC, id DESC LIMIT 1)""",
    "messages",
)
def messages_of(spark, sf_dir):
    """The session that was written to last, found through its external id."""
    rows = s.messages(spark, sf_dir)
    latest = rows.agg(F.max_by("chat_session_id", F.struct("created_at", "id")).alias("id"))
    uuid = latest.select(F.concat(F.lit("chat-"), F.col("id").cast("string"))).scalar()
    found = chat.messages_of(uuid, s.chat_sessions(spark, sf_dir), rows)
    return found.select("id", "sender_type", "content")


@query(
    """SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY id) - 1 AS position,
              count(*) OVER (PARTITION BY message_id) AS image_count, image_url AS url, thumbnail_url, file_name, width
       FROM message_images""",
    "message_images",
)
def collect_images(spark, sf_dir):
    rows = chat.collect_images(s.message_images(spark, sf_dir))
    return rows.select(
        "message_id", "position", "image_count", "image.url", "image.thumbnail_url",
        F.col("image.fileName").alias("file_name"), "image.width",
    )


@query(
    """SELECT m.id, m.sender_type, image_url AS url, count(i.id) OVER (PARTITION BY m.id) AS image_count,
              CASE WHEN i.id IS NOT NULL THEN row_number() OVER (PARTITION BY m.id ORDER BY i.id) - 1 END AS position
       FROM messages m LEFT JOIN message_images i ON m.id = i.message_id""",
    "messages message_images",
)
def messages_with_images(spark, sf_dir):
    joined = chat.messages_with_images(s.messages(spark, sf_dir), s.message_images(spark, sf_dir))
    return joined.select("id", "sender_type", "image.url", "image_count", "position")


@query(
    """SELECT cs.uuid AS chat_id, cs.title, m.uuid AS id, CASE WHEN sender_type = 'user' THEN 'user' WHEN m.id IS NOT NULL THEN 'ai' END AS role,
              content, m.created_at, coalesce(thumbnail_url, image_url) AS thumbnail_url, file_name, width,
              CASE WHEN i.id IS NOT NULL THEN row_number() OVER (PARTITION BY m.id ORDER BY i.id) - 1 END AS position
       FROM chat_sessions cs LEFT JOIN messages m ON m.chat_session_id = cs.id
            LEFT JOIN message_images i ON i.message_id = m.id AND length(image_url) > 0
       WHERE is_active""",
    "chat_sessions messages message_images",
)
def chat_detail(spark, sf_dir):
    detail = chat.chat_detail(
        s.chat_sessions(spark, sf_dir), s.messages(spark, sf_dir), s.message_images(spark, sf_dir)
    )
    return detail.select(
        "chat_id", "title", "id", "role", "content", "created_at", "image.thumbnail_url",
        F.col("image.fileName").alias("file_name"), "image.width", "position",
    )


@query(
    """SELECT id, CASE WHEN sender_type = 'user' THEN 'user' ELSE 'assistant' END AS role FROM messages
       WHERE trim(content) <> ''""",
    "messages",
)
def non_blank(spark, sf_dir):
    rows = chat.non_blank(s.messages(spark, sf_dir))
    return rows.select("id", scalars.map_role("sender_type").alias("role"))


@query(
    """SELECT id, chat_session_id, content FROM messages
       QUALIFY row_number() OVER (PARTITION BY chat_session_id ORDER BY created_at DESC, id DESC) <= 3""",
    "messages",
)
def last_n_per_group(spark, sf_dir):
    latest = scale.last_n_per_group(s.messages(spark, sf_dir), "chat_session_id", chat.MESSAGE_ORDER, 3)
    return latest.select("id", "chat_session_id", "content")


@query(
    """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position,
              count(*) OVER (PARTITION BY o_custkey) AS total FROM orders"""
)
def positions(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return scale.positions(orders, ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", total="total")


@query(
    """WITH latest AS (
         SELECT *, row_number() OVER (PARTITION BY chat_session_id ORDER BY created_at DESC, id DESC) AS back FROM messages)
       SELECT chat_session_id, CAST(count(*) FILTER (WHERE back <= 4 AND trim(content) <> '') + 2 AS INTEGER) AS entries,
              'system: You are a marketing assistant.' || chr(10)
              || string_agg(CASE WHEN sender_type = 'user' THEN 'user' ELSE 'assistant' END || ': ' || content, chr(10)
                            ORDER BY created_at, id) FILTER (WHERE back <= 4 AND trim(content) <> '') || chr(10)
              || 'user: ' || max(content) FILTER (WHERE back = 1)
              || CASE WHEN chat_session_id % 2 = 0
                      THEN chr(10) || 'Attached images:' || chr(10) || 'Image 1: a/' || max(uuid) FILTER (WHERE back = 1)
                           || chr(10) || 'Image 2: b/' || max(uuid) FILTER (WHERE back = 1)
                      ELSE '' END AS prompt
       FROM latest GROUP BY chat_session_id""",
    "messages",
)
def prompt_payloads(spark, sf_dir):
    """Each session's last message asked again; in every second session the request brings two images."""
    rows = s.messages(spark, sf_dir)
    last = rows.groupBy("chat_session_id").agg(
        F.max_by(F.struct("content", "uuid"), F.struct("created_at", "id")).alias("m")
    )
    urls = F.array(F.concat(F.lit("a/"), "m.uuid"), F.concat(F.lit("b/"), "m.uuid"))
    current = last.select(
        "chat_session_id",
        F.col("m.content").alias("text"),
        F.when(F.col("chat_session_id") % 2 == 0, urls).alias("image_urls"),
    )
    payloads = chat.prompt_payloads(rows, "You are a marketing assistant.", 4, current)
    lines = F.transform("payload", lambda p: F.concat(p["role"], F.lit(": "), p["content"]))
    return payloads.select(
        "chat_session_id", F.size("payload").alias("entries"), text.join_lines(lines).alias("prompt")
    )


_QUESTIONS = """
    SELECT conv_id, turn, "text" || CASE WHEN turn = 0 THEN ' How many transactions in TOTAL?'
                                       WHEN turn = 1 THEN ' Do you Remember my name, as I told you earlier?'
                                       ELSE '' END AS q FROM conversations"""

_MEMORY = (
    "['" + "', '".join(chat.MEMORY_KEYWORDS) + "']"
)
_DATA = "['" + "', '".join(chat.DATA_KEYWORDS) + "']"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = (
        F.when(F.col("turn") == 0, " How many transactions in TOTAL?")
        .when(F.col("turn") == 1, " Do you Remember my name, as I told you earlier?")
        .otherwise("")
    )
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", ending).alias("q"))


@query(
    f"""SELECT conv_id, turn, len(m) = 0 AND len(d) > 0 AS needs_private_data,
               CASE WHEN len(m) = 0 AND len(d) > 0 THEN 'CustomerWarehouse,MarketingDataMart' ELSE '' END AS databases,
               CASE WHEN len(m) > 0 THEN 'memory_query' WHEN len(d) > 0 THEN 'data_query' ELSE 'conversational' END AS query_type,
               CASE WHEN len(m) > 0 THEN 'memory keywords: ' || array_to_string(m, ', ')
                    WHEN len(d) > 0 THEN 'data keywords' ELSE 'no keywords' END AS reasoning
        FROM (SELECT conv_id, turn, list_filter({_MEMORY}, lambda k: contains(lower(q), k)) AS m,
                     list_filter({_DATA}, lambda k: contains(lower(q), k)) AS d FROM ({_QUESTIONS}))"""
)
def route_questions(spark, sf_dir):
    routed = chat.route_questions(questions(spark, sf_dir), "q")
    return routed.select(
        "conv_id", "turn", "needs_private_data",
        F.array_join("databases_needed", ",").alias("databases"), "query_type", "reasoning",
    )


# -- chat writes ---------------------------------------------------------------------------------


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests: English ones to an order's chat, French ones to somebody else's."""
    lang = F.col("lang")
    image = F.struct(
        F.col("source").alias("url"), F.lit(None).cast("string").alias("thumbnail_url"),
        F.lit(None).cast("string").alias("file_id"), F.lit(None).cast("string").alias("fileName"),
        F.col("n_chars").cast("int").alias("width"), F.lit(1).alias("height"),
    )
    images = F.when(F.col("n_chars") > 1000, F.array(image, image)).otherwise(F.array().cast(
        "array<struct<url:string,thumbnail_url:string,file_id:string,fileName:string,width:int,height:int>>"))
    joined = s.table(spark, sf_dir, "documents").join(
        s.table(spark, sf_dir, "orders"), F.col("doc_id") == F.col("o_orderkey")
    )
    return joined.select(
        F.col("doc_id").alias("request_id"),
        (F.col("o_custkey") + (lang == "fr").cast("int")).alias("user_id"),
        F.when(lang.isin("en", "fr"), F.concat(F.lit("chat-"), F.col("doc_id").cast("string"))).alias("chat_uuid"),
        "text",
        images.alias("images"),
        F.concat(F.lit("Noted: "), lang).alias("reply"),
        (F.lit("2024-06-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id"))).alias("created_at"),
    )


def chat_writes(spark: SparkSession, sf_dir: str) -> writes.ChatWrites:
    return writes.apply_requests(
        chat_requests(spark, sf_dir), s.chat_sessions(spark, sf_dir), s.messages(spark, sf_dir),
        s.message_images(spark, sf_dir),
    )


_REQUESTS = """
    SELECT d.*, o_custkey, o_orderstatus <> 'F' AND lang = 'en' AS existing, lang NOT IN ('en', 'fr') AS opens,
           TIMESTAMP '2024-06-01 00:00:00' + to_seconds(doc_id) AS moment
    FROM documents d JOIN orders ON doc_id = o_orderkey"""
_ACCEPTED = f"""
    SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS no FROM ({_REQUESTS}) WHERE existing OR opens"""


@query(
    f"""SELECT (SELECT max(id) + 1 FROM messages) + 2 * no + turn AS id,
               CASE WHEN opens THEN (SELECT max(id) + 1 FROM chat_sessions) + no ELSE doc_id END AS chat_session_id,
               CASE turn WHEN 0 THEN 'user' ELSE 'assistant' END AS sender_type,
               CASE turn WHEN 0 THEN "text" ELSE 'Noted: ' || lang END AS content,
               CASE WHEN turn = 0 AND n_chars > 1000 THEN 'mixed' ELSE 'text' END AS content_type, moment AS created_at
        FROM ({_ACCEPTED}), (VALUES (0), (1)) t(turn)""",
    "messages chat_sessions",
)
def write_messages(spark, sf_dir):
    rows = chat_writes(spark, sf_dir).messages
    return rows.select("id", "chat_session_id", "sender_type", "content", "content_type", "created_at")


@query(
    f"""SELECT (SELECT max(id) FROM message_images) + row_number() OVER (ORDER BY no, i) AS id,
               (SELECT max(id) + 1 FROM messages) + 2 * no AS message_id, source AS image_url,
               CAST(n_chars AS INTEGER) AS width
        FROM ({_ACCEPTED}), (VALUES (0), (1)) t(i) WHERE n_chars > 1000""",
    "messages message_images",
)
def write_images(spark, sf_dir):
    return chat_writes(spark, sf_dir).images.select("id", "message_id", "image_url", "width")


@query(
    f"""WITH moved AS (
          SELECT CASE WHEN opens THEN (SELECT max(id) + 1 FROM chat_sessions) + no ELSE doc_id END AS id,
                 o_custkey AS user_id, opens, "text", moment FROM ({_ACCEPTED}))
        SELECT c.id, c.user_id, c.title, CAST(c.message_count + CASE WHEN m.id IS NULL THEN 0 ELSE 2 END AS INTEGER)
                 AS message_count, coalesce(m.moment, c.last_message_at) AS last_message_at
        FROM chat_sessions c LEFT JOIN moved m ON c.id = m.id
        UNION ALL
        SELECT id, user_id, CASE WHEN length("text") > 50 THEN substring("text", 1, 50) || '...'
                                 WHEN coalesce("text", '') = '' THEN 'New Chat' ELSE "text" END, 2, moment
        FROM moved WHERE opens""",
    "chat_sessions",
)
def write_sessions(spark, sf_dir):
    after = chat_writes(spark, sf_dir).sessions
    return after.select("id", "user_id", "title", "message_count", "last_message_at")


@query(f"SELECT doc_id AS request_id FROM ({_REQUESTS}) WHERE NOT existing AND NOT opens")
def rejected_requests(spark, sf_dir):
    return chat_writes(spark, sf_dir).rejected.select("request_id")
