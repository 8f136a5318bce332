"""The model tables expressed over the given test tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.schemas import CONTENT_TYPES, MESSAGE_STATUSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transactions; the service is a four-digit code text."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trans_id"),
        "user_id",
        F.col("ts").alias("trans_timestamp"),
        F.col("value").alias("trans_amount"),
        F.lpad(F.get_json_object("props", "$.k"), 4, "0").alias("trans_service"),
    )


def order_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions over several years; the service is a plain name."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trans_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("trans_timestamp"),
        F.col("o_totalprice").alias("trans_amount"),
        F.col("o_orderpriority").alias("trans_service"),
    )


def dim_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"),
        (F.lit(15) + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("c_mktsegment").alias("gender"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("latitude"),
        (F.col("c_nationkey") * 14.5 - 180).alias("longitude"),
    )


def mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as codes, several of them with one description: their region."""
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").cast("bigint").alias("mcc"), F.col("r_name").alias("description"))


def chat_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("uuid"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.concat(address, F.lit("@example.com"))).otherwise(address).alias("email"),
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions of their customer."""
    seconds = F.make_dt_interval(secs=F.col("o_orderkey") % 86400)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("chat-"), F.col("o_orderkey").cast("string")).alias("uuid"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.floor(F.col("o_totalprice") / 10000).cast("int").alias("message_count"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") + seconds).alias("last_message_at"),
    )


# The declared values and one that is not among them.
_CONTENTS = (*CONTENT_TYPES, "video")
_STATES = (*MESSAGE_STATUSES, "lost")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; pairs of turns share a time, so the id breaks ties."""
    number = F.col("conv_id") * 1000 + F.col("turn")
    offset = F.make_dt_interval(secs=F.col("conv_id") * 60 + F.floor(F.col("turn") / 2))
    return table(spark, sf_dir, "conversations").select(
        number.alias("id"),
        F.concat(F.lit("m-"), number.cast("string")).alias("uuid"),
        F.col("conv_id").alias("chat_session_id"),
        F.col("role").alias("sender_type"),
        F.col("text").alias("content"),
        F.element_at(F.array(*map(F.lit, _CONTENTS)), (F.length("text") % 5 + 1).cast("int")).alias("content_type"),
        F.element_at(F.array(*map(F.lit, _STATES)), (F.col("conv_id") % 7 + 1).cast("int")).alias("status"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + offset).alias("created_at"),
    )


def message_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as images, three on the first message of a conversation."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"),
        (F.floor(F.col("page_id") / 3) * 1000).alias("message_id"),
        F.col("url").alias("image_url"),
        F.when(F.col("url").startswith("https"), F.concat("url", F.lit("?thumb"))).alias("thumbnail_url"),
        F.concat(F.lit("f-"), F.col("page_id").cast("string")).alias("imagekit_file_id"),
        F.substring_index("url", "/", -1).alias("file_name"),
        F.length("html").alias("width"),
        F.length("url").alias("height"),
    )


# The same tables for the oracle, as named subqueries.
SQL = {
    "fact_trans": """
        SELECT event_id AS trans_id, user_id, ts AS trans_timestamp, value AS trans_amount,
               lpad(json_extract_string(props, '$.k'), 4, '0') AS trans_service
        FROM events""",
    "order_trans": """
        SELECT o_orderkey AS trans_id, o_custkey AS user_id, o_orderdate AS trans_timestamp,
               o_totalprice AS trans_amount, o_orderpriority AS trans_service
        FROM orders""",
    "dim_users": """
        SELECT c_custkey AS user_id, CAST(15 + c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS gender,
               n_name AS city, r_name AS state,
               CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 END AS latitude,
               CAST(c_nationkey AS DOUBLE) * 14.5::DOUBLE - 180 AS longitude
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "mcc_lookup": """
        SELECT CAST(n_nationkey AS BIGINT) AS mcc, r_name AS description
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "chat_users": """
        SELECT c_custkey AS id, 'user-' || c_custkey AS uuid, c_name AS name,
               lower(replace(c_name, '#', '.')) || CASE WHEN c_acctbal >= 0 THEN '@example.com' ELSE '' END AS email
        FROM customer""",
    "chat_sessions": """
        SELECT o_orderkey AS id, 'chat-' || o_orderkey AS uuid, o_custkey AS user_id,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS title,
               o_orderstatus <> 'F' AS is_active,
               CAST(floor(o_totalprice / 10000) AS INTEGER) AS message_count,
               o_orderdate AS created_at,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate + to_seconds(o_orderkey % 86400) END
                   AS last_message_at
        FROM orders""",
    "messages": """
        SELECT conv_id * 1000 + turn AS id, 'm-' || (conv_id * 1000 + turn) AS uuid,
               conv_id AS chat_session_id, role AS sender_type, "text" AS content,
               ['text', 'image', 'file', 'mixed', 'video'][length("text") % 5 + 1] AS content_type,
               ['draft', 'sending', 'sent', 'delivered', 'failed', 'deleted', 'lost'][conv_id % 7 + 1] AS status,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 60 + turn // 2) AS created_at
        FROM conversations""",
    "message_images": """
        SELECT page_id AS id, (page_id // 3) * 1000 AS message_id, url AS image_url,
               CASE WHEN starts_with(url, 'https') THEN url || '?thumb' END AS thumbnail_url,
               'f-' || page_id AS imagekit_file_id,
               split_part(url, '/', -1) AS file_name,
               CAST(length(html) AS INTEGER) AS width, CAST(length(url) AS INTEGER) AS height
        FROM pages""",
    # Derived steps several oracles share.
    "rfm": """
        SELECT user_id, max(trans_timestamp) AS last_trans_date, count(trans_amount) AS frequency,
               sum(trans_amount) AS monetary,
               CAST(datediff('day', max(trans_timestamp), (SELECT max(trans_timestamp) FROM fact_trans)) AS INTEGER)
                   AS recency
        FROM fact_trans GROUP BY user_id""",
    "order_rfm": """
        SELECT user_id, max(trans_timestamp) AS last_trans_date, count(trans_amount) AS frequency,
               sum(trans_amount) AS monetary,
               CAST(datediff('day', max(trans_timestamp), (SELECT max(trans_timestamp) FROM order_trans)) AS INTEGER)
                   AS recency
        FROM order_trans GROUP BY user_id""",
    "standard": """
        SELECT rfm.*, (frequency - mf) / sf AS z_frequency, (monetary - mm) / sm AS z_monetary,
               (recency - mr) / CASE WHEN sr = 0 THEN 1 ELSE sr END AS z_recency
        FROM rfm, (SELECT avg(frequency) AS mf, stddev_pop(frequency) AS sf, avg(monetary) AS mm,
                          stddev_pop(monetary) AS sm, avg(recency) AS mr, stddev_pop(recency) AS sr FROM rfm)""",
    "clusters": """
        SELECT user_id, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 'Top Users'
                             WHEN d2 <= d3 THEN 'Loyal Users' ELSE 'At-Risk Users' END AS cluster
        FROM (SELECT user_id,
                     pow(z_frequency - 1, 2) + pow(z_monetary - 1, 2) + pow(z_recency + 0.5, 2) AS d1,
                     pow(z_frequency, 2) + pow(z_monetary, 2) + pow(z_recency, 2) AS d2,
                     pow(z_frequency + 1, 2) + pow(z_monetary + 1, 2) + pow(z_recency - 1, 2) AS d3
              FROM standard)""",
    "clustered": "SELECT u.*, c.cluster FROM dim_users u LEFT JOIN clusters c ON u.user_id = c.user_id",
    "service_count": """
        SELECT coalesce(description, trans_service) AS service, CAST(count(trans_id) AS BIGINT) AS count
        FROM fact_trans LEFT JOIN mcc_lookup ON TRY_CAST(trans_service AS BIGINT) = mcc GROUP BY 1""",
    "age_count": "SELECT age, cluster, count(user_id) AS count FROM clustered GROUP BY age, cluster",
    "gender_count": "SELECT gender, cluster, count(user_id) AS count FROM clustered GROUP BY gender, cluster",
    "trans_by_day": """
        SELECT CAST(hour(trans_timestamp) AS INTEGER) AS "hour", count(trans_id) AS count
        FROM fact_trans GROUP BY 1""",
}

# What each named subquery reads besides the given tables.
_NEEDS = {
    "rfm": ["fact_trans"],
    "order_rfm": ["order_trans"],
    "standard": ["rfm"],
    "clusters": ["standard"],
    "clustered": ["dim_users", "clusters"],
    "service_count": ["fact_trans", "mcc_lookup"],
    "age_count": ["clustered"],
    "gender_count": ["clustered"],
    "trans_by_day": ["fact_trans"],
}


def with_tables(names: str, select: str) -> str:
    """`select` with the named subqueries it uses, and those they use, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    if not order:
        return select
    shared = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    own = select.lstrip()
    return f"{shared},\n{own.removeprefix('WITH ')}" if own.startswith("WITH ") else f"{shared}\n{own}"


# Fixed model used by the queries that need clusters with a known answer: z-score centroids.
FROZEN_MODEL = (
    ("Top Users", (1.0, 1.0, -0.5)),
    ("Loyal Users", (0.0, 0.0, 0.0)),
    ("At-Risk Users", (-1.0, -1.0, 1.0)),
)
