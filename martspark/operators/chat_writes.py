"""Chat requests as rows: new sessions, messages and images, and the counters they move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.operators.chat import IMAGE_FIELDS, session_stats, session_title
from martspark.operators.scale import positions, salted_join
from martspark.session import stage
from martspark.sources.tables import touch


@dataclass(frozen=True)
class ChatWrites:
    """Rows to append, the session table as it is afterwards, and the refused requests."""

    new_sessions: DataFrame
    messages: DataFrame
    images: DataFrame
    sessions: DataFrame
    rejected: DataFrame


def stable_uuid(*parts: Column | str) -> Column:
    """An id of the usual form that depends on the parts only, so that a repeated job repeats it."""
    return F.regexp_replace(
        F.md5(F.concat_ws(":", *parts).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def _next_id(table: DataFrame) -> Column:
    return table.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()


def apply_requests(
    requests: DataFrame, sessions: DataFrame, messages: DataFrame, images: DataFrame
) -> ChatWrites:
    """What a batch of chat requests writes.

    A request (request_id, user_id, chat_uuid, text, images, reply, created_at) adds the user's
    message with its images and the reply. Without `chat_uuid` it opens a session titled by the
    text; otherwise the session must be active and belong to the user, or the request is refused.
    Row numbers continue those of the tables, in order of request_id (an integer).
    """
    heads = sessions.where(F.col("is_active")).select(
        F.col("uuid").alias("chat_uuid"), F.col("id").alias("_session"), F.col("user_id").alias("_owner")
    )
    # Any share of the requests may go to one chat, and new chats have no key at all.
    # Salted by their id: the numbering measures the requests in passes that read no texts.
    looked_up = salted_join(requests, heads, ["chat_uuid"], "left", salt_by=["request_id"])
    opens = F.col("chat_uuid").isNull()
    allowed = F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    numbered = positions(
        looked_up.where(opens | allowed), [], [F.col("request_id")], "request_id", "_no"
    )
    # Read by every result below.
    accepted = stage(
        numbered.select(
            *requests.columns,
            "_no",
            opens.alias("_opens"),
            F.coalesce("_session", _next_id(sessions) + F.col("_no")).alias("_session"),
        ),
        "chat-requests",
    )

    opened = accepted.where("_opens").select(
        F.col("_session").alias("id"),
        stable_uuid(F.lit("chat"), "request_id").alias("uuid"),
        "user_id",
        session_title("text").alias("title"),
        F.lit(True).alias("is_active"),
        F.lit(0).alias("message_count"),
        "created_at",
        F.col("created_at").alias("last_message_at"),
    )
    has_images = F.coalesce(F.size("images"), F.lit(0)) > 0
    asked = F.struct(
        F.lit(0).alias("turn"),
        F.lit("user").alias("sender_type"),
        F.col("text").alias("content"),
        F.when(has_images, F.lit("mixed")).otherwise(F.lit("text")).alias("content_type"),
    )
    answered = F.struct(
        F.lit(1).alias("turn"),
        F.lit("assistant").alias("sender_type"),
        F.col("reply").alias("content"),
        F.lit("text").alias("content_type"),
    )
    first_message = _next_id(messages)
    written = accepted.select(
        "request_id", "_no", "_session", "created_at", F.inline(F.array(asked, answered))
    ).select(
        (first_message + F.col("_no") * 2 + F.col("turn")).alias("id"),
        stable_uuid(F.lit("message"), "request_id", "turn").alias("uuid"),
        F.col("_session").alias("chat_session_id"),
        "sender_type",
        "content",
        "content_type",
        F.lit("sent").alias("status"),
        "created_at",
    )
    attached = accepted.select("_no", "created_at", F.posexplode("images").alias("_i", "image"))
    placed = positions(attached, [], [F.col("_no"), F.col("_i")], "_no", "_image")
    pictures = placed.select(
        (_next_id(images) + F.col("_image")).alias("id"),
        (first_message + F.col("_no") * 2).alias("message_id"),
        *[F.col(f"image.{name}").alias(column) for column, name in IMAGE_FIELDS.items()],
        F.lit("uploaded").alias("upload_status"),
        "created_at",
    )

    moved = session_stats(written).select(
        F.col("chat_session_id").alias("id"),
        F.col("message_count").alias("_added"),
        F.col("last_message_at").alias("_last"),
    )
    known = [c for c in sessions.columns if c in opened.columns]
    every = sessions.unionByName(opened.select(*known), allowMissingColumns=True).join(moved, "id", "left")
    if "updated_at" in sessions.columns:
        every = touch(every, F.col("_last").isNotNull(), F.col("_last"))
    after = every.withColumns({
        "message_count": (F.col("message_count") + F.coalesce("_added", F.lit(0))).cast("int"),
        "last_message_at": F.coalesce("_last", "last_message_at"),
    }).select(*sessions.columns)
    refused = looked_up.where(~(opens | allowed)).select(*requests.columns)
    return ChatWrites(opened, written, pictures, after, refused)
