"""Declared schemas, keys, references and value rules of the model tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_I, _L, _D, _S = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
_B, _TS, _NTZ = T.BooleanType(), T.TimestampType(), T.TimestampNTZType()


# Key of a column's metadata: the characters that its texts may have.
LENGTH = "length"


def _schema(*columns: tuple) -> T.StructType:
    """Columns as (name, type), (name, type, nullable) or (name, type, nullable, characters at most)."""
    return T.StructType([
        T.StructField(c[0], c[1], c[2] if len(c) > 2 else True, {LENGTH: c[3]} if len(c) > 3 else None)
        for c in columns
    ])


DIM_USERS = _schema(
    ("user_id", _I, False), ("age", _I), ("birth_month", _I), ("birth_year", _I), ("gender", _S),
    ("address", _S), ("city", _S), ("state", _S), ("zipcode", _S), ("latitude", _D),
    ("longitude", _D), ("yearly_income", _D), ("num_credit_cards", _I),
)
DIM_CARD = _schema(("card_id", _I, False), ("card_type", _S))
# As delivered the timestamp is text; FACT_TRANS is the loaded form.
FACT_TRANS_RAW = _schema(
    ("trans_id", _L, False), ("user_id", _I), ("card_id", _I), ("trans_timestamp", _S),
    ("trans_amount", _D), ("trans_service", _S),
)
FACT_TRANS = _schema(
    ("trans_id", _L, False), ("user_id", _I), ("card_id", _I), ("trans_timestamp", _NTZ),
    ("trans_amount", _D), ("trans_service", _S),
)
MCC_CODES_RAW = _schema(
    ("mcc", _L), ("edited_description", _S), ("combined_description", _S),
    ("usda_description", _S), ("irs_description", _S), ("irs_reportable", _S),
)

MART = {
    "age_count": _schema(("age", _I), ("count", _L), ("cluster", _S, True, 50)),
    "gender_count": _schema(("gender", _S, True, 20), ("count", _L), ("cluster", _S, True, 50)),
    "service_count": _schema(("service", _S, True, 100), ("count", _L)),
    "user_geo": _schema(
        ("longitude", _D), ("latitude", _D), ("city", _S, True, 100), ("country", _S, True, 100), ("cluster", _S, True, 50)
    ),
    "trans_by_day": _schema(("hour", _I), ("count", _L)),
    "stats": _schema(
        ("new_users", _L), ("returning_users", _L), ("new_transactions", _L), ("avg_clv", _D)
    ),
}

CHAT = {
    "users": _schema(
        ("id", _L, False), ("uuid", _S, False), ("name", _S, False), ("email", _S, False),
        ("avatar_url", _S), ("is_active", _B), ("created_at", _TS), ("updated_at", _TS),
        ("last_active_at", _TS),
    ),
    "chat_sessions": _schema(
        ("id", _L, False), ("uuid", _S, False), ("user_id", _L, False), ("title", _S),
        ("description", _S), ("is_active", _B), ("message_count", _I), ("created_at", _TS),
        ("updated_at", _TS), ("last_message_at", _TS),
    ),
    "messages": _schema(
        ("id", _L, False), ("uuid", _S, False), ("chat_session_id", _L, False),
        ("sender_type", _S, False), ("content", _S), ("content_type", _S), ("token_count", _I),
        ("processing_time_ms", _I), ("status", _S), ("metadata", _S), ("created_at", _TS),
        ("updated_at", _TS),
    ),
    "message_images": _schema(
        ("id", _L, False), ("message_id", _L, False), ("image_url", _S, False),
        ("thumbnail_url", _S), ("imagekit_file_id", _S), ("file_name", _S), ("file_size", _I),
        ("width", _I), ("height", _I), ("alt_text", _S), ("upload_status", _S),
        ("created_at", _TS),
    ),
    "chat_participants": _schema(
        ("id", _L, False), ("chat_session_id", _L, False), ("user_id", _L, False), ("role", _S),
        ("joined_at", _TS), ("left_at", _TS),
    ),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_column: str
    parent: str
    parent_column: str


# Spark keeps no foreign keys, so they are declared here and checked by operators.quality.
FOREIGN_KEYS = (
    ForeignKey("fact_trans", "user_id", "dim_users", "user_id"),
    ForeignKey("fact_trans", "card_id", "dim_card", "card_id"),
    ForeignKey("chat_sessions", "user_id", "users", "id"),
    ForeignKey("messages", "chat_session_id", "chat_sessions", "id"),
    ForeignKey("message_images", "message_id", "messages", "id"),
    ForeignKey("chat_participants", "chat_session_id", "chat_sessions", "id"),
    ForeignKey("chat_participants", "user_id", "users", "id"),
)

UNIQUE_KEYS = {
    "dim_users": [["user_id"]],
    "dim_card": [["card_id"]],
    "fact_trans": [["trans_id"]],
    "users": [["id"], ["uuid"], ["email"]],
    "chat_sessions": [["id"], ["uuid"]],
    "messages": [["id"], ["uuid"]],
    "message_images": [["id"]],
    "chat_participants": [["id"], ["chat_session_id", "user_id"]],
}

# Fixed values of the data model.
CLUSTER_NAMES = ("Top Users", "Loyal Users", "At-Risk Users")
UNKNOWN_CLUSTER = "Unknown"
SENDER_TYPES = ("user", "assistant", "system")
CONTENT_TYPES = ("text", "image", "file", "mixed")
MESSAGE_STATUSES = ("draft", "sending", "sent", "delivered", "failed", "deleted")
UPLOAD_STATUSES = ("uploading", "uploaded", "failed", "deleted")
PARTICIPANT_ROLES = ("owner", "admin", "member", "viewer")
