"""Chat tables: session lists and statistics, messages with images, context windows, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.functions.scalars import default_if_empty, map_role
from martspark.functions.text import (
    ellipsis,
    held_keywords,
    holds_any,
    join_lines,
    non_blank_text,
    number_items,
)
from martspark.operators.scale import Salted, deal, first_n_per_group, last_n_per_group, positions, salted_join

NEW_CHAT = "New Chat"
MESSAGE_ORDER = ("created_at", "id")
IMAGE_FIELDS = {
    "image_url": "url",
    "thumbnail_url": "thumbnail_url",
    "imagekit_file_id": "file_id",
    "file_name": "fileName",
    "width": "width",
    "height": "height",
}


# -- sessions ---------------------------------------------------------------------------------


def active_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Active sessions with their owner's name and email, latest message first.

    One owner may have any share of the sessions, so the join spreads frequent owners.
    """
    owners = users.select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email")
    )
    columns = ["id", "uuid", "user_id", "title", "message_count", "created_at", "last_message_at"]
    live = sessions.where(F.col("is_active")).select(*columns)
    joined = salted_join(live, owners, ["user_id"], "inner").drop("user_id")
    return joined.orderBy(F.desc_nulls_last("last_message_at"), "id")


def active_for_user(sessions: DataFrame, user_id: int | None = None) -> DataFrame:
    """Active sessions of one user, or of everybody when no user is given."""
    live = sessions.where(F.col("is_active"))
    return live if user_id is None else live.where(F.col("user_id") == user_id)


def active_session_total(sessions: DataFrame, user_id: int | None = None) -> DataFrame:
    """(user_id, total) active sessions per user; for a given user always one row, 0 without sessions."""
    live = active_for_user(sessions, user_id)
    total = F.count(F.lit(1)).alias("total")
    if user_id is None:
        return live.groupBy("user_id").agg(total)
    kind = sessions.schema["user_id"].dataType
    return live.agg(total).select(F.lit(user_id).cast(kind).alias("user_id"), "total")


def default_user(users: DataFrame) -> DataFrame:
    """One row: the first user."""
    return users.agg(F.min("id").alias("id"))


def list_sessions(sessions: DataFrame, user_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions, latest first: of one user, or one page for each user.

    Sessions without a message come last, the id breaks ties. Only the first limit + offset
    sessions of a user leave their input tasks (see first_n_per_group).
    """
    live = active_for_user(sessions, user_id)
    order = [F.desc_nulls_last("last_message_at"), F.desc("created_at"), F.col("id")]
    if user_id is not None:
        return live.orderBy(*order).offset(offset).limit(limit)
    page = first_n_per_group(live, ["user_id"], order, limit + offset)
    return page.where(F.col("_place") > offset).drop("_place")


CURSOR = ("last_message_at", "created_at", "id")


def _after(row: Sequence[Column], cursor: Sequence[Column]) -> Column:
    """Whether a session comes behind the cursor: by the two times, latest first and NULL last, then by id."""
    last, created, key = zip(row, cursor)

    def later(value: Column, at: Column) -> Column:
        return at.isNotNull() & (value.isNull() | (value < at))

    behind = (last[0].eqNullSafe(last[1])) & (
        later(*created) | (created[0].eqNullSafe(created[1]) & (key[0] > key[1]))
    )
    return F.coalesce(later(*last) | behind, F.lit(False))


_OWNER = ("_user", "_owned")


def _with_owner(df: DataFrame) -> DataFrame:
    """The user as two columns that are never NULL, since sessions without a user are a list like any other."""
    stand_in = F.lit("0").try_cast(df.schema["user_id"].dataType)
    return df.withColumns({"_user": F.coalesce("user_id", stand_in), "_owned": F.col("user_id").isNotNull()})


def deal_sessions(sessions: DataFrame) -> Salted:
    """The active sessions as they are now, written once by user for a walk of `sessions_after` over all pages of all users.

    A page then shuffles its cursors and its own rows, but not the sessions. Select the columns a page needs first.
    """
    return deal(_with_owner(active_for_user(sessions)), _OWNER)


def sessions_after(
    sessions: DataFrame | Salted, cursor: DataFrame | Sequence | None = None, user_id: int | None = None, limit: int = 50
) -> DataFrame:
    """The page of sessions behind a cursor, latest first: of one user, or one page for each user.

    The cursor is the (last_message_at, created_at, id) of the last session seen; without it the list begins. For each user
    it is a frame (user_id, last_message_at, created_at, id); a user without a row begins, and `page_cursors` gives the
    next one; their pages have the `_place` in the page. A page costs one filter and the first `limit` sessions of each task, however far down the list it is, and
    sessions that are added meanwhile do not shift it.
    """
    live = active_for_user(sessions.rows if isinstance(sessions, Salted) else sessions, user_id)
    columns = [c for c in live.columns if c not in (*_OWNER, "_salt")]
    order = [F.desc_nulls_last("last_message_at"), F.desc_nulls_last("created_at"), F.col("id")]
    own = [F.col(c) for c in CURSOR]
    if user_id is not None:
        if cursor is not None:
            kinds = [live.schema[c].dataType for c in CURSOR]
            live = live.where(_after(own, [F.lit(v).cast(k) for v, k in zip(cursor, kinds)]))
        return live.select(*columns).orderBy(*order).limit(limit)
    if cursor is not None:
        seen = [F.col(f"_seen_{c}") for c in CURSOR]
        marks = _with_owner(cursor).select(*_OWNER, *[F.col(c).alias(f"_seen_{c}") for c in CURSOR])
        met = salted_join(sessions if isinstance(sessions, Salted) else _with_owner(live), marks, _OWNER, "left")
        live = met.where(F.col("_seen_id").isNull() | _after(own, seen))
    return first_n_per_group(live.select(*columns), ["user_id"], order, limit)


def page_cursors(page: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(user_id, last_message_at, created_at, id): the last session of each user's page.

    A user whose list has ended has no page and keeps the cursor `before`, or would begin again; sessions without a user
    are one list. Stage pages and cursors on a walk over many pages, since each is made from the one before, and let
    `deal_sessions` write the sessions if no new ones need to be seen.
    """
    last = F.max_by(F.struct(*CURSOR), "_place").alias("last")
    found = page.groupBy("user_id").agg(last).select("user_id", "last.*")
    if before is None:
        return found
    ended = before.join(found.select(F.col("user_id").alias("_found")), F.col("user_id").eqNullSafe(F.col("_found")), "left_anti")
    return found.unionByName(ended)


def chat_list(
    sessions: DataFrame, user_id: int | None = None, limit: int = 50, offset: int = 0,
    cursor: DataFrame | Sequence | None = None,
) -> DataFrame:
    """The page shown to a user, with the total of their active sessions on each row; behind a cursor, if one is given."""
    if cursor is not None:
        page = sessions_after(sessions, cursor, user_id, limit)
    else:
        page = list_sessions(sessions, user_id, limit, offset)
    rows = page.select(
        "user_id",
        F.col("uuid").alias("id"),
        default_if_empty("title", NEW_CHAT).alias("title"),
        "message_count",
        "created_at",
        "last_message_at",
    )
    return rows.join(active_session_total(sessions, user_id), "user_id", "left")


def session_title(first_text: Column | str, n: int = 50) -> Column:
    return default_if_empty(ellipsis(first_text, n), NEW_CHAT)


def session_stats(messages: DataFrame) -> DataFrame:
    """(chat_session_id, message_count, last_message_at) from the messages themselves."""
    return messages.groupBy("chat_session_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at")
    )


# -- messages and images ----------------------------------------------------------------------


def ordered_messages(messages: DataFrame) -> DataFrame:
    return messages.orderBy(*MESSAGE_ORDER)


def messages_of(session_uuid: str | Column, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the session with this external id, looked up once before the scan."""
    wanted = sessions.where(F.col("uuid") == session_uuid).select("id").scalar()
    return messages.where(F.col("chat_session_id") == wanted)


def collect_images(images: DataFrame) -> DataFrame:
    """(message_id, position, image_count, image): the images of each message, by id.

    One row per image, whatever their number, so nothing of a message is gathered in one place.
    position counts from 0, image_count is the total of the message.
    """
    placed = positions(
        images.select("message_id", "id", *IMAGE_FIELDS),
        ["message_id"],
        [F.col("id")],
        "id",
        total="image_count",
    )
    image = F.struct(*[F.col(c).alias(name) for c, name in IMAGE_FIELDS.items()])
    return placed.select("message_id", "position", "image_count", image.alias("image"))


def messages_with_images(messages: DataFrame, images: DataFrame) -> DataFrame:
    """Messages with position, image and image_count: a row per image, or one without an image.

    The images of a message with very many are spread over tasks by the join.
    """
    rows = collect_images(images).withColumnRenamed("message_id", "id")
    shown = salted_join(rows, messages, ["id"], "inner")
    bare = messages.join(images.select(F.col("message_id").alias("id")), "id", "left_anti")
    return shown.unionByName(bare, allowMissingColumns=True).select(
        *messages.columns, "position", "image", F.coalesce("image_count", F.lit(0).cast("long")).alias("image_count")
    )


def shown_image(image: Column | str) -> Column:
    """An image as the chat page takes it, missing texts filled."""
    i = F.col(image) if isinstance(image, str) else image
    filled = F.struct(
        i["url"].alias("url"),
        F.coalesce(i["thumbnail_url"], i["url"]).alias("thumbnail_url"),
        F.coalesce(i["file_id"], F.lit("")).alias("file_id"),
        F.coalesce(i["fileName"], F.lit("")).alias("fileName"),
        i["width"].alias("width"),
        i["height"].alias("height"),
    )
    return F.when(i.isNotNull(), filled)


def chat_detail(
    sessions: DataFrame,
    messages: DataFrame,
    images: DataFrame,
    uuid: str | None = None,
    user_id: int | None = None,
) -> DataFrame:
    """Messages of an active session (of all of them without `uuid`) with session and images.

    A message has a row per image with a url, or one row without an image; a session without
    messages is one row without a message. The page of one session is in order; all sessions
    together are left in the order of the tasks.
    """
    live = active_for_user(sessions, user_id)
    if uuid is not None:
        live = live.where(F.col("uuid") == uuid)
    head = live.select(
        F.col("id").alias("chat_session_id"),
        F.col("uuid").alias("chat_id"),
        "title",
        "message_count",
        "last_message_at",
    )
    rows = messages if uuid is None else messages_of(uuid, sessions, messages)
    told = rows.select("id", "uuid", "chat_session_id", "sender_type", "content", "created_at")
    inside = salted_join(told, head, ["chat_session_id"], "inner")
    silent = head.join(told, "chat_session_id", "left_anti")
    inside = inside.unionByName(silent, allowMissingColumns=True)
    images = images.where(F.length("image_url") > 0)
    if uuid is not None:
        # Only the images of this session are worth numbering.
        images = salted_join(images, inside.select(F.col("id").alias("message_id")), ["message_id"], "left_semi")
    shown = messages_with_images(inside, images).select(
        "chat_id",
        "title",
        "message_count",
        "last_message_at",
        F.col("uuid").alias("id"),
        F.when(F.col("id").isNotNull(), map_role("sender_type", "ai")).alias("role"),
        "content",
        "position",
        shown_image("image").alias("image"),
        "image_count",
        "created_at",
        F.col("id").alias("message_no"),
    )
    if uuid is not None:
        shown = shown.orderBy("created_at", "message_no", "position")
    return shown.drop("message_no")


# -- context and routing ----------------------------------------------------------------------


def non_blank(df: DataFrame, column: str = "content") -> DataFrame:
    return df.where(non_blank_text(column))


def recent_turns(messages: DataFrame, n: int) -> DataFrame:
    """Role and content of the last n messages per session, blank ones left out."""
    latest = last_n_per_group(messages, "chat_session_id", MESSAGE_ORDER, n)
    return non_blank(latest).select(
        "chat_session_id", *MESSAGE_ORDER, map_role("sender_type").alias("role"), "content"
    )


def image_lines(urls: Column | str) -> Column:
    """The section that lists attached images under a message; "" without images."""
    listed = F.concat(F.lit("\nAttached images:\n"), join_lines(number_items(urls, "Image")))
    column = F.col(urls) if isinstance(urls, str) else urls
    return F.when(F.size(F.coalesce(column, F.array().cast("array<string>"))) > 0, listed).otherwise(F.lit(""))


def prompt_payloads(
    messages: DataFrame, system_prompt: str, n: int = 20, current: DataFrame | None = None
) -> DataFrame:
    """(chat_session_id, payload): system prompt, recent turns and the current message.

    `current` holds (chat_session_id, text, image_urls) of the messages to be answered, the urls as
    an array that came with the request; sessions appear if they have turns or a current message. A payload has at most n + 2 entries.
    """
    entry = "struct<role:string,content:string>"
    turns = recent_turns(messages, n).groupBy("chat_session_id").agg(
        F.array_sort(F.collect_list(F.struct(*MESSAGE_ORDER, "role", "content"))).alias("turns")
    )
    turns = turns.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    )
    if current is None:
        joined = turns.withColumn("asked", F.array().cast(f"array<{entry}>"))
    else:
        text = F.concat(default_if_empty("text", "(no text)"), image_lines("image_urls"))
        given = (F.coalesce(F.length("text"), F.lit(0)) > 0) | (F.coalesce(F.size("image_urls"), F.lit(0)) > 0)
        asked = current.where(given).select(
            "chat_session_id", F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("asked")
        )
        joined = turns.join(asked, "chat_session_id", "full")
    none = F.array().cast(f"array<{entry}>")
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    return joined.select(
        "chat_session_id",
        F.concat(system, F.coalesce("turns", none), F.coalesce("asked", none)).alias("payload"),
    )


# Fixed word lists and database names of the question router.
MEMORY_KEYWORDS = (
    "remember", "who am i", "my position", "my role", "my name", "you mentioned", "earlier",
    "before", "said i was", "told you", "what did i say", "what did i tell", "do you know who i am",
)
DATA_KEYWORDS = ("count", "number of", "how many", "total", "analytics", "transactions")
QUESTION_DATABASES = ("CustomerWarehouse", "MarketingDataMart")


def route_questions(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds needs_private_data, databases_needed, query_type and reasoning by keyword."""
    # In steps, so that a text is lower-cased and searched once for all four columns.
    searched = df.withColumn("_lower", F.lower(text)).withColumns({
        "_memory": F.coalesce(holds_any("_lower", MEMORY_KEYWORDS), F.lit(False)),
        "_data": F.coalesce(holds_any("_lower", DATA_KEYWORDS), F.lit(False)),
    })

    def choose(on_memory: Column, on_data: Column, otherwise: Column) -> Column:
        return F.when(F.col("_memory"), on_memory).when(F.col("_data"), on_data).otherwise(otherwise)

    nothing = F.array().cast("array<string>")
    databases = F.array(*[F.lit(d) for d in QUESTION_DATABASES])
    found = F.concat_ws(", ", held_keywords("_lower", MEMORY_KEYWORDS))
    return searched.select(
        *df.columns,
        choose(F.lit(False), F.lit(True), F.lit(False)).alias("needs_private_data"),
        choose(nothing, databases, nothing).alias("databases_needed"),
        choose(F.lit("memory_query"), F.lit("data_query"), F.lit("conversational")).alias("query_type"),
        choose(
            F.concat(F.lit("memory keywords: "), found),
            F.lit("data keywords"),
            F.lit("no keywords"),
        ).alias("reasoning"),
    )
