import datetime as dt

import duckdb
import pytest
from oracle import compare
from pyspark.sql import Window
from pyspark.sql import functions as F

from martspark.functions.text import number_item
from martspark.operators import chat
from martspark.session import stage

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(
        [
            (1, "s1", 1, None, True, 3, at(0), at(5)),
            (2, "s2", 1, "Budget", True, 0, at(1), None),
            (3, "s3", 1, "", False, 0, at(2), at(9)),
            (4, "s4", 2, "Plan", True, 1, at(3), at(5)),
            (5, "s5", 1, "Tie", True, 1, at(4), at(5)),
        ],
        "id long, uuid string, user_id long, title string, is_active boolean, message_count int, "
        "created_at timestamp_ntz, last_message_at timestamp_ntz",
    )


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (11, 1, "system", "be kind", at(0)),
        (12, 1, "user", "hello", at(1)),
        (14, 1, "assistant", "second of two", at(2)),
        (13, 1, "user", "first of two", at(2)),
        (15, 1, "user", "  ", at(3)),
        (16, 1, "user", None, at(4)),
        (17, 4, "user", "count it", at(5)),
    ]
    return spark.createDataFrame(rows, "id long, chat_session_id long, sender_type string, content string, "
                                       "created_at timestamp_ntz").withColumn("uuid", F.concat(F.lit("m"), "id"))


@pytest.fixture(scope="module")
def images(spark):
    rows = [
        (2, 12, "http://b", None, "f2", None, 20, None),
        (1, 12, "http://a", "ta", None, "one, two.png", 10, 11),
        (3, 17, "", "tc", "f3", "c", 30, 31),
    ]
    return spark.createDataFrame(
        rows, "id long, message_id long, image_url string, thumbnail_url string, imagekit_file_id string, "
              "file_name string, width int, height int")


def test_page_of_one_user(sessions):
    page = chat.list_sessions(sessions, 1)
    assert [r["id"] for r in page.collect()] == [5, 1, 2]
    assert [r["id"] for r in chat.list_sessions(sessions, 1, limit=1, offset=1).collect()] == [1]


def test_pages_of_all_users(sessions):
    assert sorted(r["id"] for r in chat.list_sessions(sessions, limit=2).collect()) == [1, 4, 5]
    assert sorted(r["id"] for r in chat.list_sessions(sessions, limit=2, offset=2).collect()) == [2]


def test_chat_list(sessions):
    rows = {r["id"]: r for r in chat.chat_list(sessions, 1).collect()}
    assert rows["s1"]["title"] == "New Chat" and rows["s2"]["title"] == "Budget"
    assert {r["total"] for r in rows.values()} == {3}


def test_active_sessions(spark, sessions):
    users = spark.createDataFrame([(1, "Ann", "a@b.c"), (2, "Bo", "b@b.c")], "id long, name string, email string")
    rows = chat.active_sessions(sessions, users).collect()
    assert [r["id"] for r in rows] == [1, 4, 5, 2]
    assert (rows[1]["user_name"], rows[1]["user_email"]) == ("Bo", "b@b.c")
    assert chat.default_user(users).first()["id"] == 1


def test_session_stats_count_messages_once(messages):
    rows = {r["chat_session_id"]: r for r in chat.session_stats(messages).collect()}
    assert rows[1]["message_count"] == 6 and rows[1]["last_message_at"] == at(4)


def test_images_of_messages(messages, images):
    rows = chat.messages_with_images(messages, images).orderBy("id", "position").collect()
    first, second = [r["image"] for r in rows if r["id"] == 12]
    assert (first["url"], first["fileName"], first["file_id"], first["width"]) == ("http://a", "one, two.png", None, 10)
    assert (second["url"], second["fileName"], second["thumbnail_url"]) == ("http://b", None, None)
    assert [(r["id"], r["position"], r["image_count"]) for r in rows] == [
        (11, None, 0), (12, 0, 2), (12, 1, 2), (13, None, 0), (14, None, 0), (15, None, 0), (16, None, 0), (17, 0, 1)]


def test_a_message_with_very_many_images_same_as_sql(spark, tmp_path):
    images = spark.range(75_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("message_id"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("image_url"),
        *[F.lit(None).cast("string").alias(c) for c in ("thumbnail_url", "imagekit_file_id", "file_name")],
        *[F.lit(None).cast("int").alias(c) for c in ("width", "height")],
    )
    messages = spark.range(0, 75_002, 2).withColumn("content", F.lit("x")).unionByName(
        spark.createDataFrame([(1, "big")], "id long, content string"))
    images.write.parquet(f"{tmp_path}/images.parquet")
    messages.write.parquet(f"{tmp_path}/messages.parquet")
    got = chat.messages_with_images(messages, images).select(
        "id", "position", "image_count", number_item("position", "image.url", "Image").alias("line"))
    assert got.where("id = 1").count() == 25_001  # every third id, and id 1
    sql = f"""
        SELECT m.id, count(i.id) OVER (PARTITION BY m.id) AS image_count,
               CASE WHEN i.id IS NOT NULL THEN row_number() OVER (PARTITION BY m.id ORDER BY i.id) - 1 END AS position,
               'Image ' || (position + 1) || ': ' || image_url AS line
        FROM '{tmp_path}/messages.parquet/*.parquet' m LEFT JOIN '{tmp_path}/images.parquet/*.parquet' i ON i.message_id = m.id"""
    assert compare(got, duckdb.connect(), sql) == []


def test_chat_detail(sessions, messages, images):
    rows = chat.chat_detail(sessions, messages, images, "s1").collect()
    assert [r["id"] for r in rows] == ["m11", "m12", "m12", "m13", "m14", "m15", "m16"]
    assert [r["role"] for r in rows] == ["ai", "user", "user", "user", "ai", "user", "user"]
    assert [tuple(r["image"]) for r in rows[1:3]] == [
        ("http://a", "ta", "", "one, two.png", 10, 11),
        ("http://b", "http://b", "f2", "", 20, None),
    ]
    assert rows[0]["image"] is None and rows[1]["image_count"] == 2
    assert chat.chat_detail(sessions, messages, images, "s3").count() == 0
    everything = chat.chat_detail(sessions, messages, images).collect()
    assert len(everything) == 10
    assert [(r["image"], r["image_count"]) for r in everything if r["id"] == "m17"] == [(None, 0)]  # an empty url is no image
    silent = [r for r in everything if r["id"] is None]
    assert sorted(r["chat_id"] for r in silent) == ["s2", "s5"] and {r["role"] for r in silent} == {None}
    assert [r["image"] for r in chat.chat_detail(sessions, messages, images, "s2").collect()] == [None]
    assert [tuple(r) for r in chat.active_session_total(sessions, 77).collect()] == [(77, 0)]
    assert chat.chat_detail(sessions, messages, images, "s1", user_id=2).count() == 0


def test_messages_of(sessions, messages):
    assert chat.messages_of("s4", sessions, messages).count() == 1
    assert chat.messages_of("none", sessions, messages).count() == 0
    assert [r["id"] for r in chat.ordered_messages(messages).collect()] == [11, 12, 13, 14, 15, 16, 17]


def test_last_messages_then_blanks_out(messages):
    turns = chat.recent_turns(messages, 4).orderBy("created_at", "id").collect()
    assert [(r["chat_session_id"], r["content"]) for r in turns] == [
        (1, "first of two"), (1, "second of two"), (4, "count it")]


def test_prompt(spark, messages):
    current = spark.createDataFrame(
        [(1, "and now?", ["u1", "u2"]), (9, None, ["u3"]), (4, "", None)],
        "chat_session_id long, text string, image_urls array<string>",
    )
    out = {r["chat_session_id"]: [tuple(p) for p in r["payload"]]
           for r in chat.prompt_payloads(messages, "SYS", 5, current).collect()}
    assert out[1] == [
        ("system", "SYS"),
        ("user", "hello"),
        ("user", "first of two"),
        ("assistant", "second of two"),
        ("user", "and now?\nAttached images:\nImage 1: u1\nImage 2: u2"),
    ]
    assert out[9] == [("system", "SYS"), ("user", "(no text)\nAttached images:\nImage 1: u3")]
    assert out[4] == [("system", "SYS"), ("user", "count it")]
    alone = {r["chat_session_id"]: len(r["payload"]) for r in chat.prompt_payloads(messages, "SYS", 5).collect()}
    assert alone == {1: 4, 4: 2}


@pytest.mark.parametrize("question, kind, data", [
    ("Do you REMEMBER my name?", "memory_query", False),
    ("How many transactions in total?", "data_query", True),
    ("hello", "conversational", False),
    ("How many did I say before?", "memory_query", False),
])
def test_routing(spark, question, kind, data):
    row = chat.route_questions(spark.createDataFrame([(question,)], "text string")).first()
    assert (row["query_type"], row["needs_private_data"]) == (kind, data)
    assert row["databases_needed"] == (["CustomerWarehouse", "MarketingDataMart"] if data else [])
    if "REMEMBER" in question:
        assert row["reasoning"] == "memory keywords: remember, my name"


@pytest.mark.parametrize("first, title", [("x" * 60, "x" * 50 + "..."), ("", "New Chat"), (None, "New Chat"), ("hi", "hi")])
def test_title(spark, first, title):
    df = spark.createDataFrame([(first,)], "t string")
    assert df.select(chat.session_title("t").alias("title")).first()["title"] == title


def pages_of(sessions, user, limit):
    cursor, seen = None, []
    while rows := chat.sessions_after(sessions, cursor, user_id=user, limit=limit).collect():
        seen += [r["id"] for r in rows]
        cursor = [rows[-1][c] for c in chat.CURSOR]
    return seen


def test_pages_behind_a_cursor_walk_the_whole_list(spark):
    """Ties in both times and NULL times, for one user and for all of them at once."""
    times = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    rows = [(i, min(i % 3, 1), i % 11 != 3, times[i % 3], times[i // 3 % 3], f"u{i}", None, 0) for i in range(60)]
    schema = "id long, user_id long, is_active boolean, last_message_at timestamp_ntz, created_at timestamp_ntz, uuid string, title string, message_count int"
    sessions = spark.createDataFrame(rows, schema)
    whole = {u: [r["id"] for r in chat.list_sessions(sessions, u, limit=100).collect()] for u in (0, 1)}
    assert all(pages_of(sessions, u, 7) == whole[u] for u in whole)

    cursor, seen = None, {0: [], 1: []}
    while True:
        page = stage(chat.sessions_after(sessions, cursor, limit=4), "page")
        found = sorted(page.collect(), key=lambda r: r["_place"])
        if not found:
            break
        for r in found:
            seen[r["user_id"]].append(r["id"])
        cursor = stage(chat.page_cursors(page, cursor), "cursors")
        # A session that comes in front of the cursor later does not shift the pages behind it.
        newer = [(1000 + len(seen[0]), 0, True, dt.datetime(2025, 1, 1), None, "", None, 0)]
        sessions = stage(sessions.unionByName(spark.createDataFrame(newer, schema)), "sessions")
    assert seen == whole
    behind = rows[whole[1][-4]]
    shown = chat.chat_list(sessions, 1, limit=3, cursor=[behind[3], behind[4], behind[0]]).collect()
    assert sorted(r["id"] for r in shown) == sorted(f"u{i}" for i in whole[1][-3:]) and {r["total"] for r in shown} == {len(whole[1])}


@pytest.mark.parametrize("dealt", [True, False])
def test_a_walk_over_all_users_shows_each_session_once(spark, dealt):
    """Users of many and of few sessions, and sessions without a user, whose list ends as well."""
    times = [None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    owner = [None, 0, 1, 1, 2, 2, 2, 2]
    rows = [(i, owner[i % 8], i % 11 != 3, times[i % 3], times[i // 3 % 3]) for i in range(64)]
    schema = "id long, user_id long, is_active boolean, last_message_at timestamp_ntz, created_at timestamp_ntz"
    sessions = spark.createDataFrame(rows, schema)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(
        F.desc_nulls_last("last_message_at"), F.desc_nulls_last("created_at"), "id"))
    wanted = sessions.where("is_active").select("id", F.floor((place - 1) / 4).alias("page")).collect()

    walked = chat.deal_sessions(sessions) if dealt else sessions
    cursor, seen = None, []
    for number in range(10):
        page = stage(chat.sessions_after(walked, cursor, limit=4), "page")
        assert page.columns == [*sessions.columns, "_place"]
        seen += [(r["id"], number) for r in page.collect()]
        cursor = stage(chat.page_cursors(page, cursor), "cursors")
    assert sorted(seen) == sorted(map(tuple, wanted))


def test_a_page_of_dealt_sessions_does_not_shuffle_them(spark):
    sessions = spark.range(100).selectExpr(
        "id", "id % 9 AS user_id", "true AS is_active", "timestamp_ntz'2024-01-01' AS last_message_at",
        "timestamp_ntz'2024-01-01' AS created_at")
    dealt = chat.deal_sessions(sessions)
    cursor = stage(chat.page_cursors(chat.sessions_after(dealt, limit=4)), "cursors")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = chat.sessions_after(dealt, cursor, limit=4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    left = plan[plan.index("SortMergeJoin"):]
    assert "dealt" in left and "Exchange" not in left[: left.index("FileScan")]


def test_a_page_sorts_only_its_own_length(spark):
    sessions = spark.createDataFrame(
        [(i, 1, True, None, None) for i in range(5)], "id long, user_id long, is_active boolean, last_message_at timestamp, created_at timestamp"
    )
    plan = chat.sessions_after(sessions, [None, None, 2], user_id=1, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=2" in plan
    assert [r["id"] for r in chat.sessions_after(sessions, [None, None, 2], user_id=1, limit=2).collect()] == [3, 4]
