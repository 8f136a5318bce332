import datetime as dt

import pytest
from pyspark.sql import functions as F

from martspark.operators.chat_writes import apply_requests
from martspark.session import stage_path
from martspark.sources.tables import append_rows

AT = dt.datetime(2024, 6, 1)
IMAGE = "array<struct<url:string,thumbnail_url:string,file_id:string,fileName:string,width:int,height:int>>"


@pytest.fixture(scope="module")
def tables(spark):
    sessions = spark.createDataFrame(
        [(1, "s1", 7, "Old", True, 3, dt.datetime(2024, 1, 1), None), (2, "s2", 7, "Closed", False, 0, AT, None)],
        "id long, uuid string, user_id long, title string, is_active boolean, message_count int, "
        "created_at timestamp_ntz, last_message_at timestamp_ntz",
    )
    messages = spark.createDataFrame([(40,)], "id long")
    images = spark.createDataFrame([], "id long")
    picture = [("u1", None, None, "a, b.png", 1, 2), ("u2", None, None, None, None, None)]
    requests = spark.createDataFrame(
        [
            (1, 7, "s1", "hi", picture, "hello", AT),
            (2, 7, None, "x" * 60, [], "new one", AT),
            (3, 8, "s1", "not mine", None, "?", AT),
            (4, 7, "s2", "closed", None, "?", AT),
            (5, 7, "nowhere", "lost", None, "?", AT),
            (6, 7, "s1", None, picture[:1], "again", AT + dt.timedelta(minutes=1)),
        ],
        f"request_id long, user_id long, chat_uuid string, text string, images {IMAGE}, reply string, "
        "created_at timestamp_ntz",
    )
    return requests, sessions, messages, images


def test_rows_written(tables):
    out = apply_requests(*tables)
    rows = out.messages.orderBy("id").collect()
    assert [(r["id"], r["chat_session_id"], r["sender_type"], r["content_type"]) for r in rows] == [
        (41, 1, "user", "mixed"), (42, 1, "assistant", "text"), (43, 4, "user", "text"), (44, 4, "assistant", "text"),
        (45, 1, "user", "mixed"), (46, 1, "assistant", "text"),
    ]
    images = out.images.orderBy("id").collect()
    assert [(r["id"], r["message_id"], r["image_url"], r["file_name"]) for r in images] == [
        (1, 41, "u1", "a, b.png"), (2, 41, "u2", None), (3, 45, "u1", "a, b.png")]
    assert sorted(r["request_id"] for r in out.rejected.collect()) == [3, 4, 5]


def test_counters_move_once(tables):
    rows = {r["id"]: r for r in apply_requests(*tables).sessions.collect()}
    assert set(rows) == {1, 2, 4}
    assert (rows[1]["message_count"], rows[1]["last_message_at"]) == (7, AT + dt.timedelta(minutes=1))
    assert (rows[2]["message_count"], rows[2]["last_message_at"]) == (0, None)
    assert (rows[4]["message_count"], rows[4]["title"], rows[4]["user_id"]) == (2, "x" * 50 + "...", 7)


def test_changed_sessions_carry_the_time_of_the_change(tables):
    requests, sessions, messages, images = tables
    dated = sessions.withColumn("updated_at", F.lit(dt.datetime(2024, 2, 2)).cast("timestamp_ntz"))
    rows = {r["id"]: r["updated_at"] for r in apply_requests(requests, dated, messages, images).sessions.collect()}
    assert rows == {1: AT + dt.timedelta(minutes=1), 2: dt.datetime(2024, 2, 2), 4: AT}


def test_a_repeated_batch_appends_nothing(spark, tables):
    path = stage_path(spark, "messages")
    assert append_rows(apply_requests(*tables).messages, path) == 6
    assert append_rows(apply_requests(*tables).messages, path) == 0
    assert spark.read.parquet(path).select("uuid").distinct().count() == 6
