import datetime as dt

import pytest
from pyspark.sql import functions as F

from martspark.operators import quality as q


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_not_empty(spark):
    out = q.check_not_empty({"a": spark.range(3), "b": spark.range(0)})
    assert rows(out) == [("a", 3, True), ("b", 0, False)]
    with pytest.raises(ValueError, match="'b'"):
        q.raise_on_failure(out, "not_empty")


def test_expected_values_only_warn(spark):
    df = spark.createDataFrame([("Top",), (None,), ("Top",)], "cluster string")
    assert rows(q.check_expected_values(df, "cluster", ["Top", "Lost"])) == [
        ("Lost", False, "warn"), ("Top", True, "ok")]
    assert rows(q.missing_expected(df, "cluster", ["Top", "Lost"])) == [("Lost",)]


def test_unique_with_compound_and_unknown_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3)], "a int, b int")
    assert rows(q.check_unique(df, ["a", "b"])) == [(1, 1, 2)]


def test_foreign_keys(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,)], "pk int")
    assert rows(q.fk_violations(child, parent, "fk", "pk")) == [(9, 2)]
    assert rows(q.check_fk(child, parent, "fk", "pk")) == [(1, 2, False)]
    assert rows(q.check_fk(child.limit(0), parent, "fk", "pk")) == [(0, 0, True)]


def test_children_are_counted_before_the_join(spark):
    plan = q.fk_violations(spark.range(9).withColumnRenamed("id", "fk"), spark.range(3), "fk", "id")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Join LeftOuter") < text.index("Aggregate [")


def test_value_rules_let_unknown_pass(spark):
    df = spark.createDataFrame([("user", "x"), ("robot", None), (None, "a@b.c")], "sender_type string, email string")
    rules = {"sender": F.col("sender_type").isin("user"), "email": F.col("email").like("%@%.%")}
    assert rows(q.check_predicates(df, rules)) == [("email", 1, False), ("sender", 1, False)]
    assert rows(q.check_not_null(df, ["email"])) == [("email", 1, False)]


def test_declared_chat_rules(spark):
    bad = spark.createDataFrame([("robot", "video", "lost"), ("user", "text", "sent")],
                                "sender_type string, content_type string, status string")
    assert {r["violations"] for r in q.check_predicates(bad, q.chat_rules("messages")).collect()} == {1}
    for table, columns in {"message_images": "upload_status", "chat_participants": "role"}.items():
        df = spark.createDataFrame([("x",)], f"{columns} string")
        assert q.check_predicates(df, q.chat_rules(table)).first()["violations"] == 1


def test_freshness(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0),), (dt.datetime(2024, 1, 2, 0),)], "ts timestamp_ntz")
    as_of = F.lit("2024-01-03 12:00:00").cast("timestamp")
    assert rows(q.check_freshness(df, "ts", 36, as_of))[0][1:] == (36.0, True)
    assert rows(q.check_freshness(df, "ts", 35, as_of))[0][1:] == (36.0, False)
    assert rows(q.check_freshness(df.limit(0), "ts", 35, as_of))[0][1:] == (None, False)


def test_contacts(spark):
    schema = "firstName string, lastName string, email string, contact string, address1 string, address2 string"
    df = spark.createDataFrame(
        [
            ("Ann", "Lee", "ann.lee+x@mail.example.org", "+49 (030) 123-4567", "a", "b"),
            ("Ann", "", "ann@", "12-34", "a", None),
            ("Ann", "Lee", None, "555-123 4567", "a", "b"),
            ("Ann", "Lee", "a@b", "0" * 5000 + "x", "a", "b"),
        ],
        schema,
    )
    assert [r["failed_rules"] for r in q.validate_contacts(df).collect()] == [
        [],
        ["lastName required", "address2 required", "invalid email", "Phone number is not valid"],
        ["email required"],
        ["Phone number is not valid"],
    ]


def test_all_failures_are_in_the_table_that_the_error_names(spark):
    checks = spark.range(50).selectExpr("id", "id >= 30 AS ok")
    with pytest.raises(ValueError, match="30 findings") as error:
        q.raise_on_failure(checks, "many")
    path = str(error.value).split(", all in ")[1].split(",")[0]
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(30))
    q.raise_on_failure(checks.where("ok"), "none")
