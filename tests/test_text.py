import re

import pytest
from pyspark.sql import functions as F

from martspark.functions import scalars, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make("t").alias("out")).first()["out"]


def test_keywords(spark):
    words = ["my name", "total", "xyz"]
    assert one(spark, "TOTAL of My Name", lambda c: text.contains_any(c, words)) is True
    assert one(spark, "TOTAL of My Name", lambda c: text.matched_keywords(c, words)) == ["my name", "total"]
    assert one(spark, "nothing", lambda c: text.matched_keywords(c, words)) == []


@pytest.mark.parametrize("value, out", [("a" * 50, "a" * 50), ("a" * 51, "a" * 50 + "..."), ("", ""), (None, None)])
def test_ellipsis(spark, value, out):
    assert one(spark, value, lambda c: text.ellipsis(c, 50)) == out


@pytest.mark.parametrize("value, out", [('x {"a":\n {"b": 1}} y } z', '{"a":\n {"b": 1}} y }'), ("none", None), ("} {", None)])
def test_extract_json(spark, value, out):
    assert one(spark, value, text.extract_json) == out


def test_parse_json(spark):
    assert one(spark, '{"k": 3}', lambda c: text.parse_json(c, "k int"))["k"] == 3


def plain_first_sql(reply):
    """The same rule line by line."""
    reply = re.sub("```\n?", "", re.sub("```sql\n?", "", reply)).strip()
    taken = []
    for line in (x.strip() for x in reply.split("\n")):
        starts = re.match("select|with|insert|update|delete", line, re.I)
        if not taken and not starts:
            continue
        if taken and not line:
            break
        taken.append(line)
        if line.endswith(";"):
            break
    statement = "\n".join(taken).strip()
    return statement[:-1] if statement.endswith(";") else statement


REPLIES = [
    "```sql\nSELECT a\nFROM t;\n```",
    "Sure:\n\n  select 1;;\nselect 2",
    "no statement at all",
    "",
    "With regards\n\nselect 1",
    "selection of things\nmore",
    "SELECT a; -- note\nFROM b\n   \nrest",
    "text select 1\nUPDATE t SET a = 1",
    "x\r\nSELECT 1\r\nFROM t;\r\n",
    "```\ndelete from t\n```\nBye",
    "\n\n  WITH a AS (\n  SELECT 1\n)\nSELECT * FROM a  ;  \nX",
]


@pytest.mark.parametrize("reply", REPLIES)
def test_first_sql(spark, reply):
    assert one(spark, reply, text.first_sql) == plain_first_sql(reply)


def test_lists_and_numbers(spark):
    assert one(spark, "a,b,,", text.split_list) == ["a", "b", "", ""]
    assert one(spark, None, text.split_list) == [""]
    assert [one(spark, v, text.safe_int) for v in ("12", "1a", "-1", "", None, "99999999999")] == [
        12, None, None, None, None, None]
    assert one(spark, ["x", "y"], lambda c: text.join_lines(text.number_items(c, "Image")), "array<string>") == (
        "Image 1: x\nImage 2: y")


def test_zip_records_fills_missing_slots(spark):
    df = spark.createDataFrame([("u1,,u3", "t1", None)], "u string, t string, w string")
    lists = {"url": text.split_list("u"), "thumb": text.split_list("t"), "w": text.split_list("w")}
    record = text.zip_records(lists, "url", {"thumb": F.lit("?")})
    assert [tuple(r) for r in df.select(record.alias("r")).first()["r"]] == [("u1", "t1", ""), ("u3", "?", None)]


def test_contact_patterns(spark):
    emails = {"a@b.co": True, "a@b": True, "a b@c.d": False, "@b.c": False, "a@-b.c": False}
    assert {e: one(spark, e, text.valid_email) for e in emails} == emails
    phones = {"1234567": True, "+1 555 123 4567": True, "123456": True, "12345": False, "(030) 1234567": True,
              "12a4567": False}
    assert {p: one(spark, p, text.valid_phone) for p in phones} == phones
    assert one(spark, "a@b.c", text.email_shape) and not one(spark, "ab.c", text.email_shape)


def test_files(spark):
    assert [one(spark, n, text.file_ext) for n in ("a.b.png", "none", None)] == ["png", "jpg", "jpg"]
    assert [one(spark, n, text.is_image) for n in ("image/png", "text/plain", None)] == [True, False, False]
    assert [one(spark, n, text.size_ok, "int") for n in (10485760, 10485761)] == [True, False]


def test_codes(spark):
    assert [one(spark, c, text.code_number) for c in ("0742", " 7 ", "7.9", "abc", "", None)] == [
        742, 7, 7, None, None, None]


def test_scalars(spark):
    assert one(spark, "", lambda c: scalars.default_if_empty(c, "New Chat")) == "New Chat"
    assert one(spark, None, lambda c: scalars.default_if_empty(c, 0.0), "double") == 0.0
    assert one(spark, "system", lambda c: scalars.map_role(c, "ai")) == "ai"
    assert one(spark, 2, lambda c: scalars.map_labels(c, {0: "a", 2: "b"}), "int") == "b"
    assert one(spark, 7, lambda c: scalars.floor_div(c, 4), "long") == 1
    assert one(spark, 2**60 + 1, lambda c: scalars.floor_div(c, 2), "long") == 2**59
    assert one(spark, "bad", scalars.parse_timestamp) is None
    assert one(spark, "2024-01-02 03:04:05", scalars.parse_timestamp).hour == 3
    assert one(spark, "abc", lambda c: scalars.length_between(c, 2, 3)) is True
    assert one(spark, 5, scalars.axis_text, "int") == "5"
