"""Part files that arrive in several runs."""

import os

import pytest

from martspark.sources import part_loads
from martspark.sources.files import read_fact_parts

HEADER = "trans_id,user_id,card_id,trans_timestamp,trans_amount,trans_service"


@pytest.fixture()
def place(tmp_path):
    os.mkdir(tmp_path / "parts")
    return tmp_path


def part(place, name, *lines):
    (place / "parts" / name).write_text("\n".join([HEADER, *lines]) + "\n")


def rows(start, end):
    return [f"{i},{i % 5},1,2024-01-0{i % 9 + 1} 10:00:00,{i}.5,s{i % 3}" for i in range(start, end)]


def load(spark, place, **how):
    return part_loads.load_parts(spark, str(place / "parts"), *(str(place / n) for n in ("table", "bad", "seen")), **how)


def loaded(spark, place):
    return sorted(map(tuple, part_loads.read_loaded(spark, str(place / "table")).drop("batch").collect()))


def test_two_runs_equal_one_load(spark, place):
    part(place, "a.csv", *rows(0, 30))
    part(place, "b.csv", *rows(30, 40), "x,1,1,2024-01-01 10:00:00,1.5,s", "41,1", ",1,1,2024-01-01 10:00:00,1.5,s1")
    assert load(spark, place, files_per_batch=1) == 2
    first = loaded(spark, place)
    assert len(first) == 40
    assert load(spark, place) == 0 and loaded(spark, place) == first

    part(place, "c.csv", *rows(50, 60), "61,2,1,never,2.5,s1", "62,2,1,,2.5,s1", "62,2,1,,2.5,s1")
    part(place, "a-again.csv", *rows(0, 30))
    os.utime(place / "parts" / "c.csv", (10**9, 10**9))
    assert load(spark, place) == 1

    bad = part_loads.read_quarantine(spark, str(place / "bad")).collect()
    assert sorted((os.path.basename(r["file"]), r["text"], r["reason"]) for r in bad) == [
        ("b.csv", ",1,1,2024-01-01 10:00:00,1.5,s1", "no trans_id"),
        ("b.csv", "41,1", "does not fit the columns"),
        ("b.csv", "x,1,1,2024-01-01 10:00:00,1.5,s", "does not fit the columns"),
    ]
    one = read_fact_parts(spark, [str(place / "parts" / n) for n in ("a.csv", "b.csv", "c.csv")])
    one = one.where("trans_id IS NOT NULL AND trans_id <> 41").dropDuplicates(["trans_id"])
    assert loaded(spark, place) == sorted(map(tuple, one.select(*part_loads.FACT_TRANS.names).collect()))


def test_a_batch_that_fails_after_writing_runs_again(spark, place, monkeypatch):
    part(place, "a.csv", *rows(0, 10), "bad")
    real = part_loads.rows_not_in

    def fails(fresh, known, key):
        real(fresh, known, key).write.mode("overwrite").parquet(str(place / "table" / "batch=0"))
        raise RuntimeError("lost")

    monkeypatch.setattr(part_loads, "rows_not_in", fails)
    with pytest.raises(Exception, match="lost"):
        load(spark, place)
    monkeypatch.undo()
    part(place, "b.csv", *rows(5, 15))
    load(spark, place)
    assert [r[0] for r in loaded(spark, place)] == list(range(15))
    assert part_loads.read_quarantine(spark, str(place / "bad")).count() == 1


def test_no_parts(spark, place):
    assert load(spark, place) == 0 and loaded(spark, place) == []
    assert part_loads.read_quarantine(spark, str(place / "bad")).count() == 0
