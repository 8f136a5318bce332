import datetime as dt

import pytest
from pyspark.sql import functions as F

from martspark.functions import scalars
from martspark.operators import charts, marts
from martspark.plans.daily_mart import check_mart, read_mart, run_daily
from martspark.session import stage_path

TRANS = "trans_id long, user_id int, trans_timestamp timestamp_ntz, trans_amount double, trans_service string"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def trans(spark):
    codes = ["0742", "742", "5411", "abc", "abc", " 5411 ", "5411.0", None]
    return spark.createDataFrame(
        [(i, i % 3, dt.datetime(2024, 1 + i % 2, 1 + i, 23 * (i % 2)), float(i), c) for i, c in enumerate(codes)], TRANS
    )


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([(742, "Vets"), (5411, "Groceries"), (5412, "Groceries"), (9, None)],
                                 "mcc long, description string")


def test_service_codes_match_as_numbers_or_stay(trans, lookup):
    assert rows(marts.service_count(trans, lookup)) == [("Groceries", 3), ("Vets", 2), ("abc", 2), (None, 1)]


def test_activity_gives_the_same_tables(trans, lookup):
    counts = marts.activity(trans)
    assert rows(marts.services_of_activity(counts, lookup)) == rows(marts.service_count(trans, lookup))
    assert rows(marts.hours_of_activity(counts)) == rows(marts.trans_by_hour(trans))


def test_codes_are_counted_before_the_join(trans, lookup):
    plan = marts.service_count(trans, lookup)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("count(trans_id")


def test_stats(spark, trans):
    users = spark.range(9).select(F.col("id").alias("user_id"))
    row = marts.dashboard_stats(users, trans, "2024-02-20").first()
    assert (row["new_users"], row["returning_users"], row["new_transactions"]) == (9, 2, 4)
    assert row["avg_clv"] == pytest.approx(28 / 3) and row["active_returning_users"] == 3
    empty = marts.dashboard_stats(users, spark.createDataFrame([], TRANS), "2024-02-20").first()
    assert (empty["new_transactions"], empty["avg_clv"]) == (0, 0.0)


def test_clean_lookup(spark):
    raw = spark.createDataFrame([(1, "a", "b", "c", "d", "Yes")],
                                "mcc long, edited_description string, combined_description string, "
                                "usda_description string, irs_description string, irs_reportable string")
    assert rows(marts.clean_lookup(raw)) == [(1, "d")]


def test_daily_job(spark, trans, lookup):
    users = spark.createDataFrame(
        [(i, 20 + i, "F", "c", "s", 1.0, 2.0) for i in range(5)],
        "user_id int, age int, gender string, city string, state string, latitude double, longitude double",
    )
    target = stage_path(spark, "test-mart")
    written = dict(rows(run_daily(spark, users, trans, lookup, target, "2024-02-20")))
    assert written == {"age_count": 5, "gender_count": 4, "service_count": 4, "user_geo": 5, "trans_by_day": 2,
                       "stats": 1, "rfm_scores": 3}
    mart = read_mart(spark, target)
    assert rows(mart["stats"]) == [(5, 1, 4, pytest.approx(28 / 3))]
    assert rows(mart["service_count"].orderBy(F.desc("count"), "service")) == rows(marts.service_count(trans, lookup))
    assert {r["severity"] for r in check_mart(spark, target).collect()} == {"ok"}


def test_daily_job_refuses_an_empty_table(spark, trans, lookup):
    nobody = spark.createDataFrame(
        [], "user_id int, age int, gender string, city string, state string, latitude double, longitude double"
    )
    with pytest.raises(ValueError, match="age_count"):
        run_daily(spark, nobody, trans, lookup, stage_path(spark, "test-mart"), "2024-02-20")


@pytest.mark.parametrize("age, label", [(17, "Unknown"), (18, "18-25"), (25, "18-25"), (26, "26-35"), (65, "56-65"),
                                        (66, "66+"), (120, "66+"), (None, "Unknown")])
def test_age_bins(spark, age, label):
    df = spark.createDataFrame([(age,)], "age int").select(scalars.age_bin("age").alias("b"))
    assert df.first()["b"] == label


def test_age_distribution(spark):
    ages = spark.createDataFrame(
        [(18, 2, "Top"), (25, 3, "Top"), (70, 1, None), (3, 9, "Top"), (40, 0, "Top"), (5, 1, "Young")],
        "age int, count long, cluster string",
    )
    assert sorted(rows(charts.age_distribution(ages))) == [("No Cluster", "66+", 1, 6), ("Top", "18-25", 5, 1)]
    series = {r["id"]: [tuple(p) for p in r["data"]] for r in charts.age_series(ages).collect()}
    assert series == {"Top": [("18-25", 5)], "No Cluster": [("66+", 1)], "Young": []}


def test_top_services_break_ties_by_name(spark):
    df = spark.createDataFrame([(c, 5) for c in "hgfedcba"], "service string, count long")
    assert [r["service"] for r in charts.top_services(df).collect()] == list("abcdefg")
    assert rows(charts.top_service(df)) == [("a", 5)]
    plan = charts.top_services(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, value long")
    assert sorted(rows(charts.share_of_total(df))) == [("a", 1, 33.3), ("b", 2, 66.7)]
    zero = spark.createDataFrame([("a", 0)], "id string, value long")
    assert rows(charts.share_of_total(zero)) == [("a", 0, 0.0)]


def test_geo_points_need_both_coordinates(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 2.0)], "longitude double, latitude double")
    assert rows(charts.geo_points(df)) == [(1.0, 2.0)]


def test_bar_keys(spark):
    df = spark.createDataFrame([("a", 1, "x")], "service string, count int, countColor string")
    assert charts.bar_keys(df) == ["count"]


def test_generic_series_falls_back_as_the_chart_does(spark):
    df = spark.createDataFrame([(1, 0, 0, 7.0), (2, 5, 3, 8.0), (9, None, None, None)],
                               "no int, hour int, count int, value double")
    got = sorted((r["position"], r["x"], r["y"]) for r in charts.generic_series(df, "no").collect())
    assert got == [(0, "0", 7.0), (1, "5", 3.0), (2, "2", None)]


def test_hour_series(spark):
    df = spark.createDataFrame([(10, 2), (9, 1)], "hour int, count long")
    row = charts.series_by_hour(df).first()
    assert (row["id"], [tuple(p) for p in row["data"]]) == ("Transactions", [("9", 1), ("10", 2)])


def test_pie_filter_order_clv(spark):
    df = spark.createDataFrame([("F", 2, "Top"), ("M", 3, None)], "gender string, count long, cluster string")
    assert rows(charts.to_pie(df, "gender"))[0] == ("F", "F", 2)
    assert rows(charts.filter_cluster(df, "Top")) == [("F", 2, "Top")]
    assert charts.filter_cluster(df).count() == 2
    assert [r["count"] for r in charts.order_by(df, ["count"], desc=True).collect()] == [3, 2]
    stats = spark.createDataFrame([(1.236,)], "avg_clv double")
    assert rows(charts.average_clv(stats)) == [(1.24,)]


def test_number_texts(spark):
    df = spark.createDataFrame([(1234567.0,), (1234.5,), (0.0,), (1000.25,)], "x double")
    assert [r[0] for r in df.select(scalars.fmt_number("x")).collect()] == ["1,234,567", "1,234.5", "0", "1,000.25"]
    assert df.select(scalars.fmt_currency("x")).first()[0] == "$1,234,567"
    assert df.select(scalars.fmt_number("x", 0)).first()[0] == "1,234,567"
