import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martspark import schemas
from martspark.operators import results
from martspark.session import sizing, stage, stage_dir, stage_path
from martspark.sources import catalog, files, jdbc, tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- results ----------------------------------------------------------------------------------


@pytest.mark.parametrize("sql", [
    "DROP TABLE x", "INSERT INTO x SELECT 1", "DELETE FROM x", "UPDATE x SET a = 1", "SET a = 1",
    "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "CREATE TABLE y AS SELECT 1", "SELECT 1; DROP TABLE x",
    "SELECT * FROM table_that_is_not_there", "",
])
def test_only_queries_run(spark, sql):
    answer = results.run_readonly_sql(spark, sql)
    assert not answer.success and answer.error and answer.frame is None


def test_query_gives_all_rows_in_its_order(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    answer = results.run_readonly_sql(spark, "WITH n AS (SELECT id FROM numbers) SELECT id FROM n ORDER BY id DESC; ")
    got = [r["id"] for r in answer.frame.collect()]
    assert answer.success and answer.columns == ("id",) and got == list(range(499, -1, -1))
    assert results.run_readonly_sql(spark, "SELECT id FROM numbers -- some", cap=100).frame.count() == 100


def test_numeric_summary_skips_text_booleans_and_unknowns(spark):
    df = spark.createDataFrame(
        [("a", True, 1, 2.0, None, 5), ("b", False, 3, None, None, 6)],
        "t string, b boolean, x int, y double, z int, late int",
    )
    assert rows(results.numeric_summary(df)) == [("x", 0, 4.0, 2.0, 1.0, 3.0), ("y", 1, 2.0, 2.0, 2.0, 2.0)]
    assert results.numeric_summary(df.select("t")).count() == 0


def test_context_text(spark):
    df = spark.range(7).select(F.col("id"), (F.col("id") % 2 == 0).alias("even"))
    text = results.result_context(df, "shop", "SELECT *", ["id"]).first()["context"]
    assert text.split("\n") == [
        "Database: shop", "Query: SELECT *", "Results: 7 rows returned", "Sample data:",
        *[f'  Row {i + 1}: {{"id":{i},"even":{str(i % 2 == 0).lower()}}}' for i in range(5)],
        "  ... and 2 more rows", "Summary statistics:", "  id: Total=21, Average=3.00, Min=0, Max=6",
    ]
    empty = results.result_context(df.limit(0), "shop", "q").first()["context"]
    assert empty.split("\n")[2:] == ["Results: 0 rows returned", "No data returned"]


def test_context_of_several_answers(spark):
    spark.range(2).createOrReplaceTempView("numbers")
    good = results.run_readonly_sql(spark, "SELECT id FROM numbers")
    bad = results.run_readonly_sql(spark, "DROP TABLE numbers")
    text = results.answers_context(spark, [("a", good), ("b", bad), ("c", good)]).first()["context"]
    first, second, third = text.removesuffix("\n").split("\n\nDatabase: ")
    assert first == results.result_context(good.frame, "a", good.query).first()["context"]
    assert second == f"b\nQuery: DROP TABLE numbers\nQuery failed: {bad.error}" and third.startswith("c\nQuery")
    assert results.answers_context(spark, []).first()["context"] == "No data was retrieved."


def test_json_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert results.to_json_records(df).first()["json"] == '{"a":1,"b":null}'


# -- files ------------------------------------------------------------------------------------


def test_csv_tables(spark, tmp_path):
    (tmp_path / "cards.csv").write_text("card_id,card_type\n1,Debit\nx,Credit\n")
    df = files.read_csv_table(spark, str(tmp_path / "cards.csv"), schemas.DIM_CARD, keep_corrupt=True)
    got = {r["card_type"]: (r["card_id"], r[files.CORRUPT]) for r in df.collect()}
    assert got["Debit"] == (1, None) and got["Credit"] == (None, "x,Credit")


def test_fact_parts(spark, tmp_path):
    head = "trans_id,user_id,card_id,trans_timestamp,trans_amount,trans_service\n"
    (tmp_path / "fact_0.csv").write_text(head + "1,1,1,2024-01-02 03:04:05,1.1,0742\n")
    (tmp_path / "fact_1.csv").write_text(head + "2,1,1,soon,,abc\n")
    glob = str(tmp_path / "fact_*.csv")
    got = files.read_fact_parts(spark, glob)
    assert got.schema == T.StructType([T.StructField(f.name, f.dataType) for f in schemas.FACT_TRANS])
    assert rows(got) == [(1, 1, 1, dt.datetime(2024, 1, 2, 3, 4, 5), 1.1, "0742"), (2, 1, 1, None, None, "abc")]
    raw = files.read_csv_table(spark, glob, schemas.FACT_TRANS_RAW)
    assert raw.where(files.bad_timestamps(raw)).count() == 1


def test_mcc_and_rows_frame(spark, tmp_path):
    (tmp_path / "mcc.csv").write_text(
        "mcc,edited_description,combined_description,usda_description,irs_description,irs_reportable\n"
        '0742,a,b,c,"Veterinary, Services",Yes\n')
    assert rows(files.read_mcc(spark, str(tmp_path / "mcc.csv"))) == [(742, "Veterinary, Services")]
    assert rows(files.rows_frame(spark, [(1, 2, 3, 4.0)], schemas.MART["stats"])) == [(1, 2, 3, 4.0)]


def test_chat_tables(spark):
    folder = stage_path(spark, "chat")
    for name, schema in schemas.CHAT.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")
    read = files.read_chat(spark, folder)
    assert read.messages.columns == schemas.CHAT["messages"].names and read.users.count() == 0


# -- JDBC options (there is no database to talk to here) --------------------------------------


def test_jdbc_options():
    plain = jdbc.jdbc_options("jdbc:x", query="SELECT a FROM t", props={"user": "u"})
    assert plain["dbtable"] == "(SELECT a FROM t) AS source" and plain["user"] == "u"
    split = jdbc.jdbc_options("jdbc:x", table="t", partition_column="id", lower=0, upper=9, num_partitions=3)
    assert (split["dbtable"], split["partitionColumn"], split["numPartitions"]) == ("t", "id", "3")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", table="t", partition_column="id")
    assert jdbc.jdbc_writer_options("jdbc:x", "t")["truncate"] == "true"


# -- tables -----------------------------------------------------------------------------------


def test_conform(spark):
    schema = T.StructType.fromDDL("a int, b string")
    df = spark.createDataFrame([("1", 5), ("x", 6)], "a string, b int")
    assert rows(tables.conform(df.select("b", "a"), schema)) == [(1, "5"), (None, "6")]
    assert rows(tables.conform_losses(df, schema)) == [(1, 0)]


def test_declared_lengths(spark):
    schema = schemas.MART["gender_count"]
    df = spark.createDataFrame([("f" * 20, 1, None), ("m" * 21, 2, "c")], "gender string, count long, cluster string")
    assert rows(tables.conform_losses(df, schema)) == [(1, 0, 0)]
    assert rows(tables.conform(df, schema)) == [("f" * 20, 1, None), (None, 2, "c")]
    with pytest.raises(ValueError, match="gender"):
        tables.write_mart(df, stage_path(spark, "lengths"), schema)


def test_write_and_append(spark):
    path = stage_path(spark, "append")
    df = spark.createDataFrame([("u1", 1), ("u2", 2)], "uuid string, n int")
    assert tables.append_rows(df, path) == 2
    more = spark.createDataFrame([("u2", 9), ("u3", 3), ("u3", 3)], "uuid string, n int")
    assert tables.append_rows(more, path) == 1 and tables.append_rows(more, path) == 0
    assert rows(spark.read.parquet(path)) == [("u1", 1), ("u2", 2), ("u3", 3)]
    assert tables.write_mart(df.limit(1), path) == 1 and spark.read.parquet(path).count() == 1


def test_upsert_keeps_what_is_not_given(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, title string, n int")
    new = spark.createDataFrame([(2, 5, 1), (2, 7, 2), (3, 9, 1), (1, None, 1)], "id int, n int, at int")
    assert rows(tables.upsert(base, new, "id", ["at"])) == [(1, "a", 1), (2, "b", 7), (3, None, 9)]


def test_few_updates_do_not_shuffle_the_base(spark):
    path = stage_path(spark, "base")
    spark.range(50_000).selectExpr("id", "id % 7 AS n").write.parquet(path)
    new = stage(spark.createDataFrame([(3, 100), (60_000, 1)], "id long, n long"), "updates")
    out = tables.upsert(spark.read.parquet(path), new, "id")
    assert out.count() == 50_001 and out.agg(F.max("n")).first()[0] == 100
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_cascade_delete(spark):
    base = {
        "s": spark.createDataFrame([(1,), (2,)], "id int"),
        "m": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, s int"),
        "i": spark.createDataFrame([(100, 10), (200, 20)], "id int, m int"),
        "p": spark.createDataFrame([(7, 1), (8, 2)], "id int, s int"),
        "other": spark.createDataFrame([(1,)], "id int"),
    }
    links = {"m": [("s", "s")], "i": [("m", "m")], "p": [("s", "s")]}
    left = tables.cascade_delete(base, "s", base["s"].where("id = 1"), "id", links)
    assert {n: rows(df.select("id")) for n, df in left.items()} == {
        "s": [(2,)], "m": [(20,), (30,)], "i": [(200,)], "p": [(8,)], "other": [(1,)]}


def test_a_row_goes_with_any_of_its_parents(spark):
    base = {
        "u": spark.createDataFrame([(1,), (2,)], "id int"),
        "s": spark.createDataFrame([(10, 1), (20, 2)], "id int, u int"),
        # Seats: in the own session, in another's, of nobody.
        "p": spark.createDataFrame([(5, 10, 1), (6, 20, 1), (7, 20, 2), (8, 10, 2), (9, 20, None)], "id int, s int, u int"),
    }
    links = {"p": [("s", "s"), ("u", "u")], "s": [("u", "u")]}
    left = tables.cascade_delete(base, "u", base["u"].where("id = 1"), "id", links)
    assert {n: rows(df.select("id")) for n, df in left.items()} == {"u": [(2,)], "s": [(20,)], "p": [(7,), (9,)]}
    assert left["p"].columns == base["p"].columns
    with pytest.raises(ValueError, match="refer to each other"):
        tables.cascade_delete(base, "u", base["u"], "id", {"s": [("u", "u"), ("p", "s")], "p": [("s", "s")]})


def test_misfits_are_not_written(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType(), False), T.StructField("b", T.StringType())])
    path = stage_path(spark, "misfits")
    df = spark.createDataFrame([("1", 5), ("x", None), (None, 6)], "a string, b int")
    with pytest.raises(ValueError, match="'a': 2"):
        tables.write_mart(df, path, schema)
    assert tables.write_mart(df, path, schema, allow_losses=True) == 3
    assert tables.write_mart(df.where("b = 5"), path, schema) == 1 and rows(spark.read.parquet(path)) == [(1, "5")]


def test_views_persist_touch(spark):
    df = tables.publish_view(tables.persist_stage(spark.range(3)), "shared_numbers")
    assert df.count() == 3
    moment = F.lit(dt.datetime(2024, 5, 1))
    base = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))],
                                 "id int, updated_at timestamp")
    assert [r["updated_at"].month for r in tables.touch(base, F.col("id") == 2, moment).orderBy("id").collect()] == [1, 5]


def test_sizing():
    small, large = sizing(1 << 30), sizing(100 << 40)
    part = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    split = "spark.sql.files.maxPartitionBytes"
    assert small[part] == "200" and int(large[part]) * (128 << 20) == 100 << 40
    assert int(large[split]) > int(small[split])
    below, above = sizing((1 << 40) - 1), sizing((1 << 40) + 1)
    assert abs(int(above[split]) - int(below[split])) < 10  # no jump


def test_stage_reads_back_the_same_from_the_shared_folder(spark):
    df = spark.createDataFrame([(1, "a", None)], "id int, t string, x double")
    again = stage(df, "round-trip")
    assert rows(again) == rows(df) and again.dtypes == df.dtypes
    assert again.inputFiles()[0].removeprefix("file://").startswith(stage_dir(spark))


# -- catalog ----------------------------------------------------------------------------------


def test_schema_description(spark):
    spark.createDataFrame([], schemas.DIM_CARD).createOrReplaceTempView("dim_card")
    spark.createDataFrame([], schemas.FACT_TRANS).createOrReplaceTempView("fact_trans")
    columns = catalog.catalog_columns(spark).where(F.col("table") == "dim_card")
    assert rows(columns.select("column", "data_type", "nullable", "position")) == [
        ("card_id", "int", False, 1), ("card_type", "string", True, 2)]
    spark.sql("CREATE TABLE IF NOT EXISTS with_default (id INT, role STRING DEFAULT 'member') USING parquet")
    defaults = catalog.catalog_columns(spark).where(F.col("table") == "with_default").select("column", "default")
    assert rows(defaults) == [("id", None), ("role", "'member'")]
    spark.sql("DROP TABLE with_default")
    described = {r["table"]: r["description"] for r in catalog.schema_text(catalog.catalog_columns(spark)).collect()}
    assert described["dim_card"] == (
        "Table: dim_card\nType: view\nColumns:\n  - card_id: int (NOT NULL)\n  - card_type: string (NULL)")
    text = catalog.describe_schema(spark, "shop").first()["description"]
    assert text.startswith("Database: shop\n\nTable: ") and "  - fact_trans.card_id -> dim_card.card_id" in text
    assert "chat_sessions.user_id" not in text
    joined = catalog.catalog_join(catalog.catalog_tables(spark), catalog.catalog_columns(spark))
    assert joined.where(F.col("table") == "dim_card").count() == 2
    assert catalog.catalog_relationships(spark).count() == len(schemas.FOREIGN_KEYS)
    assert catalog.catalog_columns(spark, "default").where(F.col("table") == "dim_card").count() == 2
    assert catalog.fallback_query(["a", "b"]) == "SELECT * FROM a LIMIT 10"
    assert catalog.fallback_query([]) == "SELECT 1 AS status"


SLOW = "SELECT count(*) AS n FROM range(300000) a, range(300000) b WHERE a.id + b.id > -1"


def test_a_slow_question_ends_in_time_and_the_next_one_runs(spark):
    import time

    results.run_within(spark, "SELECT 1 AS a", 60)
    start = time.monotonic()
    slow = results.run_within(spark, SLOW, 2)
    assert time.monotonic() - start < 15
    assert not slow.success and slow.error == "no answer within 2 s"
    after = results.run_within(spark, "SELECT id FROM range(7)", 60)
    assert after.success and after.columns == ("id",) and after.frame.count() == 7
    text = results.answers_context(spark, [("a", slow), ("b", after)]).first()["context"]
    assert "Query failed: no answer within 2 s" in text and "Results: 7 rows returned" in text


def test_other_jobs_go_on_while_a_question_is_interrupted(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(lambda: spark.range(0, 4_000_000, 1, 60).selectExpr("sum(length(sha2(string(id), 512)))").first()[0])
        assert not results.run_within(spark, SLOW, 1).success
        assert other.result() == 4_000_000 * 128


def test_a_question_that_fails_in_time(spark):
    for sql, part in (("SELECT raise_error('no') FROM range(3)", "no"), ("DELETE FROM x", "")):
        answer = results.run_within(spark, sql, 60)
        assert not answer.success and part in answer.error and "\n\tat " not in answer.error
