"""Text and number functions, and result summaries as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.functions import scalars, text
from martspark.operators import chat, results
from martspark.plans import samples as s
from martspark.plans.registry import ORACLES, query, rounded, services
from martspark.sources import tables


# -- text functions ------------------------------------------------------------------------------


_WORDS = ["the", "http", "@", "license", "<p>", "ion"]
_WORDS_SQL = "['the', 'http', '@', 'license', '<p>', 'ion']"


@query(
    f"""SELECT doc_id, len(m) > 0 AS hit, array_to_string(m, ',') AS words
        FROM (SELECT doc_id, list_filter({_WORDS_SQL}, lambda k: contains(lower("text"), k)) AS m FROM documents)"""
)
def matched_keywords(spark, sf_dir):
    return s.table(spark, sf_dir, "documents").select(
        "doc_id",
        text.contains_any("text", _WORDS).alias("hit"),
        F.array_join(text.matched_keywords("text", _WORDS), ",").alias("words"),
    )


@query(
    r"""SELECT page_id, nullif(regexp_extract(html, '(?s)\{.*\}'), '') AS "json" FROM pages"""
)
def extract_json(spark, sf_dir):
    return s.table(spark, sf_dir, "pages").select("page_id", text.extract_json("html").alias("json"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def parse_json(spark, sf_dir):
    return s.table(spark, sf_dir, "events").select("event_id", text.parse_json("props", "k int")["k"].alias("k"))


_REPLIES = """
    SELECT conv_id, turn, CASE turn % 4
        WHEN 0 THEN "text" || chr(10) || '```sql' || chr(10) || 'SELECT count(*)' || chr(10) || '  FROM t' || conv_id || ';'
                    || chr(10) || '```' || chr(10) || "text"
        WHEN 1 THEN '  with a as (select 1)  ' || chr(10) || ' select * from a ' || chr(10) || '   ' || chr(10) || "text"
        WHEN 2 THEN 'Here:' || chr(10) || '```' || chr(10) || 'select ''' || role || ''' as role; -- all' || chr(10) || 'x;'
                    || chr(10) || '```'
        ELSE "text" END AS reply
    FROM conversations"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lines(*parts):
        return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])

    body, kind = F.col("text"), F.col("turn") % 4
    reply = (
        F.when(kind == 0, lines(body, "```sql", "SELECT count(*)",
                                F.concat(F.lit("  FROM t"), F.col("conv_id").cast("string"), F.lit(";")), "```", body))
        .when(kind == 1, lines("  with a as (select 1)  ", " select * from a ", "   ", body))
        .when(kind == 2, lines("Here:", "```",
                               F.concat(F.lit("select '"), F.col("role"), F.lit("' as role; -- all")), "x;", "```"))
        .otherwise(body)
    )
    return s.table(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))


@query(
    rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(reply, '```sql\n?', '', 'g'), '```\n?', '', 'g') AS plain
         FROM ({_REPLIES})"""
)
def strip_fences(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", text.strip_fences("reply").alias("plain"))


@query(
    rf"""WITH plain AS (
           SELECT conv_id, turn, [trim(x, ' ' || chr(9) || chr(13)) for x in string_split(
                    trim(regexp_replace(regexp_replace(reply, '```sql\n?', '', 'g'), '```\n?', '', 'g'),
                         ' ' || chr(9) || chr(13) || chr(10)), chr(10))] AS l
           FROM ({_REPLIES})),
         rest AS (
           SELECT conv_id, turn, l[list_position(starts, true):] AS l, list_contains(starts, true) AS hit
           FROM (SELECT *, [regexp_matches(x, '(?i)^(select|with|insert|update|delete)') for x in l] AS starts
                 FROM plain)),
         stmt AS (
           SELECT conv_id, turn, hit, array_to_string(
                    l[:coalesce(list_position([x = '' OR ends_with(x, ';') for x in l], true), len(l))], chr(10)) AS q FROM rest)
         SELECT conv_id, turn, CASE WHEN NOT hit THEN ''
                  ELSE regexp_replace(trim(q, ' ' || chr(10)), ';$', '') END AS sql FROM stmt"""
)
def first_sql(spark, sf_dir):
    return replies(spark, sf_dir).select("conv_id", "turn", text.first_sql("reply").alias("sql"))


@query(
    """SELECT page_id, array_to_string(string_split(url, '/'), ' ') AS parts, len(string_split(url, '/')) AS n,
              TRY_CAST(CASE WHEN regexp_full_match(split_part(url, '/', -1), '[0-9]+') THEN split_part(url, '/', -1) END
                       AS INTEGER) AS number
       FROM pages"""
)
def split_list(spark, sf_dir):
    parts = text.split_list("url", "/")
    return s.table(spark, sf_dir, "pages").select(
        "page_id",
        F.array_join(parts, " ").alias("parts"),
        F.size(parts).cast("long").alias("n"),
        text.safe_int(F.element_at(parts, -1)).alias("number"),
    )


@query(
    """SELECT conv_id, turn,
              array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] <> ''),
                                             lambda i: w[i] || '|' || coalesce(t[i], w[i]) || '|' || length(w[i])), ' ') AS records
       FROM (SELECT conv_id, turn, w, list_filter(w, lambda x: length(x) > 4) AS t
             FROM (SELECT conv_id, turn, string_split(coalesce("text", ''), ' ') AS w FROM conversations))"""
)
def zip_records(spark, sf_dir):
    """The words of each turn, its longer words and the lengths of all, put together by position."""
    turns = s.table(spark, sf_dir, "conversations")
    words = text.split_list("text", " ")
    columns = {
        "url": words,
        "thumbnail": F.filter(words, lambda w: F.length(w) > 4),
        "width": F.transform(words, lambda w: F.length(w).cast("string")),
    }
    shown = F.transform(
        text.zip_records(columns, "url", {}),
        lambda r: F.concat_ws("|", r["url"], F.coalesce(r["thumbnail"], r["url"]), r["width"]),
    )
    return turns.select("conv_id", "turn", F.array_join(shown, " ").alias("records"))


@query(
    """SELECT message_id, 'Image ' || row_number() OVER (PARTITION BY message_id ORDER BY id) || ': ' || image_url AS line
       FROM message_images""",
    "message_images",
)
def number_items(spark, sf_dir):
    rows = chat.collect_images(s.message_images(spark, sf_dir))
    return rows.select("message_id", text.number_item("position", "image.url", "Image").alias("line"))


@query(
    """SELECT page_id, CASE WHEN contains(url, '.') THEN split_part(url, '.', -1) ELSE 'jpg' END AS ext,
              starts_with(url, 'image/') AS image, length(html) <= 10 * 1024 * 1024 AS fits,
              length(url) BETWEEN 20 AND 40 AS good_length
       FROM pages"""
)
def file_rules(spark, sf_dir):
    return s.table(spark, sf_dir, "pages").select(
        "page_id",
        text.file_ext("url").alias("ext"),
        text.is_image("url").alias("image"),
        text.size_ok(F.length("html")).alias("fits"),
        scalars.length_between("url", 20, 40).alias("good_length"),
    )


@query(
    """SELECT o_orderkey, round(o_totalprice / 7, 2) AS price, o_orderkey // 4 AS quarter_key,
              format('{:,}', o_orderkey) AS number, '$' || format('{:,}', o_custkey) AS money,
              CAST(o_custkey AS VARCHAR) AS axis
       FROM orders"""
)
def number_formats(spark, sf_dir):
    return s.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scalars.round2(F.col("o_totalprice") / 7).alias("price"),
        scalars.floor_div("o_orderkey", 4).alias("quarter_key"),
        scalars.fmt_number("o_orderkey").alias("number"),
        scalars.fmt_currency("o_custkey").alias("money"),
        scalars.axis_text("o_custkey").alias("axis"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CAST(datediff('day', l_shipdate, TIMESTAMP '2002-01-01 00:00:00') AS INTEGER) AS days,
              CAST(hour(l_shipdate) AS INTEGER) AS "hour", CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start
       FROM lineitem"""
)
def date_parts(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        scalars.days_between("l_shipdate", F.lit("2002-01-01").cast("date")).alias("days"),
        scalars.hour_of("l_shipdate").alias("hour"),
        scalars.month_start(F.col("l_shipdate")).alias("month_start"),
    )


@query(
    """SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'Returned' WHEN 'N' THEN 'Kept' END AS label,
              count(*) AS rows FROM lineitem GROUP BY 1, 2"""
)
def map_labels(spark, sf_dir):
    labelled = s.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", scalars.map_labels("l_returnflag", {"A": "Returned", "N": "Kept"}).alias("label")
    )
    return labelled.groupBy("l_returnflag", "label").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows, count(*) AS ids, true AS timed FROM conversations")
def new_ids(spark, sf_dir):
    rows = s.table(spark, sf_dir, "conversations").select(
        scalars.new_id().alias("uuid"), scalars.now().alias("created_at")
    )
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("uuid").alias("ids"),
        F.bool_and(F.col("created_at").isNotNull()).alias("timed"),
    )


# -- results -------------------------------------------------------------------------------------


@query(
    """SELECT 'l_orderkey' AS "column", 0 AS position, CAST(sum(l_orderkey) AS DOUBLE) AS total,
              round(avg(l_orderkey), 4) AS average, CAST(min(l_orderkey) AS DOUBLE) AS minimum,
              CAST(max(l_orderkey) AS DOUBLE) AS maximum FROM lineitem
       UNION ALL SELECT 'l_quantity', 1, sum(l_quantity), round(avg(l_quantity), 4), min(l_quantity), max(l_quantity)
       FROM lineitem
       UNION ALL SELECT 'l_linenumber', 2, sum(l_linenumber), round(avg(l_linenumber), 4), min(l_linenumber), max(l_linenumber)
       FROM lineitem"""
)
def numeric_summary(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_quantity", "l_linenumber", "l_tax"
    )
    return rounded(results.numeric_summary(lines), 4, "average")


@query(
    """SELECT '{"service":"' || service || '","count":' || count || '}' AS "json" FROM service_count""",
    "service_count",
)
def to_json_records(spark, sf_dir):
    return results.to_json_records(services(spark, sf_dir))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def head_n(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return results.head_n(orders, 5, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def preview(spark, sf_dir):
    return results.preview(s.table(spark, sf_dir, "part"), order=["p_partkey"])


@query(
    """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders
       GROUP BY 1"""
)
def run_readonly_sql(spark, sf_dir):
    tables.publish_view(s.table(spark, sf_dir, "orders"), "asked_orders")
    asked = """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent
               FROM asked_orders GROUP BY o_custkey ORDER BY spent DESC, o_custkey;"""
    return results.run_readonly_sql(spark, asked).frame


@query(
    """WITH r AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
            k AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority) AS i FROM r)
       SELECT 'Database: sales' || chr(10) || 'Query: orders by priority' || chr(10)
              || 'Results: ' || count(*) || ' rows returned' || chr(10) || 'Sample data:' || chr(10)
              || string_agg('  Row ' || i || ': {"o_orderpriority":"' || o_orderpriority || '","n":' || n || '}', chr(10)
                            ORDER BY i) FILTER (WHERE i <= 5)
              || CASE WHEN count(*) > 5 THEN chr(10) || '  ... and ' || (count(*) - 5) || ' more rows' ELSE '' END
              || chr(10) || 'Summary statistics:' || chr(10)
              || '  n: Total=' || CAST(sum(n) AS BIGINT) || ', Average=' || CAST(round(avg(n), 2) AS DECIMAL(38, 2))
              || ', Min=' || min(n) || ', Max=' || max(n) AS context
       FROM k"""
)
def result_context(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return results.result_context(counts, "sales", "orders by priority", ["o_orderpriority"])


@query(
    f"""SELECT context || chr(10) || chr(10) || 'Database: mart' || chr(10) || 'Query: DROP TABLE orders' || chr(10)
               || 'Query failed: not a query' || chr(10) AS context FROM ({ORACLES["result_context"]})"""
)
def answers_context(spark, sf_dir):
    """A good answer and a failed one."""
    orders = s.table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority")
    good = results.QueryResult(True, "orders by priority", counts, tuple(counts.columns))
    bad = results.QueryResult(False, "DROP TABLE orders", error="not a query")
    return results.answers_context(spark, [("sales", good), ("mart", bad)])


@query(
    f"""SELECT replace(context, 'orders by priority', 'SELECT o_orderpriority, count(*) AS n FROM asked_orders GROUP BY 1 ORDER BY 1')
               || chr(10) || chr(10) || 'Database: mart' || chr(10)
               || 'Query: SELECT if(o_orderkey > 0, raise_error(''closed''), 1) AS n FROM asked_orders' || chr(10)
               || 'Query failed: [USER_RAISED_EXCEPTION] closed SQLSTATE: P0001' || chr(10) AS context
        FROM ({ORACLES["result_context"]})"""
)
def answers_within(spark, sf_dir):
    """Two questions with a time limit, one of which fails while it runs."""
    tables.publish_view(s.table(spark, sf_dir, "orders"), "asked_orders")
    asked = (
        ("sales", "SELECT o_orderpriority, count(*) AS n FROM asked_orders GROUP BY 1 ORDER BY 1"),
        ("mart", "SELECT if(o_orderkey > 0, raise_error('closed'), 1) AS n FROM asked_orders"),
    )
    return results.answers_context(spark, [(name, results.run_within(spark, sql, 600)) for name, sql in asked])
