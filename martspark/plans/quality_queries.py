"""Data quality checks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martspark.functions import scalars
from martspark.operators import marts, quality
from martspark.plans import samples as s
from martspark.plans.registry import clustered, query, rounded
from martspark.schemas import CLUSTER_NAMES


@query(
    """SELECT 'orders' AS "table", count(*) AS rows, count(*) > 0 AS ok FROM orders
       UNION ALL SELECT 'part', count(*), count(*) > 0 FROM part
       UNION ALL SELECT 'nobody', count(*), count(*) > 0 FROM customer WHERE c_acctbal IS NULL"""
)
def check_not_empty(spark, sf_dir):
    return quality.check_not_empty({
        "orders": s.table(spark, sf_dir, "orders"),
        "part": s.table(spark, sf_dir, "part"),
        "nobody": s.table(spark, sf_dir, "customer").where(F.col("c_acctbal").isNull()),
    })


@query(
    """SELECT e.value, count(a.cluster) > 0 AS found, CASE WHEN count(a.cluster) > 0 THEN 'ok' ELSE 'warn' END AS severity
       FROM (VALUES ('Top Users'), ('Loyal Users'), ('At-Risk Users'), ('Lost Users')) e(value)
       LEFT JOIN age_count a ON a.cluster = e.value GROUP BY 1""",
    "age_count",
)
def check_expected_values(spark, sf_dir):
    ages = marts.age_count(clustered(spark, sf_dir))
    return quality.check_expected_values(ages, "cluster", [*CLUSTER_NAMES, "Lost Users"])


@query(
    """SELECT v AS l_returnflag FROM (VALUES ('A'), ('N'), ('R'), ('X')) e(v)
       WHERE v NOT IN (SELECT l_returnflag FROM lineitem)"""
)
def missing_expected(spark, sf_dir):
    return quality.missing_expected(s.table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


@query("SELECT DISTINCT p_brand FROM part")
def distinct_values(spark, sf_dir):
    return quality.distinct_values(s.table(spark, sf_dir, "part"), "p_brand")


@query(
    """SELECT trans_service, count(*) AS count, round(sum(trans_amount), 2) AS amount
       FROM (SELECT * FROM fact_trans UNION ALL SELECT * FROM order_trans) GROUP BY 1""",
    "fact_trans order_trans",
)
def union_all(spark, sf_dir):
    both = quality.union_all(s.fact_trans(spark, sf_dir), s.order_trans(spark, sf_dir))
    totals = both.groupBy("trans_service").agg(
        F.count(F.lit(1)).alias("count"), F.sum("trans_amount").alias("amount")
    )
    return rounded(totals, 2, "amount")


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem
       GROUP BY ALL HAVING count(*) > 1"""
)
def check_unique(spark, sf_dir):
    return quality.check_unique(s.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """SELECT l_suppkey, count(*) AS rows FROM lineitem
       WHERE l_suppkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1"""
)
def fk_violations(spark, sf_dir):
    return quality.fk_violations(
        s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "nation"), "l_suppkey", "n_nationkey"
    )


@query(
    """SELECT 'events' AS child, count(DISTINCT user_id) AS orphan_keys, count(*) AS orphan_rows, count(*) = 0 AS ok
       FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)
       UNION ALL
       SELECT 'lineitem', count(DISTINCT l_orderkey), count(*), count(*) = 0
       FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
       UNION ALL
       SELECT 'lineitem_label', count(DISTINCT l_suppkey), count(*), count(*) = 0
       FROM lineitem WHERE l_suppkey NOT IN (SELECT label FROM embeddings)"""
)
def check_fk(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    checks = {
        "events": (s.table(spark, sf_dir, "events"), s.table(spark, sf_dir, "customer"), "user_id", "c_custkey"),
        "lineitem": (lines, s.table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
        "lineitem_label": (lines, s.table(spark, sf_dir, "embeddings"), "l_suppkey", "label"),
    }
    found = [
        quality.check_fk(*check).select(F.lit(name).alias("child"), "*") for name, check in checks.items()
    ]
    return quality.union_all(*found)


@query(
    """SELECT 'discount' AS rule, count(*) FILTER (WHERE NOT l_discount <= 0.05) AS violations,
              count(*) FILTER (WHERE NOT l_discount <= 0.05) = 0 AS ok FROM lineitem
       UNION ALL SELECT 'quantity', count(*) FILTER (WHERE NOT l_quantity >= 1),
              count(*) FILTER (WHERE NOT l_quantity >= 1) = 0 FROM lineitem
       UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')),
              count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) = 0 FROM lineitem"""
)
def check_predicates(spark, sf_dir):
    rules = {
        "discount": F.col("l_discount") <= 0.05,
        "quantity": F.col("l_quantity") >= 1,
        "flag": scalars.in_set("l_returnflag", ["A", "N"]),
    }
    return quality.check_predicates(s.table(spark, sf_dir, "lineitem"), rules)


@query(
    """SELECT 'name_length' AS rule, count(*) FILTER (WHERE length(name) < 2) AS violations,
              count(*) FILTER (WHERE length(name) < 2) = 0 AS ok FROM chat_users
       UNION ALL SELECT 'email_shape', count(*) FILTER (WHERE email NOT LIKE '%@%.%'),
              count(*) FILTER (WHERE email NOT LIKE '%@%.%') = 0 FROM chat_users
       UNION ALL SELECT 'title_length', count(*) FILTER (WHERE length(title) > 255),
              count(*) FILTER (WHERE length(title) > 255) = 0 FROM chat_sessions
       UNION ALL SELECT 'sender_type', count(*) FILTER (WHERE sender_type NOT IN ('user', 'assistant', 'system')),
              count(*) FILTER (WHERE sender_type NOT IN ('user', 'assistant', 'system')) = 0 FROM messages
       UNION ALL SELECT 'content_type', count(*) FILTER (WHERE content_type NOT IN ('text', 'image', 'file', 'mixed')),
              count(*) FILTER (WHERE content_type NOT IN ('text', 'image', 'file', 'mixed')) = 0 FROM messages
       UNION ALL SELECT 'status',
              count(*) FILTER (WHERE status NOT IN ('draft', 'sending', 'sent', 'delivered', 'failed', 'deleted')),
              count(*) FILTER (WHERE status NOT IN ('draft', 'sending', 'sent', 'delivered', 'failed', 'deleted')) = 0
       FROM messages""",
    "chat_users chat_sessions messages",
)
def chat_rules(spark, sf_dir):
    frames = {
        "users": s.chat_users(spark, sf_dir),
        "chat_sessions": s.chat_sessions(spark, sf_dir),
        "messages": s.messages(spark, sf_dir),
    }
    return quality.union_all(*[quality.check_predicates(df, quality.chat_rules(n)) for n, df in frames.items()])


@query(
    """SELECT 'id' AS rule, count(*) FILTER (WHERE id IS NULL) AS violations,
              count(*) FILTER (WHERE id IS NULL) = 0 AS ok FROM chat_sessions
       UNION ALL SELECT 'title', count(*) FILTER (WHERE title IS NULL), count(*) FILTER (WHERE title IS NULL) = 0
       FROM chat_sessions
       UNION ALL SELECT 'last_message_at', count(*) FILTER (WHERE last_message_at IS NULL),
              count(*) FILTER (WHERE last_message_at IS NULL) = 0 FROM chat_sessions""",
    "chat_sessions",
)
def check_not_null(spark, sf_dir):
    return quality.check_not_null(s.chat_sessions(spark, sf_dir), ["id", "title", "last_message_at"])


@query(
    """SELECT max(ts) AS latest, round(epoch(TIMESTAMP '2024-02-01 00:00:00' - max(ts)) / 3600, 4) AS age_hours,
              TIMESTAMP '2024-02-01 00:00:00' - max(ts) <= INTERVAL 48 HOURS AS ok FROM events"""
)
def check_freshness(spark, sf_dir):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return rounded(quality.check_freshness(s.table(spark, sf_dir, "events"), "ts", 48, as_of), 4, "age_hours")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.split("c_name", "#")
    bad = F.col("c_acctbal") < 0
    # Hosts with a hyphen at either end and of 63 and 64 characters, on which a looser rule would not agree.
    key = F.col("c_custkey") % 7
    host = (
        F.when(key == 1, "-example").when(key == 2, "example-").when(key == 3, F.repeat(F.lit("e"), F.lit(63)))
        .when(key == 4, F.repeat(F.lit("e"), F.lit(64))).otherwise("my-example")
    )
    return s.table(spark, sf_dir, "customer").select(
        "c_custkey",
        name[0].alias("firstName"),
        F.when(F.col("c_nationkey") > 2, name[1]).alias("lastName"),
        F.when(bad, F.lower("c_name")).otherwise(
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), host, F.lit(".com"))
        ).alias("email"),
        F.concat(
            F.when(F.col("c_nationkey") < 10, F.lit("+1 ")).when(bad, F.lit("0x")).otherwise(F.lit("(030) ")),
            F.lpad(F.col("c_custkey").cast("string"), 7, "5"),
        ).alias("contact"),
        F.col("c_mktsegment").alias("address1"),
        F.when(bad, F.lit("")).otherwise(F.col("c_mktsegment")).alias("address2"),
    )


# The two patterns are fixed values, those of the contact rules in functions.text.
@query(
    r"""WITH contacts AS (
         SELECT c_custkey, split_part(c_name, '#', 1) AS f, CASE WHEN c_nationkey > 2 THEN split_part(c_name, '#', 2) END AS l,
                CASE WHEN c_acctbal < 0 THEN lower(c_name) ELSE lower(replace(c_name, '#', '.')) || '@' || CASE c_custkey % 7 WHEN 1 THEN '-example'
                  WHEN 2 THEN 'example-' WHEN 3 THEN repeat('e', 63) WHEN 4 THEN repeat('e', 64) ELSE 'my-example' END || '.com' END AS e,
                CASE WHEN c_nationkey < 10 THEN '+1 ' WHEN c_acctbal < 0 THEN '0x' ELSE '(030) ' END
                    || lpad(CAST(c_custkey AS VARCHAR), 7, '5') AS p,
                c_mktsegment AS a1, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS a2
         FROM customer)
       SELECT c_custkey, concat_ws('; ',
         CASE WHEN coalesce(f, '') = '' THEN 'firstName required' END,
         CASE WHEN coalesce(l, '') = '' THEN 'lastName required' END,
         CASE WHEN coalesce(e, '') = '' THEN 'email required' END,
         CASE WHEN coalesce(p, '') = '' THEN 'contact required' END,
         CASE WHEN coalesce(a1, '') = '' THEN 'address1 required' END,
         CASE WHEN coalesce(a2, '') = '' THEN 'address2 required' END,
         CASE WHEN NOT regexp_matches(e,
              '^[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$')
              THEN 'invalid email' END,
         CASE WHEN NOT regexp_matches(p,
              '^((\+[1-9]{1,4}[ -]?)|(\([0-9]{2,3}\)[ -]?)|([0-9]{2,4})[ -]?)*[0-9]{3,4}[ -]?[0-9]{3,4}$')
              THEN 'Phone number is not valid' END) AS failed
       FROM contacts"""
)
def validate_contacts(spark, sf_dir):
    checked = quality.validate_contacts(contacts(spark, sf_dir))
    return checked.select("c_custkey", F.array_join("failed_rules", "; ").alias("failed"))
