"""Features, segments, mart tables and charts as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martspark.operators import charts, features, marts, quality, segment
from martspark.plans import daily_mart
from martspark.plans import samples as s
from martspark.plans.registry import clustered, order_features, query, rounded, services
from martspark.session import stage, stage_path


# -- features and segments -----------------------------------------------------------------------


@query(
    "SELECT user_id, last_trans_date, frequency, round(monetary, 2) AS monetary, recency FROM rfm",
    "rfm",
)
def rfm_features(spark, sf_dir):
    return rounded(features.rfm_features(s.fact_trans(spark, sf_dir)), 2, "monetary")


@query("SELECT max(trans_timestamp) AS as_of FROM fact_trans", "fact_trans")
def as_of_date(spark, sf_dir):
    return features.as_of_date(s.fact_trans(spark, sf_dir))


@query("SELECT user_id, round(sum(trans_amount), 2) AS total_spent FROM fact_trans GROUP BY 1", "fact_trans")
def user_spend(spark, sf_dir):
    return rounded(features.user_spend(s.fact_trans(spark, sf_dir)), 2, "total_spent")


@query(
    """SELECT round(avg(total), 4) AS avg_clv
       FROM (SELECT sum(trans_amount) AS total FROM fact_trans GROUP BY user_id)""",
    "fact_trans",
)
def avg_clv(spark, sf_dir):
    return rounded(features.avg_clv(s.fact_trans(spark, sf_dir)), 4, "avg_clv")


@query(
    """SELECT * FROM order_trans WHERE trans_timestamp >= date_trunc('month', TIMESTAMP '2001-05-20 00:00:00')""",
    "order_trans",
)
def since_month_start(spark, sf_dir):
    return features.since_month_start(s.order_trans(spark, sf_dir), "2001-05-20")


@query(
    """SELECT user_id, round(z_frequency, 6) AS z_frequency, round(z_monetary, 6) AS z_monetary,
              round(z_recency, 6) AS z_recency FROM standard""",
    "standard",
)
def standardize(spark, sf_dir):
    scored = features.standardize(features.staged_features(s.fact_trans(spark, sf_dir)))
    zs = [f"z_{c}" for c in features.FEATURES]
    return rounded(scored, 6, *zs).select("user_id", *zs)


@query(
    """SELECT metric, edge, round(v, 4) AS value FROM (
         SELECT 'frequency' AS metric, unnest(range(0, 6)) AS edge,
                unnest(quantile_cont(frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS v FROM order_rfm
         UNION ALL
         SELECT 'monetary', unnest(range(0, 6)),
                unnest(quantile_cont(monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) FROM order_rfm)""",
    "order_rfm",
)
def quantile_edges(spark, sf_dir):
    edges = features.quantile_edges(order_features(spark, sf_dir), ["frequency", "monetary"])
    rows = edges.select("metric", F.posexplode("edges").alias("edge", "value"))
    return rounded(rows.withColumn("edge", F.col("edge").cast("long")), 4, "value")


@query(
    """SELECT user_id, frequency,
              CAST(1 + (f[2] > f[1] AND frequency > f[2])::INT + (f[3] > f[2] AND frequency > f[3])::INT
                     + (f[4] > f[3] AND frequency > f[4])::INT + (f[5] > f[4] AND frequency > f[5])::INT
                   AS INTEGER) AS frequency_score,
              CAST(1 + (m[2] > m[1] AND monetary > m[2])::INT + (m[3] > m[2] AND monetary > m[3])::INT
                     + (m[4] > m[3] AND monetary > m[4])::INT + (m[5] > m[4] AND monetary > m[5])::INT
                   AS INTEGER) AS monetary_score,
              CAST(CASE WHEN recency > 30 THEN 1 ELSE 5 END AS INTEGER) AS recency_score
       FROM order_rfm, (SELECT quantile_cont(frequency, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS f,
                               quantile_cont(monetary, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS m FROM order_rfm)""",
    "order_rfm",
)
def rfm_scores(spark, sf_dir):
    return features.rfm_scores(order_features(spark, sf_dir)).select(
        "user_id", "frequency", "frequency_score", "monetary_score", "recency_score"
    )


@query("SELECT user_id, cluster FROM clusters", "clusters")
def assign_cluster(spark, sf_dir):
    scored = features.standardize(features.staged_features(s.fact_trans(spark, sf_dir)))
    zs = [f"z_{c}" for c in features.FEATURES]
    return segment.assign_cluster(scored, s.FROZEN_MODEL, zs).select("user_id", "cluster")


@query("SELECT user_id, age, gender, city, state, cluster FROM clustered", "clustered")
def attach_cluster(spark, sf_dir):
    return clustered(spark, sf_dir).select("user_id", "age", "gender", "city", "state", "cluster")


@query("SELECT user_id, cluster FROM clustered WHERE cluster IS NOT NULL", "clustered")
def with_cluster(spark, sf_dir):
    return segment.with_cluster(clustered(spark, sf_dir)).select("user_id", "cluster")


@query(
    """SELECT user_id, CASE WHEN (SELECT count(*) FROM rfm) = 0 THEN 'Unknown' ELSE cluster END AS cluster
       FROM clustered""",
    "clustered rfm",
)
def cluster_or_unknown(spark, sf_dir):
    rfm = features.staged_features(s.fact_trans(spark, sf_dir))
    return segment.cluster_or_unknown(clustered(spark, sf_dir), rfm).select("user_id", "cluster")


@query(
    """SELECT count(DISTINCT user_id) AS users, CAST(3 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS without,
              TRUE AS best_first, TRUE AS tight
       FROM fact_trans""",
    "fact_trans",
)
def segment_customers(spark, sf_dir):
    """What must hold of the segments: all users, three clusters named best first, and no more spread within
    them than the clusters of the frozen model have."""
    scored = features.standardize(features.staged_features(s.fact_trans(spark, sf_dir)))
    z = [f"z_{c}" for c in features.FEATURES]
    frozen = segment.assign_cluster(scored, s.FROZEN_MODEL, z).withColumnRenamed("cluster", "frozen")
    found = frozen.join(segment.segment_customers(scored, staged=True), "user_id", "left")
    # One pass over the users: both models' numbers follow from the few cells that they make together.
    sums = [F.sum(c).alias(f"sum_{c}") for c in z] + [F.sum(F.col(c) * F.col(c)).alias(f"square_{c}") for c in z]
    cells = stage(found.groupBy("cluster", "frozen").agg(F.count(F.lit(1)).alias("n"), *sums), "cells")

    def spread(name: str):
        parts = cells.groupBy(name).agg(
            F.sum("n").alias("n"), *[F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for kind in ("sum", "square") for c in z]
        )
        within = sum((F.col(f"square_{c}") - F.col(f"sum_{c}") * F.col(f"sum_{c}") / F.col("n") for c in z), F.lit(0.0))
        return parts.agg(F.sum(within)).scalar()

    total = F.sum(F.col("sum_z_frequency") + F.col("sum_z_monetary") - F.col("sum_z_recency"))
    by_name = cells.groupBy("cluster").agg((total / F.sum("n")).alias("score"), F.sum("n").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "cluster")))
    names = F.transform(ranked, lambda x: x["cluster"])
    return by_name.agg(
        F.sum("n").alias("users"),
        F.count_distinct("cluster").alias("clusters"),
        F.sum(F.when(F.col("cluster").isNull(), F.col("n")).otherwise(0)).alias("without"),
        (names == F.array(*map(F.lit, segment.CLUSTER_NAMES))).alias("best_first"),
    ).withColumn("tight", spread("cluster") <= spread("frozen"))


@query(
    """SELECT count(DISTINCT user_id) AS users, CAST(3 AS BIGINT) AS clusters, count(DISTINCT user_id) AS with_cluster
       FROM order_trans""",
    "order_trans",
)
def segment_coverage(spark, sf_dir):
    """Every user with features gets one of three clusters."""
    found = segment.segment_customers(order_features(spark, sf_dir), staged=True)
    return found.agg(
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("cluster").alias("clusters"),
        F.count("cluster").alias("with_cluster"),
    )


@query(
    """WITH c AS (SELECT user_id % 5 AS cluster_id, cluster AS was, avg(z_frequency) AS f, avg(z_monetary) AS m, avg(z_recency) AS r
                  FROM standard JOIN clusters USING (user_id) GROUP BY 1, 2),
            n AS (SELECT *, row_number() OVER (ORDER BY was, cluster_id) AS id FROM c),
            k AS (SELECT *, row_number() OVER (ORDER BY f + m - r DESC, id) AS place FROM n)
       SELECT id AS cluster_id, was, CASE place WHEN 1 THEN 'Top Users' WHEN 2 THEN 'Loyal Users' WHEN 3 THEN 'At-Risk Users'
              ELSE 'Cluster ' || place END AS cluster
       FROM k""",
    "standard clusters",
)
def name_clusters(spark, sf_dir):
    """The centroids of the frozen model's clusters, each in five parts by user, named anew."""
    z = [f"z_{c}" for c in features.FEATURES]
    scored = features.standardize(features.staged_features(s.fact_trans(spark, sf_dir)))
    frozen = segment.assign_cluster(scored, s.FROZEN_MODEL, z)
    parts = frozen.groupBy(F.col("cluster").alias("was"), (F.col("user_id") % 5).alias("part")).agg(
        *[F.avg(c).alias(c) for c in z]
    )
    # At most 15 rows.
    numbered = parts.withColumn("cluster_id", F.row_number().over(Window.orderBy("was", "part")).cast("long"))
    return segment.name_clusters(stage(numbered, "centroids")).select("cluster_id", "was", "cluster")


def _frozen(scored: DataFrame) -> DataFrame:
    """Clusters of a fixed model, so that SQL can say the same."""
    columns = [f"z_{c}" for c in features.FEATURES]
    return segment.assign_cluster(features.standardize(scored), s.FROZEN_MODEL, columns).select("user_id", "cluster")


@query(
    """SELECT user_id, CASE WHEN (SELECT count(*) FROM rfm) = 0 THEN 'Unknown' ELSE cluster END AS cluster
       FROM clustered""",
    "clustered rfm",
)
def clustered_users(spark, sf_dir):
    found = segment.clustered_users(s.dim_users(spark, sf_dir), s.fact_trans(spark, sf_dir), _frozen)
    return found.select("user_id", "cluster")


# -- mart tables ---------------------------------------------------------------------------------


@query("SELECT age, cluster, count FROM age_count", "age_count")
def age_count(spark, sf_dir):
    return marts.age_count(clustered(spark, sf_dir))


@query("SELECT gender, cluster, count FROM gender_count", "gender_count")
def gender_count(spark, sf_dir):
    return marts.gender_count(clustered(spark, sf_dir))


@query('SELECT "hour", count FROM trans_by_day', "trans_by_day")
def trans_by_hour(spark, sf_dir):
    return marts.trans_by_hour(s.fact_trans(spark, sf_dir))


@query(
    """SELECT trans_service AS service, count, description
       FROM (SELECT trans_service, count(trans_id) AS count FROM fact_trans GROUP BY 1)
       LEFT JOIN mcc_lookup ON TRY_CAST(trans_service AS BIGINT) = mcc""",
    "fact_trans mcc_lookup",
)
def describe_codes(spark, sf_dir):
    return marts.describe_codes(marts.code_counts(s.fact_trans(spark, sf_dir)), s.mcc_lookup(spark, sf_dir))


@query("SELECT service, count FROM service_count", "service_count")
def service_count(spark, sf_dir):
    return services(spark, sf_dir)


@query(
    """SELECT longitude, latitude, city, state AS country, cluster
       FROM clustered""",
    "clustered",
)
def user_geo(spark, sf_dir):
    return marts.user_geo(clustered(spark, sf_dir))


@query("SELECT count(*) AS rows FROM lineitem")
def row_count(spark, sf_dir):
    return marts.row_count(s.table(spark, sf_dir, "lineitem"))


@query(
    """SELECT n AS new_users, n // 4 AS returning_users, CAST(r AS BIGINT) AS new_transactions,
              round(a, 4) AS avg_clv, CAST(b AS BIGINT) AS active_returning_users
       FROM (SELECT count(*) AS n FROM dim_users),
            (SELECT sum(recent) AS r, avg(spent) AS a, count(*) FILTER (WHERE first_day < last_day) AS b
             FROM (SELECT user_id, sum(trans_amount) AS spent,
                          count(*) FILTER (WHERE trans_timestamp >= TIMESTAMP '2001-05-01 00:00:00') AS recent,
                          min(CAST(trans_timestamp AS DATE)) AS first_day,
                          max(CAST(trans_timestamp AS DATE)) AS last_day
                   FROM order_trans GROUP BY user_id))""",
    "dim_users order_trans",
)
def dashboard_stats(spark, sf_dir):
    stats = marts.dashboard_stats(s.dim_users(spark, sf_dir), s.order_trans(spark, sf_dir), "2001-05-20")
    return rounded(stats, 4, "avg_clv")


@query(
    """SELECT CAST(year(trans_timestamp) AS INTEGER) AS "year", CAST(quarter(trans_timestamp) AS INTEGER) AS "quarter",
              round(sum(trans_amount), 2) AS revenue
       FROM order_trans GROUP BY 1, 2""",
    "order_trans",
)
def revenue_by_quarter(spark, sf_dir):
    return rounded(marts.revenue_by_quarter(s.order_trans(spark, sf_dir)), 2, "revenue")


@query("SELECT state AS country, count(*) AS users FROM clustered GROUP BY 1", "clustered")
def users_by_country(spark, sf_dir):
    return marts.users_by_country(marts.user_geo(clustered(spark, sf_dir)))


@query(
    """SELECT date_trunc('month', trans_timestamp)::DATE AS "month", CAST(hour(trans_timestamp) AS INTEGER) AS "hour",
              trans_service, count(trans_id) AS count
       FROM fact_trans GROUP BY 1, 2, 3""",
    "fact_trans",
)
def activity(spark, sf_dir):
    return marts.activity(s.fact_trans(spark, sf_dir))


def run_daily(spark: SparkSession, sf_dir: str, target: str, **how) -> DataFrame:
    return daily_mart.run_daily(
        spark,
        s.dim_users(spark, sf_dir),
        s.fact_trans(spark, sf_dir),
        s.mcc_lookup(spark, sf_dir),
        target,
        as_of="2024-01-15",
        **how,
    )


_WRITTEN = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {source}"
    for t, source in {
        "age_count": "age_count", "gender_count": "gender_count", "service_count": "service_count",
        "trans_by_day": "trans_by_day", "user_geo": "dim_users", "stats": "(SELECT 1)",
        "rfm_scores": "(SELECT DISTINCT user_id FROM fact_trans)",
    }.items()
)


@query(_WRITTEN, "age_count gender_count service_count trans_by_day dim_users fact_trans")
def daily_mart_tables(spark, sf_dir):
    """The whole daily job with the frozen model; the rows of each table it wrote."""
    return run_daily(spark, sf_dir, stage_path(spark, "mart"), label=_frozen)


@query(
    """SELECT 'service_count' AS "table", service AS label, count FROM service_count
       UNION ALL SELECT 'trans_by_day', CAST("hour" AS VARCHAR), count FROM trans_by_day
       UNION ALL SELECT 'stats', 'new_users', count(*) FROM dim_users
       UNION ALL SELECT 'stats', 'new_transactions', count(*) FROM fact_trans
         WHERE trans_timestamp >= TIMESTAMP '2024-01-01 00:00:00'
       UNION ALL SELECT 'user_geo', 'rows', count(*) FROM dim_users
       UNION ALL SELECT 'rfm_scores', 'rows', count(DISTINCT user_id) FROM fact_trans""",
    "service_count trans_by_day dim_users",
)
def daily_mart_content(spark, sf_dir):
    """What the daily job wrote, where SQL can say the same."""
    target = stage_path(spark, "mart")
    written = run_daily(spark, sf_dir, target)
    mart = daily_mart.read_mart(spark, target)

    def rows(table: str, label, count) -> DataFrame:
        return mart[table].select(F.lit(table).alias("table"), label.alias("label"), count.alias("count"))

    sizes = written.where(F.col("table").isin("user_geo", "rfm_scores")).select(
        "table", F.lit("rows").alias("label"), F.col("rows").alias("count")
    )
    return quality.union_all(
        rows("service_count", F.col("service"), F.col("count")),
        rows("trans_by_day", F.col("hour").cast("string"), F.col("count")),
        rows("stats", F.lit("new_users"), F.col("new_users")),
        rows("stats", F.lit("new_transactions"), F.col("new_transactions")),
        sizes,
    )


# -- charts --------------------------------------------------------------------------------------


@query("SELECT service, count FROM service_count ORDER BY count DESC, service LIMIT 7", "service_count")
def top_services(spark, sf_dir):
    return charts.top_services(services(spark, sf_dir))


@query(
    """SELECT service AS most_used_service, count AS usage_count
       FROM service_count ORDER BY count DESC, service LIMIT 1""",
    "service_count",
)
def top_service(spark, sf_dir):
    return charts.top_service(services(spark, sf_dir))


@query("SELECT count(*) AS new_users FROM dim_users", "dim_users")
def first_row(spark, sf_dir):
    stats = marts.dashboard_stats(s.dim_users(spark, sf_dir), s.order_trans(spark, sf_dir), "2001-05-20")
    return charts.first_row(stats, "new_users")


@query(
    """SELECT round(avg(total), 2) AS average_clv
       FROM (SELECT sum(trans_amount) AS total FROM order_trans GROUP BY user_id)""",
    "order_trans",
)
def average_clv(spark, sf_dir):
    stats = marts.dashboard_stats(s.dim_users(spark, sf_dir), s.order_trans(spark, sf_dir), "2001-05-20")
    return charts.average_clv(stats)


@query("SELECT gender, CAST(sum(count) AS BIGINT) AS count FROM gender_count GROUP BY 1", "gender_count")
def gender_distribution(spark, sf_dir):
    return charts.gender_distribution(marts.gender_count(clustered(spark, sf_dir)))


@query("SELECT age, cluster, count FROM age_count ORDER BY age, cluster", "age_count")
def order_by(spark, sf_dir):
    return charts.order_by(marts.age_count(clustered(spark, sf_dir)), ["age", "cluster"])


@query(
    """SELECT longitude, latitude, city, state AS country, cluster
       FROM clustered WHERE longitude IS NOT NULL AND latitude IS NOT NULL""",
    "clustered",
)
def geo_points(spark, sf_dir):
    return charts.geo_points(marts.user_geo(clustered(spark, sf_dir)))


@query("SELECT gender, cluster, count FROM gender_count WHERE cluster = 'Loyal Users'", "gender_count")
def filter_cluster(spark, sf_dir):
    return charts.filter_cluster(marts.gender_count(clustered(spark, sf_dir)), "Loyal Users")


@query("SELECT service AS id, service AS label, count AS value FROM service_count", "service_count")
def to_pie(spark, sf_dir):
    return charts.to_pie(services(spark, sf_dir), "service")


@query(
    """SELECT id, value, CASE WHEN sum(value) OVER () > 0
              THEN round(value * 100.0::DOUBLE / CAST(sum(value) OVER () AS DOUBLE), 1) ELSE 0 END AS percentage
       FROM (SELECT l_suppkey AS id, count(*) AS value FROM lineitem GROUP BY 1)"""
)
def share_of_total(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem")
    counts = lines.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("value"))
    return charts.share_of_total(counts)


@query(
    """SELECT 'Transactions' AS id, CAST("hour" AS VARCHAR) AS x, count AS y FROM trans_by_day""", "trans_by_day"
)
def series_by_hour(spark, sf_dir):
    series = charts.series_by_hour(marts.trans_by_hour(s.fact_trans(spark, sf_dir)))
    return series.select("id", F.inline("data"))


_BINNED = """
    SELECT coalesce(cluster, 'No Cluster') AS id,
           CASE WHEN age BETWEEN 18 AND 25 THEN '18-25' WHEN age BETWEEN 26 AND 35 THEN '26-35'
                WHEN age BETWEEN 36 AND 45 THEN '36-45' WHEN age BETWEEN 46 AND 55 THEN '46-55'
                WHEN age BETWEEN 56 AND 65 THEN '56-65' WHEN age >= 66 THEN '66+' ELSE 'Unknown' END AS x,
           CAST(sum(count) AS BIGINT) AS y
    FROM age_count GROUP BY 1, 2"""


@query(f"SELECT id, x, y FROM ({_BINNED}) WHERE x <> 'Unknown'", "age_count")
def age_distribution(spark, sf_dir):
    return charts.age_distribution(marts.age_count(clustered(spark, sf_dir))).drop("rank")


@query(f"SELECT id, x, y FROM ({_BINNED})", "age_count")
def age_distribution_all(spark, sf_dir):
    return charts.age_distribution(marts.age_count(clustered(spark, sf_dir)), keep_unknown=True).drop("rank")


@query(
    f"""SELECT id, coalesce(string_agg(x || ':' || y, ' ' ORDER BY x) FILTER (WHERE x <> 'Unknown'), '') AS points
        FROM ({_BINNED}) GROUP BY id""",
    "age_count",
)
def age_series(spark, sf_dir):
    series = charts.age_series(marts.age_count(clustered(spark, sf_dir)))
    point = F.transform("data", lambda p: F.concat(p["x"], F.lit(":"), p["y"].cast("string")))
    return series.select("id", F.array_join(point, " ").alias("points"))


# All brands of the test tables, checked by the total of every row.
_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
_BARS = ", ".join(f"sum(p_size) FILTER (WHERE p_brand = '{b}')::BIGINT AS \"{b}\"" for b in _BRANDS)


@query(f"SELECT p_type AS service, {_BARS}, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def bar_keys(spark, sf_dir):
    parts = s.table(spark, sf_dir, "part")
    wide = charts.to_wide(parts, "p_type", "p_brand", "p_size", _BRANDS)
    colored = wide.withColumnRenamed("p_type", "service").withColumn("Brand#1Color", F.lit("blue"))
    bars = charts.bar_keys(colored)
    total = sum((F.coalesce(F.col(f"`{b}`"), F.lit(0)) for b in bars), F.lit(0)).cast("long")
    return colored.select("service", *[F.col(f"`{b}`") for b in bars], total.alias("total"))


@query(
    """SELECT 'Data' AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS position,
              CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) AS x, o_totalprice AS y
       FROM orders"""
)
def generic_series(spark, sf_dir):
    orders = s.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return charts.generic_series(orders, "o_orderkey")


@query(
    """SELECT 'Data' AS id, "hour" AS position,
              CASE WHEN "hour" = 0 THEN '0' ELSE CAST("hour" AS VARCHAR) END AS x, CAST(count AS DOUBLE) AS y
       FROM (SELECT CAST("hour" AS BIGINT) AS "hour", count FROM trans_by_day)""",
    "trans_by_day",
)
def generic_hour_series(spark, sf_dir):
    return charts.generic_series(marts.trans_by_hour(s.fact_trans(spark, sf_dir)), "hour")
