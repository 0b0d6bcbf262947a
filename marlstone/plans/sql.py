"""Queries as SQL texts over views, with functions registered for the session; a paged source; stored sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import ordered as O
from marlstone.operators import sketches as K
from marlstone.operators import table_functions as Q
from marlstone.plans.base import Tables, query
from marlstone.session import shared_dir, written
from marlstone.sources import paged


def said(t: Tables, text: str) -> DataFrame:
    """The rows of a SQL text over views of the tables that it names."""
    spark = t.region.sparkSession
    for name in ("orders", "events", "documents", "embeddings", "lineitem", "customer"):
        getattr(t, name).createOrReplaceTempView(name)
    Q.register(spark)
    K.register(spark)
    return spark.sql(text)


@query("""SELECT o_custkey, o_orderkey, CAST(sum(price) OVER w AS DOUBLE) AS sum_price, sum(one) OVER w AS sum_one FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price, 1 AS one FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) QUALIFY coalesce(sum(price) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 300000
 OR coalesce(sum(one) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3""")
def sql_until_sums(t: Tables) -> DataFrame:
    """A customer's orders until they are worth 300,000 and at least three."""
    return said(t, """SELECT o_custkey, o_orderkey, CAST(sum_price AS DOUBLE) AS sum_price, sum_one FROM until_sums(
TABLE(SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price, 1 AS one FROM orders) PARTITION BY (o_custkey) ORDER BY (o_orderkey), 'price, one', '300000, 3')""")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def sql_top_orders(t: Tables) -> DataFrame:
    return said(t, "SELECT * FROM top_orders(3)")


@query("""SELECT p.user_id, p.n AS purchases, coalesce(e.n, 0) AS errors, p.units FROM (SELECT user_id, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS units FROM events WHERE event_type = 'purchase' GROUP BY 1) p
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e USING (user_id)""")
def sql_usage_by_kind(t: Tables) -> DataFrame:
    return said(t, "SELECT p.user_id, p.n AS purchases, coalesce(e.n, 0) AS errors, p.units FROM usage_by('purchase') p LEFT JOIN usage_by('error') e ON p.user_id = e.user_id")


@query("""SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS caption, '/abs/' || doc_id AS given, doc_id::VARCHAR AS canonical, replace(source, '.', '-') || '_' || doc_id AS safe FROM documents""")
def sql_text_functions(t: Tables) -> DataFrame:
    return said(t, "SELECT doc_id, caption_of(text) AS caption, '/abs/' || doc_id AS given, canonical_id('http://host/abs/' || doc_id || 'v' || (1 + doc_id % 9)) AS canonical, safe_id(source || '/' || doc_id) AS safe FROM documents")


@query("""SELECT l_orderkey, l_linenumber, round_even(CAST(l_quantity * CASE WHEN l_discount <= 0.02 THEN 1.0 WHEN l_discount <= 0.1 THEN 1.25 ELSE 1.5 END AS DOUBLE), 2) AS lost FROM lineitem""")
def sql_points_lost(t: Tables) -> DataFrame:
    return said(t, "SELECT l_orderkey, l_linenumber, points_lost(CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE)) AS lost FROM lineitem")


@query("SELECT event_type, month(ts) % 3 AS part, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS middle_near, true AS high_near FROM events GROUP BY ALL")
def merged_sketches(t: Tables) -> DataFrame:
    """Daily states stored, merged by month, then by every third month; each estimate is held against the exact figure."""
    e = t.events.withColumn("month", F.month("ts"))
    daily = written(K.states(e.withColumn("day", F.to_date("ts")), ["event_type", "month", "day"], "user_id", "value"))
    kept = K.merged(K.merged(daily, ["event_type", "month"]), ["event_type", (F.col("month") % 3).alias("part")])
    exact = e.groupBy("event_type", (F.col("month") % 3).alias("part")).agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(*[F.lit(x) for x in (0.46, 0.54, 0.91, 0.99)])).alias("q"))
    q = F.col("q")
    near = {"users_near": F.abs(K.distinct(F.col("items")) - F.col("users")) <= 0.06 * F.col("users") + 1, "middle_near": K.quantile(F.col("values"), 0.5).between(q[0], q[1]), "high_near": K.quantile(F.col("values"), 0.95).between(q[2], q[3])}
    return kept.join(exact, ["event_type", "part"]).select("event_type", "part", "n", "users", *[c.alias(n) for n, c in near.items()])


PAGE = 500


@query(f"""SELECT o_orderpriority AS query, (place - 1) // {PAGE} AS page, place AS position, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS place FROM orders)""")
def paged_orders(t: Tables) -> DataFrame:
    """Orders as pages of results for each priority, written to the shared folder and read by the paged source."""
    spark = t.region.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = O.placed(t.orders.select(F.col("o_orderpriority").alias("query"), "o_orderkey"), ["query"], ["o_orderkey"])
    rows = rows.withColumn("page", F.floor((F.col("place") - 1) / PAGE)).repartition("query", "page").sortWithinPartitions("query", "page", "place")
    rows.write.partitionBy("query", "page").json(at)
    paged.register(spark)
    found = spark.read.format("paged").option("size", PAGE).load(at)
    return found.select("query", "page", "position", F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"))
