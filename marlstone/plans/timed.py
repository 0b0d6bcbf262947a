"""Joins by time over events: the last view before a purchase, the first error after it, events in signup periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import timed as T
from marlstone.plans.base import Tables, query


def of(t: Tables, kind: str) -> DataFrame:
    return t.events.filter(F.col("event_type") == kind)


@query("""SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def last_view_before_purchase(t: Tables) -> DataFrame:
    views = of(t, "view").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return T.asof(of(t, "purchase").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["view_id", "view_value"]).drop("ts")


@query("""SELECT p.event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') e ON p.user_id = e.user_id AND p.ts <= e.ts""")
def first_error_after_purchase(t: Tables) -> DataFrame:
    errors = of(t, "error").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return T.asof(of(t, "purchase").select("event_id", "user_id", "ts"), errors, ["user_id"], "ts", ["error_id"], forward=True).select("event_id", "error_id")


@query("""WITH s AS (SELECT event_id AS signup_id, epoch_us(ts) AS start, epoch_us(ts) + CAST(round(value * 20000000) AS BIGINT) AS stop FROM events WHERE event_type = 'signup'),
p AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase')
SELECT signup_id, count(*) AS purchases, min(event_id) AS first_id, max(event_id) AS last_id FROM s JOIN p ON us BETWEEN start AND stop GROUP BY 1""")
def purchases_after_signups(t: Tables) -> DataFrame:
    """Purchases of anyone in the 20 seconds a unit of value that follow a signup."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = of(t, "signup").select(F.col("event_id").alias("signup_id"), us.alias("start"), (us + F.round(F.col("value") * 20_000_000).cast("bigint")).alias("stop"))
    pairs = T.in_intervals(of(t, "purchase").select("event_id", us.alias("at")), spans, "at", "start", "stop")
    return pairs.groupBy("signup_id").agg(F.count("*").alias("purchases"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
