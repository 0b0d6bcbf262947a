"""Given tables written to the shared folder by each writer and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import integrity as I
from marlstone.plans.base import Tables, query
from marlstone.plans.logs import log_lines
from marlstone.session import shared_dir
from marlstone.sources import files, sinks, versions

SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"


def kind(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


@query(SUPPLIER)
def json_lines_table(t: Tables) -> DataFrame:
    df, at = t.supplier, folder(t.supplier)
    sinks.write_jsonl(df.filter("s_suppkey % 2 = 0"), at)
    sinks.append_jsonl(df.filter("s_suppkey % 2 != 0"), at)
    return files.jsonl(df.sparkSession, at, kind(df))


@query(SUPPLIER)
def csv_table(t: Tables) -> DataFrame:
    df, at = t.supplier, folder(t.supplier)
    sinks.write_csv(df, at, df.columns, bom=True)
    return files.csv(df.sparkSession, at, kind(df))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS nation, count(*) AS n, sum(s_suppkey)::BIGINT AS keys FROM supplier GROUP BY 1")
def key_folders_table(t: Tables) -> DataFrame:
    """A folder of JSON files for each nation; the key is read from the path."""
    df, at = t.supplier, folder(t.supplier)
    sinks.write_per_key(df, at, ["s_nationkey"])
    rows = df.sparkSession.read.schema("s_suppkey bigint").json(f"{at}/*").withColumn("file", F.col("_metadata.file_path"))
    return rows.groupBy(F.regexp_extract("file", r"s_nationkey=([^/]+)/", 1).alias("nation")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def upserted_orders(t: Tables) -> DataFrame:
    """A customer's last order, by three batches into a versioned table, one of them twice."""
    df = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    at = folder(df)
    for k in (1, 0, 2):
        versions.upsert(df.filter(F.col("o_orderkey") % 3 == k), at, ["o_custkey"], "o_orderkey", buckets=8)
    versions.upsert(df.filter(F.col("o_orderkey") % 3 == 0), at, ["o_custkey"], "o_orderkey", buckets=8)
    return versions.read(df.sparkSession, at, df.schema)


@query("""WITH e AS (SELECT user_id % 3 AS a, event_type AS t FROM events)
SELECT '$.usage.cached_input_tokens' AS path, count(*) FILTER (a = 0 AND t = 'purchase') AS n FROM e UNION ALL SELECT '$.part.tokens.cache', count(*) FILTER (a = 2 AND t = 'purchase') FROM e
UNION ALL SELECT '$.usage.cache_read_input_tokens', count(*) FILTER (a = 1 AND t = 'purchase') FROM e UNION ALL SELECT '$.item', count(*) FILTER (a = 0 AND t = 'view') FROM e""")
def marked_keys(t: Tables) -> DataFrame:
    """Keys at any depth of agents' logs that hold one of two words."""
    return I.private_keys(log_lines(t).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL"), "v", ("cache", "item"))
