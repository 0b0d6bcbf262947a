"""Scalar functions over the driver's tables, a query for each family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.plans.base import Tables, query


@query("""SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https:', 'http:'), '/+$', '') AS canonical, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, contains(url, '?') AS has_query, regexp_replace(url, 'v\\d+$', '') AS unversioned, translate(url, '/.', '_-') AS safe FROM pages""")
def url_canonical(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", X.license_url(u).alias("canonical"), F.regexp_extract(u, "^[a-z]+://([^/]*)", 1).alias("host"), u.contains("?").alias("has_query"), F.regexp_replace(u, r"v\d+$", "").alias("unversioned"), X.safe_id(u).alias("safe"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') AS hrefs, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_href(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(X.hrefs(F.col("html")), " ").alias("hrefs"), X.escaped(F.col("url")).alias("escaped"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS words FROM documents""")
def text_normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.collapsed(F.col("text")).alias("collapsed"), F.size(X.tokens(F.col("text"))).cast("long").alias("words"))


@query("""SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS padded, 'task_' || lpad(CAST(doc_id AS VARCHAR), 4, '0') AS task, left(text, 40) AS head, right(text, 40) AS tail, upper(lang) AS lang, split_part(source, 'c', 2) AS rest, starts_with(text, 'The') AS starts, reverse(source) AS reversed FROM documents""")
def scalar_text(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("padded"), F.concat(F.lit("task_"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("task"), F.substring(text, 1, 40).alias("head"), F.right(text, F.lit(40)).alias("tail"), F.upper("lang").alias("lang"), F.split_part(F.col("source"), F.lit("c"), F.lit(2)).alias("rest"), text.startswith("The").alias("starts"), F.reverse("source").alias("reversed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '0000' AS since, strftime(o_orderdate, '%Y%m%d') || '2359' AS until, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM orders")
def scalar_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    day = F.date_format(d, "yyyyMMdd")
    return t.orders.select("o_orderkey", F.concat(day, F.lit("0000")).alias("since"), F.concat(day, F.lit("2359")).alias("until"), F.year(d).alias("y"), F.month(d).alias("m"), F.datediff(d.cast("date"), F.to_date(F.lit("1992-01-01"))).alias("days"))


@query("SELECT p_partkey, round_even(p_retailprice * 0.5, 1) AS halved, CAST(ceil(p_size * 1.5) AS BIGINT) AS pool, CAST(floor(p_size / 3.0) AS BIGINT) AS thirds, least(p_size, 20) AS capped, greatest(p_size, 20) AS raised, round(ln(1 + p_size), 6) AS logged, round(1 - abs(p_size - 25) / greatest(p_size, 25), 6) AS similarity, bit_count(p_partkey)::BIGINT AS bits FROM part")
def scalar_math(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select("p_partkey", F.bround(F.col("p_retailprice") * 0.5, 1).alias("halved"), F.ceil(s * 1.5).alias("pool"), F.floor(s / 3.0).alias("thirds"), F.least(s, F.lit(20)).alias("capped"), F.greatest(s, F.lit(20)).alias("raised"), F.round(F.log1p(s), 6).alias("logged"), F.round(1 - F.abs(s - 25) / F.greatest(s, F.lit(25)), 6).alias("similarity"), F.bit_count("p_partkey").cast("long").alias("bits"))


@query("SELECT vec_id, len(embedding)::BIGINT AS n, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, round(list_max(embedding), 5) AS greatest, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) AS norm, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS any_large, round(embedding[1] + embedding[64], 5) AS ends FROM embeddings")
def array_map_ops(t: Tables) -> DataFrame:
    e = F.col("embedding")
    norm = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return t.embeddings.select("vec_id", F.size(e).cast("long").alias("n"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max(e).cast("double"), 5).alias("greatest"), F.round(norm, 4).alias("norm"), F.exists(e, lambda x: x > 0.3).alias("any_large"), F.round((e[0] + e[63]).cast("double"), 5).alias("ends"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5, left(sha256(source || chr(0) || CAST(doc_id AS VARCHAR)), 20) AS opaque, octet_length(encode(text))::BIGINT AS bytes, base64(encode(source)) AS b64 FROM documents")
def codec_ops(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"), X.opaque_id(F.col("source"), F.col("doc_id").cast("string"), size=20).alias("opaque"), F.octet_length("text").cast("long").alias("bytes"), F.base64(F.col("source").cast("binary")).alias("b64"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1') OR contains(p_name, '7')")
def selector_filter(t: Tables) -> DataFrame:
    """Rows whose name holds any of the selectors."""
    chosen = F.exists(F.array(F.lit("1"), F.lit("7")), lambda s: F.contains(F.col("p_name"), s))
    return t.part.filter(chosen).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x0, y0, x1, y1, round((x1 - x0) * (y1 - y0) / 10000.0, 6) AS visible FROM (SELECT *, greatest(l_partkey % 150 - 25, 0) AS x0, greatest(l_suppkey % 150 - 25, 0) AS y0, least(l_partkey % 150 - 25 + 50, 100) AS x1, least(l_suppkey % 150 - 25 + 50, 100) AS y1 FROM lineitem) WHERE x1 - x0 >= 8 AND y1 - y0 >= 8")
def bbox_visibility(t: Tables) -> DataFrame:
    """Boxes clipped to a page of 100 by 100 and the share of it that they cover."""
    x, y = F.col("l_partkey") % 150 - 25, F.col("l_suppkey") % 150 - 25
    box = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.greatest(x, F.lit(0)).alias("x0"), F.greatest(y, F.lit(0)).alias("y0"), F.least(x + 50, F.lit(100)).alias("x1"), F.least(y + 50, F.lit(100)).alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return box.filter((w >= 8) & (h >= 8)).withColumn("visible", F.round(w * h / 10000.0, 6))


@query("SELECT conv_id, turn, role, array_to_string(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN turn < 0 THEN 'turn' END, CASE WHEN text IS NULL OR length(text) < 20 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS violations FROM conversations")
def validate_turns(t: Tables) -> DataFrame:
    """Broken rules of each row, in the rules' order."""
    rules = [("role", ~F.col("role").isin("user", "assistant")), ("turn", F.col("turn") < 0), ("text", F.col("text").isNull() | (F.length("text") < 20))]
    return t.conversations.select("conv_id", "turn", "role", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])), ",").alias("violations"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'complete' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS state, bool_and(event_type <> 'error') AS clean, arg_max(event_type, ts) AS last FROM events GROUP BY 1")
def run_state(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(F.bool_or(kind == "purchase"), "complete").when(F.bool_or(kind == "error"), "failed").otherwise("running")
    return t.events.groupBy("user_id").agg(state.alias("state"), F.bool_and(kind != "error").alias("clean"), F.max_by(kind, "ts").alias("last"))
