"""Row rules, joins with fallbacks and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import rules as R
from marlstone.plans.base import Tables, query


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'source' WHEN least(w, h) < 400 THEN 'side' WHEN w * h < 250000 THEN 'area' WHEN NOT (w / h BETWEEN 0.4 AND 4.0) THEN 'aspect' END AS reason
FROM (SELECT p_partkey, p_brand, p_size * 40 AS w, CAST(p_partkey % 97 AS INT) * 20 + 200 AS h FROM part)""")
def hard_filter(t: Tables) -> DataFrame:
    w, h = F.col("p_size") * 40, (F.col("p_partkey") % 97).cast("int") * 20 + 200
    return t.part.select("p_partkey", R.hard_filter(w, h, F.col("p_brand") != "Brand#11").alias("reason"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 20000 THEN 'long' WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1""")
def reject_histogram(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    reason = R.first_reason([("short", n < 200), ("long", n > 20000), ("shouting", F.col("text").contains("!!"))])
    return R.reason_counts(t.documents.select(reason.alias("reason")), "reason")


LIKED, DISLIKED = ("license", "und", "les "), ("###", "!!")


@query("""WITH s AS (SELECT doc_id, list_filter(['license', 'und', 'les '], lambda k: contains(lower(text), k)) AS p, list_filter(['###', '!!'], lambda k: contains(lower(text), k)) AS m,
 [CASE WHEN n_chars >= 80 THEN 'length80' END, CASE WHEN n_chars >= 180 THEN 'length180' END, CASE WHEN n_chars * 100 >= 1e6 THEN 'area1m' END, CASE WHEN n_chars * 100 >= 2.5e6 THEN 'area2.5m' END,
  CASE WHEN n_chars / 1000 BETWEEN 1.2 AND 3.2 THEN 'aspect' END, CASE WHEN lang = 'en' THEN 'vector' END, CASE WHEN doc_id % 2 = 0 THEN 'single' END] AS r, n_chars, lang FROM documents)
SELECT doc_id, 3.0 * len(p) - 3.0 * len(m) + list_sum(list_transform(r, lambda x: CASE x WHEN 'length180' THEN 0.5 WHEN 'area2.5m' THEN 0.5 WHEN 'single' THEN 0.5 WHEN NULL THEN 0 ELSE CASE WHEN x IS NULL THEN 0 ELSE 1.0 END END)) AS score,
 array_to_string(list_concat(list_concat(list_transform(p, lambda k: '+' || k), list_transform(m, lambda k: '-' || k)), list_filter(r, lambda x: x IS NOT NULL)), ',') AS reasons FROM s""")
def figure_score(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    score, reasons = R.keyword_score(F.col("text"), LIKED, DISLIKED, n, n * 100, n / 1000, F.col("lang") == "en", F.col("doc_id") % 2 == 0)
    return t.documents.select("doc_id", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE '%TIN%' OR nodes < 3 OR edges < 2 OR edges > greatest(100, 8 * nodes) OR p_partkey % 11 = 0 OR hits < 1 THEN -100.0
 ELSE round_even(CAST(least(20.0, 4 + 1.5 * hits) + least(8.0, nodes * 0.35) + least(8.0, edges * 0.35) + CASE WHEN labels > 0 THEN 2 ELSE 0 END + CASE WHEN p_brand LIKE '%1' THEN 2 ELSE 0 END AS DOUBLE), 3) END AS score
FROM (SELECT *, p_size AS nodes, CAST(p_partkey % 211 AS INT) AS edges, CAST(p_partkey % 7 AS INT) AS hits, length(p_name) AS labels FROM part)""")
def structured_score(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    score = R.structured_score(F.col("p_type").contains("TIN"), F.col("p_size"), (k % 211).cast("int"), k % 11 == 0, (k % 7).cast("int"), F.length("p_name") > 0, F.col("p_brand").endswith("1"))
    return t.part.select("p_partkey", score.alias("score"))


@query("""WITH a AS (SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(url)), '^https:', 'http:'), '/+$', '') AS u FROM pages WHERE page_id % 3 = 0)
SELECT page_id, u IS NOT NULL AND n <> '' AS allowed FROM (SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^https:', 'http:'), '/+$', '') AS n FROM pages) p LEFT JOIN a ON p.n = a.u""")
def url_allowed(t: Tables) -> DataFrame:
    """Membership of normalised urls in a list; an empty one is not allowed."""
    allowed = t.pages.filter("page_id % 3 = 0").select(X.license_url(F.col("url")).alias("u")).distinct()
    rows = t.pages.select("page_id", X.license_url(F.col("url")).alias("n"))
    return rows.join(allowed, F.col("n") == F.col("u"), "left").select("page_id", (F.col("u").isNotNull() & (F.col("n") != "")).alias("allowed"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN r < 0 OR r > 1 THEN 'range' END, CASE WHEN abs(r * 100 - round(r * 100)) > 1e-9 THEN 'places' END, CASE WHEN c = 0 AND r <> 0 THEN 'no cases' END], lambda x: x IS NOT NULL), ',') AS broken
FROM (SELECT *, l_tax * l_quantity / 2 AS r, l_linenumber - 1 AS c FROM lineitem)""")
def validate_ratios(t: Tables) -> DataFrame:
    rules = R.ratio_rules(F.col("l_tax") * F.col("l_quantity") / 2, F.col("l_linenumber") - 1)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(R.violations(rules), ",").alias("broken"))


@query("""SELECT source, array_to_string(list_sort(list_concat(list_filter(l, lambda x: NOT list_contains(['en', 'de', 'it'], x)), list_filter(['en', 'de', 'it'], lambda x: NOT list_contains(l, x)))), ',') AS differs
FROM (SELECT source, list(DISTINCT lang) AS l FROM documents GROUP BY 1)""")
def enumeration_difference(t: Tables) -> DataFrame:
    """Languages of each source against an expected set, in both directions."""
    expected = F.array(*map(F.lit, ("en", "de", "it")))
    return t.documents.groupBy("source").agg(F.collect_set("lang").alias("l")).select("source", F.array_join(R.symmetric_difference(F.col("l"), expected), ",").alias("differs"))


@query("""SELECT conv_id, list_sort(list(turn + 1)) = range(1, count(*) + 1) AS contiguous, bool_and(regexp_full_match(role, '[A-Za-z0-9][A-Za-z0-9_.-]*')) AS safe FROM conversations GROUP BY 1""")
def contiguous_names(t: Tables) -> DataFrame:
    out = t.conversations.groupBy("conv_id").agg(F.collect_list(F.col("turn") + 1).alias("n"), F.bool_and(R.safe_name(F.col("role"))).alias("safe"))
    return out.select("conv_id", R.contiguous(F.col("n")).alias("contiguous"), "safe")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 10 AS i, CAST(l_partkey % 300 AS DOUBLE) AS c, l_extendedprice AS o, l_tax * 100 AS r FROM lineitem),
e AS (SELECT *, array_to_string(list_filter([CASE WHEN o <> floor(o) THEN 'output' END, CASE WHEN r <> floor(r) THEN 'reasoning' END, CASE WHEN c > i THEN 'cached > input' END], lambda x: x IS NOT NULL), ',') AS error FROM u)
SELECT l_orderkey, l_linenumber, l_partkey, error, CASE WHEN error = '' THEN CAST(i AS BIGINT) END AS input_tokens, CASE WHEN error = '' THEN CAST(c AS BIGINT) END AS cached_input_tokens, CASE WHEN error = '' THEN CAST(i - c AS BIGINT) END AS uncached_input_tokens,
 CASE WHEN error = '' THEN CAST(o AS BIGINT) END AS output_tokens, CASE WHEN error = '' THEN CAST(r AS BIGINT) END AS reasoning_output_tokens, CASE WHEN error = '' THEN CAST(i + o AS BIGINT) END AS total_tokens FROM e""")
def usage_counters(t: Tables) -> DataFrame:
    u = R.usage(F.col("l_quantity") * 10, (F.col("l_partkey") % 300).cast("double"), F.col("l_extendedprice"), F.col("l_tax") * 100)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(k) for k, c in u.items()])


@query("""SELECT event_id, x, w, x < -1 OR w < 0 OR x + w > 90 + 1 AS outside, least(greatest(x, 0), 90) AS offset_in, least(greatest(w, 0), 90 - least(greatest(x, 0), 90)) AS extent_in
FROM (SELECT event_id, CAST(event_id % 101 AS INT) - 5 AS x, CAST(user_id % 17 AS INT) - 2 AS w FROM events)""")
def shape_bounds(t: Tables) -> DataFrame:
    x, w, limit = (F.col("event_id") % 101).cast("int") - 5, (F.col("user_id") % 17).cast("int") - 2, F.lit(90)
    at, extent = R.bounded(x, w, limit)
    return t.events.select("event_id", x.alias("x"), w.alias("w"), R.outside(x, w, limit).alias("outside"), at.alias("offset_in"), extent.alias("extent_in"))


@query("""SELECT page_id, coalesce(upper(CASE WHEN page_id % 5 = 0 THEN 's' || page_id % 3 END), CASE WHEN regexp_extract(p, '/(?:g|stage)[-_]?(\\d+)(?:/|$)', 1) <> '' THEN 'G' || regexp_extract(p, '/(?:g|stage)[-_]?(\\d+)(?:/|$)', 1) END) AS stage,
 CASE WHEN regexp_extract(p, '/(?:g|stage)[-_]?\\d+/([a-z]+)(?:/|$)', 1) <> '' THEN regexp_extract(p, '/(?:g|stage)[-_]?\\d+/([a-z]+)(?:/|$)', 1) END AS role
FROM (SELECT page_id, lower('/run/stage_' || page_id % 4 || '/' || CASE WHEN page_id % 2 = 0 THEN 'judge/x' ELSE '1' END) AS p FROM pages)""")
def stage_from_path(t: Tables) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("/run/stage_"), (k % 4).cast("string"), F.lit("/"), F.when(k % 2 == 0, "judge/x").otherwise("1"))
    stage, role = R.stage_and_role(path, F.when(k % 5 == 0, F.concat(F.lit("s"), (k % 3).cast("string"))), F.lit(None).cast("string"))
    return t.pages.select("page_id", stage.alias("stage"), role.alias("role"))


@query("""SELECT vec_id, round(least(greatest(c, -1.0), 1.0), 5) AS clipped, CASE WHEN a = b THEN 1.0 ELSE round(exp(-abs(ln(1 + a) - ln(1 + b))), 6) END AS alike, round(2 * p * q / greatest(p + q, 1e-9), 6) AS harmonic, round(sqrt(p * p + q * q), 6) AS distance,
 round(0.6 * p + 0.25 * q + 0.15, 6) AS composite, round(least(1600 / w, 900 / h), 6) AS scale, round((1600 - w * least(1600 / w, 900 / h)) / 2, 4) AS left_, CASE WHEN greatest(abs(c), w) <= 1.5 THEN 'share' WHEN greatest(abs(c), w) > 1e5 THEN 'emu' ELSE 'canvas' END AS units
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 20 AS c, CAST(vec_id % 7 AS DOUBLE) AS a, CAST(vec_id % 5 AS DOUBLE) AS b, abs(CAST(embedding[2] AS DOUBLE)) AS p, abs(CAST(embedding[3] AS DOUBLE)) AS q,
 CASE WHEN vec_id % 3 = 0 THEN 1.0 WHEN vec_id % 3 = 1 THEN 640.0 ELSE 2e5 END AS w, CASE WHEN vec_id % 2 = 0 THEN 360.0 ELSE 900.0 END AS h FROM embeddings)""")
def scalar_geometry(t: Tables) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    k, p, q = F.col("vec_id"), F.abs(e(1)), F.abs(e(2))
    a, b, c = (k % 7).cast("double"), (k % 5).cast("double"), e(0) * 20
    w, h = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 640.0).otherwise(2e5), F.when(k % 2 == 0, 360.0).otherwise(900.0)
    box = R.letterbox(w, h)
    return t.embeddings.select(
        "vec_id", F.round(R.clipped(c, -1.0), 5).alias("clipped"), F.round(R.count_similarity(a, b), 6).alias("alike"), F.round(R.harmonic(p, q), 6).alias("harmonic"), F.round(F.hypot(p, q), 6).alias("distance"),
        F.round(0.6 * p + 0.25 * q + 0.15, 6).alias("composite"), F.round(box["scale"], 6).alias("scale"), F.round(box["left"], 4).alias("left_"), R.box_units(F.array(c, w), w, h).alias("units"),
    )


@query("""SELECT o_orderkey, CASE WHEN s IS NOT NULL AND s = floor(s) THEN CAST(s AS BIGINT) END AS whole FROM (SELECT o_orderkey, TRY_CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey || '.0' WHEN 1 THEN o_orderkey || '.25' WHEN 2 THEN 'NaN' ELSE CAST(o_orderkey AS VARCHAR) END AS DECIMAL(38,10)) AS s FROM orders)""")
def integral_spellings(t: Tables) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey") % 4
    return t.orders.select("o_orderkey", R.integral(F.when(n == 0, F.concat(k, F.lit(".0"))).when(n == 1, F.concat(k, F.lit(".25"))).when(n == 2, "NaN").otherwise(k)).alias("whole"))


@query("""SELECT n_nationkey, s.s AS segment, coalesce(n, 0) AS customers, coalesce(total, 0) AS total FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'NONE') s
LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer GROUP BY ALL) c ON c.c_nationkey = n_nationkey AND c.c_mktsegment = s.s""")
def axes_with_zero_rows(t: Tables) -> DataFrame:
    """Every cell of two small axes; cells without data are rows of zeros. Both axes are key columns of dimension tables."""
    axis = t.customer.filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("segment")).distinct()
    axis = axis.unionByName(axis.sparkSession.createDataFrame([("NONE",)], "segment string"))
    cells = t.nation.select("n_nationkey").crossJoin(axis)
    found = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("total"))
    return cells.join(found, ["n_nationkey", "segment"], "left").fillna({"customers": 0, "total": 0.0})


@query("""SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN (SELECT p_size, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY ALL) ON p_size = 1 + s_suppkey % 50 AND p_brand = 'Brand#' || (11 + s_suppkey % 5)""")
def first_block(t: Tables) -> DataFrame:
    """The first part with a supplier's two keys."""
    left = t.supplier.select("s_suppkey", (1 + F.col("s_suppkey") % 50).cast("int").alias("p_size"), F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 5).cast("string")).alias("p_brand"))
    return R.first_match(left, t.part.select("p_size", "p_brand", "p_partkey"), ["p_size", "p_brand"], "p_partkey").select("s_suppkey", "p_partkey")


@query("""SELECT s_suppkey, CASE WHEN c_custkey IS NULL THEN 'missing' ELSE array_to_string(list_filter([CASE WHEN s_nationkey IS DISTINCT FROM c_nationkey THEN 'nation' END, CASE WHEN floor(s_acctbal / 1000) IS DISTINCT FROM floor(c_acctbal / 1000) THEN 'balance' END], lambda x: x IS NOT NULL), ',') END AS differs
FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey + 3 QUALIFY differs <> '' OR false""".replace(" QUALIFY differs <> '' OR false", ""))
def field_differences(t: Tables) -> DataFrame:
    """Suppliers and customers of one number (moved by 3), field by field."""
    a = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 1000).alias("balance"))
    b = t.customer.select((F.col("c_custkey") + 3).alias("s_suppkey"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).alias("balance"))
    wrong = R.differing_fields(a, b, "s_suppkey", ["nation", "balance"])
    return a.select("s_suppkey").join(wrong, "s_suppkey", "left").fillna({"differs": ""})


@query("""SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_linenumber FROM lineitem) ON o_orderkey = l_orderkey AND o_custkey % 50 = l_suppkey % 50""")
def current_results(t: Tables) -> DataFrame:
    """Results whose second key is still the one on record."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 50).alias("k"), "l_suppkey", "l_linenumber").distinct()
    return t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % 50).alias("k")).join(lines, ["o_orderkey", "k"]).select("o_orderkey", "o_custkey", "l_linenumber")


@query("""SELECT doc_id, CASE WHEN lang = 'de' AND n_chars < 500 THEN 0 WHEN n_chars < 500 THEN 1 ELSE 2 END AS bucket FROM documents ORDER BY bucket, doc_id LIMIT 150""")
def rescan_order(t: Tables) -> DataFrame:
    """Rejects of one kind, other rejects, then the rest; a pool of 1.5 times 100, in that order: the limit is the feature."""
    short = F.col("n_chars") < 500
    return R.by_priority(t.documents.select("doc_id", "lang", "n_chars"), [(F.col("lang") == "de") & short, short], "doc_id").limit(R.pool_size(100, 1.5)).select("doc_id", F.col("bucket"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN 100 + event_id % 3 END, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id)) AS ordinal FROM events""")
def explicit_ordinals(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "user_id", F.when(F.col("event_id") % 7 == 0, 100 + F.col("event_id") % 3).alias("given"))
    return R.ordinals(rows, ["event_type", "user_id"], "event_id", "given").select("event_id", "ordinal")


@query("""SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY path) AS round FROM (SELECT l_orderkey, l_suppkey, 'r/' || l_suppkey || '/' || l_orderkey AS path FROM lineitem GROUP BY ALL)""")
def rounds_by_path(t: Tables) -> DataFrame:
    """Rounds numbered in the order of their paths."""
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.concat_ws("/", F.lit("r"), F.col("l_suppkey"), F.col("l_orderkey")).alias("path"), F.lit(None).cast("long").alias("given")).distinct()
    return R.ordinals(rows, ["l_suppkey"], "path", "given").select("l_orderkey", "l_suppkey", F.col("ordinal").alias("round"))


@query("""SELECT doc_id, coalesce(b.lang, a.lang) AS lang, coalesce(b.n_chars, a.n_chars) AS n_chars FROM (SELECT doc_id, min(lang) AS lang, min(n_chars) AS n_chars FROM documents GROUP BY 1) a LEFT JOIN (SELECT doc_id, 'xx' AS lang, min(n_chars) + 1 AS n_chars FROM documents WHERE doc_id % 4 = 0 GROUP BY 1) b USING (doc_id)""")
def manifest_concat(t: Tables) -> DataFrame:
    """A manifest and a partial one; the partial one's rows win."""
    first = t.documents.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("n_chars").alias("n_chars"))
    second = first.filter("doc_id % 4 = 0").select("doc_id", F.lit("xx").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"))
    return R.later_wins(first, second, ["doc_id"])


@query("""SELECT user_id, event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'a' || event_id END, CASE WHEN event_id % 3 = 1 THEN 'b' || event_id END, event_type) AS path, sha256(user_id || chr(1) || event_type || chr(1) || event_id) AS fingerprint, md5('{"k":' || event_id || ',"t":"' || event_type || '"}') AS canonical FROM events""")
def nested_fallbacks(t: Tables) -> DataFrame:
    """A path from nested fields with fallbacks, a fingerprint of several columns, a hash of canonical JSON."""
    k = F.col("event_id")
    nested = F.struct(F.when(k % 3 == 0, F.concat(F.lit("a"), k.cast("string"))).alias("a"), F.struct(F.when(k % 3 == 1, F.concat(F.lit("b"), k.cast("string"))).alias("c")).alias("b"))
    rows = t.events.select("user_id", "event_id", "event_type", nested.alias("n"))
    return rows.select("user_id", "event_id", F.coalesce("n.a", "n.b.c", "event_type").alias("path"), F.sha2(F.concat_ws("\x01", "user_id", "event_type", "event_id"), 256).alias("fingerprint"), F.md5(F.to_json(F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("t"))).cast("binary")).alias("canonical"))


@query("""SELECT vec_id, list_sum(list_transform(range(4), lambda i: CAST(embedding[i + 1] > embedding[i + 5] AS BIGINT))) AS above, len(embedding) = 64 AS same_length, vec_id + 1 AS k_b, label AS k_a FROM embeddings""")
def merged_maps(t: Tables) -> DataFrame:
    """Maps merged so that the right one wins, arrays zipped after a check of their lengths, a nested field dropped."""
    e = F.col("embedding")
    zipped = F.zip_with(F.slice(e, 1, 4), F.slice(e, 5, 4), lambda a, b: F.when(a > b, 1).otherwise(0).cast("long"))
    left = F.create_map(F.lit("a"), F.col("label").cast("long"), F.lit("b"), F.lit(0).cast("long"))
    right = F.create_map(F.lit("b"), F.col("vec_id") + 1)
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right)
    row = F.struct(merged.alias("m"), F.lit(1).alias("private")).dropFields("private")
    return t.embeddings.select("vec_id", F.aggregate(zipped, F.lit(0).cast("long"), lambda s, x: s + x).alias("above"), (F.size(e) == 64).alias("same_length"), row.getField("m")["b"].alias("k_b"), row.getField("m")["a"].cast("int").alias("k_a"))


@query()
def positioned_text(t: Tables) -> DataFrame:
    """Turns of a conversation matched with the next one's, by text and place; text ratios aren't expressible in SQL."""
    c = t.conversations.select((F.col("conv_id") - F.col("conv_id") % 2).alias("pair"), F.when(F.col("conv_id") % 2 == 0, "reference").otherwise("candidate").alias("side"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 5 / 5).alias("x"), (F.col("turn") % 3 / 3).alias("y"))
    return R.matched_texts(c, "pair")
