"""Joins, aggregations, sets and sorting over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import licences as L
from marlstone.functions import text as X
from marlstone.operators import ordered as O
from marlstone.plans.base import Tables, query
from marlstone.session import written


@query("""SELECT n_name, c_mktsegment, count(o_orderkey) AS orders, CASE WHEN count(o_totalprice) = count(*) THEN round(avg(CAST(o_totalprice AS DECIMAL(18,2))), 4) END AS mean_price, count(*) FILTER (o_orderkey IS NULL) AS synthesized
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL""")
def zero_fill_missing(t: Tables) -> DataFrame:
    """Customers without an open order count as zero rows; a mean exists only where every row has a value."""
    open_ = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(open_, F.col("c_custkey") == F.col("o_custkey"), "left")
    mean = F.when(F.count("p") == F.count("*"), F.round(F.avg("p").cast("double"), 4))
    return rows.groupBy("n_name", "c_mktsegment").agg(F.count("o_orderkey").alias("orders"), mean.alias("mean_price"), F.count_if(F.col("o_orderkey").isNull()).alias("synthesized"))


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_default_join(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("quality").isNull(), "pending").when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("status"))


@query("SELECT n_nationkey, coalesce(min(s_name), min(c_name), n_name) AS source FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def prioritised_lookup(t: Tables) -> DataFrame:
    """The first source that has the key: suppliers, else customers, else the nation itself."""
    found = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("p"), F.col("s_name").alias("source"))
    found = found.unionByName(t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit(2).alias("p"), F.col("c_name").alias("source")))
    found = found.unionByName(t.nation.select(F.col("n_nationkey").alias("k"), F.lit(3).alias("p"), F.col("n_name").alias("source")))
    return found.groupBy(F.col("k").alias("n_nationkey")).agg(F.min_by("source", F.struct("p", "source")).alias("source"))


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fallback_join(t: Tables) -> DataFrame:
    nations = t.nation.filter("n_nationkey % 3 > 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return t.supplier.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("SELECT o_orderkey, o_totalprice > c_acctbal AS over_balance, o_orderstatus = 'F' AS finished FROM orders JOIN customer ON o_custkey = c_custkey AND c_nationkey < 15")
def identity_join(t: Tables) -> DataFrame:
    current = t.customer.filter("c_nationkey < 15")
    return t.orders.join(current, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", (F.col("o_totalprice") > F.col("c_acctbal")).alias("over_balance"), (F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def status_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(quantile_cont(o_totalprice, 0.5), 6) AS middle FROM orders GROUP BY 1")
def conditional_counts(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(p > 100000).alias("large"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"), F.count_distinct("o_custkey").alias("customers"), F.min(p).alias("least"), F.max(p).alias("greatest"), F.round(F.percentile(p, 0.5), 6).alias("middle"))


@query("SELECT o_custkey, sum(least(CAST(round(o_totalprice) AS BIGINT), 100000))::BIGINT AS capped FROM orders GROUP BY 1")
def capped_sum(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sum(F.least(F.round("o_totalprice").cast("long"), F.lit(100000))).alias("capped"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS per_row FROM lineitem GROUP BY ALL")
def cost_totals(t: Tables) -> DataFrame:
    d = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), d("l_quantity").alias("total"), F.round(d("l_extendedprice") / F.count("*"), 4).alias("per_row"))


LICENSE = "CASE WHEN contains(lower(text), 'by-nc-nd') THEN '{0}' WHEN contains(lower(text), 'by-nc-sa') THEN '{1}' WHEN contains(lower(text), 'by-nc') THEN '{2}' WHEN contains(lower(text), 'by-nd') THEN '{3}' WHEN contains(lower(text), 'by-sa') THEN '{4}' WHEN contains(lower(text), 'apache license') THEN '{5}' WHEN contains(lower(text), 'mit license') THEN '{6}' WHEN contains(lower(text), 'general public license') THEN '{7}' ELSE '{8}' END"
FAMILY = LICENSE.format("cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-nd", "cc-by-sa", "apache", "mit", "gpl", "unknown")
STATUS = LICENSE.format("excluded", "review", "review", "excluded", "ready", "ready", "ready", "review", "excluded")


@query(f"SELECT doc_id, {FAMILY} AS family, {STATUS} AS status FROM documents")
def license_classify(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.license_family(F.col("text")).alias("family"), X.license_family(F.col("text"), 2).alias("status"))


@query(f"SELECT family, status, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id, bool_and(n_chars > 0) AS all_with_text FROM (SELECT doc_id, source, n_chars, {FAMILY} AS family, {STATUS} AS status FROM documents) WHERE family <> 'unknown' GROUP BY ALL")
def license_summary(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars", X.license_family(F.col("text")).alias("family"), X.license_family(F.col("text"), 2).alias("status")).filter("family <> 'unknown'")
    return rows.groupBy("family", "status").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id"), F.bool_and(F.col("n_chars") > 0).alias("all_with_text"))


GRANTS = "[CASE WHEN contains(k, 'by') THEN 'attribution' END, CASE WHEN contains(k, '-nc') THEN 'noncommercial' END, CASE WHEN contains(k, '-sa') THEN 'share-alike' WHEN contains(k, '-nd') THEN 'no-derivatives' END]"


@query(f"""WITH u AS (SELECT doc_id, regexp_extract(lower(text), 'by(-nc)?(-nd|-sa)?-?[0-9]') AS m, contains(lower(text), 'apache license') AS a, contains(lower(text), 'mit license') AS b, doc_id % 2 = 0 AS even FROM documents),
k AS (SELECT doc_id, CASE WHEN m <> '' THEN regexp_replace(m, '-?[0-9]$', '') WHEN a THEN 'other' WHEN b THEN 'zero' WHEN even THEN 'archive' ELSE '' END AS k FROM u)
SELECT doc_id, CASE k WHEN 'other' THEN 'other' WHEN 'zero' THEN 'cc0' WHEN 'archive' THEN 'arxiv-nonexclusive' WHEN '' THEN 'unknown' ELSE 'cc-' || k END AS family,
 CASE WHEN k IN ('zero', 'by', 'by-sa') THEN 'release-ready' WHEN k = 'archive' OR contains(k, '-nd') THEN 'exclude-assets' ELSE 'review-required' END AS status,
 k = 'zero' OR contains(k, 'by') AND NOT contains(k, '-nd') AS granted, array_to_string(list_filter({GRANTS}, lambda x: x IS NOT NULL), ',') AS conditions FROM k""")
def license_decisions(t: Tables) -> DataFrame:
    """The ladder over URLs that name the licence a text speaks of."""
    low = F.lower("text")
    named = F.regexp_extract(low, "(by(-nc)?(-nd|-sa)?)-?[0-9]", 1)
    url = (
        F.when(named != "", F.concat(F.lit(" https://CreativeCommons.org/licenses/"), named, F.lit("/4.0/"))).when(low.contains("apache license"), F.lit("https://www.apache.org/licenses/"))
        .when(low.contains("mit license"), F.lit("https://creativecommons.org/publicdomain/zero/1.0/")).when(F.col("doc_id") % 2 == 0, F.lit("http://arxiv.org/licenses/nonexclusive-distrib/1.0/license.html"))
    )
    out = t.documents.select("doc_id", L.decision(F.coalesce(url, F.lit(" "))).alias("d"))
    return out.select("doc_id", "d.family", "d.status", F.col("d.grant").alias("granted"), F.array_join("d.conditions", ",").alias("conditions"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'a&b' ELSE '' END AS href FROM pages")
def license_link(t: Tables) -> DataFrame:
    """The licence block's link in pages that hold one, quoted either way, in a closed block, or none."""
    made = F.lit("<!-- <div class='abs-license'><a href='x'></a></div> -->")
    made = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<p><a href="#"></a></p><div class="z abs-license"><span><br/><a>no</a></span><A title=">" HREF="'), "url", F.lit('">l</A><a href="second"></a></div>'))).otherwise(made)
    made = F.when(F.col("page_id") % 4 == 1, F.lit("<div class='abs-license'><a href='a&amp;b'></a></div>")).otherwise(made)
    made = F.when(F.col("page_id") % 4 == 2, F.lit("<div class='abs-license'></div><a href='late'></a>")).otherwise(made)
    return t.pages.select("page_id", L.block_href(F.concat(made, F.coalesce("html", F.lit("")))).alias("href"))


@query(f"SELECT family, status, doc_id, row_number() OVER (PARTITION BY family, status ORDER BY doc_id) AS position FROM (SELECT doc_id, {FAMILY} AS family, {STATUS} AS status FROM documents) WHERE family <> 'unknown'")
def license_ids(t: Tables) -> DataFrame:
    """The ids of each family, a row for each, so that no family is one value. Absent ids come last, as in the SQL."""
    rows = t.documents.select("doc_id", X.license_family(F.col("text")).alias("family"), X.license_family(F.col("text"), 2).alias("status")).filter("family <> 'unknown'")
    return O.placed(rows, ["family", "status"], [F.asc_nulls_last("doc_id")], "position").select("family", "status", "doc_id", "position")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
dt AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(w) AS k FROM d) GROUP BY ALL), bt AS (SELECT item_id, k, count(*) AS n FROM (SELECT item_id, unnest(w) AS k FROM b) GROUP BY ALL),
x AS (SELECT doc_id, item_id FROM dt JOIN bt USING (k) WHERE length(k) >= 10 GROUP BY ALL HAVING sum(least(dt.n, bt.n)) >= 3),
y AS (SELECT doc_id, item_id, CAST(sum(least(dt.n, bt.n)) AS BIGINT) AS m FROM x JOIN bt USING (item_id) JOIN dt USING (doc_id, k) GROUP BY ALL)
SELECT doc_id, item_id, m AS shared, round(2 * m / (len(d.w) + len(b.w)), 6) AS f1 FROM y JOIN d USING (doc_id) JOIN b USING (item_id)""")
def token_f1(t: Tables) -> DataFrame:
    """Multiset F1 over all tokens of documents and benchmark items that share three long words or more.

    Long words, which are rare, only find the pairs; the overlap of these is over all tokens.
    """
    counted = lambda df, k, words, n: df.select(k, F.explode(words).alias("k")).groupBy(k, "k").agg(F.count("*").alias(n))
    words = X.tokens(F.col("text"))
    b = counted(t.benchmark, "item_id", words, "y")
    long = counted(t.documents, "doc_id", F.filter(words, lambda w: F.length(w) >= 10), "x")
    pairs = written(long.join(b.filter(F.length("k") >= 10), "k").groupBy("doc_id", "item_id").agg(F.sum(F.least("x", "y")).alias("s")).filter("s >= 3").drop("s"))
    # only documents of a pair give all their words
    d = counted(t.documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", words, "x")
    sizes = [df.groupBy(k).agg(F.sum(n).alias(f"size_{k}")) for df, k, n in ((d, "doc_id", "x"), (b, "item_id", "y"))]
    shared = pairs.join(b, "item_id").join(d, ["doc_id", "k"]).groupBy("doc_id", "item_id").agg(F.sum(F.least("x", "y")).alias("shared"))
    return shared.join(sizes[0], "doc_id").join(sizes[1], "item_id").select("doc_id", "item_id", "shared", F.round(2 * F.col("shared") / (F.col("size_doc_id") + F.col("size_item_id")), 6).alias("f1"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 50 OFFSET 20")
def mixed_sort_page(t: Tables) -> DataFrame:
    """A page of a mixed order: the limit is the feature."""
    return t.orders.orderBy(F.desc("o_orderpriority"), "o_totalprice", "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("SELECT k, count(*) AS n FROM (SELECT o_orderpriority AS k FROM orders INTERSECT SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P') GROUP BY 1 UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'except all', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part) UNION ALL SELECT 'intersect all', count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT ALL SELECT p_partkey FROM part)")
def set_operations(t: Tables) -> DataFrame:
    o = t.orders
    k = o.select(F.col("o_orderpriority").alias("k"))
    # an intersection joins the sides as they are, and five keys are five tasks at most: each side's distinct keys come first
    both = k.distinct().intersect(o.filter("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("k")).distinct()).groupBy("k").agg(F.count("*").alias("n"))
    named = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n")
    part, line = t.part.select(F.col("p_partkey").alias("k")), t.lineitem.select(F.col("l_partkey").alias("k"))
    # numbers compress so well that Spark would give all orders to one task: their distinct keys are dealt by number instead
    parts = 16 * o.rdd.getNumPartitions()
    dealt = lambda df, c: df.select(F.col(c).alias("k")).repartition(parts, "k")
    gone = dealt(t.customer, "c_custkey").subtract(dealt(o, "o_custkey").distinct())
    return both.unionByName(named(gone, "except")).unionByName(named(line.exceptAll(part), "except all")).unionByName(named(line.intersectAll(part), "intersect all"))


@query("SELECT a.label AS label, count(*) AS n, round(avg(x), 5) AS mean_first FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) a GROUP BY 1")
def label_means(t: Tables) -> DataFrame:
    return t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("x")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 5).alias("mean_first"))


@query("""WITH c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
e AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m))), 4) AS cosine FROM e JOIN c USING (label, i) GROUP BY 1""")
def label_centroid(t: Tables) -> DataFrame:
    """Cosine of each vector with the mean of its label."""
    rows = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    means = rows.select("label", F.posexplode("e").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    means = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.join(means, "label").select("vec_id", F.round(dot("e", "c") / (F.sqrt(dot("e", "e")) * F.sqrt(dot("c", "c"))), 4).alias("cosine"))
