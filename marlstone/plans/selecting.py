"""Selection, removal of duplicates, ordered computations and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import integrity as I
from marlstone.operators import ordered as O
from marlstone.operators import select as D
from marlstone.plans.base import Tables, query

EVENTS = "e AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c FROM events)"


def events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.col("value") * 100).cast("long").alias("c"))


@query("""WITH p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, sha256(text) AS h FROM documents)
SELECT h, position, source FROM p QUALIFY row_number() OVER (PARTITION BY h ORDER BY position, source) = 1""")
def interleave_dedupe(t: Tables) -> DataFrame:
    """Round robin over sources, the first of equal texts wins."""
    return D.interleave(t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h")), "source", "doc_id", "h")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 2")
def exact_dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def ordered_distinct(t: Tables) -> DataFrame:
    return D.ordered_distinct(t.documents, "source", "doc_id")


@query("SELECT trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS caption, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def semantic_signature(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", X.caption(F.col("text")).alias("caption")).withColumn("h", F.sha2("caption", 256))
    # fingerprints are shuffled, not texts; the first document of each gives its caption
    first = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    return first.join(rows.select("doc_id", "h", "caption"), ["doc_id", "h"]).dropDuplicates(["h"]).select("caption", "n", "doc_id")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def per_key_cap(t: Tables) -> DataFrame:
    return D.top_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def one_per_key(t: Tables) -> DataFrame:
    return D.top_per_key(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], 1)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1")
def compact_log(t: Tables) -> DataFrame:
    """Last write wins by user."""
    return D.last_wins(t.events.select("user_id", "ts", "event_type", "value"), ["user_id"], "ts")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM orders) WHERE s < 300000")
def running_stop(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return D.running_stop(rows, ["o_custkey"], ["o_orderkey"], "amount", 300000).drop("amount")


BITS = "bits AS (SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END for i in range(64)]) AS h FROM embeddings)"


def sign_bits(t: Tables) -> DataFrame:
    signed = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return t.embeddings.select("vec_id", signed.alias("h"))


@query(f"WITH {BITS} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM bits a JOIN bits b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 18")
def hamming_pairs(t: Tables) -> DataFrame:
    return D.hamming_pairs(sign_bits(t), "vec_id", "h", 18)


@query(f"""WITH RECURSIVE {BITS}, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS k FROM bits),
r(k, kept, ids) AS (SELECT 0::BIGINT, []::HUGEINT[], []::BIGINT[] UNION ALL
  SELECT o.k, CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, h)) <= 16)) = 0 THEN list_append(kept, h) ELSE kept END,
    CASE WHEN len(list_filter(kept, lambda x: bit_count(xor(x, h)) <= 16)) = 0 THEN list_append(ids, vec_id) ELSE ids END FROM r JOIN o ON o.k = r.k + 1)
SELECT unnest(ids) AS vec_id FROM (SELECT ids FROM r ORDER BY k DESC LIMIT 1)""")
def greedy_dedupe(t: Tables) -> DataFrame:
    """Vectors kept by a pass in the order of their ids that drops what is within 16 bits of a kept one."""
    bits = sign_bits(t)
    return D.greedy_keep(bits, D.hamming_pairs(bits, "vec_id", "h", 16), "vec_id", "vec_id").select("vec_id")


@query("""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, ' | ') THEN 'table' WHEN NOT regexp_matches(lower(text), '(the|der|les|que)') THEN 'no keyword' END AS reason FROM documents""")
def filter_reasons(t: Tables) -> DataFrame:
    text = F.col("text")
    rules = [("short", F.col("n_chars") < 200), ("shouting", text.contains("!!")), ("table", text.contains(" | ")), ("no keyword", ~F.lower(text).rlike("(the|der|les|que)"))]
    return t.documents.select("doc_id", D.first_reason(rules).alias("reason"))


@query("""WITH s AS (SELECT doc_id, contains(lower(text), 'license') AS a, contains(text, '!!') AS b, n_chars >= 800 AS c, n_chars >= 1800 AS d FROM documents)
SELECT doc_id, CASE WHEN a THEN 3.0 ELSE 0 END + CASE WHEN b THEN -3.0 ELSE 0 END + CASE WHEN c THEN 1.0 ELSE 0 END + CASE WHEN d THEN 0.5 ELSE 0 END AS score,
 array_to_string(list_filter([CASE WHEN a THEN 'license' END, CASE WHEN b THEN 'shouting' END, CASE WHEN c THEN 'long' END, CASE WHEN d THEN 'longer' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def keyword_score(t: Tables) -> DataFrame:
    text, n = F.col("text"), F.col("n_chars")
    score, reasons = D.additive_score([("license", 3.0, F.lower(text).contains("license")), ("shouting", -3.0, text.contains("!!")), ("long", 1.0, n >= 800), ("longer", 0.5, n >= 1800)])
    return t.documents.select("doc_id", score.alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query(f"""WITH {EVENTS}, p AS (SELECT *, event_type <> 'click' AS cumulative, row_number() OVER w AS n, last_value(CASE WHEN event_type <> 'click' THEN c END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, previous, CASE WHEN cumulative AND previous IS NOT NULL THEN c - previous WHEN cumulative AND n > 1 THEN NULL ELSE c END AS increment, cumulative AND previous IS NULL AND n > 1 AS missing,
 coalesce(CASE WHEN cumulative AND previous IS NOT NULL THEN c - previous WHEN cumulative AND n > 1 THEN NULL ELSE c END < 0, false) AS decreased FROM p""")
def usage_ledger_delta(t: Tables) -> DataFrame:
    rows = events(t).withColumn("cumulative", F.col("event_type") != "click")
    return O.ledger(rows, "user_id", "ts", "c", "cumulative").select("event_id", "previous", "increment", "missing", "decreased")


@query(f"WITH {EVENTS} SELECT event_type, k, grouping_id(event_type, k) AS level, count(*) AS n, sum(c) AS units FROM e GROUP BY GROUPING SETS ((event_type), (k), ())")
def usage_grouping_sets(t: Tables) -> DataFrame:
    rows = events(t)
    out = rows.groupingSets([[F.col("event_type")], [F.col("k")], []], F.col("event_type"), F.col("k"))
    return out.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("c").alias("units"))


@query(f"""WITH {EVENTS}, v AS (SELECT event_id, user_id, event_type, first_value(CASE event_type WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'failed' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM e)
SELECT event_id, user_id, coalesce(v, 'error') AS verdict FROM v WHERE event_type = 'error'""")
def error_attribution(t: Tables) -> DataFrame:
    return O.attributed(events(t), "user_id", "ts", "event_type", "error", {"purchase": "warning", "click": "failed"}).select("event_id", "user_id", "verdict")


@query(f"WITH {EVENTS} SELECT user_id, arg_max(k, ts) FILTER (event_type = 'click' AND k IS NOT NULL) AS last_click, arg_max(k, ts) FILTER (event_type = 'error' AND k IS NOT NULL) AS last_error FROM e GROUP BY 1")
def event_last_values(t: Tables) -> DataFrame:
    return O.last_values(events(t), ["user_id"], "ts", "event_type", "k", ["click", "error"])


@query("SELECT event_id, row_number() OVER w - 1 AS sequence, coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def event_prefix_offsets(t: Tables) -> DataFrame:
    return O.prefix_offsets(t.events.withColumn("n", F.length("props")), ["user_id"], "ts", "n").select("event_id", "sequence", "offset")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS attempt FROM events")
def attempt_ordinals(t: Tables) -> DataFrame:
    return O.placed(t.events.select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"], "attempt").select("event_id", "attempt")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(t: Tables) -> DataFrame:
    return I.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT k, CASE WHEN l IS NULL THEN 'right' ELSE 'left' END AS only_in FROM (SELECT coalesce(a.k, b.k) AS k, a.k AS l, b.k AS r FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k) WHERE l IS NULL OR r IS NULL")
def set_equality(t: Tables) -> DataFrame:
    return I.key_difference(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("SELECT l_suppkey AS k FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def complete_matrix(t: Tables) -> DataFrame:
    return I.complete(t.lineitem.select(F.col("l_suppkey").alias("k"), "l_linenumber"), "k", "l_linenumber")


@query("SELECT a.k AS k, b.p AS p FROM (SELECT DISTINCT o_custkey % 500 AS k FROM orders) a, (SELECT DISTINCT o_orderpriority AS p FROM orders) b WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey % 500 = a.k AND o_orderpriority = b.p)")
def full_matrix_check(t: Tables) -> DataFrame:
    return I.missing_cells(t.orders.select((F.col("o_custkey") % 500).alias("k"), F.col("o_orderpriority").alias("p")), "k", "p")


@query("SELECT n, count(*) AS suppliers FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def hist_of_hist(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("suppliers"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def unused_approved(t: Tables) -> DataFrame:
    used = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.filter("p_size > 25").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""SELECT e.event_id FROM events e WHERE e.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL
SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND event_type = 'error'""")
def anti_join_pending(t: Tables) -> DataFrame:
    """Events of users without a purchase, and errors of the others: what a resumed scan has to do again."""
    done = t.events.filter("event_type = 'purchase'").select("user_id").distinct()
    new = t.events.join(done, "user_id", "left_anti").select("event_id")
    again = t.events.join(done, "user_id", "left_semi").filter("event_type = 'error'").select("event_id")
    return new.unionByName(again)
