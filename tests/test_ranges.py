"""Places by ranges, the licence ladder and the link of a licence block."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marlstone.functions import licences as L
from marlstone.operators import ordered as O
from marlstone.operators import rules as R
from marlstone.operators import select as D


def test_one_key_is_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("a").alias("k"))
    out = O.placed(df, ["k"], ["x"])
    assert out.columns == ["x", "k", "place"]
    assert out.filter(F.col("place") != F.col("x") + 1).count() == 0
    ranges = df.repartitionByRange(4, "k", "x").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 2500


def test_places_of_many_keys(spark):
    rows = [(k, x) for k in ("a", "b", None, "") for x in range(ord(k) if k else 3)]
    got = O.placed(spark.createDataFrame(rows, "k string, x int"), ["k"], [F.desc("x")]).collect()
    assert sorted((str(r.k), r.x, r.place) for r in got) == sorted((str(k), x, (ord(k) if k else 3) - x) for k, x in rows)
    assert O.placed(spark.createDataFrame([], "k string, x int"), ["k"], ["x"]).collect() == []
    tied = O.placed(spark.createDataFrame([("a", 1)] * 9, "k string, x int"), ["k"], ["x"]).collect()
    assert sorted(r.place for r in tied) == list(range(1, 10))


def test_no_key_and_greedy_order(spark):
    nodes = spark.range(10).select("id", (10 - F.col("id")).alias("score"))
    assert [r.id for r in O.placed(nodes, [], [F.desc("score")]).orderBy("place").collect()] == list(range(10))
    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    assert sorted(r.id for r in D.greedy_keep(nodes, path, "id", [F.desc("score")]).collect()) == [0, 2, 4, 6, 8]
    assert sorted(r.id for r in D.greedy_keep(nodes, path, "id", ["score"]).collect()) == [1, 3, 5, 7, 9]


@pytest.mark.parametrize(
    "url, family, status, granted, conditions",
    [
        (None, "unknown", "review-required", False, 0), ("  ", "unknown", "review-required", False, 0), ("/", "unknown", "review-required", False, 0),
        ("http://arxiv.org/licenses/assumed-1991-2003/", "arxiv-nonexclusive", "exclude-assets", False, 0), ("HTTPS://creativecommons.org/publicdomain/zero/1.0/", "cc0", "release-ready", True, 0),
        ("https://creativecommons.org/publicdomain/mark/1.0/", "public-domain-mark", "release-ready", True, 0), ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd", "exclude-assets", False, 3),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa", "review-required", True, 3), ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc", "review-required", True, 2),
        ("https://creativecommons.org/licenses/by-nd/4.0/", "cc-by-nd", "exclude-assets", False, 2), ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa", "release-ready", True, 2),
        (" https://creativecommons.org/licenses/by/4.0/ ", "cc-by", "release-ready", True, 1), ("https://creativecommons.org/licenses/by/", "other", "review-required", False, 0), ("https://gnu.org/gpl", "other", "review-required", False, 0),
    ],
)
def test_ladder(spark, url, family, status, granted, conditions):
    d = spark.createDataFrame([(url,)], "u string").select(L.decision(F.col("u")).alias("d")).first().d
    assert (d.family, d.status, d.grant, len(d.conditions)) == (family, status, granted, conditions) and d.rationale


@pytest.mark.parametrize(
    "html, href",
    [
        (None, ""), ("", ""), ("<a href='x'></a>", ""), ("<div class='abs-license'><div><a href=x></a></div></div>", "x"), ("<div class='abs-licenses'><a href=x></a></div>", ""),
        ("<div class='abs-license'><a data-href='n' href=' y '></a><a href='z'></a></div>", "y"), ("<div class='abs-license'></div><a href=x></a>", ""),
        ("<div class='abs-license'><p></p></div><div class='b abs-license'><a href=\"q?a&amp;lt;\"></a></div>", "q?a&lt;"), ("<script>'<div class=abs-license>'</script><a href=x></a>", ""),
        ("<div class=abs-license><a title='>' href=\"v\">" + "<b>t</b>" * 2000, "v"), ("<div class=abs-license", ""),
    ],
)
def test_block_href(spark, html, href):
    assert spark.createDataFrame([(html,)], "h string").select(L.block_href(F.col("h"))).first()[0] == href


def test_structured_score(spark):
    row = "false raster, 10 nodes, 30 edges, false plot, 3 hits, true captioned, {0} drawn"
    score = lambda drawn: spark.sql("SELECT " + row.format(drawn)).select(R.structured_score(*[F.col(c) for c in ("raster", "nodes", "edges", "plot", "hits", "captioned", "drawn")])).first()[0]
    assert score("true") == 8.5 + 3.5 + 8 + 4 and score("false") == 8.5 + 3.5 + 8 + 2
