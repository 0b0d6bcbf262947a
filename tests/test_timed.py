"""Joins by time against plain Python, with hot keys, ties and nulls."""

from __future__ import annotations

import random

from marlstone.operators import timed as T


def test_asof_equals_the_loop(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 20)
    rng = random.Random(1)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(300)])) for i in range(500)] + [(0, 1, 5)] * 2
    right = [(key(), rng.choice([None, *range(300)]), i) for i in range(200)]
    a = spark.createDataFrame(left, "id long, k int, t long")
    b = spark.createDataFrame(right, "k int, t long, v long")
    for forward in (False, True):
        got = T.asof(a, b, ["k"], "t", ["v"], tie="v", forward=forward).collect()
        want = []
        for i, k, t in left:
            near = [(s, v) for j, s, v in right if j == k is not None and None not in (s, t) and (s >= t if forward else s <= t)]
            best = max(near, key=lambda x: (-x[0] if forward else x[0], x[1]), default=(None, None))
            want.append((i, k, t, best[1]))
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert T.asof(a.limit(0), b, ["k"], "t", ["v"]).collect() == []
    assert {r.v for r in T.asof(a, b.limit(0), ["k"], "t", ["v"]).collect()} == {None}


def test_asof_of_one_hot_key_has_no_task_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 500)
    rows = spark.range(20_000).selectExpr("1 AS k", "id AS t")
    got = T.asof(rows, rows.filter("t % 1000 = 0").selectExpr("k", "t", "t AS v"), ["k"], "t", ["v"])
    assert got.filter("v != t - t % 1000 OR v IS NULL").count() == 0
    parts = T.buckets(rows, "t", 20_000)
    assert max(r["count"] for r in rows.groupBy(parts.alias("b")).count().collect()) < 1500


def test_points_in_intervals_equal_the_loop(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT", 25)
    rng = random.Random(2)
    points = [(i, rng.choice([None, 7, 7, 7, -3, *range(-400, 400)])) for i in range(400)]
    spans = [(i, s, s + rng.choice([0, 1, 5, 64, 1000, -2])) for i in range(60) for s in [rng.randrange(-500, 500)]] + [(60, None, 3), (61, 3, None), (62, 7, 7), (62, 7, 7)]
    got = T.in_intervals(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(spans, "s long, lo long, hi long"), "at", "lo", "hi").collect()
    want = [(p, x, s, lo, hi) for p, x in points for s, lo, hi in spans if None not in (x, lo, hi) and lo <= x <= hi]
    assert sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "s long, lo long, hi long")
    assert T.in_intervals(spark.createDataFrame(points, "p long, at long"), none, "at", "lo", "hi").collect() == []
