"""Operators against small tables with known answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import consensus as C
from marlstone.operators import integrity as I
from marlstone.operators import ordered as O
from marlstone.operators import select as D
from marlstone.operators import statistics as S


def test_stairs_round_half_even(spark):
    rows = [(r, b) for r in (0.0, 0.02, 0.03, 0.10, 0.11, 0.25, 0.26, 0.5, 0.51, 1.0) for b in (0.0, 0.5, 1.5, 3.0)]
    got = spark.createDataFrame(rows, "r double, b double").select("r", "b", C.points(F.col("b"), F.col("r")).alias("p")).collect()
    step = lambda r: 1.0 if r <= 0.02 else 1.25 if r <= 0.1 else 1.5 if r <= 0.25 else 2.0 if r <= 0.5 else 2.5
    assert all(x.p == round(x.b * step(x.r), 2) for x in got)
    assert {x.p for x in got if x.r == 0.10 and x.b == 0.5} == {0.62}


def test_ledger(spark):
    rows = [("a", 1, 5, True), ("a", 2, 9, True), ("a", 3, 4, False), ("a", 4, 8, True), ("b", 1, 3, False), ("b", 2, 7, True)]
    got = O.ledger(spark.createDataFrame(rows, "t string, s int, c long, cum boolean"), "t", "s", "c", "cum").orderBy("t", "s").collect()
    assert [x.increment for x in got] == [5, 4, 4, -1, 3, None]
    assert [x.decreased for x in got] == [False, False, False, True, False, False]
    assert [x.missing for x in got] == [False, False, False, False, False, True]


def test_attribution(spark):
    rows = [("a", i, k) for i, k in enumerate(["error", "done", "error", "failed", "error"])]
    got = O.attributed(spark.createDataFrame(rows, "l string, i int, k string"), "l", "i", "k", "error", {"done": "warning", "failed": "error!"}).orderBy("i").collect()
    assert [x.verdict for x in got] == ["warning", "error!", "error"]


def test_greedy_keep_equals_the_loop(spark):
    import random

    rng = random.Random(3)
    nodes = list(range(120))
    pairs = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.04}
    kept: list[int] = []
    for x in nodes:
        if not any((min(x, k), max(x, k)) in pairs for k in kept):
            kept.append(x)
    got = D.greedy_keep(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame(list(pairs), "a long, b long"), "id", ["id"])
    assert sorted(r.id for r in got.collect()) == kept


def test_hamming_pairs_lose_none(spark):
    import random

    rng = random.Random(5)
    base = rng.getrandbits(63)
    hashes = [base ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9))) & (1 << 63) - 1 for _ in range(60)] + [-1, -2]
    got = D.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "k long, h long"), "k", "h", 6).collect()
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(i, j, far(a, b)) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and far(a, b) <= 6}
    assert {tuple(r) for r in got} == want


def test_numpy_draws_run_through_one_generator(spark):
    import numpy as np

    got = S.numpy_draws(spark, 5, [2, 3], 2, 9).orderBy("sample_size", "iteration", "draw").collect()
    rng = np.random.default_rng(9)
    want = [int(x) for size in (2, 3) for _ in range(2) for x in rng.integers(0, 5, size=size)]
    assert [r.position for r in got] == want


def test_private_fields_at_any_depth(spark):
    df = spark.createDataFrame([], "a struct<b: array<struct<elapsed_s: int>>>, Duration int, m map<string, struct<x: int>>")
    assert I.private_fields(df, ("elapsed", "duration")) == ["a.b.elapsed_s", "Duration"]


def test_private_keys_of_documents(spark):
    rows = ['{"a":[{"Elapsed_s":1,"m":{"x_elapsed":{"elapsed":2}}}]}', '{"a":[{"elapsed_s":1},{"Elapsed_s":1}]}', "[]", "3", None]
    df = spark.createDataFrame([(x,) for x in rows], "t string").select(F.parse_json("t").alias("v"))
    got = {tuple(r) for r in I.private_keys(df, "v", ("elapsed",)).collect()}
    assert got == {("$.a[].Elapsed_s", 2), ("$.a[].elapsed_s", 1), ("$.a[].m.x_elapsed", 1), ("$.a[].m.x_elapsed.elapsed", 1)}
    assert I.private_keys(df.limit(0), "v", ("elapsed",)).collect() == []


def test_greedy_keep_raises_at_its_bound(spark):
    import pytest

    path = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(10)], "id long")
    assert sorted(r.id for r in D.greedy_keep(nodes, path, "id", "id").collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(RuntimeError, match="open"):
        D.greedy_keep(nodes, path, "id", "id", rounds=3)


def test_latex(spark):
    said = r"A \textbf{bold} claim \cite{x} at 5\% % gone" + "\n" + r"\\% gone too"
    row = spark.createDataFrame([(said,)], "x string").select(X.without_comments(F.col("x")).alias("c"), X.latex_text(X.without_comments(F.col("x"))).alias("t")).first()
    assert "gone" not in row.c and row.t.startswith("A bold claim at 5%")
