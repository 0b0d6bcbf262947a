"""Line dedup, whitening and phrase mining against brute force and DuckDB, and on odd tables."""

from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest

from marlstone.llm import collocations, jaccard, licenses, line_dedup, registry, whitening

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
LONG = "\n".join(f"line {i % 700} of a very long text" for i in range(30_000))
SCHEMA = "doc_id long, text string, t int, h1 int, gone string, batch int, pos int"


def same(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


@here
@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_phrase_collocations"])
def test_registered_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    q = con.sql(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(q.columns)
    assert same(df.select(*q.columns).collect(), q.fetchall())


def lines(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA)


def test_lines_of_odd_rows(spark):
    x = "x" * 25
    rows = [
        (1, None), (2, ""), (3, "a\n\nb\n"), (4, f"{x.upper()}\n  {x}\t\nq"), (5, x), (None, f"{x}\nz"), (5, "é" * 20 + "\n" + x.upper()), (7, "É" * 20),
        (8, "é" * 20 + "A"), (9, "é" * 20), (10, "é" * 20), (4, "é" * 20), (4, "é" * 20), (11, LONG), (12, LONG), (13, LONG), (14, f"\r{x}\x0b\n\x0c"), (-5, x), (2**62, f" {x} "),
    ]
    assert same(line_dedup.dedupe_lines(lines(spark, rows)).collect(), line_dedup.brute_force(rows))
    assert line_dedup.dedupe_lines(lines(spark, rows).limit(0)).collect() == []
    nulls = [(None, x)] * 5
    assert same(line_dedup.dedupe_lines(lines(spark, nulls)).collect(), line_dedup.brute_force(nulls))


def test_lines_don_t_depend_on_batches(spark):
    rng = random.Random(5)
    pool = [f"a common line of number {i}" for i in range(40)] + [f"short {i}" for i in range(9)]
    rows = [(rng.randrange(120), "\n".join(rng.choices(pool, k=rng.randrange(8)))) for _ in range(300)]
    rows += [(1000 + i, "one very common line of text") for i in range(200)]
    want = line_dedup.brute_force(rows)
    for parts in (1, 2, 5):
        assert same(line_dedup.dedupe_lines(lines(spark, rows), batches=parts).collect(), want)


def test_runs_merge_without_a_shuffle(spark):
    runs = line_dedup.Runs(spark)
    held = lambda ids: spark.createDataFrame([(d, k, k) for d in ids for k in range(50)], "doc long, h1 long, h2 long")
    runs.add(held([9, 8, 7]))
    runs.add(held([5]))  # all settled: nothing to add
    assert {k: len(v) for k, v in runs.levels.items() if v} == {1: 1}
    runs.add(held([4, 3]))
    got = runs.frequent().collect()
    assert len(got) == 50 and {(r.n, r.top) for r in got} == {(3, 9)}
    plan = runs.merged([r.hint("merge") for r in runs.runs()])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


@here
def test_whitened_table(spark):
    df = registry.QUERIES["op12_embedding_whitening"](spark, SF)
    assert [f"{n} {t}" for n, t in df.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    got = df.toPandas()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    deviations, v, z = whitening.brute_force([list(map(float, x)) for x in vectors.embedding])
    e, u = np.linalg.eigh(v)
    want = (z @ u[:, ::-1])[:, :32] / np.sqrt(e[::-1][:32])
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors.vec_id].to_numpy()
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[vectors.vec_id]
    assert first.deviation.tolist() == deviations and set(got.n) == {len(vectors)}
    assert np.allclose(got[got.vec_id == vectors.vec_id[0]].sort_values("component").explained, e[::-1][:32] / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(0)
    for scale in (0, 10, 200, 2**30, 2**55):
        x = rng.integers(-scale - 1, scale + 1, (300, 5))
        g = whitening.gram(x)
        want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
        assert [[sum(int(g[k, i, j]) << whitening.LIMB * k for k in range(len(g))) for j in range(5)] for i in range(5)] == want


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [3.0, 0.5]), (3, None), (4, []), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.25]), (10, [-inf, 0.0])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, n int, d int")
    got = {(r.vec_id, len(r.whitened)): r for r in whitening.whiten(df).collect()}
    assert set(got) == {(1, 2), (None, 2), (9, 2), (8, 3)}
    assert got[1, 2].n == 3 and got[1, 2].identity_error < 1e-9 and got[8, 3].whitened == [0.0] * 3 and got[8, 3].deviation == 0
    assert whitening.whiten(df.limit(0)).collect() == []
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.deviation is None for r in whitening.whiten(big).collect()} == {1: True, 2: True, 3: False}


def test_phrases_of_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "É", "c\x1cd", "e", "F", "g", "h"]
    docs = [(rng.choice(["en", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t", "  ", ". ", "\n", ", ", "-"]) for _ in range(rng.randrange(60)))) for _ in range(500)]
    docs += [("en", None), ("x", ""), (None, "A b " * 50), ("one", "w " * 20_000)]
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "lang string, text string, word string, n int, score int")
    want = collocations.brute_force(docs)
    assert same(collocations.collocations(df).collect(), want)
    monkeypatch.setattr(collocations, "BUCKET", 40)  # hot pivots, dealt to several buckets
    monkeypatch.setattr(collocations, "TOKENS", 500)
    assert same(collocations.collocations(df).collect(), want)
    assert same(collocations.collocations(df, top=3).collect(), collocations.brute_force(docs, top=3))
    assert collocations.collocations(df.limit(0)).collect() == [] == collocations.collocations(df.filter("lang = 'x'")).collect()


def test_licences_are_whole_words(spark):
    texts = {
        "AGPL-3.0": "AGPL", "LGPL-2.1": "LGPL", "the GPL 2019 workshop": "", "the gpl 300 items license": "", "GPL v3": "GPL-3.0", "GPLv2.": "GPL-2.0", "under the GNU Affero General Public License": "AGPL",
        "GPL-3.0 and LGPL": "LGPL,GPL-3.0", "a CC-BY-4.0 and a CC-BY-40 thing": "CC-BY-4.0", "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    }
    got = licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: r.licenses for r in got} == texts


def test_one_of_each_drops_rows_not_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    near = a.replace("a39", "x")
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (2, b, "r"), (3, near, "s"), (4, None, "t"), (4, None, "t"), (5, "", "u"), (None, a, "v"), (None, "w " * 9, "x"), (1, near, "y")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, n int, c int, th int")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    kept = sorted([(r.doc_id, r.text) for r in got.collect()], key=repr)
    first = [x for x in kept if x[0] == 1]
    assert len(first) == 1 and first[0][1] in (a, near)
    assert [x for x in kept if x[0] != 1] == sorted([(2, b), (4, None), (5, ""), (None, "w " * 9)], key=repr)
    nulls = spark.createDataFrame([(None, a), (None, a), (None, near)], "doc_id long, text string")
    assert jaccard.one_of_each(nulls).count() == 1 and jaccard.one_of_each(df.limit(0)).collect() == []


def test_brute_force_compares_any_number():
    texts = {i: f"{i % 1500} is the number of this text here" for i in range(2100)}
    got = jaccard.brute_force(texts)
    assert got[1500] == (got[0][0], 0) and got[1499][1] == 1499


def test_large_groups_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 400)
    rng = random.Random(8)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = {}
    for family in range(3):  # near copies in chains, whose ends aren't alike
        words = [f"f{family}w{i}" for i in range(40)]
        for k in range(40):
            words[rng.randrange(40)] = f"x{family}y{k}"
            texts[len(texts)] = f"{shared} {' '.join(words)}"
    for k in range(60):  # a passage in common and nothing else
        texts[len(texts)] = shared + " " + " ".join(f"o{k}z{i}" for i in range(rng.randrange(5, 60)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == jaccard.brute_force(texts) and len({c for _, c in got.values()}) < len(texts) - 40
