"""The rule of the latest kept row against the plain loop, on long signatures too."""

from __future__ import annotations

import random

from marlstone.operators import chains as C
from marlstone.operators import files


def loop(rows, most):
    latest, kept = {}, []
    for sig, order, h in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if sig is None or h is None:
            kept.append(order)
        elif sig not in latest or ((h ^ latest[sig]) & (1 << 64) - 1).bit_count() > most:
            latest[sig] = h
            kept.append(order)
    return sorted(kept)


def rows_of(rng, n, flips, sig):
    h, out = rng.getrandbits(63), []
    for i in range(n):
        h ^= sum({1 << rng.randrange(63) for _ in range(rng.randrange(flips + 1))})
        out.append((sig(i), i, h))
    return out


def test_latest_kept_equals_the_loop(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(C, "BLOCK", 3)
    rows = rows_of(rng, 400, 3, lambda i: rng.choice(["a", "a", "a", "b", None])) + [("c", 1000 + i, 5) for i in range(50)] + [("d", 2000, None), ("d", 2001, -1), ("d", 2002, -(2**63))]
    df = spark.createDataFrame(rows, "s string, i long, h long")
    for most in (0, 12):
        assert sorted(r.i for r in C.latest_kept(df, ["s"], "i", "h", most).collect()) == loop(rows, most)
    assert C.latest_kept(df.limit(0), ["s"], "i", "h", 12).collect() == []


def test_chains_of_near_rows_keep_the_ends(spark):
    # A near B, B near C, A far from C: A and C stay
    rows = [("s", 1, 0), ("s", 2, 0b11111111), ("s", 3, 0b1111111111111111)]
    assert sorted(r.i for r in C.latest_kept(spark.createDataFrame(rows, "s string, i long, h long"), ["s"], "i", "h", 12).collect()) == [1, 3]


def test_a_signature_of_a_hundred_thousand_rows(spark):
    rng = random.Random(6)
    rows = rows_of(rng, 100_000, 1, lambda i: "s")
    df = spark.createDataFrame(rows, "s string, i long, h long").repartition(8, "i")
    assert sorted(r.i for r in C.latest_kept(df, ["s"], "i", "h", 12).collect()) == loop(rows, 12)


TREE = {
    ("p", "main.tex"): r"\begin{figure}\input{parts/a}\includegraphics{plot}\end{figure}\input{b.tex}", ("p", "parts/a.tex"): r"A \input{c} \input{../b}", ("p", "parts/c.tex"): "C",
    ("p", "b.tex"): r"B \input{parts/c}", ("p", "img/plot.svg"): "<svg/>", ("p", "img/other.svg"): "<svg/>", ("q", "x.tex"): r"\input{y}", ("q", "y.tikz"): r"Y \input{missing} \input{#1}",
}


def tree(spark, files_):
    return spark.createDataFrame([(p, f, t, 1) for (p, f), t in files_.items()], "paper string, file string, text string, depth int")


def test_included_files(spark):
    got = files.closure(files.includes(tree(spark, TREE)))
    assert sorted((r.paper, r.root, r.file, r.depth) for r in got.collect()) == [
        ("p", "b.tex", "parts/c.tex", 1), ("p", "main.tex", "b.tex", 1), ("p", "main.tex", "parts/a.tex", 1), ("p", "main.tex", "parts/c.tex", 2), ("p", "parts/a.tex", "b.tex", 1),
        ("p", "parts/a.tex", "parts/c.tex", 1), ("q", "x.tex", "y.tikz", 1),
    ]
    missing = files.includes(tree(spark, TREE)).filter("target IS NULL").select("file", "value").collect()
    assert sorted(map(tuple, missing)) == [("y.tikz", "missing")]


def test_cycles_raise(spark):
    import pytest

    cycle = {("p", "a.tex"): r"\input{b}", ("p", "b.tex"): r"\input{c}", ("p", "c.tex"): r"\input{a}", ("p", "d.tex"): r"\input{a}"}
    with pytest.raises(ValueError, match="a.tex"):
        files.closure(files.includes(tree(spark, cycle))).collect()
    with pytest.raises(ValueError, match="a.tex"):
        files.closure(files.includes(tree(spark, {("p", "a.tex"): r"\input{a}"}))).collect()
    assert files.closure(files.includes(tree(spark, TREE).limit(0))).collect() == []


def test_graphics_by_suffix_then_by_name(spark):
    got = files.graphics(tree(spark, TREE))
    assert [(r.file, r.value, r.target) for r in got.collect()] == [("main.tex", "plot", "img/plot.svg")]
    two = {**TREE, ("p", "alt/plot.png"): "x"}
    assert [r.target for r in files.graphics(tree(spark, two)).collect()] == [None]  # two files of that name: neither
    near = {**two, ("p", "plot.pdf"): "x"}
    assert [r.target for r in files.graphics(tree(spark, near)).collect()] == ["plot.pdf"]


def test_each_block_comes_once(spark):
    block = r"\begin{tikzpicture}\node {x};\end{tikzpicture}"
    given = {("p", "m.tex"): r"\begin{figure}\input{t}\caption{one}\end{figure} \begin{figure}\input{t}\end{figure}" + block, ("p", "t.tikz"): f"{block} {block} " + block.replace("x", "y")}
    got = files.figure_blocks(tree(spark, given)).collect()
    assert sorted((r.file, "y" in r.block, r.in_figure) for r in got) == [("m.tex", False, False), ("t.tikz", False, True), ("t.tikz", True, True)]
