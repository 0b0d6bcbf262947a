"""Parsers and image functions on known texts and arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marlstone.functions import images as M
from marlstone.functions import structure as S
from marlstone.operators import consensus as C
from marlstone.operators import rules as R
from marlstone.operators import statistics as T


def test_latex():
    assert S.uncommented("50\\% a % b\nx \\\\% c") == "50\\% a \nx \\\\"
    assert S.argument("\\caption[s{h}]{a {b} \\} c} d", "caption") == "a {b} \\} c"
    assert S.argument("\\captionof{x}{y} \\caption {z}", "caption") == "z" and S.argument("\\caption{open", "caption") is None
    assert [len(x) > 0 for x in S.environments("\\begin{figure*}a\\begin{figure}b\\end{figure}\\end{figure*} \\begin{figure}", "figure")] == [True]
    assert S.brace_groups("{a{b}}x{c}") == ["a{b}", "c"] and S.commands("\\draw (a;b) {x;y}; \\node;") == ["\\draw (a;b) {x;y};", "\\node;"]
    assert S.macros("\\newcommand{\\x}[1]{a#1} \\tikzset{open") == ["\\newcommand{\\x}[1]{a#1}"]
    tex = "\\begin{figure}\\includegraphics[width=1]{a}%\\includegraphics{no}\n\\includegraphics{b.pdf}\\caption{Two {x}}\\label{f}\\end{figure}"
    assert S.latex_figures("t", tex) == [("t", 0, 0, 2, "a", "Two {x}", "f"), ("t", 0, 1, 2, "b.pdf", "Two {x}", "f")]
    nodes, edges = S.tikz_graph("\\node[draw] (a) at (0,0) {In \\textbf{put}}; \\node (b) {B}; \\node (a) {no}; \\draw[->] (a) -- (b); \\draw (a) -- (zz); \\draw (a);")
    assert nodes == {"a": "In put", "b": "B"} and edges == [("a", "b")]
    assert S.svg_graph("<svg xmlns='http://www.w3.org/2000/svg'><rect id='r'/><text>T <tspan>u</tspan></text><line/><path fill='none'/><path fill='red'/></svg>") == ({"r": "T u"}, 2)
    assert S.svg_graph("<svg") == ({}, 0)
    assert S.infoset("<a:x xmlns:a='u' c='1' b='2'/>") == S.infoset("<x xmlns='u' b='2' c='1'></x>")
    assert S.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and S.unescaped("&lt;&#233;") == "<é"
    assert S.flag_values(["--image", "a", "x", "--image=b"], "--image") == ["a", "b"]
    with pytest.raises(ValueError):
        S.flag_values(["--image", "--x"], "--image")


def test_tables(spark):
    slide = """<p:sld xmlns:p='p' xmlns:a='a'><p:cSld><p:spTree><p:grpSp><p:grpSpPr><a:xfrm><a:off x='100' y='0'/><a:ext cx='50' cy='50'/><a:chOff x='0' y='0'/><a:chExt cx='100' cy='100'/></a:xfrm></p:grpSpPr>
      <p:sp><p:nvSpPr><p:cNvPr name='n'/></p:nvSpPr><p:spPr><a:xfrm><a:off x='10' y='20'/><a:ext cx='40' cy='60'/></a:xfrm></p:spPr><p:txBody><a:t>hi</a:t></p:txBody></p:sp></p:grpSp><p:pic/></p:spTree></p:cSld></p:sld>"""
    feed = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://x/abs/2401.1v2</id><title>A\n b</title><author><name>N</name></author><category term='cs'/></entry></feed>"
    df = spark.createDataFrame([("s", slide), ("f", feed), ("n", None), ("bad", "<a")], "file string, text string")
    got = S.rows_of(df.filter("file <> 'f'"), "slide_shapes").collect()
    assert [(r.z, r.kind, r.name, r.x, r.y, r.w, r.h, r.text) for r in got] == [(0, "sp", "n", 105.0, 10.0, 20.0, 30.0, "hi"), (1, "pic", "", 0, 0, 0, 0, "")]
    r = S.rows_of(df.filter("file = 'f'"), "atom_papers").first()
    assert (r.id, r.title, r.authors, r.categories) == ("2401.1", "A b", ["N"], ["cs"])
    figures = spark.createDataFrame([("p", "./fig/a"), ("p", "b"), ("p", "c")], "folder string, path string")
    listing = spark.createDataFrame([("p", "fig/a.png"), ("p", "fig/a.pdf"), ("p", "x/b.png"), ("p", "1/c.png"), ("p", "2/c.png")], "folder string, file string")
    assert {r.path: r.resolved for r in S.resolved_graphics(figures, listing).collect()} == {"./fig/a": "fig/a.pdf", "b": "x/b.png", "c": None}


def test_images(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    s = M.similarity(a, a)
    assert all(abs(v - 1) < 1e-9 for v in s.values()) and M.similarity(a, 255 - a)["composite"] < 0.6
    assert M.delta(a, a) == {"changed": 0, "greatest": 0, "mean": 0.0}
    ramp = np.tile(np.arange(64, dtype=np.uint8)[None, ::-1, None] * 4, (32, 1, 3))
    assert M.difference_hash(ramp) == "ff" * 8 and M.difference_hash(ramp[:, ::-1]) == "00" * 8
    page = np.full((100, 200, 3), 255, np.uint8)
    page[40:50, 60:90], page[5, 5] = 0, 0
    assert M.shown(page, alone=True) == (56, 36, 94, 54) and M.shown(page)[0] < 6
    assert M.letterboxed(a).shape == (900, 1600, 3) and M.normalized(page, 50).shape == (25, 50, 3) and M.side_by_side(page, page).shape[2] == 3
    clear = np.zeros((2, 2, 4), np.uint8)
    assert (M.on_white(clear) == 255).all()
    rows = [(1, "RGB", 60, 40, a.tobytes()), (2, "RGB", 3, 3, b"x"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, mode string, width int, height int, pixels binary")
    assert {r.id: r.dhash for r in M.hashes(df).collect()} == {1: M.difference_hash(a), 2: None, 3: None}
    assert df.filter("id = 1").select(M.pixel_sha256(F.col("mode"), F.col("width"), F.col("height"), F.col("pixels")).alias("h")).first().h == M.digest("RGB", a)
    pictures = spark.createDataFrame([("d", "1"), ("d", "9"), ("e", "2"), ("e", "3"), ("f", "1")], "deck string, sha256 string")
    got = {r.deck: r for r in M.raster_gate(pictures, pictures.filter("deck = 'x'"), df.withColumn("sha256", F.col("id").cast("string")), a).collect()}
    assert got["d"].triggered and got["d"].unavailable == 1 and not got["e"].triggered and got["e"].undecodable == 2
    c = M.calibrated(spark.createDataFrame([(True, 0.95), (False, 0.5)], "is_copy boolean, score double")).first()
    assert abs(c.threshold - 0.725) < 1e-9
    v = spark.sql("SELECT array(3f, 4f) AS a, array(4f, 3f) AS b, array(0f, 0f) AS z")
    assert v.select(M.clip_score(M.cosine(F.col("a"), F.col("b"))).alias("x")).first().x == 96.0
    with pytest.raises(PySparkException, match="zero vector"):
        v.select(M.cosine(F.col("a"), F.col("z"))).collect()
    blocks = spark.createDataFrame([("h", "RGBA", 4, 4, 2), ("h", "RGBA", 4, 4, 1), ("o", "RGBA", 4, 4, 0)], "pixel_sha256 string, mode string, width int, height int, block int")
    assert M.first_equal_block(blocks.filter("block = 2").drop("block"), blocks).first().block == 1


def test_matched_texts(spark):
    rows = [(1, "reference", 0, "one two three", 0.0, 0.0), (1, "candidate", 0, "one two three", 0.0, 0.0), (2, "reference", 0, "abc", 0.0, 0.0), (3, "candidate", 0, "x", 0.0, 0.0), (1, "reference", 1, "zzz", 0.9, 0.9)]
    df = spark.createDataFrame(rows, "pair long, side string, position int, text string, x double, y double")
    assert {r.pair: r.score for r in R.matched_texts(df, "pair").collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    # words in lower case; nearness ends at .35 of the diagonal; a text ratio below .25 doesn't fit, however near
    far = [(1, "reference", 0, "One, two!", 0.0, 0.0), (1, "candidate", 0, "one two", 0.0, 1.0), (2, "reference", 0, "abcdefgh", 0.5, 0.5), (2, "candidate", 0, "hxyzuvwq", 0.5, 0.5)]
    df = spark.createDataFrame(far, "pair long, side string, position int, text string, x double, y double")
    assert {r.pair: r.score for r in R.matched_texts(df, "pair").collect()} == {1: 0.72, 2: 0.0}


def test_rounds_are_enforced(spark):
    found = spark.createDataFrame([("t", "c", 1, "text", "k", "i", 0.1, 1.5, "medium")], "task_id string, candidate_id string, round int, dimension string, category string, issue_type string, affected_ratio double, base_points double, severity string")
    rounds = lambda n: spark.createDataFrame([("t", "c", i, False) for i in range(n)], "task_id string, candidate_id string, round int, gated boolean")
    assert C.merge_rounds(found, rounds(3)).count() == 1
    with pytest.raises(PySparkException, match="not 3 rounds"):
        C.merge_rounds(found, rounds(2)).collect()


def test_draws_equal_one_generator(spark):
    rng, want = np.random.default_rng(7), []
    for size in (3, 5):
        for i in range(4):
            want += [(size, i, d, int(p)) for d, p in enumerate(rng.integers(0, 9, size=size))]
    assert sorted(map(tuple, T.numpy_draws(spark, 9, [3, 5], 4, 7).collect())) == sorted(want)
    assert T.subsample(spark, list("abcdef"), 3, 1) == sorted(T.subsample(spark, list("abcdef"), 3, 1))
