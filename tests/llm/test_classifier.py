"""The quality classifier: held-out labels of the given tables, its features counted plainly, odd rows and empty tables."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from marlstone.llm.common import table
from marlstone.llm.quality_classifier import AGAIN, bag, features, good_documents, learned, op8_quality_classifier, scored

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, score double, quality int"


def test_bag_counts_features():
    for text in ("to be or not not to be", "a a a", "x", "größe größe \ud800", "one\ttwo\n\nthree"):
        words = text.split()
        want = Counter(f for w in words for f in features(w))
        want[AGAIN] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        want = {k: v for k, v in want.items() if v}
        ids, share = bag(text, {})
        assert ids.tolist() == sorted(want)
        assert np.allclose(share, [want[k] / sum(want.values()) for k in sorted(want)])
    assert len(bag("", {})[0]) == len(bag(None, {})[0]) == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_labels(spark):
    got = op8_quality_classifier(spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in table(spark, SF, "documents").select("doc_id").collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").filter("quality IS NOT NULL").collect()}
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert len(good) and len(bad)
    assert ((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])).mean() >= 0.95


def test_odd_rows_and_ties(spark):
    docs = spark.createDataFrame(
        [(1, "good clear words", 9.0, 7), (2, "bad bad bad bad", 9.0, 7), (3, None, 9.0, 7), (4, "", None, None), (5, " \n", None, None), (1, "good clear words", 9.0, 7), (6, "bad " * 200_000, None, None)], DOCS
    )
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (9, 0), (5, None)], "doc_id bigint, quality int")
    model = learned(docs, labels)
    rows = scored(docs, model, ["doc_id"]).collect()
    assert len(rows) == 7
    score = {r["doc_id"]: r["score"] for r in rows}
    # of five labelled rows that have a document, 1 twice, three say 1
    assert score[3] == score[4] == score[5] == pytest.approx((3 + 1) / (5 + 2))
    assert score[1] > 0.5 > score[2] and score[6] < 0.5
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    kept = good_documents(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3, 4, 5]


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int")
    model = learned(docs, labels)
    assert model.empty == 0.5
    assert scored(docs, model, ["doc_id"]).count() == 0
    assert good_documents(docs, model).count() == 0
    one = spark.createDataFrame([(1, "some words", None, None)], DOCS)
    assert 0 <= scored(one, model, ["doc_id"]).first()["score"] <= 1
