"""Operators on training data at the limits that round 3's review named."""

from __future__ import annotations

import gc
import random
import weakref

from marlstone.llm import jaccard, secrets


def test_a_short_set_in_a_tree_makes_no_long_ones_candidates():
    """Long sets that share a tenth aren't candidates of each other by bitmaps, though a short set lies in their tree."""
    rng = random.Random(3)
    shared = [f"s{rng.random()}" for _ in range(400)]
    long = [" ".join([*shared, *(f"{i} {rng.random()}" for _ in range(1800))]) for i in range(20)]
    texts = [*long, " ".join(shared[:60]), " ".join([*long[0].split()[:-90], *map(str, range(90))])]
    sets = [jaccard.Shingles()(t) for t in texts]
    ids = list(range(len(sets)))
    tree = jaccard.Tree([jaccard.bitmap(s) for s in sets])
    assert jaccard.linked(tree, tree, (ids, ids), jaccard.Groups()) == [(0, len(sets) - 1)]


def test_driver_keeps_no_maps_while_sets_are_connected(spark, monkeypatch):
    """The maps of common shingles are needed for postings alone; the long work on links goes without them."""
    held, seen, found, connected = [], [], jaccard.shared_shingles, jaccard.connected

    def shared(*a):
        out = found(*a)
        held.extend(weakref.ref(m) for m in out)
        return out

    def then(*a):
        seen.append([r() is None for r in held])
        return connected(*a)

    monkeypatch.setattr(jaccard, "shared_shingles", shared)
    monkeypatch.setattr(jaccard, "connected", then)
    words = " ".join(map(str, range(60)))
    rows = jaccard.near_duplicates(spark.createDataFrame([(1, words), (2, words + " more"), (3, "a b c d e f")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3} and seen == [[True, True]]


def test_driver_keeps_no_scanner():
    """Of the automaton the driver keeps the array that tasks get."""
    secrets.scanner_for.cache_clear()
    secrets.shipped.cache_clear()
    load = secrets.shipped(secrets.RULES)
    gc.collect()
    assert load and not any(isinstance(o, secrets.Scanner) for o in gc.get_objects())
