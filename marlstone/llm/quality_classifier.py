"""Quality classifier: learned vectors of hashed words and character n-grams, averaged over a document, then a softmax."""

from __future__ import annotations

from array import array
from dataclasses import dataclass
from math import exp
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, map_batches, table

#: Hash buckets, width of a vector, character n-gram lengths; epochs, rate; labelled rows learned from at most;
#: words that a task remembers; score from which a document counts as good.
BUCKETS, WIDTH, GRAMS, EPOCHS, RATE, SAMPLE, REMEMBERED, GOOD = 1 << 16, 16, (3, 4), 6, 0.5, 3000, 200_000, 0.3
LEAST_STEPS = 4000
#: The feature of a word that repeats the one before it.
AGAIN = 0


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    """The word and its character n-grams between boundary marks, hashed."""
    marked = f"<{word}>"
    data = marked.encode("utf-8", "surrogatepass") if not marked.isascii() else None
    out = [crc32(data or marked.encode()) % buckets]
    for n in GRAMS:
        out += [crc32(marked[i : i + n].encode("utf-8", "surrogatepass")) % buckets for i in range(len(marked) - n + 1)]
    return out


@dataclass
class Model:
    """As softmax is linear in the averaged vector, a feature's vector acts by one number, its share of the log odds."""

    odds: np.ndarray
    bias: float
    empty: float

    def scorer(self):
        odds, bias, empty = self.odds.tolist(), self.bias, self.empty
        again = complex(odds[AGAIN], 1)

        class Words(dict):
            def __missing__(self, word: str) -> complex:
                if len(self) >= REMEMBERED:
                    self.clear()
                found = features(word)
                self[word] = value = complex(sum([odds[f] for f in found]), len(found))
                return value

        known = Words()

        def score(text: str | None) -> float:
            words = text.split() if text else []
            if not words:
                return empty
            total = sum(map(known.__getitem__, words)) + again * sum(map(eq, words, words[1:]))
            z = bias + total.real / total.imag
            return 1 / (1 + exp(-z)) if z > -700 else 0.0

        return score


def bag(text: str | None, known: dict[str, array]) -> tuple[np.ndarray, np.ndarray]:
    """The text's features and the share of each; arrays, as lists of numbers would take most of the driver's memory."""
    words = text.split() if text else []
    found = array("i", [AGAIN]) * sum(map(eq, words, words[1:]))
    for w in words:
        if w not in known:
            known[w] = array("i", features(w))
        found += known[w]
    ids, counts = np.unique(np.frombuffer(found, dtype=np.intc), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> Model:
    """Stochastic gradient descent on the log loss; without rows every score is 0.5, with one label that label's share."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), dtype=np.float32), np.array([np.log(1 - share), np.log(share)], dtype=np.float32)
    known: dict[str, array] = {}
    bags = [(b, int(y)) for t, y in zip(texts, labels, strict=True) if len((b := bag(t, known))[0])]
    known.clear()
    steps = max(EPOCHS * len(bags), LEAST_STEPS) if bags else 0
    for k in range(steps):
        if k % len(bags) == 0:
            order = rng.permutation(len(bags))
        (ids, weight), y = bags[order[k % len(bags)]]
        rate = RATE * (1 - k / steps)
        hidden = weight @ vectors[ids]
        z = out @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = p @ out
        out -= rate * np.outer(p, hidden)
        bias -= rate * 0.1 * p
        vectors[ids] -= (rate * 10) * weight[:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]), float(share))


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of at most `sample` labelled rows, chosen by hash; rows without label, key or document teach nothing."""
    spark = docs.sparkSession
    chosen = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__y").limit(sample).collect()
    some = spark.createDataFrame([tuple(r) for r in chosen], f"__id {docs.schema[key].dataType.simpleString()}, __y int")
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(some), "__id").collect()
    rows.sort(key=lambda r: (r["__id"], r["__y"], r["__t"] or ""))
    model = train([r["__t"] for r in rows], [r["__y"] for r in rows])
    del rows
    give_back()
    return model


def held_out(key: str, folds: int = 5):
    return F.crc32(F.col(key).cast("string")) % folds == 0


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and `score`, from the whole text alone; a null or empty text gets the share of label 1 learned."""
    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep], "score double"])

    def make():
        score = model.scorer()
        return lambda x: {**{k: x[k] for k in keep}, "score": [score(t) for t in x["__text"]]}

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), make, schema)


def good_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score is GOOD at least, with all their columns."""
    names = docs.columns

    def make():
        score = model.scorer()

        def step(x: dict) -> dict:
            good = [score(t) >= GOOD for t in x[text]]
            return {n: [v for v, ok in zip(x[n], good, strict=True) if ok] for n in names}

        return step

    return map_batches(docs, make, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: score and prediction of every document; labels teach only where crc32(doc_id) mod 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
