"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import map_batches, table

#: Bytes in a window, numbers for a byte, filter widths, filters of each width; labelled rows and windows of each row
#: learned from at most; steps, windows in a step, rate; windows scored at once.
LENGTH, DEPTH, WIDTHS, FILTERS, SAMPLE, EACH, STEPS, BATCH, RATE, AT_ONCE = 192, 8, (2, 3, 4), 12, 1500, 4, 700, 64, 0.01, 256
NONE = "und"
LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes, length: int = LENGTH) -> np.ndarray:
    """The bytes in rows of `length`, the last one filled up with zeros."""
    out = np.zeros((max(1, -(-len(data) // length)), length), dtype=np.uint8)
    out.reshape(-1)[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


@dataclass
class Network:
    """Byte vectors, filters per width (width, DEPTH, FILTERS), their biases, the last layer, and the languages."""

    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    last: np.ndarray
    shift: np.ndarray
    languages: list[str]

    @staticmethod
    def new(languages: list[str], seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return Network(
            draw(256, DEPTH, by=0.5), [draw(w, DEPTH, FILTERS, by=1 / np.sqrt(w * DEPTH)) for w in WIDTHS], [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
            draw(len(WIDTHS) * FILTERS, len(languages), by=0.2), np.zeros(len(languages), dtype=np.float32), languages,
        )

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima of every filter over every window, and where they are."""
        e = self.vectors[x]
        values, places = [], []
        for w, filters, bias in zip(WIDTHS, self.filters, self.biases, strict=True):
            t = x.shape[1] - w + 1
            seen = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)[:, :t].transpose(0, 1, 3, 2).reshape(len(x) * t, w * DEPTH)
            out = (seen @ filters.reshape(w * DEPTH, FILTERS)).reshape(len(x), t, FILTERS)
            at = out.argmax(axis=1)
            places.append(at)
            values.append(np.maximum(np.take_along_axis(out, at[:, None], axis=1)[:, 0] + bias, 0))
        return np.concatenate(values, axis=1), places

    def tables(self) -> list[list[np.ndarray]]:
        """For inference: what each byte adds to each filter at each place of it."""
        return [[np.ascontiguousarray(self.vectors @ f[j]) for j in range(len(f))] for f in self.filters]

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        parts = []
        for own, bias in zip(tables, self.biases, strict=True):
            t = x.shape[1] - len(own) + 1
            out = own[0].take(x[:, :t], axis=0)
            for j in range(1, len(own)):
                out += own[j].take(x[:, j : j + t], axis=0)
            parts.append(np.maximum(out.max(axis=1) + bias, 0))
        z = np.concatenate(parts, axis=1) @ self.last + self.shift
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 4) -> None:
        """Adam on the log loss; each step cuts its windows at random, so that short texts are learned too."""
        rng, state = np.random.default_rng(seed), {}
        for k in range(STEPS):
            rows = rng.integers(0, len(x), BATCH)
            b, want = x[rows].copy(), y[rows]
            length = int(rng.choice([LENGTH, LENGTH, 64, 24, 12]))
            b = b[:, :length]
            pool, places = self.pooled(b)
            z = pool @ self.last + self.shift
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(BATCH), want] -= 1
            p /= BATCH
            grads = {"last": pool.T @ p, "shift": p.sum(axis=0), "vectors": np.zeros_like(self.vectors)}
            back = (p @ self.last.T) * (pool > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[f"bias{i}"] = g.sum(axis=0)
                own = np.zeros_like(self.filters[i])
                for j in range(w):
                    chars = np.take_along_axis(b, places[i] + j, axis=1)
                    own[j] = np.einsum("bfd,bf->df", self.vectors[chars], g)
                    np.add.at(grads["vectors"], chars, g[:, :, None] * self.filters[i][j].T[None])
                grads[f"filter{i}"] = own
            for name, g in grads.items():
                at = self.filters[int(name[6:])] if name.startswith("filter") else self.biases[int(name[4:])] if name.startswith("bias") else getattr(self, name)
                m, v = state.setdefault(name, (np.zeros_like(at), np.zeros_like(at)))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                at -= RATE * (1 - k / STEPS) * m / (1 - 0.9 ** (k + 1)) / (np.sqrt(v / (1 - 0.99 ** (k + 1))) + 1e-8)


def train(rows: list[tuple[str, str]]) -> Network | None:
    """From (text, language); None without rows that have a letter."""
    rows = [(t, y) for t, y in rows if t and y is not None and LETTER.search(t)]
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    out = Network.new(languages)
    if len(languages) > 1:
        parts = [(windows(t.encode("utf-8", "replace"))[:: max(1, -(-len(t) // LENGTH) // EACH)][:EACH], languages.index(y)) for t, y in rows]
        out.fit(np.concatenate([w for w, _ in parts]), np.concatenate([np.full(len(w), y) for w, y in parts]))
    return out


def held_out(key: str, folds: int = 4, fold: int = 2):
    return F.crc32(F.col(key).cast("string")) % folds == fold


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network | None:
    """A network of at most `sample` rows with a language, chosen by hash."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("__id"), F.col(lang).alias("__y"), F.col(text).alias("__t"))
    some = rows.select("__id").orderBy(F.xxhash64("__id"), "__id").limit(sample).distinct()
    got = rows.join(F.broadcast(some), "__id").collect()
    got.sort(key=lambda r: (r["__id"], r["__y"], r["__t"]))
    return train([(r["__t"], r["__y"]) for r in got])


def identify(docs: DataFrame, network: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score: the language with the greatest mean probability over all windows of the whole text.

    A null text, one without a letter, and any text without a network, is `und` with score 0.
    """
    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep], "lang_pred string, score double"])

    def make():
        tables = network.tables() if network else None

        def step(x: dict) -> dict:
            texts = x["__text"]
            lang, score = [NONE] * len(texts), [0.0] * len(texts)
            which = [i for i, t in enumerate(texts) if network and t and LETTER.search(t)]
            todo = [windows(texts[i].encode("utf-8", "replace")) for i in which]
            if todo:
                rows = np.concatenate(todo)
                p = np.concatenate([network.probabilities(rows[a : a + AT_ONCE], tables) for a in range(0, len(rows), AT_ONCE)])
                first = np.cumsum([0, *map(len, todo)])[:-1]
                mean = np.add.reduceat(p, first, axis=0) / np.array([len(w) for w in todo])[:, None]
                for i, m in zip(which, mean, strict=True):
                    lang[i], score[i] = network.languages[int(m.argmax())], float(min(1.0, m.max()))
            return {**{k: x[k] for k in keep}, "lang_pred": lang, "score": score}

        return step

    return map_batches(docs.select(*keep, F.col(text).alias("__text")), make, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: the predicted language of every document; rows whose crc32(doc_id) mod 4 is 2 teach nothing."""
    docs = table(spark, sf_dir, "documents")
    network = learned(docs.filter(~held_out("doc_id")))
    return identify(docs, network, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
