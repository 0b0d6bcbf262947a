"""Images as arrays: difference hash, similarity, crops, letterbox, deltas; columns of (mode, width, height, pixels).

Decoding files isn't done here: pixels are raw bytes, row by row, 1 (L), 3 (RGB) or 4 (RGBA) a pixel.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = {"L": 1, "RGB": 3, "RGBA": 4}


def array_of(mode: str, width: int, height: int, pixels: bytes) -> np.ndarray:
    n = CHANNELS[mode]
    if len(pixels) != width * height * n or not pixels:
        raise ValueError("pixels don't fit the size")
    return np.frombuffer(pixels, np.uint8).reshape(height, width, n)


def on_white(a: np.ndarray) -> np.ndarray:
    """RGB, what is transparent on white."""
    a = np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a
    if a.shape[2] == 4:
        alpha = a[..., 3:].astype(float) / 255
        a = np.rint(a[..., :3] * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return a


def luma(a: np.ndarray) -> np.ndarray:
    """Fixed weights of ITU-R 601."""
    return on_white(a) @ np.array([0.299, 0.587, 0.114])


def lanczos(n: int, to: int, lobes: int = 3) -> np.ndarray:
    """The matrix that resamples n numbers to `to`; its support widens when it shrinks."""
    scale = n / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    planes = a[..., None] if a.ndim == 2 else a
    out = np.einsum("ih,hwc,jw->ijc", lanczos(planes.shape[0], height), planes.astype(float), lanczos(planes.shape[1], width), optimize=True)
    out = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    return out[..., 0] if a.ndim == 2 else out


def normalized(a: np.ndarray, side: int = 1024) -> np.ndarray:
    a = on_white(a)
    h, w = a.shape[:2]
    k = min(1.0, side / max(h, w))
    return a if k == 1 else resized(a, max(1, round(w * k)), max(1, round(h * k)))


def letterboxed(a: np.ndarray, width: int = 1600, height: int = 900) -> np.ndarray:
    a = on_white(a)
    k = min(width / a.shape[1], height / a.shape[0])
    small = resized(a, max(1, round(a.shape[1] * k)), max(1, round(a.shape[0] * k)))
    out = np.full((height, width, 3), 255, np.uint8)
    top, left = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def difference_hash(a: np.ndarray, size: int = 8) -> str:
    """Bits, row by row, of whether a pixel of the small grey image is brighter than its right neighbour; hexadecimal."""
    g = resized(luma(a), size + 1, size).astype(int)
    return np.packbits(g[:, :-1] > g[:, 1:]).tobytes().hex()


def shown(a: np.ndarray, alone: bool = False, threshold: int = 10) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of what differs from the border's median, with a margin; without isolated pixels if `alone`."""
    a = on_white(a).astype(int)
    h, w = a.shape[:2]
    edge = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
    hit = np.abs(a - np.median(edge, axis=0)).max(axis=2) > threshold
    if alone:
        p = np.pad(hit, 1).astype(int)
        hit &= sum(p[1 + i : h + 1 + i, 1 + j : w + 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j) > 0
    ys, xs = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(ys):
        return 0, 0, w, h
    m = max(4, round(0.02 * max(w, h)))
    return max(0, int(xs[0]) - m), max(0, int(ys[0]) - m), min(w, int(xs[-1]) + 1 + m), min(h, int(ys[-1]) + 1 + m)


def block_ssim(a: np.ndarray, b: np.ndarray, side: int = 8) -> float:
    """Mean structural similarity over whole blocks of brightness, clipped to [0, 1]."""
    h, w = (a.shape[0] // side or 1) * side, (a.shape[1] // side or 1) * side
    x, y = (np.pad(luma(i), ((0, max(0, h - i.shape[0])), (0, max(0, w - i.shape[1]))), mode="edge")[:h, :w].reshape(h // side, side, w // side, side) for i in (a, b))
    mx, my = x.mean(axis=(1, 3)), y.mean(axis=(1, 3))
    vx, vy, xy = (x * x).mean(axis=(1, 3)) - mx**2, (y * y).mean(axis=(1, 3)) - my**2, (x * y).mean(axis=(1, 3)) - mx * my
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(np.clip(((2 * mx * my + c1) * (2 * xy + c2) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean(), 0, 1))


def edges(a: np.ndarray, threshold: int = 28) -> np.ndarray:
    g = luma(a)
    dx, dy = np.abs(np.diff(g, axis=1, append=g[:, -1:])), np.abs(np.diff(g, axis=0, append=g[-1:]))
    return np.maximum(dx, dy) >= threshold


def edge_f1(a: np.ndarray, b: np.ndarray) -> float:
    """F1 of edge pixels that have one of the other's within a pixel."""
    x, y = edges(a), edges(b)
    if not x.any() and not y.any():
        return 1.0
    near = lambda e: np.lib.stride_tricks.sliding_window_view(np.pad(e, 1), (3, 3)).any(axis=(2, 3))
    p, r = (x & near(y)).sum() / max(1, x.sum()), (y & near(x)).sum() / max(1, y.sum())
    return float(2 * p * r / max(p + r, 1e-9))


def similarity(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Pixel similarity, block similarity, edge F1 and their composite (0.60, 0.25, 0.15); b is brought to a's size."""
    a, b = on_white(a), on_white(b)
    b = b if a.shape == b.shape else resized(b, a.shape[1], a.shape[0])
    pixel = 1 - float(np.abs(a.astype(int) - b.astype(int)).mean()) / 255
    s, e = block_ssim(a, b), edge_f1(a, b)
    return {"pixel": pixel, "ssim": s, "edge": e, "composite": 0.60 * s + 0.25 * e + 0.15 * pixel}


def delta(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """Pixels that differ, greatest and mean difference of a channel; sizes must agree."""
    if a.shape != b.shape:
        raise ValueError("sizes differ")
    d = np.abs(a.astype(int) - b.astype(int))
    return {"changed": int(d.any(axis=2).sum()), "greatest": int(d.max()), "mean": float(d.mean())}


def side_by_side(a: np.ndarray, b: np.ndarray, gap: int = 16) -> np.ndarray:
    """Both images' shown parts next to each other on white."""
    parts = []
    for i in (on_white(a), on_white(b)):
        left, top, right, bottom = shown(i, alone=True)
        parts.append(i[top:bottom, left:right])
    h = max(p.shape[0] for p in parts)
    out = np.full((h, parts[0].shape[1] + gap + parts[1].shape[1], 3), 255, np.uint8)
    out[: parts[0].shape[0], : parts[0].shape[1]] = parts[0]
    out[: parts[1].shape[0], parts[0].shape[1] + gap :] = parts[1]
    return out


def pixel_sha256(mode: Column, width: Column, height: Column, pixels: Column) -> Column:
    """A hash of mode, size and raw pixels."""
    head = F.concat(mode.cast("binary"), F.lit(b"\0"), F.concat_ws("x", width, height).cast("binary"), F.lit(b"\0"))
    return F.sha2(F.concat(head, pixels), 256)


def hashes(images: DataFrame) -> DataFrame:
    """(id, dhash) of rows with id, mode, width, height, pixels; what isn't an image has none."""

    def run(batches):
        for b in batches:
            out = []
            for m, w, h, p in zip(*[b.column(i).to_pylist() for i in range(1, 5)], strict=True):
                try:
                    out.append(difference_hash(array_of(m, w, h, p or b"")))
                except (ValueError, KeyError, TypeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "dhash"])

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "mode", "width", "height", "pixels").mapInArrow(run, f"id {kind}, dhash string")


def raster_gate(pictures: DataFrame, approved: DataFrame, images: DataFrame, reference: np.ndarray, bound: float = 0.90) -> DataFrame:
    """Per deck: whether a picture that isn't approved is like the reference, and the reasons.

    pictures: deck, sha256; approved: sha256; images: sha256, mode, width, height, pixels. Each digest is compared once.
    """
    named = pictures.select("deck", "sha256").distinct().join(approved.select("sha256").distinct().withColumn("ok", F.lit(True)), "sha256", "left")
    needed = images.join(named.filter("ok IS NULL").select("sha256").distinct(), "sha256", "left_semi").dropDuplicates(["sha256"])

    def run(batches):
        for b in batches:
            score = []
            for m, w, h, p in zip(*[b.column(i).to_pylist() for i in range(1, 5)], strict=True):
                try:
                    score.append(similarity(reference, array_of(m, w, h, p or b""))["composite"])
                except (ValueError, KeyError, TypeError):
                    score.append(-1.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["sha256", "score"])

    scored = needed.select("sha256", "mode", "width", "height", "pixels").mapInArrow(run, "sha256 string, score double")
    out = named.join(scored, "sha256", "left")
    state = F.when(F.col("ok"), "approved").when(F.col("score").isNull(), "unavailable").when(F.col("score") < 0, "undecodable").otherwise("decoded")
    return out.withColumn("state", state).groupBy("deck").agg(
        F.coalesce(F.bool_or((F.col("state") == "decoded") & (F.col("score") >= bound)), F.lit(False)).alias("triggered"),
        F.max(F.when(F.col("state") == "decoded", F.col("score"))).alias("greatest"), *[F.count_if(F.col("state") == s).alias(s) for s in ("approved", "unavailable", "undecodable", "decoded")],
    )


def calibrated(scores: DataFrame) -> DataFrame:
    """One row from (is_copy, score): the least score of copies, the greatest of others, and the middle if they are apart."""
    low, high = F.min(F.when(F.col("is_copy"), F.col("score"))), F.max(F.when(~F.col("is_copy"), F.col("score")))
    return scores.agg(low.alias("least_copy"), high.alias("greatest_other")).withColumn("threshold", F.when(F.col("least_copy") > F.col("greatest_other"), (F.col("least_copy") + F.col("greatest_other")) / 2))


def first_equal_block(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each target with the first block of its pixel hash, mode and size."""
    best = blocks.groupBy("pixel_sha256", "mode", "width", "height").agg(F.min("block").alias("block"))
    return targets.join(best, ["pixel_sha256", "mode", "width", "height"], "left")


def clip_score(cosine: Column) -> Column:
    """A cosine as 0 to 100, four places."""
    return F.round(100 * F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)), 4)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; a length of zero is an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.when(size > 0, size).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))


def digest(mode: str, a: np.ndarray) -> str:
    """pixel_sha256 on the driver, for tests."""
    return hashlib.sha256(mode.encode() + b"\0" + f"{a.shape[1]}x{a.shape[0]}".encode() + b"\0" + a.tobytes()).hexdigest()
