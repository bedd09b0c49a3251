"""Hashes, signals and colour vectors of decoded images, in Arrow batches.

Images come decoded: (key, width, height, pixels), the pixels as rows of bytes, blue, green
and red (three a pixel) or grey (one).  Decoding is the caller's; sizes are reduced by
plain area means here, so hashes agree among themselves, not with other resamplers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Weights of grey, sides, and the scales on which signals run from 0 to 1.
GREY = (0.114, 0.587, 0.299)
SIDE, CRISP, NOISE_LEVELS = 1024, 1500.0, 8.0
MIDDLE, CALM, SHADOW, LIGHT = 0.46, 0.18, 4, 251


def reduced(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of an image (rows, columns, ...) on a grid of ``height`` by ``width``."""
    for axis, n in ((0, height), (1, width)):
        size = x.shape[axis]
        edges = np.linspace(0, size, n + 1)
        sums = np.concatenate([np.zeros_like(x[:1] if axis == 0 else x[:, :1], float), np.cumsum(x, axis=axis, dtype=float)], axis=axis)
        low = np.floor(edges).astype(int)
        part = (edges - low).reshape([-1 if a == axis else 1 for a in range(x.ndim)])
        up = np.minimum(low + 1, size)
        at = np.take(sums, low, axis=axis) * (1 - part) + np.take(sums, up, axis=axis) * part
        x = np.diff(at, axis=axis) * n / size
    return x


def grey(x: np.ndarray) -> np.ndarray:
    return x.astype(float) if x.ndim == 2 else x @ np.array(GREY)


def _hex(bits: np.ndarray) -> str:
    return np.packbits(bits.ravel()).tobytes().hex()


def perceptual_hash(x: np.ndarray) -> str:
    """Average, difference and frequency hash of 16 hexadecimal digits each; empty for an empty image."""
    if not x.size:
        return ""
    g = grey(x)
    small, wide, fine = reduced(g, 8, 8), reduced(g, 8, 9), reduced(g, 32, 32)
    k = np.arange(32)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)  # the lowest frequencies
    low = cosine @ fine @ cosine.T
    low[0, 0] = 0
    return _hex(small > small.mean()) + _hex(wide[:, 1:] > wide[:, :-1]) + _hex(low > np.median(low))


def noise_sigma(g: np.ndarray) -> float:
    """Grey levels of noise by the second differences in both directions."""
    h, w = g.shape
    if h < 3 or w < 3:
        return 0.0
    second = np.diff(np.diff(g, 2, axis=0), 2, axis=1)
    return math.sqrt(math.pi / 2) * float(np.abs(second).sum()) / (6 * (w - 2) * (h - 2))


def signals(x: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness (noise taken off), exposure, noise (1: none) and blockiness (1: none) of an image."""
    g = grey(x)
    blocks = blockiness(g)
    if max(g.shape) * 0.98 > SIDE:
        scale = SIDE / max(g.shape)
        g = reduced(g, max(1, round(g.shape[0] * scale)), max(1, round(g.shape[1] * scale)))
    sigma = noise_sigma(g)
    edge = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplace = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * g
    spread = max(0.0, float(laplace.var()) - 20 * sigma * sigma)
    sharp = min(1.0, math.log1p(spread) / math.log1p(CRISP))
    away = max(0.0, abs(float(g.mean()) / 255 - MIDDLE) - CALM)
    dark, light = (g <= SHADOW).mean(), (g >= LIGHT).mean()
    exposed = 1 - 2 * away - 2.5 * max(0.0, dark - 0.02) - 3 * max(0.0, light - 0.01)
    return sharp, float(np.clip(exposed, 0, 1)), max(0.0, 1 - sigma / NOISE_LEVELS), blocks


def blockiness(g: np.ndarray) -> float:
    """Steps across the borders of 8 by 8 blocks over steps elsewhere."""
    g = g[:SIDE, :SIDE]
    if min(g.shape) < 32:
        return 1.0
    found = []
    for axis in (0, 1):
        step = np.abs(np.diff(g, axis=axis)).mean(axis=1 - axis)
        on = np.arange(len(step)) % 8 == 7
        found.append(step[on].mean() / (step[~on].mean() + 1e-6))
    return float(np.mean(found))


def colour_vector(x: np.ndarray) -> np.ndarray:
    """Unit vector of 80: roots of a 4 by 4 by 4 colour histogram, mean colours of the quarters, tone."""
    p = reduced(np.repeat(x[:, :, None], 3, axis=2) if x.ndim == 2 else x, 64, 64)[:, :, ::-1]  # red, green, blue
    cell = np.minimum(p // 64, 3).astype(int).reshape(-1, 3) @ np.array([16, 4, 1])
    share = np.sqrt(np.bincount(cell, minlength=64) / len(cell))
    quarters = p.reshape(2, 32, 2, 32, 3).mean(axis=(1, 3)).ravel() / 255
    tone = np.array([p.mean() / 255, p.std() / 128, *(p.mean(axis=(0, 1)) / 255)[:2]])
    v = np.concatenate([share, quarters / 2, tone / 2])
    return v / max(np.linalg.norm(v), 1e-12)


def covered(box: list[float], points: list[list[float]] | None, pad: float = 0.35) -> Callable[[float, float], bool]:
    """Whether a point lies in the ellipse that hides a face: its box and ``pad`` more on every side, turned as its eyes are."""
    x, y, w, h = box
    turn = 0.0
    if points is not None and len(points) >= 2:
        turn = math.atan2(points[1][1] - points[0][1], points[1][0] - points[0][0])
        turn = turn if abs(math.degrees(turn)) <= 60 else 0.0
    a, b = w / 2 * (1 + 2 * pad), h / 2 * (1 + 2 * pad)

    def inside(u: float, v: float) -> bool:
        dx, dy = u - x - w / 2, v - y - h / 2
        p, q = dx * math.cos(turn) + dy * math.sin(turn), dy * math.cos(turn) - dx * math.sin(turn)
        return (p / a) ** 2 + (q / b) ** 2 <= 1

    return inside


def _image(pixels: bytes | None, width: int | None, height: int | None) -> np.ndarray | None:
    x = np.frombuffer(pixels or b"", np.uint8)
    if not width or not height or len(x) not in (width * height, 3 * width * height):
        return None
    return x.reshape(height, width) if len(x) == width * height else x.reshape(height, width, 3)


def describe(images: DataFrame, key: str = "id") -> DataFrame:
    """(key, phash, sharpness, exposure, noise, blockiness, colours) of images; all null where the bytes do not fit the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, w, h in zip(b.column("pixels"), b.column("width"), b.column("height"), strict=True):
                x = _image(p.as_py(), w.as_py(), h.as_py())
                rows.append((None,) * 6 if x is None else (perceptual_hash(x), *signals(x), colour_vector(x).tolist()))
            kinds = (pa.string(), *[pa.float64()] * 4, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [key, "phash", "sharpness", "exposure", "noise", "blockiness", "colours"])

    rows = images.select(key, "width", "height", "pixels")
    return rows.mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, phash string, sharpness double, exposure double, noise double, blockiness double, colours array<double>")
