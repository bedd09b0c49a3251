import math

import numpy as np
from pyspark.sql import functions as F

from galleon.functions import pixels as op
from galleon.functions import scalars as X


def picture(seed=0, h=60, w=80):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w] / max(h, w)
    waves = sum(r.uniform(20, 60) * np.sin(r.uniform(2, 14) * x + r.uniform(2, 14) * y + r.uniform(0, 6))[..., None] * r.uniform(0.5, 1, 3) for _ in range(6))
    return np.clip(waves + 120, 0, 255).astype(np.uint8)


def far(a, b):
    return [bin(int(a[i : i + 16], 16) ^ int(b[i : i + 16], 16)).count("1") for i in (0, 16, 32)]


def test_reduction_is_an_area_mean():
    x = np.random.default_rng(1).uniform(size=(12, 10))
    want = np.array([[x[i : i + 3, j : j + 5].mean() for j in (0, 5)] for i in range(0, 12, 3)])
    assert np.allclose(op.reduced(x, 4, 2), want)
    assert np.allclose(op.reduced(x, 5, 7).mean(), x.mean()) and np.allclose(op.reduced(x, 24, 20)[::2, ::2], x)


def test_frequencies_against_the_definition():
    x = picture(3)
    fine = op.reduced(op.grey(x), 32, 32)
    low = np.array([[sum(fine[i, j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)])
    low[0, 0] = 0
    bits = "".join("1" if b else "0" for b in (low > np.median(low)).ravel())
    assert op.perceptual_hash(x)[32:] == f"{int(bits, 2):016x}" and len(op.perceptual_hash(x)) == 48 and op.perceptual_hash(x[:0]) == ""


def test_copies_are_near_and_others_far(spark):
    x = picture(4, 120, 160)
    noisy = np.clip(x + np.random.default_rng(0).normal(0, 4, x.shape), 0, 255).astype(np.uint8)
    other = picture(9, 120, 160)
    small = np.round(op.reduced(x.astype(float), 60, 80)).astype(np.uint8)
    rows = [(1, x), (2, noisy), (3, small), (4, other)]
    df = spark.createDataFrame([(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in rows] + [(5, 3, 3, bytearray(b"xx")), (6, None, None, None)], "id long, width int, height int, pixels binary")
    out = {r.id: r for r in op.describe(df).collect()}
    assert out[5].phash is None and out[6].colours is None
    pairs = spark.createDataFrame([(out[1].phash, out[i].phash, i) for i in (2, 3, 4)], "a string, b string, i int")
    near = {r.i for r in pairs.where(X.near_duplicate(F.col("a"), F.col("b"))).collect()}
    assert near == {2, 3} and max(far(out[1].phash, out[4].phash)) > 10
    assert np.dot(out[1].colours, out[3].colours) > 0.98 > np.dot(out[1].colours, out[4].colours)
    assert len(out[1].colours) == 80 and abs(np.linalg.norm(out[1].colours) - 1) < 1e-9


def test_signals_order_images():
    x = op.grey(picture(5, 100, 100))
    r = np.random.default_rng(2)
    noisy = np.clip(x + r.normal(0, 6, x.shape), 0, 255)
    assert abs(op.noise_sigma(noisy) - 6) < 1.2 and op.noise_sigma(x) < 1
    stripes = np.tile(255.0 * ((np.arange(96) // 4) % 2), (96, 1))
    soft = np.tile(120 + 100 * np.sin(np.arange(96) / 15), (96, 1))
    assert op.signals(stripes)[0] > op.signals(soft)[0] > op.signals(np.full((50, 50), 120.0))[0] == 0
    assert op.signals(np.full((50, 50), 2.0))[1] < 0.1 and op.signals(np.full((50, 50), 255.0))[1] == 0 and op.signals(np.full((50, 50), 118.0))[1] == 1
    tiles = r.uniform(0, 255, (12, 12)).repeat(8, 0).repeat(8, 1)
    assert op.blockiness(tiles) > 100 and 0.5 < op.blockiness(r.uniform(0, 255, (96, 96))) < 2 and op.blockiness(x[:20]) == 1
    assert op.signals(np.zeros((1, 1)))[0] == 0


def test_hidden_regions():
    inside = op.covered([10, 10, 20, 20], None)
    assert inside(20, 20) and inside(20 + 16.9, 20) and not inside(20 + 17.1, 20) and not inside(35, 35)
    turned = op.covered([10, 10, 40, 10], [[20, 12], [30, 22]])
    assert turned(30 + 20, 15 + 20) and not turned(30 + 25, 15 - 20)
    assert op.covered([10, 10, 40, 10], [[20, 12], [20, 40]])(60, 15)
