import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import images


def blank(h=40, w=30):
    return np.full((h, w), 255, dtype=np.uint8)


def test_otsu_separates_two_levels():
    x = blank()
    x[5:20, 5:20] = 40
    t = images.otsu(x)
    assert 40 <= t < 255
    assert (images.binarize(x) == np.where(x > 100, 255, 0)).all()
    assert images.otsu(np.full((4, 4), 7, np.uint8)) == 0


@pytest.mark.parametrize("method", ["sauvola", "niblack", "mean"])
def test_local_thresholds_equal_loops(method):
    x = np.random.default_rng(1).integers(0, 256, (12, 9)).astype(np.uint8)
    got = images.local_threshold(x, method, size=5)
    for i in range(12):
        for j in range(9):
            part = x[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].astype(float)
            m, s = part.mean(), part.std()
            level = {"sauvola": m * (1 + 0.2 * (s / 128 - 1)), "niblack": m - 0.2 * s, "mean": m - 10}[method]
            assert got[i, j] == (255 if x[i, j] > level + 1e-9 else 0) or abs(x[i, j] - level) < 1e-6


def test_components_equal_flood_fill():
    mask = np.random.default_rng(2).random((30, 25)) < 0.4
    label, n = images.components(mask)
    seen = np.zeros_like(mask, dtype=int)
    count = 0
    for i, j in zip(*np.nonzero(mask), strict=True):
        if not seen[i, j]:
            count += 1
            stack = [(i, j)]
            while stack:
                a, b = stack.pop()
                if 0 <= a < 30 and 0 <= b < 25 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    stack += [(a + p, b + q) for p in (-1, 0, 1) for q in (-1, 0, 1)]
    assert n == count and ((label > 0) == mask).all()
    assert len(set(zip(label[mask].tolist(), seen[mask].tolist(), strict=True))) == n
    assert images.components(np.zeros((3, 3), bool))[1] == 0


def test_denoise_drops_specks_only():
    x = blank()
    x[3, 3] = 0
    x[10:14, 10:14] = 0
    out = images.denoise(x)
    assert out[3, 3] == 255 and (out[10:14, 10:14] == 0).all()


def test_edges_boxes_and_runs():
    x = blank()
    x[10:20, 5:8] = x[10:20, 12:15] = 0
    assert images.ink_edges(x) == (5, 10, 15, 20)
    assert images.ink_edges(blank()) == (0, 0, 30, 40)
    assert images.ink_box(x, 0, 0, 10, 40) == (5, 10, 8, 20)
    assert images.zero_runs(x) == [(5, 8), (12, 15)]


def test_skew():
    x = blank(200, 100)
    for i in range(200):
        x[i, 20 + i // 20 : 60 + i // 20] = 0
    assert 1.5 < images.skew(x) < 4
    rows = blank(100, 200)
    for k in range(10, 90, 10):
        for j in range(200):
            rows[min(99, k + round(j * np.tan(np.radians(2)))), j] = 0
    assert abs(images.profile_skew(rows) - 2) < 0.3
    assert images.skew(blank()) == images.profile_skew(blank()) == 0


def test_shapes_and_attributes():
    x = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert images.pad(x, 1, 1, 2, 0).shape == (5, 6) and images.crop(x, -1, 1, 3, 9).shape == (2, 3)
    assert images.rescale(x, 6).shape == (6, 8) and images.rotate90(x, 90).shape == (4, 3)
    assert (images.invert(images.invert(x)) == x).all()
    plate = np.zeros((10, 10, 3), np.uint8)
    plate[..., 0] = 200
    assert images.page_attributes(plate)["plate"] and images.page_attributes(blank())["blank"]
    hole = blank()
    hole[5:15, 5:15] = 0
    hole[9, 9] = 255
    assert images.morph(255 - hole)[9, 9] == 255
    dark = blank(20, 50)
    dark[:, :3] = 100
    assert images.gutter_side(dark) == "left" and images.gutter_side(blank()) == "unknown"
    m = np.array([[2.0, 1, 3], [0, 1, -1]])
    p = np.random.default_rng(0).random((5, 2))
    assert np.allclose(images.affine(images.affine(p, m), images.inverse_affine(m)), p)


def test_formats_and_rotation(spark):
    rows = [(1, bytes.fromhex("89504E470D0A1A0A") + bytes(9)), (2, b"RIFF" + bytes(4) + b"WEBP" + bytes(9)), (3, bytes(20)), (4, b"\xff\xd8\xff")]
    got = {x[0]: x[1] for x in spark.createDataFrame(rows, "k int, c binary").select("k", images.sniff(F.col("c"))).collect()}
    assert got == {1: "png", 2: "webp", 3: None, 4: None}
    probes = spark.createDataFrame([(1, 0, 0.7), (1, 90, 0.9), (2, 0, 0.1), (2, 90, 0.4), (2, 180, 0.4)], "page int, rotation int, conf double")
    assert {x.page: x.rotation for x in images.best_rotation(probes, "page").collect()} == {1: 0, 2: 90}
