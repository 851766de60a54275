"""Page images as binary columns of 8-bit pixels with height and width: numpy kernels over Arrow batches.

Images are rows, so memory is bounded by an Arrow batch of them; statistics that are plain sums (histograms) can also be
taken in SQL.  Models (text recognition, layout) are plug-ins: see registry.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPRIGHT = 0.6
# Magic bytes of image formats.
MAGIC = [("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "474946383761"), ("gif", "474946383961"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A")]


def sniff(content: Column) -> Column:
    """The format of the first bytes, or null; under 16 bytes nothing is recognized."""
    out = F.when((F.substring(content, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250"))), "webp")
    for name, magic in MAGIC:
        out = out.when(F.substring(content, 1, len(magic) // 2) == F.unhex(F.lit(magic)), name)
    return F.when(F.length(content) >= 16, out)


def best_rotation(probes: DataFrame, page: str, upright: float = UPRIGHT) -> DataFrame:
    """(page, rotation): 0 if its confidence is high enough, else that of the best confidence, smaller turns first."""
    best = F.max_by("rotation", F.struct("conf", -F.col("rotation")))
    return probes.groupBy(page).agg(F.when(F.max(F.when(F.col("rotation") == 0, F.col("conf"))) >= upright, 0).otherwise(best).alias("rotation"))


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest between-class variance; the first of equals."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    low, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    apart = mass * low[-1] - mass[-1] * low
    both = low * (low[-1] - low)
    return int(np.divide(apart * apart, both, out=np.zeros(256), where=both > 0).argmax())


def binarize(gray: np.ndarray, threshold: int | None = None) -> np.ndarray:
    """255 where a pixel is above the threshold (Otsu's if none is given), else 0."""
    return np.where(gray > (otsu(gray) if threshold is None else threshold), 255, 0).astype(np.uint8)


def window_sums(gray: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, sum of squares and count over a square window at every pixel, cut off at the edges."""
    g = gray.astype(np.float64)
    up = size // 2
    rows, cols = (np.clip(np.add.outer(np.arange(n), [-up, size - up]), 0, n) for n in g.shape)
    out = []
    for x in (g, g * g):
        c = np.zeros((g.shape[0] + 1, g.shape[1] + 1))
        c[1:, 1:] = x.cumsum(0).cumsum(1)
        out.append(c[rows[:, 1]][:, cols[:, 1]] - c[rows[:, 0]][:, cols[:, 1]] - c[rows[:, 1]][:, cols[:, 0]] + c[rows[:, 0]][:, cols[:, 0]])
    return out[0], out[1], np.outer(rows[:, 1] - rows[:, 0], cols[:, 1] - cols[:, 0])


def local_threshold(gray: np.ndarray, method: str = "sauvola", size: int = 25, k: float = 0.2, spread: float = 128.0, offset: float = 10.0) -> np.ndarray:
    """Binary image by a threshold at each pixel: 'sauvola', 'niblack' or 'mean'."""
    s, q, n = window_sums(gray, size)
    mean = s / n
    dev = np.sqrt(np.maximum(q / n - mean * mean, 0))
    level = {"sauvola": lambda: mean * (1 + k * (dev / spread - 1)), "niblack": lambda: mean - k * dev, "mean": lambda: mean - offset}[method]()
    return np.where(gray > level, 255, 0).astype(np.uint8)


def ink_edges(binary: np.ndarray, count: int = 1, band: int = 1) -> tuple[int, int, int, int]:
    """First and last column and row whose ink over a band reaches count pixels: left, top, right, bottom; all of the image
    if there is none."""
    ink = (binary == 0).astype(np.int64)

    def ends(profile: np.ndarray) -> tuple[int, int]:
        full = np.flatnonzero(np.convolve(profile, np.ones(band, dtype=np.int64), "same") >= count)
        return (int(full[0]), int(full[-1]) + 1) if len(full) else (0, len(profile))

    (left, right), (top, bottom) = ends(ink.sum(axis=0)), ends(ink.sum(axis=1))
    return left, top, right, bottom


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels 1..n of the 8-connected parts of a mask, by least labels over whole rows and columns until nothing moves."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        pad = np.pad(label, 1)
        h, w = mask.shape
        near = np.stack([pad[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        near = np.where(near == 0, mask.size + 1, near).min(axis=0)
        now = np.where(mask, np.minimum(label, near), 0)
        flat = now.ravel()
        hop = np.where(flat > 0, flat[np.maximum(flat, 1) - 1], 0).reshape(mask.shape)
        now = np.where(mask, np.minimum(now, hop), 0)
        if (now == label).all():
            names, out = np.unique(label, return_inverse=True)
            out = out.reshape(mask.shape) + (0 if names[0] == 0 else 1)
            return out, int(out.max())
        label = now


def denoise(binary: np.ndarray, least_area: int = 6) -> np.ndarray:
    """Without ink parts of fewer pixels."""
    label, n = components(binary == 0)
    small = np.bincount(label.ravel(), minlength=n + 1) < least_area
    small[0] = False
    return np.where(small[label], 255, binary).astype(np.uint8)


def skew(binary: np.ndarray, part: float = 0.3) -> float:
    """Degrees between the first ink columns of the top and the bottom of a page; 0 without ink there."""
    ink = binary == 0
    n = max(1, int(ink.shape[0] * part))
    ends = [np.flatnonzero(x.any(axis=0)) for x in (ink[:n], ink[-n:])]
    if not all(map(len, ends)):
        return 0.0
    return float(np.degrees(np.arctan2(ends[1][0] - ends[0][0], ink.shape[0] - n)))


def profile_skew(binary: np.ndarray, reach: float = 5.0, steps: int = 21) -> float:
    """The shear (degrees) at which the row profile varies most, by a coarse and a fine search."""
    y, x = np.nonzero(binary == 0)
    if not len(y):
        return 0.0

    def score(degrees: float) -> float:
        rows = np.round(y - x * np.tan(np.radians(degrees))).astype(int)
        return float(np.bincount(rows - rows.min()).var())

    best = max(np.linspace(-reach, reach, steps), key=score)
    fine = reach / (steps - 1) * 2
    return float(max(np.linspace(best - fine, best + fine, steps), key=score))


def morph(binary: np.ndarray, size: int = 3) -> np.ndarray:
    """Close, then open, with a square of odd size; outside counts as the edge."""

    def slide(a: np.ndarray, f: Callable) -> np.ndarray:
        pad = np.pad(a, size // 2, mode="edge")
        h, w = a.shape
        return f.reduce([pad[i : i + h, j : j + w] for i in range(size) for j in range(size)])

    out = binary
    for f in (np.maximum, np.minimum, np.minimum, np.maximum):
        out = slide(out, f)
    return out


def luma(rgb: np.ndarray) -> np.ndarray:
    return np.clip(np.round(rgb[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])), 0, 255).astype(np.uint8)


def page_attributes(rgb: np.ndarray) -> dict[str, bool]:
    """Blank (light all over), colour plate (over 5 % of pixels with a spread over 30), centred (ink in under half the width)."""
    gray = luma(rgb) if rgb.ndim == 3 else rgb
    spread = rgb.max(axis=-1).astype(int) - rgb.min(axis=-1) if rgb.ndim == 3 else np.zeros_like(gray, dtype=int)
    left, _, right, _ = ink_edges(binarize(gray))
    blank = bool(gray.mean() >= 245)
    return {"blank": blank, "plate": bool((spread > 30).mean() > 0.05), "centred": not blank and (right - left) < 0.5 * gray.shape[1]}


def invert(image: np.ndarray) -> np.ndarray:
    return 255 - image


def pad(image: np.ndarray, top: int, bottom: int, left: int, right: int, value: int = 255) -> np.ndarray:
    return np.pad(image, [(top, bottom), (left, right)] + [(0, 0)] * (image.ndim - 2), constant_values=value)


def crop(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """The part of a rectangle that is in the image."""
    return image[max(0, top) : max(0, bottom), max(0, left) : max(0, right)]


def rescale(image: np.ndarray, short_side: int) -> np.ndarray:
    """Nearest pixels, so that the shorter side has a length."""
    h, w = image.shape[:2]
    k = short_side / min(h, w)
    rows, cols = (np.minimum((np.arange(round(n * k)) / k).astype(int), n - 1) for n in (h, w))
    return image[rows][:, cols]


def rotate90(image: np.ndarray, degrees: int) -> np.ndarray:
    return np.rot90(image, degrees // 90)


def split_columns(image: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    return image[:, :at], image[:, at:]


def split_rows(image: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    return image[:at], image[at:]


def ink_box(binary: np.ndarray, left: int, top: int, right: int, bottom: int) -> tuple[int, int, int, int]:
    """A box shrunk to its ink; unchanged without any."""
    part = crop(binary, left, top, right, bottom)
    if not (part == 0).any():
        return left, top, right, bottom
    a, b, c, d = ink_edges(part)
    return left + a, top + b, left + c, top + d


def zero_runs(binary: np.ndarray) -> list[tuple[int, int]]:
    """Column ranges between empty columns: where a word's image falls into characters."""
    full = np.concatenate([[0], (binary == 0).any(axis=0).astype(int), [0]])
    step = np.flatnonzero(np.diff(full))
    return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))


def gutter_side(gray: np.ndarray, strip: float = 0.06, darker: float = 12.0) -> str:
    """'left' or 'right' where an edge strip is darker than the page's middle, else 'unknown'."""
    n = max(1, int(gray.shape[1] * strip))
    middle = gray[:, n:-n].mean() if gray.shape[1] > 2 * n else gray.mean()
    left, right = middle - gray[:, :n].mean(), middle - gray[:, -n:].mean()
    return "unknown" if max(left, right) < darker else "left" if left >= right else "right"


def affine(points: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Points moved by a 2 x 3 matrix."""
    return points @ matrix[:, :2].T + matrix[:, 2]


def inverse_affine(matrix: np.ndarray) -> np.ndarray:
    m = np.linalg.inv(matrix[:, :2])
    return np.hstack([m, -(m @ matrix[:, 2])[:, None]])


def flatten(gray: np.ndarray, size: int = 31) -> np.ndarray:
    """Uneven light taken out: each pixel over the mean of its neighbourhood."""
    s, _, n = window_sums(gray, size)
    return np.clip(np.round(gray / np.maximum(s / n, 1) * 255), 0, 255).astype(np.uint8)


def stretch(gray: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """The range between two percentiles spread over all levels."""
    a, b = np.percentile(gray, [low, high])
    return np.clip(np.round((gray - a) / max(b - a, 1) * 255), 0, 255).astype(np.uint8)


def equalize(gray: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Histograms equalized by tile with limited contrast, tiles blended bilinearly."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            n = np.bincount(part.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * part.size / 256)
            over = np.maximum(n - top, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(n, top) + over / 256) * 255 / part.size
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], gray]
    out = (1 - ay) * ((1 - ax) * at(y0, x0) + ax * at(y0, x1)) + ay * ((1 - ax) * at(y1, x0) + ax * at(y1, x1))
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def best_channel(rgb: np.ndarray) -> np.ndarray:
    """The colour channel of greatest spread."""
    return rgb[..., int(rgb.reshape(-1, rgb.shape[-1]).astype(float).std(axis=0).argmax())]


def on_canvas(image: np.ndarray, height: int, width: int, value: int = 255) -> np.ndarray:
    """The image scaled to fit, in the middle of a canvas."""
    k = min(height / image.shape[0], width / image.shape[1])
    rows, cols = (np.minimum((np.arange(max(1, int(n * k))) / k).astype(int), n - 1) for n in image.shape[:2])
    part = image[rows][:, cols]
    top, left = (height - part.shape[0]) // 2, (width - part.shape[1]) // 2
    return pad(part, top, height - part.shape[0] - top, left, width - part.shape[1] - left, value)


def smooth(gray: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian filter, edges repeated."""
    n = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = gray.astype(float)
    for axis in (0, 1):
        padded = np.pad(out, [(n, n) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, padded)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def median_filter(gray: np.ndarray, size: int = 3) -> np.ndarray:
    padded = np.pad(gray, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3)).astype(np.uint8)


def boxes_of_parts(binary: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Left, top, right, bottom of each ink part."""
    label, n = components(binary == 0)
    y, x = np.nonzero(label)
    k = label[y, x] - 1
    out = np.array([np.full(n, binary.shape[1]), np.full(n, binary.shape[0]), np.zeros(n, int), np.zeros(n, int)])
    np.minimum.at(out[0], k, x)
    np.minimum.at(out[1], k, y)
    np.maximum.at(out[2], k, x + 1)
    np.maximum.at(out[3], k, y + 1)
    return [tuple(map(int, b)) for b in out.T]


def drop_small_parts(binary: np.ndarray, always: int = 10, share: tuple[float, float] = (0.04, 0.03), floor: int = 5, near: int = 20, ink: int = 10) -> np.ndarray:
    """Without ink parts whose sides are both under `always`, or that are small for the page with little ink around them."""
    h, w = binary.shape
    small_w, small_h = max(share[0] * w, floor), max(share[1] * h, floor)
    out = binary.copy()
    for a, b, c, d in boxes_of_parts(binary):
        around = (out[max(0, b - near) : d + near, max(0, a - near) : c + near] == 0).sum() - (out[b:d, a:c] == 0).sum()
        if (c - a < always and d - b < always) or (c - a < small_w and d - b < small_h and around < ink):
            out[b:d, a:c] = 255
    return out


def curvature(binary: np.ndarray, bands: int = 8) -> float:
    """How much the height of the ink's centre moves across the page, from 0 to 1 of a band's height."""
    parts = np.array_split(binary == 0, bands, axis=1)
    rows = np.arange(binary.shape[0])
    centres = [float((p.sum(axis=1) * rows).sum() / p.sum()) for p in parts if p.any()]
    return min(1.0, (max(centres) - min(centres)) * bands / binary.shape[0]) if centres else 0.0


def straighten(binary: np.ndarray, bands: int = 16) -> np.ndarray:
    """Columns shifted so that the ink's centre follows a level line; a quadratic is fitted to the bands' centres."""
    h, w = binary.shape
    edges = np.linspace(0, w, bands + 1).astype(int)
    rows = np.arange(h)
    at, centre = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        ink = (binary[:, a:b] == 0).sum(axis=1)
        if ink.sum():
            at.append((a + b) / 2)
            centre.append((ink * rows).sum() / ink.sum())
    if len(at) < 3:
        return binary
    fit = np.polyval(np.polyfit(at, centre, 2), np.arange(w))
    shift = np.round(fit - fit.mean()).astype(int)
    source = rows[:, None] + shift[None, :]
    inside = (source >= 0) & (source < h)
    return np.where(inside, binary[np.clip(source, 0, h - 1), np.arange(w)[None, :]], 255).astype(np.uint8)


def correct(gray: np.ndarray, curved: float = 0.1) -> dict:
    """Side, curvature, skew and the corrected binary page: straightened if curved, then sheared level."""
    binary = binarize(gray)
    bend = curvature(binary)
    if bend > curved:
        binary = straighten(binary)
    turn = profile_skew(binary)
    shift = np.round(np.arange(binary.shape[1]) * np.tan(np.radians(turn))).astype(int)
    source = np.arange(binary.shape[0])[:, None] + shift[None, :]
    level = np.where((source >= 0) & (source < binary.shape[0]), binary[np.clip(source, 0, binary.shape[0] - 1), np.arange(binary.shape[1])[None, :]], 255)
    return {"side": gutter_side(gray), "curvature": bend, "skew": turn, "page": level.astype(np.uint8)}


def map_images(df: DataFrame, schema: str, kernel: Callable[[np.ndarray], dict], keys: list[str], pixels: str = "pixels", height: str = "height", width: str = "width", channels: str | None = None) -> DataFrame:
    """The keys and what the kernel gives for each image, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType([df.schema[k] for k in keys] + StructType.fromDDL(schema).fields)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, h, w, c in zip(batch.column(pixels).to_pylist(), batch.column(height).to_pylist(), batch.column(width).to_pylist(), batch.column(channels).to_pylist() if channels else [1] * batch.num_rows, strict=True):
                image = np.frombuffer(raw, dtype=np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                rows.append(kernel(image))
            columns = [batch.column(k) for k in keys] + [pa.array([r[f] for r in rows], type=arrow.field(f).type) for f in out.names[len(keys) :]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    picked = [*keys, pixels, height, width] + ([channels] if channels else [])
    return df.select(*picked).mapInArrow(run, out)
