"""Image features of binary RGB frames: numpy over Arrow batches, one frame at a time."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_image(rgb: bytes, width: int, height: int) -> np.ndarray:
    """height x width x 3 bytes; a buffer of another length is an error."""
    if len(rgb) != width * height * 3:
        raise ValueError(f"frame of {width}x{height} needs {width * height * 3} bytes, has {len(rgb)}")
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


#: Saturation and hue divided by value and by range, in fixed point with 12 fractional bits.
S_SCALE = np.rint(255 * 4096 / np.maximum(np.arange(256), 1)).astype(np.int32)
H_SCALE = np.rint(180 * 4096 / (6.0 * np.maximum(np.arange(256), 1))).astype(np.int32)


def planes(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """Red, green and blue as flat bytes."""
    return tuple(np.ascontiguousarray(image[..., k]).ravel() for k in range(3))


@lru_cache(maxsize=1)
def hsv_tables() -> tuple[np.ndarray, np.ndarray]:
    """Saturation at value << 8 | range, and hue at (turn + 256) << 8 | range; turn is the scaled place on the wheel."""
    d = np.arange(256)
    saturation = np.minimum((d * S_SCALE[:, None] + 2048) >> 12, 255)
    hue = (np.arange(-256, 5 * 256)[:, None] * H_SCALE[d] + 2048) >> 12
    hue = hue + 180 * (hue < 0) - 180 * (hue >= 180)
    # Turns that no range of that size allows are never looked up.
    return saturation.astype(np.uint8).ravel(), np.clip(hue, 0, 255).astype(np.uint8).ravel()


def hsv_planes(image: np.ndarray) -> np.ndarray:
    """3 x pixels bytes of hue (0 to 179), saturation and value."""
    saturation, hue = hsv_tables()
    r, g, b = planes(image)
    v = np.maximum(np.maximum(r, g), b)
    d = v - np.minimum(np.minimum(r, g), b)
    out = np.empty((3, v.size), np.uint8)
    out[2] = v
    # Of pixels without colour the range is 0, and so are both entries.
    np.take(saturation, (v.astype(np.uint16) << 8) | d, out=out[1], mode="clip")
    red, green = v == r, v == g
    r, g, b, wide = (x.astype(np.int16) for x in (r, g, b, d))
    turn = np.where(red, g - b, np.where(green, b - r + 2 * wide, r - g + 4 * wide))
    np.take(hue, ((turn + 256).astype(np.int32) << 8) | d, out=out[0], mode="clip")
    return out


def luma_plane(image: np.ndarray) -> np.ndarray:
    r, g, b = planes(image)
    return (0.299 * r + 0.587 * g + 0.114 * b).reshape(image.shape[:2])


def mean_luma(image: np.ndarray) -> float:
    """Mean luma out of whole sums; 0 without pixels."""
    if not image.size:
        return 0.0
    r, g, b = (int(p.sum(dtype=np.int64)) for p in planes(image))
    return (0.299 * r + 0.587 * g + 0.114 * b) / (image.size // 3)


def whole_counts(image: np.ndarray, bins: int) -> np.ndarray:
    """Numbers of pixels by luma bin."""
    bins = max(1, bins)
    which = np.clip((luma_plane(image).ravel() * bins / 256.0).astype(np.int64), 0, bins - 1)
    return np.bincount(which, minlength=bins)


def luma_counts(image: np.ndarray, bins: int) -> np.ndarray:
    """Counts of pixels by luma bin, divided by their Euclidean norm if that is above 0."""
    counts = whole_counts(image, bins).astype(np.float64)
    norm = np.sqrt((counts * counts).sum())
    return counts / norm if norm > 0 else counts


@lru_cache(maxsize=4)
def cells(height: int, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each of n x n cells' pixels row by row, one column a cell (filled up by height * width), and their numbers."""
    k = np.arange(n)
    y0, y1, x0, x1 = k * height // n, -(-(k + 1) * height // n), k * width // n, -(-(k + 1) * width // n)
    y, x = y0[:, None] + np.arange((y1 - y0).max()), x0[:, None] + np.arange((x1 - x0).max())
    inside = (y < y1[:, None])[:, None, :, None] & (x < x1[:, None])[None, :, None, :]
    places = np.where(inside, y[:, None, :, None] * width + x[None, :, None, :], height * width)
    return np.ascontiguousarray(places.reshape(n * n, -1).T), ((y1 - y0)[:, None] * (x1 - x0)[None, :]).ravel()


def box_resize(plane: np.ndarray, n: int) -> np.ndarray:
    """n x n means over source cells, summed pixel by pixel; cells overlap where n doesn't divide a side."""
    if not plane.size:
        return np.zeros((n, n))
    places, counts = cells(*plane.shape, n)
    # Running sums add in order; what is added beyond a cell is 0.
    return (np.append(plane.ravel(), 0.0)[places].cumsum(0)[-1] / counts).reshape(n, n)


@lru_cache(maxsize=8)
def dct_matrix(n: int, keep: int) -> np.ndarray:
    """The first keep rows of the orthonormal DCT-II of n points."""
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def dct_in_order(plane: np.ndarray, keep: int) -> np.ndarray:
    """The low frequencies summed pixel by pixel, so that equal ones round alike on every machine."""
    n = len(plane)
    basis = np.array([[math.cos(math.pi * (2 * x + 1) * k / (2 * n)) for k in range(keep)] for x in range(n)])
    scale = np.array([math.sqrt((1 if k == 0 else 2) / n) for k in range(keep)])
    out = np.zeros((keep, keep))
    for row, by in zip(plane, basis, strict=True):
        for value, bx in zip(row, basis, strict=True):
            out += (value * bx)[None, :] * by[:, None]
    out *= scale[:, None] * scale[None, :]
    out[np.abs(out) < 1e-12] = 0.0
    return out


def hash_bits(plane: np.ndarray, size: int, lowpass: int) -> np.ndarray:
    """size x size low frequencies of a luma plane, each compared with their median.

    Where one beside the middle lies so near the median that rounding decides, all are summed in order.
    """
    size, lowpass = max(1, size), max(1, lowpass)
    n = size * lowpass
    small = box_resize(plane, n)
    small = small / max(1.0, small.max())
    m = dct_matrix(n, size)
    low = m @ small @ m.T
    if np.count_nonzero(np.abs(low - np.median(low)) < 1e-12 * n * n) > size % 2:
        low = dct_in_order(small, size)
    return (low > np.median(low)).ravel()


#: tan(22.5 degrees) with 15 fractional bits.
TAN = 13573


def canny(value: np.ndarray) -> np.ndarray:
    """Edges of a byte plane: thresholds from the median, four directions, hysteresis over eight neighbours."""
    median = float(np.median(value))
    low, high = int(max(0.0, median * 2 / 3)), int(min(255.0, median * 4 / 3))
    p = np.pad(value.astype(np.int64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    ax, ay = np.abs(gx), np.abs(gy) << 15
    flat, steep = ay < ax * TAN, ay > ax * TAN + (ax << 16)
    left, right, up, down = q[1:-1, :-2], q[1:-1, 2:], q[:-2, 1:-1], q[2:, 1:-1]
    same = (gx ^ gy) >= 0
    d1 = np.where(same, q[:-2, :-2], q[:-2, 2:])
    d2 = np.where(same, q[2:, 2:], q[2:, :-2])
    peak = np.where(flat, (m > left) & (m >= right), np.where(steep, (m > up) & (m >= down), (m > d1) & (m > d2)))
    weak, edge = peak & (m > low), peak & (m > high)
    while True:
        near = np.pad(edge, 1)
        h, w = edge.shape
        grown = weak & np.any([near[y : y + h, x : x + w] for y in range(3) for x in range(3)], axis=0)
        if (grown == edge).all():
            return edge
        edge = grown


def edge_map(image: np.ndarray) -> np.ndarray:
    """Dilated edges (0 or 255) of an image's value channel."""
    edges = canny(image.max(axis=-1))
    h, w = edges.shape
    k = 4 + int(np.rint(np.sqrt(w * h) / 192))
    k += k % 2 == 0
    p = np.pad(edges, k // 2)
    rows = np.any([p[y : y + h] for y in range(k)], axis=0)
    return np.any([rows[:, x : x + w] for x in range(k)], axis=0).astype(np.uint8) * 255


def similarity_hash(image: np.ndarray) -> int:
    """64-bit hash of 8 x 8 low frequencies (without the first) of 32 x 32 integer luma samples."""
    h, w = image.shape[:2]
    y, x = (np.minimum((2 * np.arange(32) + 1) * n // 64, n - 1) for n in (h, w))
    s = image[np.ix_(y, x)].astype(np.int64)
    gray = (77 * s[..., 0] + 150 * s[..., 1] + 29 * s[..., 2] + 128) >> 8
    m = dct_matrix(32, 8)
    low = np.round((m @ gray @ m.T).ravel(), 6)  # what should be 0 is
    bits = low > np.median(low[1:])
    return int(np.packbits(bits).view(">i8")[0])


def _each(function, *columns) -> pd.Series:
    return pd.Series([function(as_image(*row)) for row in zip(*columns, strict=True)])


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _phash(rgb: pd.Series, width: pd.Series, height: pd.Series, size: pd.Series, lowpass: pd.Series) -> pd.Series:
    return pd.Series([hash_bits(luma_plane(as_image(*row[:3])), *row[3:]).tolist() for row in zip(rgb, width, height, size, lowpass, strict=True)])


def phash(rgb, width, height, size: int = 16, lowpass: int = 2):
    """Perceptual hash of a binary RGB frame as size * size booleans."""
    return _phash(rgb, width, height, F.lit(size), F.lit(lowpass))


@F.pandas_udf(T.BinaryType())
def edges(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Edge map of a binary RGB frame, one byte a pixel."""
    return _each(lambda i: edge_map(i).tobytes(), rgb, width, height)


@F.pandas_udf(T.LongType())
def fingerprint(rgb: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """64-bit similarity hash of a binary RGB frame."""
    return _each(similarity_hash, rgb, width, height)


@F.pandas_udf(T.LongType())
def differing_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Places at which two byte strings of one length differ; null if a length differs or one is null."""
    both = lambda x, y: x is not None and y is not None and len(x) == len(y)
    return pd.Series([int((np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8)).sum()) if both(x, y) else None for x, y in zip(a, b, strict=True)], dtype="Int64")


def register(spark) -> None:
    """Makes the image functions callable from SQL."""
    spark.udf.register("phash", _phash)
    spark.udf.register("edge_map", edges)
    spark.udf.register("fingerprint", fingerprint)
