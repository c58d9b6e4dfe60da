"""Scores that tie exactly are judged alike on every machine."""

import math

import numpy as np

from framecut.config import Histogram
from framecut.functions import image
from framecut.operators import decisions, scores

#: 8 x 8 gray pixels of which two low frequencies are the middle ones and equal, but for rounding.
TIED = [109, 151, 125, 85, 120, 138, 136, 87, 136, 137, 123, 133, 89, 124, 148, 147, 142, 102, 88, 102, 128, 81, 102, 122, 98, 108, 89, 122, 184, 115, 96, 144,
        129, 145, 130, 115, 142, 69, 134, 103, 50, 149, 143, 152, 74, 100, 142, 132, 128, 101, 111, 104, 107, 109, 113, 80, 126, 97, 167, 114, 94, 130, 96, 135]


def hash_in_order(luma, width, height, size, lowpass):
    """The hash by plain sums, as its definition goes."""
    n, small, out = size * lowpass, [], []
    for v in range(n):
        for u in range(n):
            total = count = 0.0
            for y in range(v * height // n, -(-(v + 1) * height // n)):
                for x in range(u * width // n, -(-(u + 1) * width // n)):
                    total, count = total + luma[y * width + x], count + 1
            small.append(total / count)
    top = max(1.0, *small)
    small = [x / top for x in small]
    for v in range(size):
        for u in range(size):
            total = 0.0
            for y in range(n):
                for x in range(n):
                    total += small[y * n + x] * math.cos(math.pi * (2 * x + 1) * u / (2 * n)) * math.cos(math.pi * (2 * y + 1) * v / (2 * n))
            total *= math.sqrt((1 if u == 0 else 2) / n) * math.sqrt((1 if v == 0 else 2) / n)
            out.append(0.0 if abs(total) < 1e-12 else total)
    return [x > float(np.median(out)) for x in out]


def test_tied_frequencies_are_summed_in_order():
    luma = [0.299 * v + 0.587 * v + 0.114 * v for v in TIED]
    want = hash_in_order(luma, 8, 8, 3, 2)
    assert "".join("01"[b] for b in want) == "100101100"
    assert image.hash_bits(np.array(luma).reshape(8, 8), 3, 2).tolist() == want
    rng = np.random.default_rng(5)
    for w, h in [(8, 8), (13, 7), (3, 5)]:
        for _ in range(20):
            luma = [float(x) for x in rng.integers(0, 4, w * h)]
            assert image.hash_bits(np.array(luma).reshape(h, w), 4, 2).tolist() == hash_in_order(luma, w, h, 4, 2)


def test_tied_correlation_is_a_boundary(spark):
    counts = ([0, 2, 2, 8, 11, 14, 16, 5, 5, 1, 0, 0, 0, 0, 0, 0], [0, 0, 2, 2, 10, 11, 16, 13, 4, 5, 1, 0, 0, 0, 0, 0])
    n, a, b = (16 * sum(x * y for x, y in zip(*p, strict=True)) - 64 * 64 for p in (counts, counts[:1] * 2, counts[1:] * 2))
    assert 400 * n * n == 289 * a * b  # the correlation is 0.85
    levels = [[16 * k + 8 for k, c in enumerate(one) for _ in range(c)] for one in counts]
    plain = spark.createDataFrame([(0, f, 8, 8, [(v, v, v) for v in one]) for f, one in enumerate(levels)], "video_id long, frame long, width int, height int, px array<struct<r:int,g:int,b:int>>")
    stored = spark.createDataFrame([(0, f, 8, 8, bytes(v for x in one for v in (x, x, x))) for f, one in enumerate(levels)], "video_id long, frame long, width int, height int, rgb binary")
    for frames in (plain, stored):
        found = scores.histogram_scores(frames, Histogram(threshold=0.15, bins=16))
        assert [r.hist_diff for r in found.orderBy("frame").collect()] == [0.0, 0.85]
        assert [r.frame for r in decisions.histogram_boundaries(found, 0.15, 1).collect()] == [1]
