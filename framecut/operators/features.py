"""Features and scores of binary frames of any size: numpy over Arrow batches, each frame read once.

``frame_features`` keeps a few numbers of each frame, of all detectors that are asked for.  ``image_content_scores``
compares frames where they lie: a task goes through its rows in the order they are stored and compares each frame with
the one before if that is its predecessor.  Such a stretch of neighbours is a run.  Only a run's first and last
image leave the task, so that a first one meets the last one of the run before; all other images are neither shuffled
nor written.  Rows in any order give the same scores; the less they are in order, the more runs there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Content
from ..functions import image as im
from ..sources.shared import cut, image_batches

SCORES = ["content_val", "delta_hue", "delta_saturation", "delta_luminance", "delta_edges"]
KEYS = ["video_id", "frame"]


def images(batch: pa.RecordBatch, prefix: str = ""):
    """The images of a batch, without a copy."""
    sizes = (batch.column(prefix + c).to_pylist() for c in ("width", "height"))
    for w, h, rgb in zip(*sizes, batch.column(prefix + "rgb"), strict=True):
        yield im.as_image(memoryview(rgb.as_buffer()), w, h)


def stored(frames: DataFrame, run, schema: str) -> DataFrame:
    """What run makes of the frames, written to the shared folder: no plan above reads an image again."""
    with image_batches(frames.sparkSession):
        return cut(frames.select(*KEYS, "width", "height", "rgb").mapInArrow(run, schema))


def frame_features(frames: DataFrame, luma: bool = False, bins: int | None = None, phash: tuple[int, int] | None = None, fingerprint: bool = False, counts: int | None = None) -> DataFrame:
    """video_id, frame and, as asked for, average_rgb, hist (of bins), counts (of so many bins), bits (of size, lowpass) and hash (64 bits)."""
    wanted = []
    if luma:
        wanted.append(("average_rgb", "double", pa.float64(), im.mean_luma))
    if bins is not None:
        wanted.append(("hist", "array<double>", pa.list_(pa.float64()), lambda i: im.luma_counts(i, bins)))
    if counts is not None:
        wanted.append(("counts", "array<long>", pa.list_(pa.int64()), lambda i: im.whole_counts(i, counts)))
    if phash:
        wanted.append(("bits", "array<boolean>", pa.list_(pa.bool_()), lambda i: im.hash_bits(im.luma_plane(i), *phash)))
    if fingerprint:
        wanted.append(("hash", "long", pa.int64(), im.similarity_hash))

    def run(batches):
        for b in batches:
            found = [[f(i) for _, _, _, f in wanted] for i in images(b)]
            columns = [pa.array([row[k] for row in found], kind) for k, (_, _, kind, _) in enumerate(wanted)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), *columns], [*KEYS, *(w[0] for w in wanted)])

    return stored(frames, run, ", ".join(["video_id long", "frame long", *(f"{w[0]} {w[1]}" for w in wanted)]))


class Comparer:
    """Scores of two images by the weights of a content detector."""

    def __init__(self, config: Content):
        self.weights = config.used_weights
        self.total = sum(map(abs, self.weights))

    def features(self, image: np.ndarray):
        return im.hsv_planes(image), im.edge_map(image) if self.weights[3] else None

    def scores(self, now, before) -> tuple[float, ...]:
        n = min(now[0].shape[1], before[0].shape[1])
        a, b = now[0][:, :n], before[0][:, :n]
        h, s, v = ((np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.uint64)).tolist()
        hue, sat, val, edge = self.weights
        e = 0.0
        if edge and now[1].shape == before[1].shape and now[1].size:
            e = float(255.0 * np.count_nonzero(now[1] != before[1]) / now[1].size)
        score = float(hue * h + sat * s + val * v + edge * e * n) / (n * self.total) if n and self.total else 0.0
        return score, h / max(n, 1), s / max(n, 1), v / max(n, 1), e


def score_columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(SCORES))]


def image_content_scores(frames: DataFrame, config: Content = Content(), step: int = 1) -> DataFrame:
    """video_id, frame, content_val and the delta_* components of binary frames; 0 for a video's first frame.

    step: the distance of neighbours' numbers, for streams that keep every step-th frame.  Other distances end a run.
    """
    compare = Comparer(config)
    names = [*KEYS, "first", "last", "width", "height", "rgb", *SCORES]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]

    def rows_out(rows) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, *score_columns([r[len(kinds)] for r in rows])], names)

    def run(batches):
        held = None
        for b in batches:
            out = []
            numbers = (b.column(c).to_pylist() for c in (*KEYS, "width", "height"))
            for video, frame, w, h, rgb, image in zip(*numbers, b.column("rgb"), images(b), strict=True):
                now = compare.features(image)
                follows = held is not None and held[0] == video and held[1] + step == frame
                if held is not None:
                    out.append(sent(held, not follows))
                held = (video, frame, not follows, w, h, rgb, compare.scores(now, held[-1]) if follows else (0.0,) * len(SCORES), now)
            yield rows_out(out)
        if held is not None:
            yield rows_out([sent(held, True)])

    def sent(held, last):
        video, frame, first, w, h, rgb, scores, _ = held
        return video, frame, first, last, w, h, rgb.as_py() if first or last else None, scores

    types = "video_id long, frame long, first boolean, last boolean, width int, height int, rgb binary"
    scored = ", ".join(f"{c} double" for c in SCORES)
    rows = stored(frames, run, f"{types}, {scored}")

    w = Window.partitionBy("video_id").orderBy("frame")
    ends = rows.where("first or last").select(*KEYS, "first", F.lag("frame").over(w).alias("before"), F.lag("last").over(w).alias("ended"))
    within = F.raise_error(F.lit("frames stand between neighbours of a run: step is not the distance of these frames")).cast("boolean")
    starts = ends.where(F.when(F.col("first") & ~F.col("ended"), within).otherwise(F.col("first"))).select(*KEYS, "before")
    whole = rows.where("rgb is not null").select(*KEYS, "width", "height", "rgb")
    earlier = whole.select("video_id", F.col("frame").alias("before"), *(F.col(c).alias(f"before_{c}") for c in ("width", "height", "rgb")))
    seams = starts.where("before is not null").join(whole, KEYS).join(earlier, ["video_id", "before"])

    def join_runs(batches):
        for b in batches:
            found = [compare.scores(compare.features(x), compare.features(y)) for x, y in zip(images(b), images(b, "before_"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEYS), *score_columns(found)], [*KEYS, *SCORES])

    joined = seams.mapInArrow(join_runs, f"video_id long, frame long, {scored}")
    alone = starts.where("before is null").select(*KEYS, *(F.lit(0.0).alias(c) for c in SCORES))
    return rows.where("not first").select(*KEYS, *SCORES).unionByName(joined).unionByName(alone)
