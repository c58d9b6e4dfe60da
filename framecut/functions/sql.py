"""Functions for SQL users: image UDFs and a table function of scene spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import image


class SceneSpans:
    """scene_number, start, end of one video's sorted or unsorted boundaries and its number of frames."""

    def eval(self, boundaries, total):
        if not total:
            return
        starts = sorted({0, *(boundaries or ())})
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], total], strict=True), 1):
            yield k, a, b


def register(spark) -> None:
    """``phash``, ``edge_map``, ``fingerprint`` and ``scene_spans(boundaries, total)``."""
    image.register(spark)
    spark.udtf.register("scene_spans", F.udtf(SceneSpans, returnType="scene_number int, start long, end long"))
