"""Command line: detect scenes of frame tables or video files, render and inspect the results.

    python -m framecut detect content frames.parquet out --threshold 27
    python -m framecut detect-content clip.mp4 out --video
    python -m framecut render csv out/scenes --rate 24
    python -m framecut render stats out/stats --out out/stats-csv
    python -m framecut list-scenes out/scenes --rate 24
    python -m framecut inspect clip.framecut.json
"""

from __future__ import annotations

import argparse
import dataclasses
import json

from .config import DETECTORS, MERGE_LAST, SUPPRESS, Options, load

#: Detectors that commands call by another name as well.
SHORT = {"histogram": "hist"}


def add_detector(d: argparse.ArgumentParser, name: str) -> None:
    """Arguments of a detector, its own settings among them."""
    d.set_defaults(command="detect", detector=name)
    d.add_argument("frames", help="a table of frames, or with --video a file")
    d.add_argument("out")
    d.add_argument("--video", action="store_true", help="decode a video file by ffmpeg; frames and timing become tables in out, too")
    d.add_argument("--min-scene-len", type=int, default=15)
    d.add_argument("--merge-last-scene", action="store_true")
    d.add_argument("--stats", action="store_true", help="also write statistics and, for content and adaptive, the review")
    for f in dataclasses.fields(DETECTORS[name]):
        option = "--" + f.name.replace("_", "-")
        if f.name == "weights":
            d.add_argument(option, type=lambda t: tuple(map(float, t.split(","))))
        elif isinstance(f.default, bool):
            d.add_argument(option, action=argparse.BooleanOptionalAction, default=None)
        else:
            d.add_argument(option, type=type(f.default))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framecut")
    commands = p.add_subparsers(dest="command", required=True)
    detect = commands.add_parser("detect").add_subparsers(dest="detector", required=True)
    for name in DETECTORS:
        short = SHORT.get(name, name)
        for d in (detect.add_parser(name, aliases=[short] if short != name else []), commands.add_parser(f"detect-{short}")):
            add_detector(d, name)
    forms = commands.add_parser("render").add_subparsers(dest="form", required=True)
    scenes = {form: forms.add_parser(form) for form in ("csv", "json", "ndjson", "html")} | {"list-scenes": commands.add_parser("list-scenes"), "export-html": commands.add_parser("export-html")}
    for r in scenes.values():
        r.add_argument("scenes")
        r.add_argument("--rate", type=float, required=True)
        r.add_argument("--out")
    for r in (forms.add_parser("stats"), forms.add_parser("boundaries"), commands.add_parser("list-boundaries")):
        r.add_argument("rows")
        r.add_argument("--out", required=True)
    timeline = forms.add_parser("timeline")
    timeline.add_argument("rows")
    timeline.add_argument("--timing", required=True)
    timeline.add_argument("--out", required=True)
    commands.add_parser("inspect").add_argument("stats")
    return p


def decoded(spark, a):
    """The frames of a video file, decoded once into a table, and their times in another."""
    from .sources.media import open_videos, video_frames

    video_frames(open_videos(spark.createDataFrame([(a.frames,)], "path string"))).write.mode("overwrite").parquet(f"{a.out}/frames")
    frames = spark.read.parquet(f"{a.out}/frames")
    frames.select("video_id", "frame", "presentation_time", "duration").write.mode("overwrite").parquet(f"{a.out}/timing")
    return frames.drop("presentation_time", "duration")


#: Earlier names of rendering commands.
LEGACY = {"list-scenes": "csv", "export-html": "html", "list-boundaries": "boundaries"}


def write_rows(spark, a) -> None:
    """Statistics and review candidates as CSV files, timelines as JSON lines, a folder for each video."""
    from .operators.timeline import scene_timeline
    from .sinks import render

    rows = spark.read.parquet(a.rows)
    if a.form == "timeline":
        scene_timeline(rows, spark.read.parquet(a.timing)).write.mode("overwrite").partitionBy("video_id").json(a.out)
        return
    order = "frame"
    if a.form == "boundaries":
        sides = [c for c in ("before", "after") if c in rows.columns]
        rows, order = rows.select(*(c for c in rows.columns if c not in sides), *(rows[s][e].alias(f"{s}_{e}") for s in sides for e in ("start", "end"))), "rank"
    names = render.metric_names(rows)
    flat = render.metric_columns(rows, names)
    flat.repartitionByRange("video_id", order).sortWithinPartitions("video_id", order).write.mode("overwrite").partitionBy("video_id").option("header", True).csv(a.out)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command in LEGACY:
        a.form, a.command = LEGACY[a.command], "render"
    if a.command == "inspect":
        from .sinks.documents import summary

        print(json.dumps(summary(a.stats), indent=2))
        return
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    if a.command == "detect":
        from .api import boundary_review, detect, stats

        settings = {f.name: v for f in dataclasses.fields(DETECTORS[a.detector]) if (v := getattr(a, f.name)) is not None}
        config = load(a.detector, settings)
        if a.detector == "hash" and config.lowpass > config.size:
            raise SystemExit("lowpass is at most size")
        frames = decoded(spark, a) if a.video else spark.read.parquet(a.frames)
        options = Options(a.min_scene_len, MERGE_LAST if a.merge_last_scene else SUPPRESS)
        tables = detect(frames, config, options)._asdict()
        if a.stats:
            tables["stats"] = stats(frames, config, options)
        if a.stats and a.detector in ("content", "adaptive"):
            tables["review"] = boundary_review(frames, config, options)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
        return
    if a.form in ("stats", "boundaries", "timeline"):
        write_rows(spark, a)
        return
    from .sinks.render import documents

    scenes = spark.read.parquet(a.scenes)
    texts = documents(scenes, scenes.select("video_id").distinct().withColumn("frame_rate", F.lit(a.rate)), a.form)
    if a.out:
        texts.write.mode("overwrite").partitionBy("video_id").text(a.out)
    else:
        for r in texts.orderBy("video_id").toLocalIterator():
            print(r["text"], end="")


if __name__ == "__main__":
    main()
