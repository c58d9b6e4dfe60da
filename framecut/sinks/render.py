"""Renderers of scene lists, statistics and reviews.

Each renderer is a small function over one video's rows; ``documents`` runs one per video on the
executors and gives (video_id, text), to be written by any Spark writer.
"""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecode import clock

SCENE_HEADER = ["Scene Number", "Start Frame", "Start Timecode", "Start Time (seconds)", "End Frame", "End Timecode", "End Time (seconds)", "Length (frames)", "Length (timecode)", "Length (seconds)"]
REVIEW_HEADER = ["Rank", "Status", "Boundary Candidate Number", "Boundary Frame", "Boundary Frame Index", "Boundary Timecode", "Boundary Seconds", "Score Metric", "Boundary Score", "Detector Threshold", "Review Threshold", "Threshold Distance", "Before Start Frame", "Before End Frame", "After Start Frame", "After End Frame"]


def _csv(rows) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue()


def scene_facts(spans: list[dict], rate: float) -> list[dict]:
    """The ten exported fields of each scene: the first and the last frame count from 1."""
    out = []
    for k, s in enumerate(spans, 1):
        length = max(s["end"] - s["start"], 0)
        out.append({"scene_number": k} | {f"{name}_{unit}": value for name, f in (("start", s["start"]), ("end", s["end"]), ("length", length)) for unit, value in (("frame" if name != "length" else "frames", f + (name == "start")), ("timecode", clock(f, rate)), ("seconds", f / rate))})
    return out


def scenes_csv(spans: list[dict], rate: float) -> str:
    """A line of the cuts' timecodes, a header, and a line for each scene, whose start frame counts from 1."""
    facts = scene_facts(spans, rate)
    rows = [["Timecode List:", *(f["start_timecode"] for f in facts[1:])], SCENE_HEADER]
    for f in facts:
        rows.append([f["scene_number"], f["start_frame"], f["start_timecode"], f"{f['start_seconds']:.6f}", f["end_frame"], f["end_timecode"], f"{f['end_seconds']:.6f}", f["length_frames"], f["length_timecode"], f"{f['length_seconds']:.6f}"])
    return _csv(rows)


def scenes_json(spans: list[dict], rate: float) -> str:
    return json.dumps({"frame_rate": rate, "scene_count": len(spans), "scenes": scene_facts(spans, rate)}, indent=2)


def scenes_ndjson(spans: list[dict], rate: float) -> str:
    return "".join(json.dumps({"event": "scene"} | f, separators=(",", ":")) + "\n" for f in scene_facts(spans, rate))


def scenes_html(spans: list[dict], rate: float) -> str:
    """A page with one table."""
    cells = lambda tag, values: "".join(f"<{tag}>{v}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', [f'{v:.6f}' if isinstance(v, float) else v for v in facts.values()])}</tr>\n" for facts in scene_facts(spans, rate))
    head = cells("th", [h.replace("(", "").replace(")", "").title() for h in SCENE_HEADER])
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Scenes</title><style>td, th {{ text-align: right; padding: .3rem }}</style></head>\n<body><h1>Scenes</h1><p>{len(spans)} scenes at {rate:.6f} frames a second</p>\n<table><thead><tr>{head}</tr></thead><tbody>\n{body}</tbody></table></body></html>\n'


def stats_csv(rows: list[dict], names: list[str]) -> str:
    """Frame numbers from 0 and the named metrics; one that is missing is 0."""
    return _csv([["Frame Number", *names], *([r["frame"], *(f"{(r['metrics'] or {}).get(n, 0.0):.6f}" for n in names)] for r in rows)])


def review_csv(rows: list[dict], rate: float) -> str:
    """Candidates in rank order; metric columns in the order in which they first appear."""
    rows = sorted(rows, key=lambda r: r["rank"])
    names = list(dict.fromkeys(n for r in rows for n in sorted(r["metrics"] or {})))
    out = [REVIEW_HEADER + names]
    for r in rows:
        number = [f"{r[c]:.6f}" for c in ("score", "detector_threshold", "review_threshold", "threshold_distance")]
        scenes = [r["before"]["start"] + 1, r["before"]["end"], r["after"]["start"] + 1, r["after"]["end"]]
        out.append([r["rank"], r["status"], r["candidate_number"], r["frame"] + 1, r["frame"], clock(r["frame"], rate), f"{r['frame'] / rate:.6f}", r["score_metric"], *number, *scenes, *(f"{r['metrics'].get(n, 0.0):.6f}" for n in names)])
    return _csv(out)


def review_json(rows: list[dict], rate: float, detector: str = "content") -> str:
    """The review's settings and its candidates in rank order; first frames count from 1, boundary_frame_index from 0."""
    rows = sorted(rows, key=lambda r: r["rank"])
    common = ("score_metric", "detector_threshold", "review_threshold")
    around = lambda span: {"start_frame": span["start"] + 1, "end_frame": span["end"]}
    listed = [
        {"rank": k, "status": r["status"], "boundary_candidate_number": r["candidate_number"], "boundary_frame": r["frame"] + 1, "boundary_frame_index": r["frame"]}
        | {"boundary_timecode": clock(r["frame"], rate), "boundary_seconds": r["frame"] / rate, "score_metric": r["score_metric"], "boundary_score": r["score"]}
        | {c: r[c] for c in ("detector_threshold", "review_threshold", "threshold_distance")}
        | {"before": around(r["before"]), "after": around(r["after"]), "metrics": dict(sorted((r["metrics"] or {}).items()))}
        for k, r in enumerate(rows, 1)
    ]
    head = {"frame_rate": rate, "detector": detector, "sort": "threshold_distance"} | {c: rows[0][c] if rows else None for c in common}
    return json.dumps(head | {"candidate_count": len(rows), "boundary_candidates": listed}, indent=2)


RENDERERS = {"csv": scenes_csv, "json": scenes_json, "ndjson": scenes_ndjson, "html": scenes_html}


def documents(spans: DataFrame, videos: DataFrame, form: str) -> DataFrame:
    """video_id, text: each video's scene list as csv, json, ndjson or html; videos: video_id, frame_rate."""
    render = RENDERERS[form]
    rows = spans.join(videos.select("video_id", "frame_rate"), "video_id").groupBy("video_id").agg(F.first("frame_rate").alias("rate"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches):
        for b in batches:
            texts = [render(s, r) for s, r in zip(b.column("spans").to_pylist(), b.column("rate").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("video_id"), pa.array(texts, pa.string())], ["video_id", "text"])

    return rows.mapInArrow(run, "video_id long, text string")


def metric_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """Metrics maps as columns, in the given order; a missing one is 0."""
    return rows.select(*(c for c in rows.columns if c != "metrics"), *(F.coalesce(F.element_at("metrics", n), F.lit(0.0)).alias(n) for n in names))


def metric_names(rows: DataFrame) -> list[str]:
    """Names of the metrics in the order in which they first appear by frame; as many as there are metrics."""
    seen = rows.select("frame", F.posexplode(F.array_sort(F.map_keys("metrics"))).alias("k", "name")).groupBy("name").agg(F.min(F.struct("frame", "k")).alias("first"))
    return [r["name"] for r in seen.orderBy("first").collect()]


def write_stream_stats(stream: DataFrame, names: list[str], path: str, checkpoint: str):
    """Starts a streaming query that appends frame statistics as csv files."""
    return metric_columns(stream, names).writeStream.format("csv").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def shell_quote(words: list[str]) -> str:
    """A command line that a POSIX shell reads back as these words."""
    import shlex

    return shlex.join(words)
