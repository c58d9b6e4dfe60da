"""Small JSON documents beside the data: statistics headers, timelines, artifacts and manifests for reuse.

They hold settings and provenance; large rows stay in Parquet.
"""

from __future__ import annotations

import dataclasses
import json
import os
from pathlib import Path

from ..config import load

VERSIONS = range(1, 3)
SUFFIX = {"stats": ".framecut.json", "timeline": ".timeline.json", "scenes-csv": "-Scenes.csv", "scenes-json": "-Scenes.json", "scenes-ndjson": "-Scenes.ndjson", "scenes-html": "-Scenes.html", "boundaries": "-Boundaries.csv"}


def default_path(video: str, kind: str, folder: str | None = None) -> str:
    """Where a document of a video goes if nothing else is said."""
    p = Path(video)
    return str(Path(folder or p.parent) / (p.stem + SUFFIX[kind]))


def fnv64(data: bytes) -> str:
    """64-bit FNV-1a as 16 hex digits."""
    value = 0xCBF29CE484222325
    for b in data:
        value = (value ^ b) * 0x100000001B3 % 2**64
    return f"{value:016x}"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def key_of(request: dict) -> str:
    return fnv64(canonical(request).encode())


def fingerprint(path: str) -> dict | None:
    """Canonical path, size and time of change of a file; None if it is gone."""
    try:
        real = os.path.realpath(path)
        s = os.stat(real)
    except FileNotFoundError:
        return None
    return {"path": real, "bytes": s.st_size, "modified_ns": s.st_mtime_ns}


def _write(path: str, body: dict) -> str:
    temporary = f"{path}.part"
    Path(temporary).write_text(json.dumps(body, indent=2))
    os.replace(temporary, path)
    return path


def write_stats(path: str, detector, options, rows: list[dict], total: int, frame_rate: float, source: str | None = None) -> str:
    """A self-contained result: settings, provenance, rows."""
    return _write(path, {"version": 1 if detector.name == "content" else 2, "kind": "detection-stats", "detector": detector.name, "config": dataclasses.asdict(detector), "options": dataclasses.asdict(options), "frame_rate": frame_rate, "total_frames": total, "source": source and fingerprint(source), "rows": rows})


def read_stats(path: str) -> dict:
    """A statistics document with its detector loaded; wrong kinds and versions, and stale sources, are errors.

    A source that is gone is not stale.
    """
    body = json.loads(Path(path).read_text())
    if body.get("kind") != "detection-stats" or body.get("version") not in VERSIONS:
        raise ValueError(f"{path} is no statistics document of a known version")
    if source := body.get("source"):
        now = fingerprint(source["path"])
        if now and now != source:
            raise ValueError(f"{path} is stale: {source['path']} has changed")
    return body | {"settings": load(body["detector"], body["config"])}


def summary(path: str) -> dict:
    """Detector, settings, provenance and number of boundaries of a statistics document."""
    body = read_stats(path)
    return {k: body[k] for k in ("detector", "config", "source", "total_frames")} | {"boundaries": sum(r.get("decision") == "accepted" for r in body["rows"])}


def write_timeline(path: str, scenes: list[dict], stats_version: int, source: str | None = None) -> str:
    return _write(path, {"version": 1, "kind": "scene-timeline", "stats_version": stats_version, "source": source and fingerprint(source), "scenes": scenes})


def write_artifact(path: str, request: dict, table: str) -> str:
    """Says that table (a Parquet path) holds the scenes of request."""
    return _write(path, {"version": 1, "kind": "scene-list", "key": key_of(request), "request": request, "table": table})


def read_artifact(path: str, request: dict) -> str | None:
    """The table of the same request; None for a missing, broken or other document."""
    try:
        body = json.loads(Path(path).read_text())
    except (FileNotFoundError, ValueError):
        return None
    same = isinstance(body, dict) and (body.get("version"), body.get("kind"), body.get("request")) == (1, "scene-list", request)
    return body["table"] if same else None


def write_manifest(path: str, kind: str, output: str, request: dict) -> str:
    return _write(path, {"version": 1, "kind": "render", "render": kind, "output": fingerprint(output), "key": key_of(request), "request": request})


def reusable(path: str, kind: str, output: str, request: dict) -> bool:
    """Whether output is still what this request rendered."""
    try:
        body = json.loads(Path(path).read_text())
    except (FileNotFoundError, ValueError):
        return False
    want = {"version": 1, "kind": "render", "render": kind, "output": fingerprint(output), "key": key_of(request), "request": request}
    return body == want and want["output"] is not None


def same_review(saved: dict, current: dict) -> bool:
    """Whether a saved review belongs to the same file (size and time), settings and scenes."""
    return all(canonical(saved.get(k)) == canonical(current.get(k)) for k in ("bytes", "modified_ns", "settings", "scenes"))


def bundle(detection: dict, samples: list[dict], review: dict | None = None, exports: dict | None = None) -> dict:
    """All outputs of one session."""
    return {"detection": detection, "samples": samples, "review": review, "exports": exports or {}}


def review_session(source: str, settings: dict, actions: list[dict], scenes: list[dict]) -> dict:
    """A saved review: what same_review compares, and the decisions made so far."""
    now = fingerprint(source) or {}
    return {"bytes": now.get("bytes"), "modified_ns": now.get("modified_ns"), "settings": settings, "actions": sorted(actions, key=lambda a: (a["video_id"], a["frame"])), "scenes": scenes}
