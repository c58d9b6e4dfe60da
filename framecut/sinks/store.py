"""Statistics of many videos as a document of tables: rows, totals and facts of the sources in Parquet, settings in a header.

Each write has a folder of its own, and its header, a small JSON file put in place by a rename once all tables stand,
commits it.  Readers take the last header, so they see a whole write or the one before it, and never a failed one.
"""

from __future__ import annotations

import dataclasses
import json
import shlex
import uuid
from typing import NamedTuple

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load
from ..operators.spans import stored_spans
from .documents import VERSIONS
from .render import metric_names

KIND = "detection-stats-tables"


class StatsError(ValueError):
    """A document that is missing, of a wrong kind or version, or older than its sources."""


class Stored(NamedTuple):
    header: dict
    settings: object
    rows: DataFrame
    totals: DataFrame


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def recovery(path: str, detector: str = "content", source: str | None = None) -> str:
    """The command that writes a document anew."""
    return f"python -m framecut detect {detector} {shlex.quote(source) if source else 'FRAMES'} {shlex.quote(path)} --stats"


def source_facts(spark: SparkSession, source: str) -> DataFrame | None:
    """path, length, modificationTime of the files of a path, folder or pattern; contents aren't read.  None if there are none."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).select("path", "length", "modificationTime")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write(path: str, rows: DataFrame, totals: DataFrame, detector, options, frame_rate: float, source: str | None = None) -> str:
    """Writes rows (video_id, frame, score, threshold, decision, metrics) and totals (video_id, total); gives the header's path.

    source: files that the statistics are of; a reader refuses the document once one of them has changed.
    """
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/{folder}/rows")
    totals.write.parquet(f"{path}/{folder}/totals")
    facts = source_facts(spark, source) if source else None
    if facts is not None:
        facts.write.parquet(f"{path}/{folder}/sources")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}/rows")
    header = {"version": 1 if detector.name == "content" else 2, "kind": KIND, "folder": folder, "detector": detector.name, "config": dataclasses.asdict(detector), "options": dataclasses.asdict(options)}
    header |= {"frame_rate": frame_rate, "source": source, "sources": facts is not None, "metric_names": metric_names(written), "rows": written.count(), "schema": rows.schema.jsonValue()}
    system, root = _system(path)
    system.create_dir(f"{root}/headers", recursive=True)
    number = 1 + max((int(name[:10]) for name in _headers(system, root)), default=0)
    draft, final = f"{root}/headers/_{folder}", f"{root}/headers/{number:010d}-{folder}.json"
    with system.open_output_stream(draft, compression=None) as f:
        f.write(json.dumps(header, indent=2).encode())
    system.move(draft, final)
    return final


def _headers(system: fs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(f"{root}/headers", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json") and f.base_name[:10].isdigit())


def read_header(path: str) -> dict:
    """Settings and names of the last committed write; what is missing, malformed or of another kind is an error."""
    system, root = _system(path)
    names = _headers(system, root)
    if not names:
        raise StatsError(f"no statistics in {path}. Recovery: `{recovery(path)}`")
    with system.open_input_stream(f"{root}/headers/{names[-1]}") as f:
        text = f.read()
    try:
        header = json.loads(text)
    except ValueError:
        raise StatsError(f"statistics in {path} are malformed. Recovery: `{recovery(path)}`") from None
    if not isinstance(header, dict) or header.get("kind") != KIND or header.get("version") not in VERSIONS:
        raise StatsError(f"{path} holds no statistics of a known version. Recovery: `{recovery(path)}`")
    return header


def _check_sources(spark: SparkSession, path: str, header: dict) -> None:
    now = source_facts(spark, header["source"]) if header["sources"] else None
    if now is None:  # sources that are gone aren't stale
        return
    then = spark.read.parquet(f"{path}/{header['folder']}/sources")
    changed = then.alias("a").join(now.alias("b"), "path").where("a.length <> b.length or a.modificationTime <> b.modificationTime").select("path").first()
    if changed:
        raise StatsError(f"statistics in {path} are stale: {changed.path} has changed. Recovery: `{recovery(path, header['detector'], header['source'])}`")


def read(spark: SparkSession, path: str) -> Stored:
    """The last committed write, its detector loaded; stale sources are an error."""
    from pyspark.sql.types import StructType

    header = read_header(path)
    _check_sources(spark, path, header)
    table = lambda name: spark.read.parquet(f"{path}/{header['folder']}/{name}")
    rows = spark.read.schema(StructType.fromJson(header["schema"])).parquet(f"{path}/{header['folder']}/rows")
    return Stored(header, load(header["detector"], header["config"]), rows, table("totals"))


def scenes(stored: Stored) -> DataFrame:
    """The scenes that the accepted rows make."""
    return stored_spans(stored.rows, stored.totals)


def plain(rows: DataFrame) -> DataFrame:
    """video_id, frame, metrics: statistics without decisions."""
    return rows.select("video_id", "frame", "metrics")


def content_rows(stored: Stored) -> DataFrame:
    """Rows of a content detector; those of another are an error."""
    if stored.header["detector"] != "content":
        raise StatsError(f"these are {stored.header['detector']} statistics, not those of content")
    return stored.rows


def summary(spark: SparkSession, path: str) -> dict:
    """Detector, settings, provenance and numbers of videos, rows and boundaries."""
    stored = read(spark, path)
    count = stored.rows.where(F.col("decision") == "accepted").count()
    return {k: stored.header[k] for k in ("detector", "config", "source", "metric_names", "rows")} | {"videos": stored.totals.count(), "boundaries": count}
