"""Frame sources as Spark data sources, for batches and streams.

A ``FrameSource`` names clips, says how many whole frames each has by now, and reads a range of them.  ``register``
makes it a format for ``spark.read`` and ``spark.readStream``: a clip is cut into ranges of about SPLIT bytes (option
``split``), one a task, so one long file is read by many tasks, and no more than BATCH bytes of it stand in a task at a time.  ``RawFiles``, the
format ``rawframes``, reads files of raw rgb24 frames from any file system that Arrow knows:

    register(spark)
    spark.read.format("rawframes").option("width", 320).option("height", 180).load("hdfs://…/clips")

A batch refuses a file that ends within a frame.  A stream takes the whole frames that are there and waits for the rest;
its offset is the number of frames read of each clip.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "clip string, video_id long, frame long, width int, height int, rgb binary"
#: Bytes of frames that a task reads, and that it holds at a time.
SPLIT, BATCH = 32 << 20, 4 << 20


class FrameSource:
    """What a source of frames has to offer; it is sent to the tasks."""

    width: int
    height: int

    def clips(self, whole: bool) -> dict[str, int]:
        """The whole frames of each clip; where whole, a clip that ends within a frame is an error."""
        raise NotImplementedError

    def read(self, clip: str, first: int, count: int) -> bytes:
        """count frames of a clip, from first on, one after the other."""
        raise NotImplementedError


class RawFiles(FrameSource):
    """Files of raw rgb24 frames: a file, or all files of a folder whose names don't begin with a dot or underscore."""

    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        if self.width < 1 or self.height < 1:
            raise ValueError("width and height are one at least")

    def _files(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def clips(self, whole: bool) -> dict[str, int]:
        system, path = self._files()
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        listed = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        size = self.width * self.height * 3
        for f in listed:
            if whole and f.size % size:
                raise ValueError(f"truncated frame {f.size // size} of {f.path}: {f.size % size} of {size} bytes")
        return {f.path: f.size // size for f in listed}

    def read(self, clip: str, first: int, count: int) -> bytes:
        size = self.width * self.height * 3
        with self._files()[0].open_input_file(clip) as f:
            data = f.read_at(count * size, first * size)
        if len(data) < count * size:
            raise ValueError(f"{clip} has become shorter than {first + count} frames")
        return data


class Range(InputPartition):
    def __init__(self, clip: str, first: int, count: int):
        self.clip, self.first, self.count = clip, first, count


def video_of(clip: str) -> int:
    """A number for a clip: 63 bits of a hash of its last name, whatever else the source holds."""
    return int.from_bytes(hashlib.blake2b(clip.rsplit("/", 1)[-1].encode(), digest_size=8).digest(), "big") >> 1


def ranges(source: FrameSource, start: dict[str, int], end: dict[str, int], split: int) -> list[Range]:
    step = max(1, split // (source.width * source.height * 3))
    return [Range(c, k, min(step, end[c] - k)) for c in sorted(end) for k in range(start.get(c, 0), end[c], step)]


def batches(source: FrameSource, part: Range) -> Iterator[pa.RecordBatch]:
    size = source.width * source.height * 3
    step = max(1, BATCH // size)
    for first in range(part.first, part.first + part.count, step):
        n = min(step, part.first + part.count - first)
        ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * size)
        rgb = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(source.read(part.clip, first, n))])
        same = lambda value, kind: pa.array([value] * n, kind)  # noqa: E731, B023
        columns = [same(part.clip, pa.string()), same(video_of(part.clip), pa.int64()), pa.array(np.arange(first, first + n)), same(source.width, pa.int32()), same(source.height, pa.int32()), rgb]
        yield pa.RecordBatch.from_arrays(columns, ["clip", "video_id", "frame", "width", "height", "rgb"])


class FrameReader(DataSourceReader):
    def __init__(self, source: FrameSource, split: int):
        self.source, self.split = source, split

    def partitions(self) -> list[Range]:
        return ranges(self.source, {}, self.source.clips(whole=True), self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches(self.source, partition)


class FrameStream(DataSourceStreamReader):
    def __init__(self, source: FrameSource, split: int):
        self.source, self.split = source, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.source.clips(whole=False)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.source, start, end, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches(self.source, partition)


def frame_format(name: str, make: Callable[[dict], FrameSource]) -> type[DataSource]:
    """A data source of that name, whose options make the frame source."""

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> FrameReader:
            return FrameReader(make(self.options), int(self.options.get("split", SPLIT)))

        def streamReader(self, schema) -> FrameStream:
            return FrameStream(make(self.options), int(self.options.get("split", SPLIT)))

    return Frames


def register(spark: SparkSession, name: str = "rawframes", make: Callable[[dict], FrameSource] = RawFiles) -> None:
    """Makes the format known to a session: raw files, or frames of the caller's own source."""
    spark.dataSource.register(frame_format(name, make))
