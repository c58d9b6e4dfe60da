"""Sinks of frame statistics as Spark data sources, for batches and streams.

A ``StatsSink`` is the caller's: tasks call start, then row for every row, then finish, whose message goes to the driver;
there commit settles the messages of a batch, or abort undoes them.  ``JsonStats``, the format ``framestats``, writes
JSON lines.  Its commit lists the files of a batch in one manifest, named by the batch and put in place by a rename, and
``read_statistics`` reads only files that a manifest lists.  So rows of failed or repeated tasks are never seen, and a batch
that a restarted stream repeats counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage


class StatsSink:
    """What a sink has to offer; each task has one of its own, and the driver another."""

    def start(self) -> None:
        """Before a task's first row."""

    def row(self, row: dict) -> None:
        """Every row of the task."""
        raise NotImplementedError

    def finish(self):
        """After the last row; what it returns reaches commit."""

    def commit(self, messages: list, batch: int | None) -> None:
        """All tasks have finished; batch is null but in a stream, and may come a second time after a restart."""

    def abort(self, messages: list, batch: int | None) -> None:
        """A task has failed; messages of those that had finished."""


class JsonStats(StatsSink):
    """JSON lines in path/rows, manifests of the committed files in path/commits."""

    def __init__(self, options: dict):
        path = options["path"]
        self.system, self.path = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def __getstate__(self) -> dict:
        return {"system": self.system, "path": self.path}

    def start(self) -> None:
        self.system.create_dir(f"{self.path}/rows", recursive=True)
        self.name, self.n = f"{uuid.uuid4().hex}.json", 0
        self.out = self.system.open_output_stream(f"{self.path}/rows/{self.name}", compression=None)

    def row(self, row: dict) -> None:
        self.out.write(json.dumps(row).encode() + b"\n")
        self.n += 1

    def finish(self):
        self.out.close()
        return {"file": self.name, "rows": self.n}

    def commit(self, messages: list, batch: int | None) -> None:
        name = f"{self.path}/commits/{'once-' + uuid.uuid4().hex if batch is None else f'batch-{batch:010d}'}.json"
        if self.system.get_file_info(name).is_file:
            self.abort(messages, batch)  # the batch was committed before the stream stopped
            return
        self.system.create_dir(f"{self.path}/commits", recursive=True)
        draft = f"{self.path}/commits/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps({"batch": batch, "files": messages}).encode())
        self.system.move(draft, name)

    def abort(self, messages: list, batch: int | None) -> None:
        for m in messages:
            if m:
                self.system.delete_file(f"{self.path}/rows/{m['file']}")


class Message(WriterCommitMessage):
    def __init__(self, value):
        self.value = value


class _Tasks:
    """Writing and settling, the same for batches and streams."""

    def __init__(self, sink: StatsSink):
        self.sink = sink

    def write(self, iterator) -> Message:
        self.sink.start()
        for row in iterator:
            self.sink.row(row.asDict(recursive=True))
        return Message(self.sink.finish())


class BatchWriter(_Tasks, DataSourceWriter):
    def commit(self, messages) -> None:
        self.sink.commit([m.value for m in messages if m], None)

    def abort(self, messages) -> None:
        self.sink.abort([m.value for m in messages if m], None)


class StreamWriter(_Tasks, DataSourceStreamWriter):
    def commit(self, messages, batchId) -> None:
        self.sink.commit([m.value for m in messages if m], batchId)

    def abort(self, messages, batchId) -> None:
        self.sink.abort([m.value for m in messages if m], batchId)


def stats_format(name: str, make: Callable[[dict], StatsSink]) -> type[DataSource]:
    """A data source of that name, whose options make the sink."""

    class Statistics(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> BatchWriter:
            if overwrite:
                raise ValueError("statistics are appended")
            return BatchWriter(make(self.options))

        def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
            return StreamWriter(make(self.options))

    return Statistics


def register(spark: SparkSession, name: str = "framestats", make: Callable[[dict], StatsSink] = JsonStats) -> None:
    """Makes the format known to a session: JSON lines, or rows of the caller's own sink."""
    spark.dataSource.register(stats_format(name, make))


def read_statistics(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the committed files."""
    commits = spark.read.schema("files array<struct<file string, rows long>>").json(f"{path}/commits")
    files = commits.selectExpr("explode(files) AS f").where("f.rows > 0").select("f.file")
    rows = spark.read.schema(schema).json(f"{path}/rows").selectExpr("*", "_metadata.file_name AS file")
    return rows.join(files, "file", "left_semi").drop("file")
