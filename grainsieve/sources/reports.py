"""A data source of reports, `label_reports`: rows as JSON lines that a reader sees only once their job, or their micro-batch, is committed.

Tasks write part files under names that nobody lists. A commit adds a small manifest that names the job's parts; a
micro-batch's manifest has the batch's number, so one that runs again takes the first one's place. An aborted job's parts
are removed, and what a lost task leaves behind is in no manifest.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..runtime import ship

SCHEMA = "label_id string, confidence double, rejected boolean, report string"
PARTS, MANIFESTS = "_parts", "_committed"


def _files(path: str):
    """The file system of a folder, and the folder there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(options: dict) -> str:
    if not (path := options.get("path")):
        raise ValueError("label_reports needs a path")
    return path.rstrip("/").replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class _Writer:
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite

    def write(self, iterator: Iterator) -> Written:
        files, at = _files(self.path)
        files.create_dir(f"{at}/{PARTS}", recursive=True)
        part, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{at}/{PARTS}/{part}") as out:
            for row in iterator:
                out.write((json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False) + "\n").encode())
                rows += 1
        return Written(part, rows)

    def _told(self, name: str, messages: list) -> None:
        files, at = _files(self.path)
        files.create_dir(f"{at}/{MANIFESTS}", recursive=True)
        parts = [m.part for m in messages if m is not None and m.rows]
        with files.open_output_stream(f"{at}/{MANIFESTS}/_{name}") as out:
            out.write(json.dumps({"overwrite": self.overwrite, "parts": parts}).encode())
        files.move(f"{at}/{MANIFESTS}/_{name}", f"{at}/{MANIFESTS}/{name}")

    def _gone(self, messages: list) -> None:
        files, at = _files(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{at}/{PARTS}/{m.part}")


class Writer(_Writer, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._told(f"{time.time_ns():020d}-{uuid.uuid4().hex}.json", messages)

    def abort(self, messages: list) -> None:
        self._gone(messages)


class StreamWriter(_Writer, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._told(f"batch-{batchId:012d}.json", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._gone(messages)


@dataclass
class Part(InputPartition):
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        files, at = _files(self.path)
        found = files.get_file_info(fs.FileSelector(f"{at}/{MANIFESTS}", allow_not_found=True))
        parts: list[str] = []
        for x in sorted(found, key=lambda x: x.base_name):
            if x.base_name.endswith(".json") and not x.base_name.startswith("_"):
                with files.open_input_stream(x.path) as f:
                    told = json.loads(f.read())
                parts = told["parts"] if told["overwrite"] else parts + told["parts"]
        return [Part(p) for p in parts] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.name:
            files, at = _files(self.path)
            with files.open_input_file(f"{at}/{PARTS}/{partition.name}") as f:
                for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                    row = json.loads(line)
                    yield tuple(row[n] for n in self.names)


class Reports(DataSource):
    """format("label_reports"): batch reads and writes (append, overwrite) and streams."""

    @classmethod
    def name(cls) -> str:
        return "label_reports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(_folder(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(_folder(self.options), schema.names, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:  # noqa: N802
        return StreamWriter(_folder(self.options), schema.names, False)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(Reports)
