"""Requests and answers as data sources of their own: format("chat_requests") reads, format("chat_answers") writes, in batches and streams.

Paths are URIs of any file system that pyarrow opens (a cluster needs one that all executors share). Files are read and
written whole by tasks, a file a partition. A stream's offset is a modification time: a file belongs to the micro-batch in whose span
it was finished, files younger than `settle_ms` wait for the next. What tasks write is staged and moved into its place by the
commit, once for each micro-batch, so a batch that is run again adds nothing."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

REQUEST = "protocol string, body string, file string, line bigint"
BATCH = 4096


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{posixpath.abspath(uri)}")


def _files(uri: str) -> list[tuple[int, str]]:
    """(modification time in ns, path) of the finished files below a path; names that begin with _ or . are none."""
    system, root = _open(uri)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x[:1] in "_." for x in posixpath.relpath(p, root).split("/"))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and not hidden(f.path))


@dataclass
class OneFile(InputPartition):
    path: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Requests:
    """A request a line; its protocol is the option `protocol`, else the folder right above the file."""

    def __init__(self, options: dict) -> None:
        self.uri, self.protocol = options["path"], options.get("protocol")
        self.settle = int(options.get("settle_ms", "0")) * 1_000_000

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        system, _ = _open(self.uri)
        protocol = self.protocol or posixpath.basename(posixpath.dirname(partition.path))
        names, held = [x.split()[0] for x in REQUEST.split(", ")], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([protocol] * len(held), pa.string()), pa.array([b for b, _ in held], pa.string()), pa.array([partition.path] * len(held), pa.string()), pa.array([n for _, n in held], pa.int64())], names)

        with system.open_input_stream(partition.path) as raw, pa.PythonFile(raw, mode="r") as file:
            for n, line in enumerate(_lines(file)):
                if line.strip():
                    held.append((line.decode("utf-8", "replace"), n))
                if len(held) == BATCH:
                    yield batch()
                    held = []
        yield batch()


def _lines(file: pa.PythonFile) -> Iterator[bytes]:
    rest = b""
    while chunk := file.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _RequestReader(_Requests, DataSourceReader):
    def partitions(self) -> list[OneFile]:
        return [OneFile(p) for _, p in _files(self.uri)]


class _RequestStream(_Requests, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        ready = [t for t, _ in _files(self.uri) if t <= time.time_ns() - self.settle]
        return {"until": max(ready, default=-1)}

    def partitions(self, start: dict, end: dict) -> list[OneFile]:
        return [OneFile(p) for t, p in _files(self.uri) if start["until"] < t <= end["until"]]

    def commit(self, end: dict) -> None:
        pass


class ChatRequests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_requests"

    def schema(self) -> str:
        return REQUEST

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RequestReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _RequestStream(self.options)


@dataclass
class Staged(WriterCommitMessage):
    path: str | None


class _Answers:
    """Rows with a `response`: a line each. Rows of events (event_name, data): server-sent events, in the order of their
    rows, with the option `done` a sentinel behind each stream's last chunk."""

    def __init__(self, options: dict) -> None:
        self.uri, self.done = options["path"], options.get("done", "false").lower() == "true"

    def _text(self, row: Row) -> str:
        if "response" in row.__fields__:
            return row["response"] + "\n"
        name = f"event: {row['event_name']}\n" if row["event_name"] else ""
        last = self.done and any(c.get("finish_reason") for c in json.loads(row["data"]).get("choices", ()))
        return f"{name}data: {row['data']}\n\n" + ("data: [DONE]\n\n" if last else "")

    def write(self, rows: Iterator[Row]) -> Staged:
        first = next(rows, None)
        if first is None:
            return Staged(None)
        system, root = _open(self.uri)
        path = f"{root}/_staged/{uuid.uuid4().hex}"
        system.create_dir(posixpath.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(self._text(first).encode())
            for row in rows:
                out.write(self._text(row).encode())
        return Staged(path)

    def _place(self, messages: list[Staged | None], name: str) -> None:
        system, root = _open(self.uri)
        target = f"{root}/{name}"
        if system.get_file_info(f"{root}/_done/{name}").type == fs.FileType.File:  # this batch has been committed before
            self._drop(messages)
            return
        if system.get_file_info(target).type == fs.FileType.Directory:  # left by a commit that broke off
            system.delete_dir(target)
        system.create_dir(target, recursive=True)
        for i, m in enumerate(x for x in messages if x is not None and x.path):
            system.move(m.path, f"{target}/part-{i:05d}")
        system.create_dir(f"{root}/_done", recursive=True)
        with system.open_output_stream(f"{root}/_done/{name}") as mark:
            mark.write(b"")

    def _drop(self, messages: list[Staged | None]) -> None:
        system, _ = _open(self.uri)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class _AnswerWriter(_Answers, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self._place(messages, f"write={uuid.uuid4().hex}")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class _AnswerStream(_Answers, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._place(messages, f"batch={batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._drop(messages)


class ChatAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_answers"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _AnswerWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _AnswerStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatRequests)
    spark.dataSource.register(ChatAnswers)
