"""The event trail as a streaming source and sink, with offsets by sequence number.

Layout of a trail folder: ``data/`` has JSON lines without numbers, ``_commits/`` one small file for each batch of a writer,
which names its data files and the sequence numbers of their lines.  A commit file appears by one rename, so a batch is visible whole or not
at all; a batch that is delivered again finds its commit and drops what it staged, so each event gets one number.
A reader's offset is the last number it has read.  A batch of a reader is a range of numbers, its partitions are pieces of data files, and rows
are found by their place in the file, so any number of readers, restarts and replays see each event once and under the same number.

Paths go through Arrow's file systems: a plain or ``file://`` path, or a URI of a shared store.  A trail has one writer at a time.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from .trail import SCHEMA

#: Lines of one partition of a reader.
LINES = 100_000


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def commits(path: str) -> list[dict]:
    """(writer, batch, files) of all visible batches, by sequence number."""
    from pyarrow import fs

    store, root = _fs(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    out = []
    for f in found:
        if f.path.endswith(".json"):
            with store.open_input_stream(f.path) as s:
                out.append(json.loads(s.read()))
    return sorted(out, key=lambda c: (c["last"], c["batch"]))


@dataclass
class Piece(InputPartition):
    """Lines ``skip`` to ``skip + n`` of a data file; the first has number ``first``."""

    path: str
    name: str
    skip: int
    n: int
    first: int


@dataclass
class Staged(WriterCommitMessage):
    name: str | None
    n: int
    task: int


def pieces(path: str, after: int, upto: int) -> list[Piece]:
    """What holds the numbers after ``after`` up to ``upto``."""
    out = []
    for c in commits(path):
        for f in c["files"]:
            lo, hi = max(f["first"], after + 1), min(f["last"], upto)
            for at in range(lo, hi + 1, LINES):
                out.append(Piece(path, f["name"], at - f["first"], min(LINES, hi + 1 - at), at))
    return out


def _rows(piece: Piece):
    import io

    store, root = _fs(piece.path)
    names = [f.name for f in SCHEMA.fields]
    times = {f.name for f in SCHEMA.fields if f.dataType.typeName() == "timestamp"}
    with store.open_input_stream(f"{root}/data/{piece.name}") as s:
        for k, line in enumerate(io.TextIOWrapper(s, "utf-8")):
            if k >= piece.skip + piece.n:
                break
            if k >= piece.skip:
                row = json.loads(line)
                row["seq"] = piece.first + k - piece.skip
                yield tuple(datetime.datetime.fromisoformat(row[c]) if c in times and row.get(c) is not None else row.get(c) for c in names)


class _Stream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path, self.start = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seq": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"seq": max([self.start, *(c["last"] for c in commits(self.path))])}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(self.path, start["seq"], end["seq"])

    def read(self, partition: Piece):
        return _rows(partition)


class _Batch(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.start = options["path"], int(options.get("since", 0))

    def partitions(self) -> list[Piece]:
        return pieces(self.path, self.start, 1 << 62) or [Piece(self.path, "", 0, 0, 0)]

    def read(self, partition: Piece):
        return _rows(partition) if partition.n else iter(())


class _Writer(DataSourceStreamWriter):
    def __init__(self, options, schema) -> None:
        self.path, self.writer = options["path"], options.get("writer", "main")
        self.order = [c.strip() for c in options.get("order", "").split(",") if c.strip()]
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - {f.name for f in SCHEMA.fields}
        if unknown:
            raise ValueError(f"the trail has no columns {sorted(unknown)}")

    def write(self, iterator) -> Staged:
        from pyspark import TaskContext

        rows = [r.asDict(recursive=True) for r in iterator]
        task = TaskContext.get().partitionId()
        if not rows:
            return Staged(None, 0, task)
        # what a control plane emits in one batch is few rows; absent values come first
        rows.sort(key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        store, root = _fs(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(f"{root}/data/{name}") as s:
            for r in rows:
                plain = {k: v.isoformat() if isinstance(v, datetime.datetime) else v for k, v in r.items() if k != "seq" and v is not None}
                plain.setdefault("ts", datetime.datetime.now(datetime.timezone.utc).isoformat())
                s.write((json.dumps(plain) + "\n").encode())
        return Staged(name, len(rows), task)

    def _drop(self, messages) -> None:
        store, root = _fs(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/data/{m.name}")

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        store, root = _fs(self.path)
        target = f"{root}/_commits/{self.writer}-{batchId:020d}.json"
        if store.get_file_info(target).type != fs.FileType.NotFound:  # delivered again
            return self._drop(messages)
        last = max([0, *(c["last"] for c in commits(self.path))])
        files = []
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.task):
            files.append({"name": m.name, "first": last + 1, "last": last + m.n})
            last += m.n
        store.create_dir(f"{root}/_commits", recursive=True)
        with store.open_output_stream(f"{target}.tmp") as s:
            s.write(json.dumps({"writer": self.writer, "batch": batchId, "last": last, "files": files}).encode())
        store.move(f"{target}.tmp", target)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class Trail(DataSource):
    """Format ``trail``: options path, since (read after this number), writer and order (columns by which a task's events are numbered)."""

    @classmethod
    def name(cls) -> str:
        return "trail"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(Trail)
