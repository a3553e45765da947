"""ARFF as a data source whose files are read in splits.

``spark.read.format("arff").load(path)`` gives the header's attributes as columns, numeric ones as double and nominal ones as
string; a schema given with ``.schema(...)`` names the columns that are wanted, and only these are made.  A file is cut into byte ranges of ``split``
bytes, and a range has the rows whose first byte lies in it, so a large file is many tasks and no line is read
twice or cut.  The header is read once, from the first bytes of the first file, and goes to the tasks with their range.

Rows are kept or dropped by all their values, whichever columns are wanted: the wrong number of values, a number that can't be parsed,
or a class (the last attribute) that the header doesn't name drop a row.  Paths go through Arrow's file systems; a folder's files have one header
each, and the first one's attributes hold for all (a file with others is an error).
"""

from __future__ import annotations

import io
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a split, rows of a batch, and bytes in which a header must end.
SPLIT, ROWS, HEAD = 32 << 20, 10_000, 16 << 20


@dataclass(frozen=True)
class Attributes:
    names: tuple[str, ...]
    numeric: tuple[bool, ...]
    classes: frozenset[str]


@dataclass
class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file whose rows begin at ``data``."""

    path: str
    start: int
    end: int
    data: int
    attributes: Attributes


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def head(store, path: str) -> tuple[Attributes, int]:
    """The attributes, and where the first row begins."""
    names, numeric, classes, at = [], [], frozenset(), 0
    with store.open_input_stream(path) as f:
        for raw in io.BufferedReader(f, 1 << 16):
            at += len(raw)
            line = raw.decode("latin-1").strip()
            low = line.lower()
            if low.startswith("@data"):
                return Attributes(tuple(names), tuple(numeric), classes), at
            if low.startswith("@attribute"):
                rest = line[len("@attribute") :].strip()
                quote = rest[0] if rest[:1] in "'\"" else ""
                name, _, kind = rest[1:].partition(quote) if quote else rest.partition(" ") if " " in rest else rest.partition("\t")
                names.append(name)
                numeric.append("{" not in kind)
                if "{" in kind:
                    classes = frozenset(c.strip() for c in kind[kind.index("{") + 1 : kind.rindex("}")].split(","))
            elif line and line[0] not in "@%" or at > HEAD:
                break
    raise ValueError(f"{path} has no @data line")


def ranges(path: str, split: int) -> list[Range]:
    from pyarrow import fs

    store, root = _fs(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [info] if info.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
    out, first = [], None
    for f in files:
        attributes, data = head(store, f.path)
        first = first or attributes
        if attributes != first:
            raise ValueError(f"{f.path} has other attributes than the first file")
        out += [Range(f.path, at, min(at + split, f.size), data, attributes) for at in range(data, f.size, split)]
    return out


def lines(store, r: Range):
    """The lines whose first byte lies in the range."""
    with store.open_input_file(r.path) as f:
        # a line begins at the range's start if a newline ends right before it
        at = r.start if r.start == r.data else r.start - 1
        f.seek(at)
        b = io.BufferedReader(f, 1 << 20)
        if r.start > r.data:
            at += len(b.readline())
        while at < r.end:
            raw = b.readline()
            if not raw:
                return
            at += len(raw)
            yield raw.decode("latin-1")


def parsed(line: str, a: Attributes) -> list | None:
    """Values of a row; None for a line that is no good row."""
    line = line.strip()
    if not line or line[0] in "%@":
        return None
    parts = [x.strip() for x in line.split(",")]
    if len(parts) != len(a.names) or parts[-1] not in a.classes:
        return None
    try:
        return [float(x) if n else x for x, n in zip(parts, a.numeric)]
    except ValueError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, schema: T.StructType) -> None:
        self.path, self.split, self.schema = path, split, schema

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split) or [Range("", 0, 0, 0, Attributes((), (), frozenset()))]

    def read(self, partition: Range):
        import pyarrow as pa

        if not partition.path:
            return
        store, a = _fs(self.path)[0], partition.attributes
        lost = [f.name for f in self.schema.fields if f.name not in a.names]
        if lost:
            raise ValueError(f"the header has no attributes {lost}")
        at = [a.names.index(f.name) for f in self.schema.fields]
        kinds = pa.schema([(f.name, pa.float64() if f.dataType.typeName() == "double" else pa.string()) for f in self.schema.fields])
        columns: list[list] = [[] for _ in at]
        n = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

        for line in lines(store, partition):
            row = parsed(line, a)
            if row is None:
                continue
            for c, i in zip(columns, at):
                c.append(row[i])
            n += 1
            if n % ROWS == 0:
                yield batch()
                columns[:] = [[] for _ in at]
        if n % ROWS:
            yield batch()


class Arff(DataSource):
    """Format ``arff``: options path and split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def schema(self):
        found = ranges(self.options["path"], 1 << 62)
        if not found:
            raise ValueError(f"{self.options['path']} has no rows to take a schema from: give one")
        a = found[0].attributes
        return T.StructType([T.StructField(name, T.DoubleType() if n else T.StringType()) for name, n in zip(a.names, a.numeric)])

    def reader(self, schema) -> DataSourceReader:
        wrong = [f.name for f in schema.fields if f.dataType.typeName() not in ("double", "string")]
        if wrong:
            raise ValueError(f"columns are double or string: {wrong}")
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)), schema)


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(Arff)
