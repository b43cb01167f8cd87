"""JSON lines as a format that users plug in: format("quillon_lines") writes, reads and streams folders of record files.

Writing gives one file for each partition, and the files appear only when all partitions are there; overwriting removes those
that were there before, after the new ones stand. Reading cuts files into byte ranges: a task starts behind the first line
break of its range and ends with the line that its range ends in. Filters on plain columns can be pushed down and are decided
before a line becomes a row. A stream's offset is how many bytes of each file have been read, so a restart repeats and loses nothing.

Paths are URIs of file systems that Arrow opens (file:, hdfs:, s3:, gs:) or plain paths of a folder that all executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import BinaryType, MapType, StructType

from quillon.shipping import ship

#: Bytes of a range, of a file (more is an error, as with any raw read), and rows of an Arrow batch.
SPLIT, MOST, ROWS = 32 << 20, 256 << 30, 4096


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    rows: int


class LinesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        c = TaskContext.get()
        fs, folder = opened(self.path)
        fs.create_dir(folder)
        name = f"part-{self.job}-{c.partitionId():05d}.json"
        temporary = f"{folder}/.{name}.{c.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(temporary) as f:
            for row in iterator:
                f.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode("utf-8", "surrogatepass"))
                n += 1
        return Written(temporary, f"{folder}/{name}", n)

    def commit(self, messages):
        fs, folder = opened(self.path)
        old = [f.path for f in files(fs, folder)] if self.overwrite else []
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)
        for f in old:
            fs.delete_file(f)

    def abort(self, messages):
        fs, _ = opened(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(m.temporary).type == pafs.FileType.File:
                fs.delete_file(m.temporary)


def files(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name.startswith("part-") and f.base_name.endswith(".json")), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__(self.file)


#: What is decided for a column's value before a row is made; null satisfies none but the null tests.
_DECIDED = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    GreaterThan: lambda v, f: v is not None and v > f.value,
    GreaterThanOrEqual: lambda v, f: v is not None and v >= f.value,
    LessThan: lambda v, f: v is not None and v < f.value,
    LessThanOrEqual: lambda v, f: v is not None and v <= f.value,
    In: lambda v, f: v is not None and v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
}


class _Lines:
    """Reading of byte ranges, for batches and streams."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.filters = schema, {k.lower(): v for k, v in options.items()}, []
        self.path = options["path"]

    def ranges(self, read: dict[str, int] | None = None, upto: dict[str, int] | None = None) -> list[Range]:
        """Ranges of all files, or of what lies between two offsets."""
        fs, folder = opened(self.path)
        split, most = int(self.options.get("splitbytes", SPLIT)), int(self.options.get("maxbytes", MOST))
        out = []
        for f in files(fs, folder):
            lo, hi = (read or {}).get(f.base_name, 0), f.size if upto is None else min(f.size, upto.get(f.base_name, 0))
            if f.size > most:
                raise ValueError(f"{f.base_name} has {f.size} bytes; at most {most} are read")
            out += [Range(f.path, at, min(hi, at + split)) for at in range(lo, hi, split)]
        return out

    def lines(self, part: Range):
        """The lines that begin within the range."""
        fs, _ = opened(self.path)
        with fs.open_input_file(part.file) as f:
            at = part.start
            f.seek(max(0, at - 1))
            held = b""
            if at:  # a line that begins before the range is another's, unless a break stands right before
                while True:
                    block = f.read(1 << 16)
                    cut = block.find(b"\n")
                    if not block or cut >= 0:
                        held = block[cut + 1 :] if cut >= 0 else b""
                        at = f.tell() - len(held)
                        break
            while at < part.end:
                cut = held.find(b"\n")
                while cut < 0:
                    block = f.read(1 << 20)
                    if not block:
                        break
                    cut = block.find(b"\n")
                    cut = len(held) + cut if cut >= 0 else -1
                    held += block
                if cut < 0:
                    if held:
                        yield held
                    return
                yield held[:cut]
                at += cut + 1
                held = held[cut + 1 :]

    def batches(self, part: Range):
        names = self.schema.names
        kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema.fields])
        rows = []
        for line in self.lines(part):
            if not line.strip():
                continue
            row = json.loads(line.decode("utf-8", "surrogatepass"))
            if all(_DECIDED[type(f)](row.get(f.attribute[0]), f) for f in self.filters):
                rows.append({n: row.get(n) for n in names})
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _simple(kind) -> bool:
    """Kinds whose values in JSON compare as the column's do."""
    return kind.typeName() in ("string", "integer", "long", "short", "byte", "double", "boolean")


class LinesReader(DataSourceReader, _Lines):
    def __init__(self, schema, options):
        _Lines.__init__(self, schema, options)

    def partitions(self):
        return self.ranges() or [Range("", 0, 0)]

    def read(self, partition):
        if partition.file:
            yield from self.batches(partition)


class FilteringReader(LinesReader):
    def pushFilters(self, filters):
        for f in filters:
            at = getattr(f, "attribute", ())
            known = type(f) in _DECIDED and len(at) == 1 and at[0] in self.schema.names and _simple(self.schema[at[0]].dataType)
            if known:
                self.filters.append(f)
            else:
                yield f


class LinesStream(DataSourceStreamReader, _Lines):
    def __init__(self, schema, options):
        _Lines.__init__(self, schema, options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        fs, folder = opened(self.path)
        return {f.base_name: f.size for f in files(fs, folder)}

    def partitions(self, start, end):
        return self.ranges(start, end) or [Range("", 0, 0)]

    def read(self, partition):
        if partition.file:
            yield from self.batches(partition)

    def commit(self, end):
        """Files stay; the checkpoint remembers what was read."""


class LinesSource(DataSource):
    """Options: path, splitBytes, maxBytes, pushdown. The schema is given by the reader, never inferred; unknown fields are left
    out, missing ones are null. With pushdown, filters are decided in the reader; Spark keeps the reader of a loaded DataFrame
    with the filters that were pushed last, so with it each query needs a DataFrame of its own."""

    @classmethod
    def name(cls):
        return "quillon_lines"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return LinesWriter(self.options["path"], overwrite)

    def reader(self, schema):
        refused = [f.name for f in schema.fields if isinstance(f.dataType, (BinaryType, MapType))]
        if refused:
            raise ValueError(f"JSON lines hold no binary or map: {', '.join(refused)}")
        return (FilteringReader if str(self.options.get("pushdown")).lower() == "true" else LinesReader)(schema, self.options)

    def streamReader(self, schema):
        return LinesStream(schema, self.options)



def register(spark) -> None:
    """Makes format("quillon_lines") known to a session, and its code to the executors."""
    ship(spark).dataSource.register(LinesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
