"""Arrow IPC files as a data source and sink.

Reading: a file, a folder or a glob, on any file system that pyarrow opens, by record batch.
The option ``columns`` ("a,b") reads only these from the files.  In a folder that the sink
wrote, a manifest holds the least and greatest values of each batch's columns; the option
``where`` (a JSON list of [column, sign, value]) leaves out batches that hold no such row when
the read is planned.  ``read`` gives it and filters the rows too.  Filters that Spark would push
to a Python reader are not taken: Spark keeps a reader's pruned batches for the whole relation, so a
second query over the same DataFrame would miss rows.

Writing: each task writes its own files; they count once the driver has put their names and
numbers into the manifest, so a failed job, or a task that ran twice, leaves no rows.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import operator
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
SIGNS = {"=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
#: Bytes of a written file, about, and rows of its batches.
FILE_BYTES, BATCH_ROWS = 128 << 20, 1 << 16


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowFiles)


def read(spark: SparkSession, path: str, columns: Sequence[str] = (), where: Sequence[tuple] = ()) -> DataFrame:
    """The rows of a path that fulfil all of ``where``: (column, sign, value) with one of the
    signs ``=``, ``<``, ``<=``, ``>``, ``>=`` or ``in`` (then a list of values)."""
    register(spark)
    reader = spark.read.format("arrow_file")
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if where:
        plain = [(c, sign, [_plain(x) for x in v] if sign == "in" else _plain(v)) for c, sign, v in where]
        reader = reader.option("where", json.dumps(plain))
    df = reader.load(path)
    for c, sign, v in where:
        df = df.filter(F.col(f"`{c}`").isin(list(v)) if sign == "in" else SIGNS[sign](F.col(f"`{c}`"), F.lit(v)))
    return df


def file_system(path: str):
    """The file system of an address or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def find(path: str) -> tuple[object, list[str]]:
    """The files of a path: itself, a folder's (by its manifest if it has one), or a glob's."""
    from pyarrow import fs

    star = min((path.index(c) for c in "*?[" if c in path), default=-1)
    if star >= 0:
        head = path[: path.rindex("/", 0, star)] or "/" if "/" in path[:star] else "."
        system, base = file_system(head)
        pattern = f"{base}/{path[len(head) + 1 :] if head != '.' else path}"
        found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.count("/") == pattern.count("/") and fnmatch.fnmatch(f.path, pattern)]
        if not found:
            raise FileNotFoundError(f"No file matches {path!r}")
        return system, sorted(found)
    system, base = file_system(path)
    if system.get_file_info(base).type != fs.FileType.Directory:
        return system, [base]
    listed = manifest(system, base)
    if listed is not None:
        return system, [f"{base}/{name}" for name in sorted(listed["files"])]
    return system, sorted(f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".arrow"))


def manifest(system, base: str) -> dict | None:
    try:
        with system.open_input_stream(f"{base}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _open(system, path: str, columns: list[str] | None = None):
    """A record-batch reader of an Arrow file or stream."""
    import pyarrow as pa

    def options(schema: pa.Schema) -> pa.ipc.IpcReadOptions:
        return pa.ipc.IpcReadOptions(included_fields=[schema.get_field_index(c) for c in columns] if columns else None)

    source = system.open_input_file(path)
    try:
        schema = pa.ipc.open_file(source).schema
        opened = pa.ipc.open_file
    except pa.ArrowInvalid:
        source.seek(0)
        schema = pa.ipc.open_stream(source).schema
        opened = pa.ipc.open_stream
    source.seek(0)
    return opened(source, options=options(schema))


def _plain(value) -> int | float | str | None:
    """A value in a form that JSON keeps and that is ordered as the value is; None where there is none."""
    if isinstance(value, bool) or value is None or value != value:
        return None
    if isinstance(value, (int, float, str)):
        return value
    if isinstance(value, datetime.datetime):
        return None if value.tzinfo else value.isoformat()
    return value.isoformat() if isinstance(value, datetime.date) else None


def bounds(batch) -> dict[str, list]:
    """The least and greatest value of each column that has an order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        kind = column.type
        if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_date(kind) or pa.types.is_timestamp(kind) and kind.tz is None:
            if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
                continue
            low, high = (_plain(v.as_py()) for v in pc.min_max(column).values())
            if low is not None and high is not None:
                out[name] = [low, high]
    return out


def possible(stats: dict[str, list], where: list) -> bool:
    """Whether a batch with these bounds can hold a row that fulfils all of ``where``."""
    for column, sign, value in where:
        values = value if sign == "in" else [value]
        if column not in stats or None in values or any(isinstance(v, str) != isinstance(stats[column][0], str) for v in values):
            continue
        low, high = stats[column]
        if sign in ("=", "in"):
            if not any(low <= v <= high for v in values):
                return False
        elif not SIGNS[sign](low if sign[0] == "<" else high, value):
            return False
    return True


class _Batches(InputPartition):
    def __init__(self, path: str, numbers: list[int] | None):
        self.path, self.numbers = path, numbers


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None, batches: int, where: list):
        self.path, self.columns, self.batches, self.where = path, columns, batches, where

    def partitions(self):
        from pyarrow import fs

        system, files = find(self.path)
        star = any(c in self.path for c in "*?[")
        base = None if star else file_system(self.path)[1]
        listed = manifest(system, base) if base and system.get_file_info(base).type == fs.FileType.Directory else None
        out = []
        for path in files:
            stats = listed["files"].get(os.path.basename(path)) if listed else None
            if stats is None:
                n = getattr(_open(system, path), "num_record_batches", None)
                if n is None:
                    out.append(_Batches(path, None))
                    continue
                numbers = list(range(n))
            else:
                numbers = [i for i, own in enumerate(stats) if possible(own, self.where)]
            out += [_Batches(path, numbers[i : i + self.batches]) for i in range(0, len(numbers), self.batches)]
        return out or [_Batches("", [])]

    def read(self, partition):
        if not partition.path:
            return
        reader = _open(file_system(self.path.split("*")[0].split("?")[0].split("[")[0])[0], partition.path, self.columns)
        for batch in reader if partition.numbers is None else (reader.get_batch(i) for i in partition.numbers):
            yield batch.select(self.columns) if self.columns else batch


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, list]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator) -> _Written:
        import pyarrow as pa

        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        files: dict[str, list] = {}
        writer = sink = None
        for batch in iterator:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                if writer is None or sink.tell() >= FILE_BYTES:
                    if writer is not None:
                        writer.close()
                        sink.close()
                    name = f"part-{uuid.uuid4().hex}.arrow"
                    files[name] = []
                    sink = system.open_output_stream(f"{base}/{name}")
                    writer = pa.ipc.new_file(sink, part.schema)
                writer.write_batch(part)
                files[name].append(bounds(part))
        if writer is not None:
            writer.close()
            sink.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        before = (manifest(system, base) or {"files": {}})["files"]
        files = {k: v for m in messages if m for k, v in m.files.items()}
        kept = files if self.overwrite else before | files
        with system.open_output_stream(f"{base}/{MANIFEST}.new") as f:
            f.write(json.dumps({"files": kept}).encode())
        system.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")
        for name in before if self.overwrite else ():
            system.delete_file(f"{base}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = file_system(self.path)
        for name in (k for m in messages if m for k in m.files):
            system.delete_file(f"{base}/{name}")


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_file").load(path)`` and ``df.write.format("arrow_file")``."""

    @classmethod
    def name(cls):
        return "arrow_file"

    def _columns(self) -> list[str] | None:
        named = self.options.get("columns")
        return [c.strip() for c in named.split(",")] if named else None

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema
        from pyspark.sql.types import StructType

        system, files = find(self.options["path"])
        if not files:
            raise FileNotFoundError(f"No Arrow file in {self.options['path']!r}")
        whole = from_arrow_schema(_open(system, files[0]).schema, prefer_timestamp_ntz=True)
        columns = self._columns()
        return StructType([whole[c] for c in columns]) if columns else whole

    def reader(self, schema):
        return _Reader(self.options["path"], self._columns(), int(self.options.get("batchesperpartition", 16)), json.loads(self.options.get("where", "[]")))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)
