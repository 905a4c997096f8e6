"""A data source of its own for record exports: JSON lines in folders by a label, through Spark's data source interface.

    spark.dataSource.register(Records)
    spark.read.format("records").schema("doc_id long, lang string, text string").option("label", "lang").load(folder)
    frame.write.format("records").option("label", "lang").mode("append").save(folder)

Files lie in `<label>=<value>/`. A read has a partition for each file; a filter that compares the label with values is pushed down
and decides which files there are, other filters stay with Spark. A write puts each task's files aside under `_tasks` and moves them
when all tasks are done; a failed job removes them, so readers never see a part of a write.

Defined cases: a null label is the folder of the Hive default name; fields that a line lacks are null, unknown ones are left out; a folder
that is not there, or is empty, has no rows; a line that is not JSON fails the read with its file and number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NONE = "__HIVE_DEFAULT_PARTITION__"
LINES = 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _folder(value) -> str:
    return NONE if value is None else quote(str(value), safe="")


@dataclass
class File(InputPartition):
    path: str
    label: str | None

    def __init__(self, path: str, label: str | None):
        super().__init__(path)
        self.path, self.label = path, label


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)
    rows: int = 0


class RecordsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.label = schema, options["path"], options.get("label")
        self.wanted: set | None = None

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if self.label and isinstance(f, (EqualTo, In)) and f.attribute == (self.label,):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[File]:
        store, root = _store(self.folder)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return []
        out = []
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.endswith(".jsonl") or "/_tasks/" in info.path:
                continue
            at = info.path.rsplit("/", 2)[1].partition("=")
            label = unquote(at[2]) if at[0] == self.label and at[2] != NONE else None
            if self.wanted is None or label in self.wanted:
                out.append(File(info.path, label))
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None or not isinstance(partition, File):
            return
        schema = to_arrow_schema(self.schema)
        store, _ = _store(self.folder)
        names, rows = schema.names, []
        with store.open_input_stream(partition.path) as stream:
            for number, line in enumerate(_lines(stream)):
                try:
                    row = json.loads(line)
                except ValueError as broken:
                    raise ValueError(f"{partition.path}: line {number + 1} is no JSON") from broken
                rows.append({n: row.get(n) for n in names} | ({self.label: partition.label} if self.label in names else {}))
                if len(rows) == LINES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _lines(stream) -> Iterator[bytes]:
    """Lines of a stream that is read a megabyte at a time."""
    rest = b""
    while data := stream.read(1 << 20):
        *whole, rest = (rest + data).split(b"\n")
        yield from (w for w in whole if w.strip())
    if rest.strip():
        yield rest


class RecordsWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.folder, self.label, self.overwrite = schema, options["path"], options.get("label"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.folder)
        task, out, done = uuid.uuid4().hex, {}, Written()
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    value = row.pop(self.label) if self.label else None
                    name = f"{self.label}={_folder(value)}" if self.label else "all"
                    if name not in out:
                        aside = f"{root}/_tasks/{self.job}/{task}/{name}"
                        store.create_dir(aside, recursive=True)
                        out[name] = store.open_output_stream(f"{aside}/{task}.jsonl")
                        done.files.append((f"{aside}/{task}.jsonl", f"{root}/{name}/{task}.jsonl"))
                    out[name].write(json.dumps(row, ensure_ascii=False, default=str).encode() + b"\n")
                    done.rows += 1
        finally:
            for stream in out.values():
                stream.close()
        return done

    def commit(self, messages: list[Written]) -> None:
        store, root = _store(self.folder)
        old = [i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.path.endswith(".jsonl") and "/_tasks/" not in i.path] if self.overwrite else []
        for message in messages:
            for aside, place in message.files if message else ():
                store.create_dir(place.rpartition("/")[0], recursive=True)
                store.move(aside, place)
        for path in old:
            store.delete_file(path)
        self._clear(store, root)

    def abort(self, messages: list[Written]) -> None:
        store, root = _store(self.folder)
        self._clear(store, root)

    def _clear(self, store, root: str) -> None:
        if store.get_file_info(f"{root}/_tasks/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_tasks/{self.job}")


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        raise ValueError("records have no schema of their own: give one to the reader")

    def reader(self, schema: StructType) -> RecordsReader:
        return RecordsReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(schema, self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Records)
