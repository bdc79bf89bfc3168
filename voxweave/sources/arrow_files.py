"""Arrow IPC files as a source, a task for each run of record batches, and as a sink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

SUFFIXES = (".arrow", ".feather", ".ipc")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def files_of(listed: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files of a comma-separated list; a folder stands for its files with one of the suffixes, by name."""
    out = []
    for path in (p.strip() for p in listed.split(",") if p.strip()):
        store, base = store_of(path)
        if store.get_file_info(base).type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(base))
            scheme = path[: path.index(base)] if base in path else ""
            out += [f"{scheme}{f.path}" for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(suffixes) and not f.base_name.startswith(("_", "."))]
        else:
            out.append(path)
    if not out:
        raise ValueError(f"no files at {listed}")
    return out


class Run(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class ArrowReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.files, self.schema, self.most = files_of(options["path"], SUFFIXES), to_arrow_schema(schema), int(options.get("batches", 16))

    def partitions(self) -> list[InputPartition]:
        """Only footers are read here."""
        out = []
        for path in self.files:
            store, base = store_of(path)
            with store.open_input_file(base) as f:
                n = pa.ipc.open_file(f).num_record_batches
            out += [Run(path, i, min(n, i + self.most)) for i in range(0, n, self.most)]
        return out or [Run("", 0, 0)]

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        if part.path:
            store, base = store_of(part.path)
            with store.open_input_file(base) as f:
                file = pa.ipc.open_file(f)
                for i in range(part.first, part.end):
                    b = file.get_batch(i)
                    if missing := [n for n in self.schema.names if n not in b.schema.names]:
                        raise ValueError(f"{part.path} has no column {', '.join(missing)}")
                    yield pa.RecordBatch.from_arrays([b.column(n).cast(t.type) for n, t in zip(self.schema.names, self.schema, strict=True)], schema=self.schema)


@dataclass
class Written(WriterCommitMessage):
    name: str


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.path)
        name, out = f"part-{uuid.uuid4().hex}.arrow", None
        store.create_dir(f"{base}/_{self.job}", recursive=True)
        with store.open_output_stream(f"{base}/_{self.job}/{name}") as f:
            for b in iterator:
                out = out or pa.ipc.new_file(f, b.schema)
                out.write_batch(b)
            if out:
                out.close()
        return Written(name if out else "")

    def commit(self, messages: list) -> None:
        store, base = store_of(self.path)
        for m in messages:
            if m and m.name:
                store.move(f"{base}/_{self.job}/{m.name}", f"{base}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = store_of(self.path)
        if store.get_file_info(f"{base}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_{self.job}")


class ArrowFiles(DataSource):
    """read and write.format("arrow_files"). Options: path (files or folders, comma-separated; one folder to write), batches (record
    batches of a task at most). The first file's schema is that of all; other files need its columns."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        store, base = store_of(files_of(self.options["path"], SUFFIXES)[0])
        with store.open_input_file(base) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("arrow_files only appends")
        return ArrowWriter(dict(self.options))
