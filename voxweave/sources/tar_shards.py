"""Shards of samples in tar files: members whose names agree up to the first dot are one sample."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .arrow_files import files_of, store_of
from .shared import kept, numbered

SAMPLE = "key string, shard string, members map<string,binary>"
#: A task reads about one of so many equal shares of all bytes, but no more than MOST_BYTES where shards can be cut.
TASKS, MOST_BYTES = 256, 128 << 20


class Ranges(InputPartition):
    """(shard, start, end) of each range: samples whose first member's header lies in [start, end); start is the place of a sample."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def split_name(name: str) -> tuple[str, str]:
    """(key, suffix): the folder belongs to the key, and the suffix begins behind the first dot of what follows it."""
    folder, _, base = name.rpartition("/")
    stem, _, suffix = base.partition(".")
    return (f"{folder}/{stem}" if folder else stem), suffix


def members(f: object, start: int = 0) -> Iterator[tuple[int, tarfile.TarInfo, tarfile.TarFile]]:
    """(place of the header, header, archive) of all plain files from a header on; contents are stepped over."""
    f.seek(start)
    with tarfile.open(fileobj=f, mode="r:") as tar:
        for m in tar:
            if m.isfile():
                yield m.offset, m, tar
            tar.members = []  # a long shard's headers aren't kept


def cuts_of(f: object, size: int) -> list[int]:
    """Places of samples, `size` bytes or more apart, from 0; all headers are read."""
    cuts, key = [0], None
    for at, m, _ in members(f):
        own = split_name(m.name)[0]
        if own != key and at - cuts[-1] >= size:
            cuts.append(at)
        key = own
    return cuts


class TarReader(DataSourceReader):
    """It goes to every task, so it holds no list of shards."""

    def __init__(self, options: dict[str, str]):
        self.path, self.size = options["path"], int(options.get("bytes", MOST_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Shards are cut between samples, for which their headers are read, only if they are larger than `bytes` and than a task's
        share; what is smaller than that share goes together."""
        sized = []
        for path in files_of(self.path, (".tar",)):
            store, base = store_of(path)
            sized.append((path, store.get_file_info(base).size))
        share = min(MOST_BYTES, sum(n for _, n in sized) // TASKS)
        size = max(self.size, share)
        out, held = [], share
        for path, total in sized:
            cuts = [0]
            if total > size:
                store, base = store_of(path)
                with store.open_input_file(base) as f:
                    cuts = cuts_of(f, size)
            for a, b in zip(cuts, [*cuts[1:], total], strict=True):
                if not out or held + b - a > share:
                    out.append(Ranges([]))
                    held = 0
                out[-1].ranges.append((path, a, b))
                held += b - a
        return out

    def read(self, part: Ranges) -> Iterator[tuple]:
        for path, start, end in part.ranges:
            yield from self._samples(path, start, end)

    @staticmethod
    def _samples(path: str, start: int, end: int) -> Iterator[tuple]:
        store, base = store_of(path)
        with store.open_input_file(base) as f:
            key, found = None, {}
            for at, m, tar in members(f, start):
                own, suffix = split_name(m.name)
                if own != key:
                    if key is not None:
                        yield key, base.rsplit("/", 1)[-1], found
                    if at >= end:
                        return
                    key, found = own, {}
                if suffix in found:
                    raise ValueError(f"{path}: {m.name} is there twice")
                found[suffix] = tar.extractfile(m).read()
            if key is not None:
                yield key, base.rsplit("/", 1)[-1], found


@dataclass
class Written(WriterCommitMessage):
    names: tuple


class TarWriter(DataSourceArrowWriter):
    """Each task writes shards of up to `samples` samples, aside until the job is done."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.job = options["path"], int(options.get("samples", 10_000)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.path)
        store.create_dir(f"{base}/_{self.job}", recursive=True)
        names, tar, out, n = [], None, None, 0
        for b in iterator:
            for key, held in zip(b.column("key").to_pylist(), b.column("members").to_pylist(), strict=True):
                if not key or not split_name(key)[0] or split_name(key)[1]:
                    raise ValueError(f"{key!r} is no key")
                if n % self.most == 0:
                    if tar:
                        tar.close(), out.close()
                    names.append(f"shard-{uuid.uuid4().hex}.tar")
                    out = store.open_output_stream(f"{base}/_{self.job}/{names[-1]}")
                    tar = tarfile.open(fileobj=out, mode="w|")
                for suffix, content in sorted(held):
                    info = tarfile.TarInfo(f"{key}.{suffix}")
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
                n += 1
        if tar:
            tar.close(), out.close()
        return Written(tuple(names))

    def commit(self, messages: list) -> None:
        store, base = store_of(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{base}/_{self.job}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = store_of(self.path)
        if store.get_file_info(f"{base}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_{self.job}")


class TarShards(DataSource):
    """read and write.format("tar_shards") of (key, shard, members: suffix to content). Options: path, bytes (of a part of a shard at least;
    a task takes several where there are many), samples (of a written shard at most)."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SAMPLE

    def reader(self, schema: object) -> DataSourceReader:
        return TarReader(dict(self.options))

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("tar_shards only appends")
        return TarWriter(dict(self.options))


def virtual_epoch(rows: DataFrame, order: list[str], length: int) -> DataFrame:
    """An epoch of `length` samples whatever the rows: `_place` from 0 in order, the rows again from the first one when they are through,
    or only the first `length` of them."""
    rows = kept(rows, "epoch")  # counted, sampled for ranges and dealt out, but made once
    total = rows.count()
    if not total:
        return rows.withColumn("_place", F.lit(0).cast("long")).limit(0)
    places = numbered(rows, order, name="_first").withColumn("_first", F.col("_first") - 1).where(F.col("_first") < length)
    again = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(length) - 1 - F.col("_first")) / F.lit(total)).cast("long"))
    return places.withColumn("_round", F.explode(again)).withColumn("_place", F.col("_first") + F.col("_round") * total).drop("_first", "_round")
