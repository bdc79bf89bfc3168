"""WAV files as a sink: each row one file, written aside and renamed when the whole job is done."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files that are renamed at the same time.
MOVERS = 16


@dataclass
class Written(WriterCommitMessage):
    aside: str
    names: tuple


def pcm16(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit WAV; samples beyond [-1, 1] are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(samples * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


class WavWriter(DataSourceArrowWriter):
    def __init__(self, path: str, rate: int):
        self.path, self.rate, self.job = path, rate, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = self._store()
        aside = f"{base}/_{self.job}/{uuid.uuid4().hex}"  # of this attempt alone
        store.create_dir(aside, recursive=True)
        done = []
        for b in iterator:
            for name, samples in zip(b.column("name").to_pylist(), b.column("samples"), strict=True):
                if not name or "/" in name or name.startswith(("_", ".")):
                    raise ValueError(f"{name!r} names no file")
                with store.open_output_stream(f"{aside}/{name}.wav") as out:
                    out.write(pcm16(np.array(samples.as_py() or [], np.float64), self.rate))
                done.append(name)
        return Written(aside, tuple(done))

    def commit(self, messages: list) -> None:
        """Only files of the attempts that Spark counts are moved; those of failed or doubled ones go with the job's folder."""
        store, base = self._store()
        moves = ((f"{m.aside}/{name}.wav", f"{base}/{name}.wav") for m in messages if m for name in m.names)
        with ThreadPoolExecutor(MOVERS) as pool:  # a rename is a call to the store, and there may be many
            for _ in pool.map(lambda x: store.move(*x), moves):
                pass
        self._clear(store, base)

    def abort(self, messages: list) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/_{self.job}")


class WavFiles(DataSource):
    """write.format("wav_files") of rows (name string, samples array<double>). Options: path, rate (16000). Mode append."""

    @classmethod
    def name(cls) -> str:
        return "wav_files"

    def schema(self) -> str:
        return "name string, samples array<double>"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("wav_files only appends")
        return WavWriter(self.options["path"], int(self.options.get("rate", 16_000)))
