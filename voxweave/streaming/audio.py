"""Audio as streams: WAV files as a source of blocks, blocks cut anew into overlapping chunks, and results or errors for each chunk."""

from __future__ import annotations

import wave
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOCK = "name string, block long, start double, last boolean, samples array<double>"
CHUNK = "chunk long, start double, length long, samples array<double>"
#: Blocks that one task reads at most, of one long file or of many short ones.
TASK_BLOCKS = 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


class Part(InputPartition):
    """(file, first block, block behind the last one) of each run; without an end the file is whole."""

    def __init__(self, runs: list[tuple[str, int, int | None]]):
        self.runs = runs


class WavReader(DataSourceStreamReader):
    """An offset is the name of the last file that is done; files are taken in the order of their names, each as a whole."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.size = options["path"], int(options["block"])
        self.before, self.behind = int(options.get("before", 0)), int(options.get("behind", 0))
        self.most = int(options.get("files", 1 << 30))
        self.at = ""

    def _files(self) -> list[tuple[str, int]]:
        """Path and bytes of each file."""
        store, base = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.is_file and f.base_name.lower().endswith(".wav") and not f.base_name.startswith((".", "_")))

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        names = [n for n in (f.rsplit("/", 1)[-1] for f, _ in self._files()) if n > self.at][: self.most]
        self.at = names[-1] if names else self.at
        return {"name": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Files that can't hold more than TASK_BLOCKS blocks share tasks of about so many; only of larger ones the headers are read here."""
        self.at = max(self.at, end["name"])
        store, out, runs, held = _store(self.folder)[0], [], [], 0
        for path, size in self._files():
            if start["name"] < path.rsplit("/", 1)[-1] <= end["name"]:
                most = -(-(self.before + size // 2 + self.behind) // self.size)  # 16 bits a frame at least
                if most > TASK_BLOCKS:
                    with store.open_input_file(path) as f, wave.open(f) as w:
                        n = -(-(self.before + w.getnframes() + self.behind) // self.size)
                    out += [Part([(path, i, min(n, i + TASK_BLOCKS))]) for i in range(0, n, TASK_BLOCKS)]
                    continue
                if runs and held + most > TASK_BLOCKS:
                    out.append(Part(runs))
                    runs, held = [], 0
                runs.append((path, 0, None))
                held += most
        return [*out, Part(runs)] if runs else out

    def read(self, part: Part) -> Iterator[tuple]:
        store = _store(self.folder)[0]
        for path, first, stop in part.runs:
            with store.open_input_file(path) as f, wave.open(f) as w:
                frames, rate, channels, width = w.getnframes(), w.getframerate(), w.getnchannels(), w.getsampwidth()
                if width != 2:
                    raise ValueError(f"{path}: {8 * width} bits, not 16")
                total = self.before + frames + self.behind
                for block in range(first, -(-total // self.size) if stop is None else stop):
                    low = block * self.size - self.before  # in frames of the file; what lies outside is silent
                    a, b = max(0, min(frames, low)), max(0, min(frames, low + self.size))
                    samples = np.zeros(self.size)
                    if a < b:
                        w.setpos(a)
                        samples[a - low : b - low] = np.frombuffer(w.readframes(b - a), "<i2").reshape(-1, channels).mean(1) / 32768
                    yield path.rsplit("/", 1)[-1].rsplit(".", 1)[0], block, block * self.size / rate, (block + 1) * self.size >= total, samples.tolist()

    def commit(self, end: dict) -> None:
        pass


class WavBlocks(DataSource):
    """Blocks of the 16-bit WAV files of a folder, channels averaged. Options: path, block (samples), before and behind (silent samples around
    a file), files (of one trigger at most). New files must have names behind those that are there."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return BLOCK

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return WavReader(self.options)


class Chunks(StatefulProcessor):
    """Overlapping chunks of a key's samples; the samples that later chunks need are carried as state, `size` at most."""

    def __init__(self, key: str, size: int, step: int):
        if not 0 < step <= size:
            raise ValueError("step must lie between 1 and size")
        self.key, self.size, self.step = key, size, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carried", "block long, chunk long, samples binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        after, chunk, kept = self.state.get() if self.state.exists() else (-1, 0, b"")
        parts, have, out = [np.frombuffer(bytes(kept))], len(kept) // 8, []
        blocks = pd.concat(list(rows)).sort_values("block")  # one trigger's blocks of one key
        for block, last, samples in blocks[["block", "last", "samples"]].itertuples(index=False):
            if block <= after:
                raise ValueError(f"block {block} of {key[0]} comes behind {after}")
            after, own = block, np.asarray(samples, np.float64)
            parts.append(own)
            have += len(own)
            if have >= self.size or last:
                x = np.concatenate(parts)
                # Of D samples ceil((D - size + step) / step) chunks, one at least: the next one is due if some sample has been in none.
                while len(x) >= self.size or last and (len(x) > self.size - self.step or not chunk):
                    part = x[: self.size]
                    out.append((key[0], chunk, len(part), np.pad(part, (0, self.size - len(part)))))
                    chunk, x = chunk + 1, x[self.step :]
                parts, have = [x], len(x)
        self.state.update((after, chunk, np.concatenate(parts).tobytes()))
        yield pd.DataFrame({self.key: [r[0] for r in out], "chunk": [r[1] for r in out], "length": [r[2] for r in out], "samples": [r[3] for r in out]})

    def close(self) -> None:
        pass


def chunked(blocks: DataFrame, key: str, kind: str, size: int, step: int) -> DataFrame:
    """(key, chunk, length, samples): chunks of `size` samples that begin every `step` ones, from a stream of (key, block, last, samples);
    the last one is filled with zeros, length counts its own samples. Start it inside buffers.list_state."""
    rows = blocks.select(key, "block", "last", "samples").groupBy(key)
    return rows.transformWithStateInPandas(Chunks(key, size, step), f"{key} {kind}, chunk long, length long, samples array<double>", "Append", "None")


def processed(chunks: DataFrame, key: str, kind: str, process: Callable[[np.ndarray], float]) -> DataFrame:
    """(key, chunk, length, value, error): what process gives for each chunk, or its error as a record; no chunk ends the stream."""
    schema = pa.schema([("value", pa.float64()), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: list[tuple] = []
            for samples in b.column("samples"):
                try:
                    got.append((float(process(np.array(samples.as_py()))), None))
                except Exception as e:  # whatever a model raises
                    got.append((None, str(e)))
            values = [pa.array([g[k] for g in got], t.type) for k, t in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "chunk", "length")), *values], names=[key, "chunk", "length", "value", "error"])

    return chunks.mapInArrow(run, f"{key} {kind}, chunk long, length long, value double, error string")
