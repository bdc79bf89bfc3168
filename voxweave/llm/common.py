"""Pieces that several training-data operators share: scratch tables, word hashes, grouped streams, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in slices of about this many bytes, so that memory doesn't follow the Arrow batch.
SLICE_BYTES = 4 << 20
#: Words whose hashes a Python worker remembers; further words are hashed again each time.
MEMO_WORDS = 400_000
#: Rows of one Arrow batch: documents may be long.
BATCH_ROWS = 1000

U64 = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows, unless the session names another number than Spark's own."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


class Scratch:
    """Tables written in the shared folder named in spark.checkpoint.dir, which cut the lineage of a query; they go when the
    driver ends, as results may still read them.

    The folder is read from the session; only where it is unset (local tests) a folder of its own is made.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="voxweave-")
            spark.conf.set("spark.checkpoint.dir", base)
        small_batches(spark)
        self.spark, self.base = spark, f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """df, computed once and read back."""
        schema, path = df.schema, f"{self.base}/{len(self.paths)}-{name}"
        self.paths[f"{len(self.paths)}-{name}"] = self.paths[name] = path
        df.write.parquet(path, compression=compression)
        del df
        if len(self.paths) == 2:  # the first table: its folder is there now
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        return self.spark.read.schema(schema).parquet(path)

    def ship(self, name: str, data: bytes) -> None:
        """Write a file in the shared folder and have Spark copy it to every executor, later ones too (SparkFiles)."""
        sc = self.spark.sparkContext
        if any(f.endswith(f"/{name}") for f in sc.listFiles):
            return
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(data))
        out.close()
        sc.addFile(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more, and let Spark remove the shuffle files of ended jobs."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[name])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return int


def trimmed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """run for mapInArrow; what a task has freed goes back to the system when it ends, as Spark keeps its workers for later tasks."""

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return out


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; whatever else the table has can't clash with an operator's own names. Ids become longs."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    for n in names:
        if n in ("doc_id", "page_id") and kinds[n] not in ("bigint", "int", "smallint", "tinyint", "void"):
            raise ValueError(f"{n} must hold whole numbers, not {kinds[n]}")
    return df.select(*(F.col(n).cast("long") if n in ("doc_id", "page_id") and kinds[n] != "bigint" else F.col(n) for n in names))


def text_key(text: Column) -> list[Column]:
    """128 bits of a text as two longs, computed in the JVM; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(2654435761) + U64(seed)) | U64(1)


class Memo(dict):
    """word -> value; a bounded number of words is remembered."""

    def __init__(self, of: Callable, limit: int = MEMO_WORDS):
        self.of, self.limit = of, limit

    def __missing__(self, word):
        x = self.of(word)
        if len(self) < self.limit:
            self[word] = x
        return x


#: Bytes that are hashed together, and the longest word that is hashed with others.
PIECE, LONG_WORD = 1 << 20, 4096
_SPACES = b" \t\n\v\f\r"
_SPACE = np.isin(np.arange(256), list(_SPACES))
_BASE = int(odd_numbers(1, 91)[0])
_BYTES = {lower: mix(np.frombuffer(x, np.uint8).astype(U64) + U64(1000)) for lower, x in ((False, bytes(range(256))), (True, bytes(range(256)).lower()))}


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64."""
    up, down = np.full(PIECE + 1, _BASE, U64), np.full(PIECE + 1, pow(_BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class HashedWords:
    """The words of a buffer of UTF-8, what ASCII white space separates: 64-bit hashes, first byte and end of each.

    A word's hash is a polynomial of random numbers for its bytes, taken from differences of running sums, so no word becomes
    an object; words of more than LONG_WORD bytes are hashed by xxhash. lower: A-Z count as a-z.
    """

    def __init__(self, raw: bytes, lower: bool = False):
        hashes, starts, ends, at = [], [], [], 0
        up, down = _powers()
        while at < len(raw):
            piece = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)
            space = _SPACE[piece]
            if at + len(piece) < len(raw):  # cut behind the last white space
                last = len(piece) - int(space[::-1].argmax()) if space.any() else 0
                if not last:  # a word that is longer than a piece
                    stop = min((k for c in _SPACES if (k := raw.find(c, at)) >= 0), default=len(raw))
                    starts.append([at])
                    ends.append([stop])
                    hashes.append(self._long([raw[at:stop]], lower))
                    at = stop
                    continue
                piece, space = piece[:last], space[:last]
            edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
            start, end = edge[::2], edge[1::2]
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum(_BYTES[lower][piece] * up[: len(piece)], out=sums[1:])
            h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
            if len(long := np.flatnonzero(end - start > LONG_WORD)):
                h[long] = self._long([raw[at + a : at + b] for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], lower)
            hashes.append(h)
            starts.append(start + at)
            ends.append(end + at)
            at += len(piece)
        self.hashes = np.concatenate([np.zeros(0, U64), *hashes])
        self.start, self.end = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, ends))

    @staticmethod
    def _long(words: list[bytes], lower: bool) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(w.lower() if lower else w, 1) for w in words], U64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words that hold no white space."""
    return HashedWords(b" ".join(words)).hashes


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(lengths: Iterable[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about `most` bytes; a longer item stands alone."""
    start, total, i = 0, 0, 0
    for i, n in enumerate(lengths, 1):
        if total and total + n > most:
            yield start, i - 1
            start, total = i - 1, 0
        total += n
    if i > start:
        yield start, i


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names), strict=True)


def groups_of(batches: Iterable[pa.RecordBatch], keys: int, names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of neighbouring rows with equal first `keys` columns; the partition must be sorted by them."""
    for key, rows in itertools.groupby(rows_of(batches, names), key=lambda r: r[:keys]):
        yield key, list(rows)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node in edges (a, b: long): the same root exactly for nodes that edges connect.

    Each round every node hooks to the neighbour (or itself) that comes first in an order drawn anew for the round, and
    the edges are contracted: no node ever gathers its neighbours, only a minimum, so hubs are pre-aggregated.
    """
    e, maps = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0"), []
    while not e.isEmpty():
        n = len(maps)
        rank = lambda c, n=n: F.struct(F.xxhash64(F.lit(n), F.col(c)).alias("h"), F.col(c).alias("to"))
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["to"].alias("up"))
        up = scratch.keep(up, f"{name}-m{n}")
        maps.append(up)
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        e = e.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = scratch.keep(e, f"{name}-e{n + 1}")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0].select("node", F.col("up").alias("root"))
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return scratch.keep(out, f"{name}-roots") if len(maps) > 1 else out
