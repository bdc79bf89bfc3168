"""Encoders as columns: any object that turns a list of texts into lists of ids, loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import dealt


class Encoder(Protocol):
    def encode_batch(self, texts: list[str]) -> list[list[int]]: ...


class ByteEncoder:
    """The bytes of UTF-8, each one id."""

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [list(t.encode()) for t in texts]


class FileEncoder:
    """A tokenizer file of the tokenizers library, without special tokens, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer  # only where it is used

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(rows: DataFrame, column: str, make: Callable[[], Encoder], out: str = "ids", batch: int = 256) -> DataFrame:
    """rows with the ids of a text column; a null text has no ids. Rows are dealt out anew, as encoding costs far more than reading."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.slice(at, batch)
                ids = encoder.encode_batch([t or "" for t in part.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int64()))], names=[*part.schema.names, out])

    return dealt(rows).mapInArrow(run, f"{schema}, `{out}` array<bigint>")
