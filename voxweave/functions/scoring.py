"""Models as functions over Arrow batches: loaded once a worker, with a fallback where a row fails."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame


class Model(Protocol):
    """What a scorer needs of a model: it is opened once for a task, scores lists, and is closed at the end."""

    def open(self) -> None: ...

    def score(self, items: list[Any]) -> list[Any]: ...

    def close(self) -> None: ...


def scored(rows: DataFrame, column: str, make: Callable[[], Model], out: str, kind: str, batch: int = 64) -> DataFrame:
    """rows with column `out`: the model's answers to `column`. A batch that fails is scored row by row, a row that fails is
    null; null items are never asked. A model that can't be opened fails the task."""
    types = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def answers(model: Model, items: list[Any]) -> list[Any]:
        try:
            got = list(model.score(items))
            if len(got) != len(items):
                raise ValueError("as many answers as items are needed")
            return got
        except Exception:
            if len(items) == 1:
                return [None]
            return [x for item in items for x in answers(model, [item])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        model.open()
        try:
            for b in batches:
                items = b.column(column).to_pylist()
                there = [i for i, x in enumerate(items) if x is not None]
                got: list[Any] = [None] * len(items)
                for at in range(0, len(there), batch):
                    part = there[at : at + batch]
                    for i, x in zip(part, answers(model, [items[i] for i in part]), strict=True):
                        got[i] = x
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, types[kind])], names=[*b.schema.names, out])
        finally:
            model.close()

    return rows.mapInArrow(run, f"{schema}, `{out}` {kind}")
