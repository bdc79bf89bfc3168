"""Arrays of any size, buffers and chunks with state, WAV files in and out: against plain versions, cut and stopped anywhere."""

import json
import math
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxweave.operators.samples import first_fit
from voxweave.plans import catalog, streams  # noqa: F401
from voxweave.sources.json_arrays import json_array
from voxweave.sources.wav_sink import WavWriter
from voxweave.streaming.audio import Chunks, WavReader
from voxweave.streaming.buffers import TokenBuffer, take

SCHEMA = "id long, t string, m struct<a:array<long>,b:struct<c:string>>"
ITEMS = [{"id": 1, "t": 'a}b{"[\\'}, {"id": 2, "m": {"a": [1, 2], "b": {"c": "}]"}}}, {"id": 3, "t": "\\", "m": {"a": [], "b": {"c": '\\"'}}}, {"id": 4, "t": "x\n\ty ü中"}]


@pytest.fixture()
def split_size(spark):
    names = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        for n, v in names.items():
            spark.conf.set(n, v or str(size))

    yield put
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


@pytest.mark.parametrize("size", [1, 2, 5, 11, 64, 10_000])
def test_array_cut_anywhere(spark, tmp_path, split_size, size):
    (tmp_path / "a.json").write_text(" \n[\n" + ",\n".join(json.dumps(i, ensure_ascii=False) for i in ITEMS) + "\n]\n")
    (tmp_path / "b.json").write_text('[{"id": 5},,{"id": 6},]')
    (tmp_path / "c.json").write_text("[ ]\n")
    split_size(size)
    got = json_array(spark, str(tmp_path), SCHEMA)
    assert size > 2 or got.rdd.getNumPartitions() > 1
    rows = {r["id"]: r.asDict(recursive=True) for r in got.collect()}
    want = {i["id"]: {"id": i["id"], "t": i.get("t"), "m": i.get("m")} for i in [*ITEMS, {"id": 5}, {"id": 6}]}
    assert rows == want


@pytest.mark.parametrize("text", ["[1]", '[{"id":1},2]', '{"id":1}', '[{"id":1}', '[{"id":1},{"id":', '[{"id":1}] {"id":2}', '[{"id":"x"}]', '["a}",{"id":1}]', '[{"id":1}, "]"]'])
def test_array_of_other_things_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="no object|MALFORMED_RECORD"):
        json_array(spark, str(tmp_path), SCHEMA).collect()


class Kept:
    """State that a test looks into; what is put in is copied, as through a checkpoint."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = [tuple(x) for x in value]

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states = {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Kept())

    getValueState = getListState


def triggers(draw, n):
    cuts = sorted(draw(st.lists(st.integers(0, n), max_size=5)))
    return [r for r in zip([0, *cuts], [*cuts, n], strict=True) if r[0] < r[1]]


@settings(max_examples=200, deadline=None)
@given(st.data(), st.lists(st.integers(1, 30), min_size=1, max_size=60), st.booleans())
def test_buffer_stopped_anywhere_packs_as_one_pass(data, sizes, force):
    handle, out = Handle(), {}
    for a, b in triggers(data.draw, len(sizes)):
        made = TokenBuffer("k", "ord", "n", 20, 4, force)  # each trigger in a new process
        made.init(handle)
        rows = pd.DataFrame({"ord": range(a, b), "n": sizes[a:b]}).sample(frac=1, random_state=1)
        for pdf in made.handleInputRows((7,), iter([rows.iloc[::2], rows.iloc[1::2]]), None):
            out |= dict(zip(pdf["ord"], pdf["batch"], strict=True))
    rest, batch = list(handle.states["waiting"].get() or []), handle.states["counts"].get()[1]
    while rest:
        taken, rest = take(rest, 20, force)
        out |= {i: batch for i, _ in taken}
        batch += 1
    assert [out.get(i, -1) for i in range(len(sizes))] == first_fit(sizes, 20, 4, force)


def test_buffer_that_lost_samples_is_an_error():
    handle = Handle()
    made = TokenBuffer("k", "ord", "n", 100, 4, False)
    made.init(handle)
    list(made.handleInputRows((1,), iter([pd.DataFrame({"ord": [1, 2], "n": [5, 6]})]), None))
    handle.states["waiting"].value.pop()
    with pytest.raises(ValueError, match="5 tokens instead of 11"):
        list(made.handleInputRows((1,), iter([pd.DataFrame({"ord": [3], "n": [1]})]), None))


@settings(max_examples=200, deadline=None)
@given(st.data(), st.lists(st.integers(0, 12), min_size=1, max_size=12), st.integers(1, 20))
def test_chunks_of_blocks(data, lengths, size):
    step = data.draw(st.integers(1, size))
    x = np.arange(1.0, sum(lengths) + 1)
    blocks = np.split(x, np.cumsum(lengths)[:-1])
    handle, out = Handle(), []
    for a, b in triggers(data.draw, len(blocks)):
        made = Chunks("name", size, step)
        made.init(handle)
        rows = pd.DataFrame({"block": range(a, b), "last": [i == len(blocks) - 1 for i in range(a, b)], "samples": blocks[a:b]})
        for pdf in made.handleInputRows(("f",), iter([rows]), None):
            out += list(pdf[["chunk", "length", "samples"]].itertuples(index=False, name=None))
    n = max(1, math.ceil((len(x) - size + step) / step))
    assert [o[0] for o in out] == list(range(n))
    for k, length, samples in out:
        want = x[k * step : k * step + size]
        assert length == len(want) and len(samples) == size and list(samples) == [*want, *[0] * (size - len(want))]


def test_blocks_of_the_past_are_an_error():
    made = Chunks("name", 4, 2)
    made.init(Handle())
    rows = lambda k: iter([pd.DataFrame({"block": [k], "last": [False], "samples": [np.ones(3)]})])
    list(made.handleInputRows(("f",), rows(3), None))
    with pytest.raises(ValueError, match="comes behind"):
        list(made.handleInputRows(("f",), rows(3), None))


def written(path, rows, rate=16_000):
    sink = WavWriter(str(path), rate)
    batch = pa.RecordBatch.from_pylist([{"name": n, "samples": s} for n, s in rows], pa.schema([("name", pa.string()), ("samples", pa.list_(pa.float64()))]))
    return sink, sink.write(iter([batch]))


def test_wav_files_of_counted_attempts_only(tmp_path):
    sink, first = written(tmp_path, [("a", [0.5, -1.0, 2.0]), ("b", None)])
    sink.write(iter([pa.RecordBatch.from_pylist([{"name": "a", "samples": [0.25]}])]))  # the same task, doubled
    assert not list(tmp_path.glob("*.wav"))
    sink.commit([first])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    with wave.open(str(tmp_path / "a.wav")) as w:
        assert (w.getnchannels(), w.getframerate(), w.readframes(9)) == (1, 16_000, np.array([16384, -32768, 32767], "<i2").tobytes())
    sink, message = written(tmp_path, [("c", [0.1])])
    sink.abort([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.wav", "b.wav"]
    with pytest.raises(ValueError, match="names no file"):
        written(tmp_path, [("x/y", [0.0])])


def test_wav_blocks_from_offset_to_offset(tmp_path):
    sink, message = written(tmp_path, [("a", [k / 100 for k in range(37)]), ("b", [0.5] * 8), ("c", [])], 8000)
    sink.commit([message])
    reader = WavReader({"path": str(tmp_path), "block": "10", "before": "3", "behind": "2", "files": "2"})
    start, seen = reader.initialOffset(), []
    for name in ("b", "c", "c"):
        end = reader.latestOffset()
        assert end == {"name": f"{name}.wav"}
        seen += [r for p in reader.partitions(start, end) for r in reader.read(p)]
        again = WavReader({"path": str(tmp_path), "block": "10", "before": "3", "behind": "2"})  # a restarted driver plans the same
        assert [r for p in again.partitions(start, end) for r in again.read(p)] == [r for r in seen if start["name"] < f"{r[0]}.wav" <= end["name"]]
        start = end
    assert [(r[0], r[1], r[3]) for r in seen] == [("a", 0, False), ("a", 1, False), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("b", 0, False), ("b", 1, True), ("c", 0, True)]
    whole = np.concatenate([r[4] for r in seen if r[0] == "a"])
    assert np.allclose(whole, [0] * 3 + [round(k / 100 * 32768) / 32768 for k in range(37)] + [0] * 10) and seen[1][2] == 10 / 8000


def test_short_wav_files_share_tasks_and_long_ones_are_cut(tmp_path, monkeypatch):
    monkeypatch.setattr("voxweave.streaming.audio.TASK_BLOCKS", 40)
    sink, message = written(tmp_path, [(f"f{k:03}", [k / 200] * (k % 7)) for k in range(100)] + [("long", [0.5] * 950)])
    sink.commit([message])
    reader = WavReader({"path": str(tmp_path), "block": "10"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    rows = [r for p in parts for r in reader.read(p)]
    assert sorted({r[0] for r in rows}) == [*(f"f{k:03}" for k in range(100) if k % 7), "long"] and len(rows) == len({r[:2] for r in rows})
    assert [r[1] for r in rows if r[0] == "long"] == list(range(95)) and len(parts) < 20
    assert max(len(list(reader.read(p))) for p in parts) == 40


def test_the_array_query_writes_with_many_tasks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(streams.json_arrays, "json_array", lambda s, path, schema: seen.append(path) or json_array(s, path, schema))
    assert streams.source_json_array(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    files = [r["value"] for r in spark.read.text(seen[0], wholetext=True).collect()]
    assert len(files) > 8 and all(f.startswith("[") and f.rstrip().endswith("]") for f in files)
