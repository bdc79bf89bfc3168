"""Resampling, fixed spectra, Arrow files and tar shards."""

import io
import pickle
import tarfile

import numpy as np
import pyarrow as pa
import pytest

from voxweave.functions.resampling import fitted, log_spectrum, resample
from voxweave.sources.arrow_files import ArrowFiles, ArrowWriter
from voxweave.sources.tar_shards import TarReader, TarShards, split_name, virtual_epoch


@pytest.mark.parametrize(("rate", "to"), [(16_000, 24_000), (44_100, 16_000), (8000, 16_000), (48_000, 16_000)])
def test_a_sine_keeps_level_and_frequency(rate, to):
    t = np.arange(rate) / rate
    y = resample(np.stack([np.sin(2 * np.pi * 440 * t), np.ones(rate)]), rate, to)
    assert y.shape == (2, to)
    inside = slice(to // 20, -to // 20)
    want = np.sin(2 * np.pi * 440 * np.arange(to) / to)
    assert np.abs(y[0] - want)[inside].max() < 2e-3 and np.abs(y[1][inside] - 1).max() < 2e-3


def test_what_the_new_rate_cannot_hold_goes():
    t = np.arange(48_000) / 48_000
    assert np.abs(resample(np.sin(2 * np.pi * 15_000 * t), 48_000, 16_000)[0, 800:-800]).max() < 5e-3


def test_resampling_by_the_sum_itself():
    from voxweave.functions.resampling import filter_of

    x, up, down = np.random.default_rng(0).normal(size=23), 3, 5
    h = filter_of(up, down)
    half = len(h) // 2
    want = [sum(x[k] * h[n * down + half - k * up] for k in range(len(x)) if 0 <= n * down + half - k * up < len(h)) for n in range(-(-len(x) * up // down))]
    assert np.allclose(resample(x, 5, 3)[0], want)
    assert resample(np.zeros((2, 0)), 2, 3).shape == (2, 0) and np.array_equal(resample(x, 7, 7)[0], x)


def test_fixed_length_and_spectrum():
    assert fitted([1, 2, 3], 8).tolist() == [[1, 2, 3, 1, 2, 3, 1, 2]] and fitted(np.zeros((1, 0)), 2).tolist() == [[0, 0]]
    s = log_spectrum(fitted(np.sin(2 * np.pi * 1000 * np.arange(5000) / 16_000), 160_000))
    assert s.shape == (1, 1001, 161) and (s[0, 3:20].argmax(1) == 20).all() and log_spectrum(np.zeros((1, 320))).max() == -7


def test_arrow_files(spark, tmp_path):
    spark.dataSource.register(ArrowFiles)
    df = spark.createDataFrame([(i, f"t{i}", [i, i]) for i in range(50)], "id long, t string, `odd name` array<int>")
    df.repartition(3).write.format("arrow_files").mode("append").option("path", str(tmp_path / "a")).save()
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("more", pa.int8()), ("odd name", pa.list_(pa.int32())), ("t", pa.string()), ("id", pa.int32())])) as out:
        for k in range(5):  # other order, other width, one column more, a batch each
            out.write_batch(pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([[k]], pa.list_(pa.int32())), pa.array([None], pa.string()), pa.array([100 + k], pa.int32())], schema=out.schema if hasattr(out, "schema") else pa.schema([("more", pa.int8()), ("odd name", pa.list_(pa.int32())), ("t", pa.string()), ("id", pa.int32())])))
    got = spark.read.format("arrow_files").option("path", f"{tmp_path / 'a'}, {tmp_path / 'b.arrow'}").option("batches", 2).load()
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [*((i, f"t{i}", [i, i]) for i in range(50)), *((100 + k, None, [k]) for k in range(5))]
    writer = ArrowWriter({"path": str(tmp_path / "c")})
    message = writer.write(iter([pa.RecordBatch.from_pydict({"x": [1]})]))
    writer.abort([message])
    assert not list((tmp_path / "c").iterdir())


def shard(path, names):
    with tarfile.open(path, "w") as tar:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 700
            tar.addfile(info, io.BytesIO(name.encode().ljust(700, b".")))


def test_tar_shards_cut_between_samples(tmp_path):
    names = [f"d{k % 3}/s{k:03}.{x}" for k in range(40) for x in ("txt", "a.json", "wav")[: 1 + k % 3]]
    shard(tmp_path / "one.tar", names)
    shard(tmp_path / "two.tar", ["only.txt"])
    want = {}
    for n in [*names, "only.txt"]:
        key, suffix = split_name(n)
        want.setdefault(key, {})[suffix] = n
    for size in (1, 3000, 20_000, 1 << 30):
        reader = TarReader({"path": str(tmp_path), "bytes": str(size)})
        parts = reader.partitions()
        rows = [r for p in parts for r in reader.read(p)]
        assert {k: {s: c.rstrip(b".").decode() for s, c in m.items()} for k, _, m in rows} == want and len(rows) == len(want)
        assert (len(parts) == 2) == (size > 1 << 20) and all(len(list(reader.read(p))) == 1 for p in parts) is (size == 1)


def test_many_small_tar_shards_share_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr("voxweave.sources.tar_shards.TASKS", 5)
    for k in range(60):
        shard(tmp_path / f"{k:02}.tar", [f"s{k:02}-{i}.txt" for i in range(8)])
    reader = TarReader({"path": str(tmp_path), "bytes": "2000"})  # shards of 20,480 bytes are larger, but not larger than a task's share
    scanned = []
    monkeypatch.setattr("voxweave.sources.tar_shards.cuts_of", lambda f, size: scanned.append(f))
    parts = reader.partitions()
    assert len(parts) == 5 and not scanned and len(pickle.dumps(reader)) < 500
    assert sorted(r[0] for p in parts for r in reader.read(p)) == [f"s{k:02}-{i}" for k in range(60) for i in range(8)]


def test_tar_shards_twice_the_same_member(tmp_path):
    shard(tmp_path / "x.tar", ["a.txt", "a.txt"])
    reader = TarReader({"path": str(tmp_path / "x.tar")})
    with pytest.raises(ValueError, match="twice"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_virtual_epoch(spark, tmp_path):
    spark.dataSource.register(TarShards)
    rows = spark.createDataFrame([(f"k{i}",) for i in range(7)], "key string")
    for length in (0, 3, 7, 16):
        got = sorted((r["_place"], r["key"]) for r in virtual_epoch(rows, ["key"], length).collect())
        assert got == [(i, f"k{i % 7}") for i in range(length)]
    assert virtual_epoch(rows.limit(0), ["key"], 5).count() == 0
    with pytest.raises(Exception, match="is no key"):
        spark.createDataFrame([("a.b", "", {})], "key string, shard string, members map<string,binary>").write.format("tar_shards").mode("append").option("path", str(tmp_path)).save()
