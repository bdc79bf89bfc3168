"""Ogg files: round trips, times, damage and awkward rows."""

import collections
import hashlib
import struct
import zlib

import pytest

from voxweave.llm import ogg_media

TEXTS = [None, "", " ", "one", "x" * 63, "x" * 64, "x" * 65, "é" * 3000, "abc " * 40_000, "one"]


def payload_of(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def test_digests(spark):
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(TEXTS)], "doc_id int, text string, n_bytes int, media binary")
    got = ogg_media.media_digests(ogg_media.to_media(docs)).collect()
    want = collections.Counter((i, len((t or "").encode()), len(p := payload_of(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in enumerate(TEXTS))
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    for r in got:
        media = ogg_media.write_ogg(payload_of(TEXTS[r["doc_id"]]))
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest() and r["error"] is None
        assert f"packets={-(-r['payload_bytes'] // ogg_media.PACKET)};" in r["feature"]
    assert ogg_media.media_digests(ogg_media.to_media(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        ogg_media.to_media(docs.selectExpr("cast(doc_id as string) AS doc_id", "text"))


def test_packets_have_times_of_their_own_stream():
    payload = bytes(range(256)) * 800  # 204,800 samples: 52 packets over two streams
    packets, info = ogg_media.read_packets(ogg_media.write_ogg(payload))
    assert b"".join(p[4] for p in packets) == payload and info["pages"] > 4
    heard = collections.Counter()
    for k, (stream, number, start, end, data) in enumerate(packets):
        assert (stream, number) == (k % 2, k // 2)
        assert start == heard[stream] / 8000 and end == (heard[stream] + len(data)) / 8000
        heard[stream] += len(data)
    assert info["ends"] == [heard[0] / 8000, heard[1] / 8000] and sum(heard.values()) == len(payload)


def changed(media, at, value):
    """A page's byte changed, with the page's checksum made right again."""
    out = bytearray(media)
    out[at] = value
    page = out.rfind(b"OggS", 0, at + 1)
    end = out.find(b"OggS", page + 4)
    end = len(out) if end < 0 else end
    out[page + 22 : page + 26] = bytes(4)
    out[page + 22 : page + 26] = struct.pack("<I", ogg_media.page_crc(bytes(out[page:end])))
    return bytes(out)


def test_damage_is_told_and_fails_no_job(spark):
    good = ogg_media.write_ogg(b"\1" * 9000)
    second = good.find(b"OggS", good.find(b"OggS", 4) + 4)
    media = {
        1: good, 2: None, 3: b"", 4: good[:-1], 5: good[:-1] + b"\2", 6: good + b"x" * 40, 7: good[second:], 8: changed(good, second + 6, 99),
        9: changed(good, 28 + 3, 0), 10: good[:20], 11: changed(good, 5, 6), 12: good + good,
    }
    rows = spark.createDataFrame([(i, 9000, m) for i, m in media.items()], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in ogg_media.media_digests(rows).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 9000
    assert all(r["error"] and r["payload_sha256"] is None and r["feature"] is None for i, r in got.items() if i > 1), got
    assert got[2]["media_bytes"] is None and got[3]["media_bytes"] == 0 and "checksum" in got[5]["error"] and "position" in got[8]["error"]
    packets = ogg_media.media_packets(rows).collect()
    assert [(r["stream"], r["packet"], r["start"], r["end"], r["n_bytes"]) for r in packets if r["doc_id"] == 1] == [(0, 0, 0.0, 0.5, 4000), (1, 0, 0.0, 0.5, 4000), (0, 1, 0.5, 0.625, 1000)]
    assert sum(r["doc_id"] > 1 for r in packets) == len(media) - 1 and all(r["error"] for r in packets if r["doc_id"] > 1)


def test_checksum_bit_by_bit():
    slow = 0
    for byte in b"check sum":
        slow ^= byte << 24
        for _ in range(8):
            slow = (slow << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if slow >> 31 else slow << 1
    assert ogg_media.page_crc(b"check sum") == slow
