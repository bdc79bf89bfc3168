"""Media columns: Ogg containers of raw 8-bit streams, written to and read back from a binary column.

A payload is cut into packets that alternate between logical streams; a stream's granule position counts its own samples.
Reading verifies every page's checksum, joins packets from lacing values (also across pages), separates the streams by serial
number, and gives each packet its start and end from the granule positions: a page's position is the end of the last packet
that ends there, and those before it end where the next one begins. Packets of all streams are put in order by time, then by
the stream's index.

Null text counts as empty, and an empty payload is padded like any other; equal texts give equal bytes, since serial
numbers and every header come from constants; repeated rows and ties therefore repeat their values; an empty table gives
an empty result; other columns are ignored. Media that is null, empty or damaged has nulls and says why in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, need, slices, texts

# Fixed values of the container format.
MAGIC, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS = 255
# Fixed values of this codec: 8-bit mono samples at this rate, packets of this many samples, streams in turn.
RATE, PACKET, STREAMS, IDENT = 8000, 4000, 2, struct.Struct("<8sIII")
CODEC = b"raw8\0\0\0\1"
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """CRC-32 with polynomial 04c11db7, most significant bit first, no inversion: zlib's, over reversed bits."""
    x = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(REVERSED), "big")


class Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int, out: list[bytes]):
        self.serial, self.out, self.number = serial, out, 0
        self.lacing, self.parts, self.granule, self.carried = bytearray(), [], -1, False

    def flush(self, last: bool = False) -> None:
        flags = CONTINUED * self.carried | FIRST * (self.number == 0) | LAST * last
        body = b"".join(self.parts)
        head = HEADER.pack(MAGIC, 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing)) + self.lacing
        page = head + body
        self.out.append(page[:22] + struct.pack("<I", page_crc(page)) + page[26:])
        self.carried = bool(self.lacing) and self.lacing[-1] == 255
        self.number, self.lacing, self.parts, self.granule = self.number + 1, bytearray(), [], -1

    def packet(self, data: bytes, granule: int) -> None:
        at, left = 0, len(data) // 255 + 1
        while left:
            if len(self.lacing) == MOST_SEGMENTS:
                self.flush()
            n = min(left, MOST_SEGMENTS - len(self.lacing))
            end = n == left
            size = len(data) - at if end else n * 255
            self.lacing += b"\xff" * (n - end) + bytes([len(data) % 255]) * end
            self.parts.append(data[at : at + size])
            at, left = at + size, left - n
        self.granule = granule


def write_ogg(payload: bytes) -> bytes:
    """Packets in turn on STREAMS logical streams; each stream's pages come as its packets fill them."""
    out: list[bytes] = []
    streams, heard = [Writer(i + 1, out) for i in range(STREAMS)], [0] * STREAMS
    for i, s in enumerate(streams):
        s.packet(IDENT.pack(CODEC, RATE, i, STREAMS), 0)
        s.flush()
    for i, at in enumerate(range(0, len(payload), PACKET)):
        data = payload[at : at + PACKET]
        heard[i % STREAMS] += len(data)
        streams[i % STREAMS].packet(data, heard[i % STREAMS])
    for s in streams:
        s.flush(last=True)
    return b"".join(out)


class Damaged(ValueError):
    """A page or packet isn't as the container format demands."""


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(serial, number, flags, granule, lacing values, body) of each page whose checksum holds."""
    if not media:
        raise Damaged("no page")
    at = 0
    while at < len(media):
        if at + HEADER.size > len(media):
            raise Damaged("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        if magic != MAGIC or version:
            raise Damaged(f"no page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(media):
            raise Damaged("the last page is cut off")
        page = media[at:end]
        if page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise Damaged(f"checksum of page {number} of stream {serial}")
        yield serial, number, flags, granule, lacing, page[27 + n :]
        at = end


def demultiplex(media: bytes) -> dict[int, dict]:
    """Per serial number: packets, and for each the granule position of the page where it ends if it is the last one there
    (else -1); pages; whether the stream ended."""
    found: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, body in read_pages(media):
        if bool(flags & FIRST) != (serial not in found):
            raise Damaged(f"first page of stream {serial}")
        s = found.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "ended": False, "part": None})
        if number != s["pages"] or s["ended"] or bool(flags & CONTINUED) != (s["part"] is not None):
            raise Damaged(f"page {number} of stream {serial} is out of order")
        s["pages"], at, whole = number + 1, 0, len(s["packets"])
        part = s["part"] or []
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s["packets"].append(b"".join([*part, body[at : at + size]]))
                s["granules"].append(-1)
                at, size, part = at + size, 0, []
        s["part"] = [*part, body[at : at + size]] if lacing and lacing[-1] == 255 else None
        if len(s["packets"]) > whole:
            s["granules"][-1] = granule
        elif granule != -1:
            raise Damaged(f"page {number} of stream {serial} ends no packet but has a position")
        s["ended"] = bool(flags & LAST)
    for serial, s in found.items():
        if not s["ended"] or s["part"] is not None:
            raise Damaged(f"stream {serial} doesn't end")
    return found


def times(sizes: list[int], granules: list[int]) -> list[tuple[int, int]]:
    """Start and end of each packet in samples, backwards from the positions of pages; a packet lasts its own samples."""
    out, end = [], None
    for size, granule in zip(reversed(sizes), reversed(granules), strict=True):
        if granule >= 0:
            if end is not None and end != granule:
                raise Damaged("granule positions don't fit the packets")
            end = granule
        if end is None:
            raise Damaged("the last packet has no position")
        out.append((end - size, end))
        end -= size
    if end:
        raise Damaged("granule positions don't begin at 0")
    return out[::-1]


def read_packets(media: bytes) -> tuple[list[tuple[int, int, float, float, bytes]], dict]:
    """(stream, number in it, start and end in seconds, data) of all packets in order of time; and the counts of streams,
    pages and packets, and where each stream ends."""
    streams, packets, ends = demultiplex(media), [], {}
    for s in streams.values():
        if not s["packets"] or len(s["packets"][0]) != IDENT.size:
            raise Damaged("identification packet")
        codec, rate, index, count = IDENT.unpack(s["packets"][0])
        if codec != CODEC or not rate or count != len(streams) or index in ends:
            raise Damaged("identification packet")
        data = s["packets"][1:]
        at = times([len(x) for x in data], s["granules"][1:]) if data else []
        packets += [(index, k, a / rate, b / rate, x) for k, ((a, b), x) in enumerate(zip(at, data, strict=True))]
        ends[index] = at[-1][1] / rate if at else 0.0
    packets.sort(key=lambda p: (p[2], p[0], p[1]))
    return packets, {"streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(packets), "ends": [e for _, e in sorted(ends.items())]}


def read_ogg(media: bytes) -> tuple[bytes, dict]:
    """The payload, and features: streams, pages, packets, each stream's last time stamp and the longest in seconds."""
    packets, info = read_packets(media)
    return b"".join(p[4] for p in packets), info | {"seconds": max(info["ends"])}


def feature_of(payload: bytes, info: dict) -> str:
    """Counts and times of the container, and mean, root mean square and zero crossings of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    square, crossings = int(np.dot(x, x)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    ends = ",".join(f"{e:.6f}" for e in info["ends"])
    return f"streams={info['streams']};pages={info['pages']};packets={info['packets']};seconds={info['seconds']:.6f};ends={ends};mean={int(x.sum()) / len(x):.4f};rms={(square / len(x)) ** 0.5:.4f};crossings={crossings}"


def pad(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an Ogg file in a binary column."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column("doc_id"), texts(b, "text")
            for i, j in slices(map(len, raw)):
                yield batch_of(schema, [ids[i:j], [len(x) for x in raw[i:j]], [write_ogg(pad(x)) for x in raw[i:j]]])

    return need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(media: bytes | None, of) -> tuple:
    """What `of` reads, and None; or None and why it can't be read."""
    if media is None:
        return None, "null"
    try:
        return of(media), None
    except Damaged as e:
        return None, str(e)


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: digests of payload and container, the feature string, and error."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for m in b.column("media").to_pylist():
                found, error = _read(m, read_ogg)
                payload = found and (len(found[0]), hashlib.sha256(found[0]).hexdigest(), zlib.crc32(found[0][-64:]))
                stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                for c, v in zip(out, (*(payload or (None, None, None)), *stored, feature_of(*found) if found else None, error), strict=True):
                    c.append(v)
            yield batch_of(schema, [b.column("doc_id"), b.column("n_bytes"), *out])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema))


def media_packets(media: DataFrame) -> DataFrame:
    """(doc_id, stream, packet, start, end, n_bytes, error): the packets of each file in order of time; a file that can't be
    read has one row with its error."""
    schema = pa.schema([("doc_id", pa.int64()), ("stream", pa.int64()), ("packet", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("n_bytes", pa.int64()), ("error", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                found, error = _read(m, read_packets)
                rows = [(i, *p[:4], len(p[4]), None) for p in found[0]] if found else [(i, *[None] * 5, error)]
                yield batch_of(schema, list(map(list, zip(*rows, strict=True))) if rows else [[] for _ in schema])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, stream long, packet long, start double, end double, n_bytes long, error string")
