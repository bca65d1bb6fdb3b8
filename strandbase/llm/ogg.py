"""Media columns: Ogg. Bytes are stored as 8-bit samples in the packets of two interleaved logical streams, and read back.

Writing: a stream begins with a header packet (magic, rate, stream number); samples are cut into packets of PACKET
bytes, dealt to the streams in turn; pages carry lacing values, granule positions (samples of the stream so far) and checksums.

Reading: every page's checksum is verified, packets are put together from lacing values (255 continues), pages are sorted
to their logical streams by serial number, page sequence numbers must be gapless, and timestamps are granule / rate.

Defined results: a null text counts as empty; the payload is never empty (64 zero bytes at least); equal texts give equal bytes and
features; very long texts only make more pages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, pick

UNIT = 64
RATE = 8000
PACKET = 4080
STREAMS = 2
_MAGIC = b"BYTES8\0\0"
_PAGE = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC (polynomial 0x04C11DB7, not reflected, from 0), by way of zlib's reflected one on mirrored bytes."""
    c = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_MIRROR), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(flags: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """packets: (bytes, granule at the packet's end). The first packet has a page of its own; others share pages of 255 laces."""
    out, number = [], 0

    def put(laces: bytes, body: bytes, granule: int, cont: bool, last: bool):
        nonlocal number
        flags = (1 if cont else 0) | (2 if number == 0 else 0) | (4 if last else 0)
        out.append(page(flags, granule, serial, number, laces, body))
        number += 1

    put(lacing(len(packets[0][0])), packets[0][0], packets[0][1], False, len(packets) == 1)
    laces, body, ends = b"".join(lacing(len(p)) for p, _ in packets[1:]), b"".join(p for p, _ in packets[1:]), []
    at = 0
    for p, granule in packets[1:]:
        at += len(p) // 255 + 1
        ends.append((at, granule))
    start = taken = e = 0
    while start < len(laces):
        part = laces[start : start + 255]
        size, granule = sum(part), -1
        while e < len(ends) and ends[e][0] <= start + len(part):
            granule = ends[e][1]
            e += 1
        put(part, body[taken : taken + size], granule, start > 0 and laces[start - 1] == 255, start + len(part) == len(laces))
        start, taken = start + len(part), taken + size
    return out


def write(payload: bytes, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """An Ogg file of the payload's bytes."""
    tracks: list[list[tuple[bytes, int]]] = [[(_MAGIC + struct.pack("<IHH", rate, k, streams), 0)] for k in range(streams)]
    for i in range(0, len(payload), PACKET):
        t = tracks[i // PACKET % streams]
        t.append((payload[i : i + PACKET], t[-1][1] + len(payload[i : i + PACKET])))
    paged = [pages_of(t, 1000 + k) for k, t in enumerate(tracks)]
    return b"".join(p[i] for i in range(max(map(len, paged))) for p in paged if i < len(p))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    open: bytes | None = None
    ended: bool = False


def read(data: bytes) -> dict[int, Stream]:
    """The logical streams of a file, by serial number. Raises ValueError on any damage."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _PAGE.size:
            raise ValueError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise ValueError("no page begins here")
        laces = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(laces)
        if len(laces) < n or end > len(data):
            raise ValueError("a page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or bool(flags & 2) != (number == 0) or bool(flags & 1) != (s.open is not None) or s.ended:
            raise ValueError("pages are missing or out of order")
        s.pages, s.ended = s.pages + 1, bool(flags & 4)
        body, parts = at + 27 + n, [s.open or b""]
        for lace in laces:
            parts.append(data[body : body + lace])
            body += lace
            if lace < 255:
                s.packets.append(b"".join(parts))
                parts = []
        s.open = b"".join(parts) if laces and laces[-1] == 255 else None
        if granule >= 0:
            s.granules.append(granule)
        at = end
    if any(s.open is not None or not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, int]:
    """The payload from the demultiplexed streams, and the sample rate."""
    tracks = {}
    for s in streams.values():
        head = s.packets[0]
        if head[:8] != _MAGIC:
            raise ValueError("unknown stream")
        rate, k, n = struct.unpack("<IHH", head[8:16])
        tracks[k] = s.packets[1:]
        if s.granules[-1] != sum(map(len, s.packets[1:])):
            raise ValueError("the last granule position is not the stream's length")
    if sorted(tracks) != list(range(n)):
        raise ValueError("a stream is missing")
    return b"".join(tracks[i % n][i // n] for i in range(sum(map(len, tracks.values())))), rate


def feature(streams: dict[int, Stream], rate: int, payload: bytes) -> str:
    """Streams, pages, packets, end time of each stream in ms, mean and deviation of the samples about 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    mean = int(x.sum()) * 1000 // len(x)
    power = int((x * x).sum()) * 1000 // len(x)
    order = [streams[k] for k in sorted(streams)]
    ends = "/".join(str(s.granules[-1] * 1000 // rate) for s in order)
    return f"streams={len(order)};pages={sum(s.pages for s in order)};packets={sum(len(s.packets) for s in order)};end_ms={ends};mean_m={mean};power_m={power}"


def page_times(streams: dict[int, Stream], rate: int) -> str:
    """The time in ms at which each page ends that ends a packet, of each stream."""
    return "/".join(",".join(str(g * 1000 // rate) for g in streams[k].granules) for k in sorted(streams))


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit or (unit if not data else 0))


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """One row for each row of df: doc_id, sizes and digests of payload and media, feature, page times and, if asked, media (binary)."""
    t = pick(df, doc_id=id_col, text=text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch["text"].to_pylist():
            raw = (text or "").encode()
            media = write(padded(raw))
            streams = read(media)
            back, rate = payload_of(streams)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(streams, rate, back), page_times(streams, rate), *([media] if with_media else [])))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "page_ms", "media"]
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, types, strict=False))], ["doc_id", *names[: len(cols)]])

    kind = t.schema["doc_id"].dataType.simpleString()
    return map_texts(t, fn, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, page_ms string" + (", media binary" if with_media else ""))


def op9_ogg(spark, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)
