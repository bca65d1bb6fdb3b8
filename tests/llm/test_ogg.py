"""Exact round trips, a checksum from first principles, and damage."""

import random

import pytest

from strandbase.llm.ogg import PACKET, checksum, padded, payload_of, read, write


def plain_checksum(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 2, 77, 300):
        data = rng.randbytes(n)
        assert checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, PACKET, PACKET + 1, 2 * PACKET, 3 * PACKET - 5, 300_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:n] == data and not any(payload[n:])
    back, rate = payload_of(read(write(payload)))
    assert back == payload and rate == 8000


def test_timestamps():
    streams = read(write(bytes(PACKET * 3)))
    assert [streams[k].granules[-1] for k in sorted(streams)] == [2 * PACKET, PACKET]


def test_damage():
    whole = write(padded(random.Random(5).randbytes(20_000)))
    rng = random.Random(6)
    for _ in range(200):
        at = rng.randrange(len(whole))
        broken = whole[:at] + bytes([whole[at] ^ 1 << rng.randrange(8)]) + whole[at + 1 :]
        with pytest.raises(ValueError):
            payload_of(read(broken))
    with pytest.raises(ValueError):
        read(whole[:-1])


def test_any_table(spark):
    import hashlib
    import zlib

    from strandbase.llm.ogg import media_column

    rows = [(1, "é text", "a"), (1, "é text", "a"), (None, None, None), (2, "", "b"), (3, "long " * 300_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string").selectExpr("*", "'x' as TEXT", "1 as feature")
    got = media_column(df).collect()
    assert len(got) == 5
    texts = {d: (t or "") for d, t, _ in rows}
    for r in got:
        payload = padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert payload_of(read(bytes(r.media)))[0] == payload and r.media_bytes == len(r.media)
        times = [[int(x) for x in p.split(",")] for p in r.page_ms.split("/")]
        assert all(p == sorted(p) for p in times) and "/".join(str(p[-1]) for p in times) in r.feature
    assert len({(r.feature, r.media_sha256) for r in got if r.doc_id == 1}) == 1
    assert media_column(df.limit(0)).count() == 0
