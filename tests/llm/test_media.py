import hashlib
import random

import pytest

from quillforge.llm import media as m


def slow_checksum(data):
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else (c << 1) & 0xFFFFFFFF
    return c


def test_checksum_against_bitwise_version():
    data = random.Random(1).randbytes(300)
    assert m.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 3999, 4000, 4001, 8000, 65025, 70000, 300000])
def test_round_trip_and_damage(n):
    rng = random.Random(n)
    payload = m.pad(rng.randbytes(n))
    assert len(payload) % 64 == 0 and len(payload) > 0
    stored = m.encode(payload)
    back = m.decode(stored)
    assert back.payload == payload
    assert max(end for _, end in back.times) == pytest.approx(len(payload) / m.RATE)
    for _ in range(5):
        broken = bytearray(stored)
        broken[rng.randrange(len(stored))] ^= 1 << rng.randrange(8)
        with pytest.raises(m.OggError):
            m.decode(bytes(broken))
    with pytest.raises(m.OggError):
        m.decode(stored[:-1])


def test_streams_are_told_apart():
    streams = m.demux(m.encode(bytes(range(256)) * 100))
    assert sorted(streams) == [1, 2]
    assert all(s.packets[0].startswith(m.MAGIC) for s in streams.values())


def test_digest(awkward, empty):
    got = m.media_digest(awkward).collect()
    assert len(got) == awkward.count()
    by_text = {}
    for row, text in zip(got, (r["text"] for r in awkward.collect()), strict=True):
        raw = (text or "").encode()
        payload = m.pad(raw)
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        by_text.setdefault(text or "", set()).add((row["media_sha256"], row["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert m.media_digest(empty).count() == 0
    stored = m.ogg_column(awkward, media="lang").select("lang", "text").collect()
    assert all(m.decode(bytes(r["lang"])).payload == m.pad((r["text"] or "").encode()) for r in stored)


@pytest.mark.parametrize("n", [0, 1, 64, 4000, 70001])
def test_level_takes_every_sample(n):
    payload = m.pad(random.Random(n).randbytes(n))
    level = lambda data: m.features(m.decode(m.encode(data)), data).split("level=")[1]
    assert level(payload) == f"{sum(abs(b - 128) for b in payload) / len(payload):.2f}"
    changed = bytearray(payload)
    changed[1::2] = bytes(128 for _ in changed[1::2])
    assert level(bytes(changed)) == f"{sum(abs(b - 128) for b in changed) / len(changed):.2f}"
