"""Media columns: payloads stored losslessly in Ogg, and Ogg read back.

The container is the public Ogg framing (RFC 3533): pages of up to 255 lacing
values, a checksum over each page, packets reassembled from lacing values,
logical streams told apart by serial number, and granule positions that count
8-bit samples at ``RATE`` samples a second.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillforge.llm.columns import release

RATE = 8000
PACKET = 4000
#: Logical streams of one file: packets are dealt to them in turn.
STREAMS = 2
BLOCK = 64
_REVERSE = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_INTRO = struct.Struct("<8sBBHIQ")
MAGIC = b"QFpcm8\x00\x01"


class OggError(ValueError):
    """The bytes are not a whole, valid Ogg file."""


def page_checksum(page: bytes) -> int:
    """The checksum of RFC 3533: polynomial 04c11db7, most significant bit first, start 0.

    zlib's CRC has the same polynomial with bits reversed, so bytes are
    reversed, zlib's start and end values are cancelled, and the result is reversed.
    """
    c = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSE), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; packets with the granule position at their end."""
    pages, number, lacing, body, granule, fresh = [], 0, bytearray(), bytearray(), -1, True
    for k, (packet, position) in enumerate(packets):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            if not lacing:
                fresh = at == 0
            part, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            size = sum(part)
            lacing += part
            body += packet[at : at + size]
            at += size
            if not values:
                granule = position
            last = k == len(packets) - 1 and not values
            if len(lacing) == 255 or last or k == 0 and not values:
                flags = (0 if fresh else 1) | (2 if number == 0 else 0) | (4 if last else 0)
                pages.append(_page(serial, number, flags, granule, bytes(lacing), bytes(body)))
                number, granule = number + 1, -1
                lacing.clear()
                body.clear()
    return pages


def encode(payload: bytes, streams: int = STREAMS, rate: int = RATE, packet: int = PACKET) -> bytes:
    """An Ogg file of 8-bit samples; packets are dealt to the logical streams in turn."""
    made = []
    for s in range(streams):
        intro = _INTRO.pack(MAGIC, s, streams, packet, rate, len(payload))
        packets, at = [(intro, 0)], 0
        for k in range(s * packet, max(len(payload), 1), streams * packet):
            part = payload[k : k + packet]
            at = k + len(part)
            packets.append((part, at))
        made.append(_stream_pages(s + 1, packets))
    firsts = [pages[0] for pages in made]  # all first pages come before any other
    rest = [pages[n] for n in range(1, max(map(len, made))) for pages in made if n < len(pages)]
    return b"".join(firsts + rest)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: Granule position known at each packet's end, -1 if the packet doesn't end a page's count.
    positions: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError on any damage."""
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should start")
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if len(lacing) < n or len(page) < size:
            raise OggError("cut page")
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError(f"checksum of page {number} of stream {serial}")
        first = serial not in streams
        s = streams.setdefault(serial, Stream(serial))
        if bool(flags & 2) != first or s.ended or number != s.pages or bool(flags & 1) != (serial in partial):
            raise OggError(f"page {number} of stream {serial} is out of order")
        s.pages += 1
        body, open_packet = 27 + n, partial.pop(serial, None)
        ended_here = 0
        for value in lacing:
            if open_packet is None:
                open_packet = bytearray()
            open_packet += page[body : body + value]
            body += value
            if value < 255:
                s.packets.append(bytes(open_packet))
                s.positions.append(-1)
                open_packet, ended_here = None, ended_here + 1
        if open_packet is not None:
            partial[serial] = open_packet
        if (granule != -1) != (ended_here > 0):
            raise OggError(f"granule position of page {number} of stream {serial}")
        if ended_here:
            s.positions[-1] = granule
        s.ended = bool(flags & 4)
        at += size
    if partial or any(not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Decoded:
    payload: bytes
    pages: int
    packets: int
    #: Start and end in seconds of each logical stream's samples, from granule positions.
    times: list[tuple[float, float]]
    rate: int


def decode(data: bytes) -> Decoded:
    """The payload that ``encode`` stored, after all checks."""
    streams = demux(data)
    by_order, spans, rate, total, packet = {}, {}, RATE, 0, PACKET
    for s in streams.values():
        if not s.packets or len(s.packets[0]) != _INTRO.size:
            raise OggError("stream without an introduction")
        magic, order, count, packet, rate, total = _INTRO.unpack(s.packets[0])
        if magic != MAGIC or count != len(streams) or order in by_order:
            raise OggError("unknown stream")
        by_order[order] = s.packets[1:]
        last = max((p for p in s.positions[1:]), default=0)
        spans[order] = (order * packet / rate if len(s.packets) > 1 else 0.0, max(last, 0) / rate)
    parts = []
    for k in range(max(map(len, by_order.values()), default=0)):
        parts += [by_order[o][k] for o in sorted(by_order) if k < len(by_order[o])]
    payload = b"".join(parts)
    if len(payload) != total:
        raise OggError("samples are missing")
    return Decoded(payload, sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values()), [spans[o] for o in sorted(spans)], rate)


def pad(raw: bytes, block: int = BLOCK) -> bytes:
    """``raw`` with bytes 0 appended up to a positive multiple of ``block``."""
    return raw + bytes(-len(raw) % block if raw else block)


def ogg_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with each text stored as an Ogg file in the binary column ``media``, which comes last.

    A null text is stored as an empty one; repeated rows give repeated files. A column already called ``media`` is replaced,
    others, of any names, pass through. An empty table gives no rows. A narrow map: no shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() != media.lower()]
    source = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").cast("string").alias(media))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [encode(pad((t.as_py() or "").encode())) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(stored, pa.binary())], names=[*batch.schema.names[: len(kept)], media])
        release()

    return source.mapInArrow(run, T.StructType([*kept, T.StructField(media, T.BinaryType())]))


#: Distance of each sample value from the middle.
_AWAY = np.abs(np.arange(256) - 128).astype(np.uint8)


def features(d: Decoded, payload: bytes) -> str:
    """pages, packets, seconds by granule positions and the mean distance of all samples from the middle."""
    seconds = max((end for _, end in d.times), default=0.0)
    level = int(_AWAY[np.frombuffer(payload, np.uint8)].sum(dtype=np.int64)) / max(1, len(payload))
    return f"pages={d.pages};packets={d.packets};streams={len(d.times)};seconds={seconds:.4f};level={level:.2f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text with ``ogg_column``, read the stored column back, and describe it, one row for each input row.

    Null texts count as empty; an empty text is 64 bytes 0. Repeated rows give
    repeated rows; null ids stay null; other columns are dropped. There is no shuffle.
    """
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("media"))
    stored = ogg_column(slim, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for media in batch.column(2):
                data = media.as_py()
                d = decode(data)
                out.append((len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), features(d, d.payload)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        release()

    return stored.mapInArrow(run, DIGEST)
