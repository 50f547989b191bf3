"""Ogg media columns: a container written and read page by page.

The payload is the text's bytes padded to whole frames. It is stored as packets of one frame of 576 unsigned
8-bit samples, dealt in turn to two interleaved logical streams, each beginning with an identification packet.
Reading verifies each page's checksum, follows the lacing values to put packets together again across pages,
separates the streams by serial number, checks page sequence numbers, and takes times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphloom.llm.common import table

FRAME = 576
RATE = 8000
SERIALS = (1, 2)
_IDENT = struct.Struct("<8sBBIH")
_MAGIC = b"glphPCM8"
_HEADER = struct.Struct("<4sBBqIIIB")
_CONTINUED, _BEGIN, _END = 1, 2, 4
_PACKETS_PER_PAGE = 64
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first, start 0, nothing inverted.

    zlib has the same polynomial with bits reversed and values inverted; both are undone here.
    """
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _page(packets: list[bytes], flags: int, granule: int, serial: int, number: int) -> bytes:
    """One page of whole packets; a packet's last lacing value is under 255."""
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def write(payload: bytes, rate: int = RATE, frame: int = FRAME) -> bytes:
    """An Ogg file with the payload's frames in two interleaved streams."""
    if not payload or len(payload) % frame:
        raise ValueError("the payload must be a positive multiple of a frame")
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    lanes = [frames[k :: len(SERIALS)] for k in range(len(SERIALS))]
    pages = [
        _page([_IDENT.pack(_MAGIC, 1, k, rate, frame)], _BEGIN | (0 if lanes[k] else _END), 0, serial, 0)
        for k, serial in enumerate(SERIALS)
    ]
    per_page = min(_PACKETS_PER_PAGE, 255 // (frame // 255 + 1))
    for at in range(0, len(lanes[0]), per_page):
        for k, serial in enumerate(SERIALS):
            if own := lanes[k][at : at + per_page]:
                done = at + len(own)
                last = _END if done == len(lanes[k]) else 0
                pages.append(_page(own, last, done * frame, serial, at // per_page + 1))
    return b"".join(pages)


class Stream(NamedTuple):
    packets: list[bytes]
    granules: list[int]  # of the pages on which packets end
    pages: int
    ended: bool


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams of an Ogg file by serial number.

    Raises ValueError for a bad capture pattern, version, checksum, page number, continuation or a cut file.
    """
    streams: dict[int, Stream] = {}
    open_packets: dict[int, bytes | None] = {}
    at = 0
    while at < len(media):
        if len(media) < at + _HEADER.size:
            raise ValueError(f"cut page header at {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no Ogg page at {at}")
        lacing = media[at + _HEADER.size : at + _HEADER.size + n]
        start = at + _HEADER.size + n
        end = start + sum(lacing)
        if len(lacing) < n or len(media) < end:
            raise ValueError(f"cut page at {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"bad checksum at {at}")
        if flags & _BEGIN:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial] = Stream([], [], 0, False)
            open_packets[serial] = None
        if serial not in streams or streams[serial].ended:
            raise ValueError(f"page outside its stream at {at}")
        own, rest = streams[serial], open_packets[serial]
        if number != own.pages:
            raise ValueError(f"stream {serial} lacks page {own.pages}")
        if bool(flags & _CONTINUED) != (rest is not None):
            raise ValueError(f"broken continuation at {at}")
        parts, begin, here, ended = [rest or b""], start, start, False
        for value in lacing:
            here += value
            if value < 255:
                parts.append(media[begin:here])
                own.packets.append(b"".join(parts))
                parts, begin, ended = [], here, True
        open_packets[serial] = b"".join([*parts, media[begin:here]]) if n and lacing[-1] == 255 else None
        if ended:
            own.granules.append(granule)
        streams[serial] = own._replace(pages=own.pages + 1, ended=bool(flags & _END))
        at = end
    if unfinished := [s for s, x in streams.items() if not x.ended or open_packets[s] is not None]:
        raise ValueError(f"streams {unfinished} do not end")
    return streams


def payload_of(streams: dict[int, Stream]) -> tuple[bytes, int, int]:
    """The payload, sample rate and frame size: lanes are put together in turn."""
    lanes: dict[int, list[bytes]] = {}
    rate = frame = 0
    for stream in streams.values():
        magic, version, lane, rate, frame = _IDENT.unpack(stream.packets[0])
        if magic != _MAGIC or version != 1:
            raise ValueError("unknown stream type")
        lanes[lane] = stream.packets[1:]
    frames: list[bytes] = [b""] * sum(map(len, lanes.values()))
    for lane, own in lanes.items():
        frames[lane :: len(lanes)] = own
    return b"".join(frames), rate, frame


def features(streams: dict[int, Stream], payload: bytes, rate: int) -> str:
    """Counts, durations from granule positions in ms, and level, spread and crossings of the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    low = samples < 128
    crossings = int(np.count_nonzero(low[1:] != low[:-1]))
    total = int(samples.sum(dtype=np.int64))
    squares = int((np.bincount(samples, minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    times = ",".join(str(s.granules[-1] * 1000 // rate) for _, s in sorted(streams.items()))
    pages = sum(s.pages for s in streams.values())
    packets = sum(len(s.packets) for s in streams.values())
    return f"streams={len(streams)};pages={pages};packets={packets};ms={times};sum={total};squares={squares};crossings={crossings}"


def describe(text: str) -> tuple:
    """The row of one text: written, read back and measured."""
    raw = text.encode("utf-8")
    payload = raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)
    media = write(payload)
    streams = read(media)
    back, rate, _ = payload_of(streams)
    return (
        len(raw),
        len(back),
        hashlib.sha256(back).hexdigest(),
        zlib.crc32(back[-32:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        features(streams, back, rate),
    )


SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string"
)


def media_columns(docs: DataFrame) -> DataFrame:
    """Every document's text stored as Ogg, read back and described.

    A null text counts as empty and gets one frame of padding. Null or repeated ids and repeated rows are kept;
    equal texts get equal values; an empty table gives no rows.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [describe(t.as_py() or "") for t in batch.column(1)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
