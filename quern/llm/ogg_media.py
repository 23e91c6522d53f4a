"""Ogg containers: writing pages, and reading them back with every check the format allows.

Reading verifies each page's checksum, reassembles packets from lacing values across pages,
demultiplexes the logical streams by serial number and derives timestamps from granule positions.
The codec stored here is plain unsigned 8-bit PCM: one granule is one sample is one byte.
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

from .common import map_arrow

#: Fixed values of the format: capture pattern, page header, flags; and our codec's magic.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MAGIC = b"QPCM8"
CODEC = struct.Struct("<5sBBIQ")
#: Bytes that a payload is padded to a multiple of; samples a second; bytes of a packet; logical streams.
UNIT = 192
RATE = 8000
PACKET = 25 * UNIT
STREAMS = 2

_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, no inversion: zlib's reflected CRC over mirrored bytes, mirrored."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with spaces to a positive multiple of UNIT, and the length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" "), len(raw)


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(HEADER.pack(CAPTURE, 0, flags, granule, serial, seq, 0, len(lacing)) + lacing + body)
    page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def _stream_pages(serial: int, packets: list[bytes], head: bytes) -> list[bytes]:
    """The pages of one logical stream: the codec header alone, then the packets in full pages."""
    pages = [_page(FIRST, 0, serial, 0, bytes([len(head)]), head)]
    lacing, body, granule, done, flags = bytearray(), bytearray(), -1, 0, 0
    pieces = [(p, i) for p in packets for i in range(0, len(p) + 1, 255)]
    for n, (packet, i) in enumerate(pieces):
        piece = packet[i : i + 255]
        lacing.append(len(piece))
        body += piece
        if len(piece) < 255:
            done += len(packet)
            granule = done
        last = n + 1 == len(pieces)
        if len(lacing) == 255 or last:
            pages.append(_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
            flags = CONTINUED if len(piece) == 255 else 0
            lacing, body, granule = bytearray(), bytearray(), -1
    if not pieces:
        pages.append(_page(LAST, 0, serial, 1, b"", b""))
    return pages


def write_ogg(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    """payload as samples, dealt packet by packet to interleaved logical streams."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    pages = [_stream_pages(1 + k, packets[k::streams], CODEC.pack(MAGIC, k, streams, rate, len(payload))) for k in range(streams)]
    longest = max(map(len, pages))
    return b"".join(p[i] for i in range(longest) for p in pages if i < len(p))


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  # granule position after each packet
    pages: int = 0
    closed: bool = False
    lost: bool = False
    _open: bytearray | None = None
    _next: int = 0

    @property
    def header(self) -> tuple | None:
        ok = self.packets and len(self.packets[0]) == CODEC.size and self.packets[0][:5] == MAGIC
        return CODEC.unpack(self.packets[0]) if ok else None

    def times(self, rate: int) -> list[float | None]:
        """The second at which each data packet starts."""
        return [None if e is None else (e - len(p)) / rate for p, e in zip(self.packets[1:], self.ends[1:], strict=True)]


def read_ogg(data: bytes) -> tuple[dict[int, LogicalStream], int]:
    """The logical streams by serial, and the number of damaged places.

    A page whose checksum fails is passed over, and the reader looks for the next capture pattern;
    a packet of which a page is missing is dropped.
    """
    streams: dict[int, LogicalStream] = {}
    at, bad = 0, 0
    while at < len(data):
        size = 0
        if data[at : at + 4] == CAPTURE and at + 27 <= len(data):
            _, version, flags, granule, serial, seq, crc, n = HEADER.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            size = 27 + n + sum(lacing)
        page = data[at : at + size]
        if not size or len(lacing) < n or len(page) < size or version or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                break
            continue
        at += size
        s = streams.setdefault(serial, LogicalStream(serial))
        s.pages += 1
        if seq != s._next:
            s.lost, s._open = True, None
        s._next = seq + 1
        if not flags & CONTINUED:
            s._open = None
        open_, skip = s._open, bool(flags & CONTINUED) and s._open is None
        first, pos = len(s.packets), 27 + n
        for length in lacing:
            if open_ is None:
                open_ = bytearray()
            open_ += page[pos : pos + length]
            pos += length
            if length < 255:
                if not skip:
                    s.packets.append(bytes(open_))
                    s.ends.append(None)
                open_, skip = None, False
        s._open = None if skip else open_
        end = granule
        for i in range(len(s.packets) - 1, first - 1, -1):  # the page's granule position belongs to its last whole packet
            if granule >= 0:
                s.ends[i] = end
                end -= len(s.packets[i])
        s.closed |= bool(flags & LAST)
    return streams, bad


def payload_from(streams: dict[int, LogicalStream]) -> tuple[bytes, list[tuple[int, int, float | None]]]:
    """The payload in order of timestamps within dealt rounds, and (stream, packet, second) of each packet."""
    order = []
    for s in streams.values():
        head = s.header
        if head is None:
            continue
        _, k, count, rate, _ = head
        order += [((i * count + k), s.serial, i, t, p) for i, (p, t) in enumerate(zip(s.packets[1:], s.times(rate), strict=True))]
    order.sort(key=lambda x: x[0])
    return b"".join(p for *_, p in order), [(serial, i, t) for _, serial, i, t, _ in order]


def features(payload: bytes, streams: dict[int, LogicalStream], times: list[tuple[int, int, float | None]], bad: int) -> str:
    """Pages, packets, damage, the longest stream's duration, and mean, root mean square and mean crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, mean = max(1, len(x)), x.sum() / max(1, len(x))
    above = x > mean
    last = max((s.ends[-1] or 0 for s in streams.values() if s.ends), default=0)
    start = max((t for *_, t in times if t is not None), default=0.0)
    return f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(times)};bad={bad};ms={last * 1000 // RATE};last_start={start:.4f};mean={mean:.4f};rms={(float((x * x).sum()) / n) ** 0.5:.4f};crossings={int((above[1:] != above[:-1]).sum())}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media, the Ogg file).

    The payload columns describe what was read back from the stored bytes. Null texts count as
    empty and are stored as one unit of spaces. Equal texts give equal values; repeated rows are
    stored each; other columns don't matter; an empty table gives an empty result.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text in part.column(1):
                    payload, n = payload_of(text.as_py())
                    media = write_ogg(payload)
                    streams, bad = read_ogg(media)
                    back, times = payload_from(streams)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, streams, times, bad), *[media] * keep_media))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, store, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media)


def read_media(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packets of a column of Ogg files: id, serial, packet, second, data, bad (damaged places of the file). Null or empty files have none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1), strict=True):
                streams, bad = read_ogg(media.as_py() or b"")
                rows = [(key.as_py(), s.serial, i, None if e is None else (e - len(p)) / (s.header or (0, 0, 0, RATE, 0))[3], p, bad) for s in streams.values() for i, (p, e) in enumerate(zip(s.packets, s.ends, strict=True))]
                if rows:
                    kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "serial", "packet", "second", "data", "bad"])

    rows = files.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return map_arrow(rows, read, f"id {rows.schema['id'].dataType.simpleString()}, serial long, packet long, second double, data binary, bad long")
