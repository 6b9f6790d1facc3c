"""MPEG audio columns: write bytes as the frames of a stream, read streams back with resynchronisation.

The writer makes MPEG-1 layer III frames (48 kHz, stereo, variable bit rate, with checksums) whose side information says
that no main data follows, so the rest of each frame is ancillary data: a decoder plays silence, and the payload is kept
as it is. An ID3v2 tag in front and a first frame with the table of a variable bit rate (frames, bytes, seek points) say
what to expect. The reader takes any stream of MPEG-1, 2 or 2.5 in layers I to III: it skips tags (ID3v1, ID3v2 with extended
headers and footers), looks for a header that the next frame of the same kind confirms, drops what lies between, checks each checksum
(layers I and III; that of layer II depends on its allocation and isn't checked), reads the table of a variable bit rate in either
form and notes where every frame starts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from farfield.llm.scratch import id_text

#: fixed values of ISO/IEC 11172-3 and 13818-3: bit rates in kbit/s by index (MPEG-1 layers I, II, III; MPEG-2 layer I and the others),
#: sample rates of MPEG-1 (half and a quarter of them in MPEG-2 and 2.5), bytes of side information for mono and other modes
BITRATES_1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
BITRATES_2 = {1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
BITRATES_2[3] = BITRATES_2[2]
RATES = (44100, 48000, 32000)
SIDE_INFO = {1: (17, 32), 2: (9, 17)}
BITRATES = BITRATES_1[3]
HEAD, CRC = 4, 2
_FULL = 14
_AREA = {i: 144 * BITRATES[i] * 1000 // 48000 - HEAD - CRC - 32 for i in range(1, 15)}


def crc16(data: bytes) -> int:
    """The checksum of the standard: polynomial 0x8005, from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _start(index: int) -> bytes:
    """A frame up to its data: header, checksum, empty side information."""
    head = bytes([0xFF, 0xFA, index << 4 | 0b01 << 2, 0])
    side = bytes(32)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {i: _start(i) for i in range(1, 15)}


def write(payload: bytes) -> bytes:
    """A stream that holds ``payload``."""
    area, start = _AREA[_FULL], np.frombuffer(_STARTS[_FULL], np.uint8)
    full = len(payload) // area
    body = np.empty((full, len(start) + area), np.uint8)
    body[:, : len(start)] = start
    body[:, len(start) :] = np.frombuffer(payload, np.uint8, full * area).reshape(full, area)
    rest = payload[full * area :]
    last = b""
    if rest:
        index = next(i for i in range(1, 15) if _AREA[i] >= len(rest))
        last = _STARTS[index] + rest.ljust(_AREA[index], b"\0")
    frames = full + bool(rest)
    stream = body.tobytes() + last
    total = len(stream) + len(_STARTS[_FULL]) + area
    points = bytes(min(255, (len(_STARTS[_FULL]) + area + min(frames, k * frames // 100) * (len(start) + area)) * 256 // total) for k in range(100))
    table = b"Xing" + struct.pack(">III", 0b111, frames, total) + points
    text = b"\x00payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    size = len(frame)
    tag = b"ID3\x03\x00\x00" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frame
    return tag + _STARTS[_FULL] + table.ljust(area, b"\0") + stream


@dataclass
class Stream:
    """What a stream holds: offsets of its audio frames, counts, exact samples and the data after the side information."""

    offsets: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # samples up to the end of each frame
    rate: int = 0
    kbits: int = 0
    checked: int = 0
    bad_checksums: int = 0
    skipped_bytes: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table_frames: int | None = None
    table_bytes: int | None = None
    table_points: list[int] = field(default_factory=list)  # byte places of the table's seek points
    data: bytes = b""

    @property
    def samples(self) -> int:
        return self.ends[-1] if self.ends else 0

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0

    def seek(self, us: int) -> int | None:
        """The offset of the frame that holds a time; None beyond the end."""
        k = bisect_right(self.ends, us * self.rate // 1_000_000)
        return self.offsets[k] if k < len(self.offsets) else None


class Header(NamedTuple):
    size: int
    rate: int
    kbits: int
    samples: int
    side: int  # bytes of side information (layer III)
    covered: int | None  # bytes after the checksum that it covers, None if unknown
    has_crc: bool
    kind: tuple[int, int, int]  # version bits, layer, sample rate


def _header(b: bytes, at: int) -> Header | None:
    if at + HEAD > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3)
    index, rate = b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    one = version == 3
    kbits = (BITRATES_1 if one else BITRATES_2)[layer][index]
    hertz = RATES[rate] >> (0 if one else 1 if version == 2 else 2)
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    padding, mode = b[at + 2] >> 1 & 1, b[at + 3] >> 6
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples * 125 * kbits // hertz + padding
    side = SIDE_INFO[1 if one else 2][mode != 3] if layer == 3 else 0
    bound = (b[at + 3] >> 4 & 3) * 4 + 4 if mode == 1 else 32  # joint stereo shares the allocation above it
    covered = side if layer == 3 else (16 if mode == 3 else (bound + 32) // 2) if layer == 1 else None
    return Header(size, hertz, kbits, samples, side, covered, not b[at + 1] & 1, (version, layer, rate))


def _size(b: bytes) -> int:
    """Four bytes of seven bits."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(b: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio starts, and the text fields of the leading ID3v2 tags (versions 2.3 and 2.4)."""
    start, found = 0, {}
    while b[start : start + 3] == b"ID3" and start + 10 <= len(b):
        version, flags = b[start + 3], b[start + 5]
        end = start + 10 + _size(b[start + 6 : start + 10]) + (10 if flags & 16 else 0)
        at = start + 10
        if flags & 64 and at + 4 <= len(b):  # an extended header; 2.3 doesn't count its size field
            at += _size(b[at : at + 4]) if version >= 4 else struct.unpack(">I", b[at : at + 4])[0] + 4
        while version >= 3 and at + 10 <= min(end, len(b)) and b[at] != 0:
            size = _size(b[at + 4 : at + 8]) if version >= 4 else struct.unpack(">I", b[at + 4 : at + 8])[0]
            value = b[at + 10 : at + 10 + size]
            if b[at : at + 4] == b"TXXX" and value[:1] in (b"\0", b"\3") and b"\0" in value[1:]:
                name, _, content = value[1:].partition(b"\0")
                code = "utf-8" if value[:1] == b"\3" else "latin-1"
                found[name.decode(code, "replace")] = content.rstrip(b"\0").decode(code, "replace")
            at += 10 + size
        start = end
    return min(start, len(b)), found


def _table(b: bytes, at: int, head: Header, out: Stream) -> bool:
    """Reads the table of a variable bit rate, if a frame holds one."""
    end = at + head.size
    for data in (at + HEAD + head.side, at + HEAD + CRC + head.side):
        if b[data : data + 4] in (b"Xing", b"Info") and data + 8 <= end:
            flags, data = struct.unpack(">I", b[data + 4 : data + 8])[0], data + 8
            if flags & 1 and data + 4 <= end:
                out.table_frames, data = struct.unpack(">I", b[data : data + 4])[0], data + 4
            if flags & 2 and data + 4 <= end:
                out.table_bytes, data = struct.unpack(">I", b[data : data + 4])[0], data + 4
            if flags & 4 and data + 100 <= end and out.table_bytes:
                out.table_points = [at + p * out.table_bytes // 256 for p in b[data : data + 100]]
            return True
    data = at + HEAD + 32
    if b[data : data + 4] == b"VBRI" and data + 26 <= end:
        out.table_bytes, out.table_frames, entries, scale, width = struct.unpack(">IIHHH", b[data + 10 : data + 24])
        if 1 <= width <= 4 and data + 26 + entries * width <= end:
            place = at
            for k in range(entries):
                out.table_points.append(place)
                place += scale * int.from_bytes(b[data + 26 + k * width : data + 26 + (k + 1) * width], "big")
        return True
    return False


_good_checks: dict[bytes, bool] = {}


def _checksum_holds(b: bytes, at: int, covered: int) -> bool:
    part = b[at + 2 : at + HEAD + CRC + covered]
    if part not in _good_checks:
        if len(_good_checks) > 4096:
            _good_checks.clear()
        _good_checks[part] = crc16(part[:2] + part[4:]) == part[2] << 8 | part[3]
    return _good_checks[part]


def _confirmed(b: bytes, at: int, end: int, head: Header, locked: bool) -> bool:
    """Whether a header that may be chance is one: a frame of its kind or the end follows, or, in step, its checksum holds."""
    if at + head.size == end:
        return True
    after = _header(b, at + head.size)
    return after is not None and after.kind == head.kind or locked and head.has_crc and head.covered is not None and _checksum_holds(b, at, head.covered)


def read(b: bytes | None) -> Stream:
    """Parse a stream. Bytes that belong to no confirmed frame are skipped and counted; a cut last frame is one of them. No
    bytes (or null) are a stream without frames."""
    out = Stream()
    b = b or b""
    at, out.tags = _tags(b)
    end = len(b) - 128 if len(b) - 128 >= at and b[-128:-125] == b"TAG" else len(b)
    parts, first, locked = [], True, False
    while at < end:
        head = _header(b, at)
        if head is None or at + head.size > end or not _confirmed(b, at, end, head, locked):
            nxt = b.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped_bytes += nxt - at
            at, locked = nxt, False
            continue
        if not (first and head.kind[1] == 3 and _table(b, at, head, out)):
            if head.has_crc and head.covered is not None:
                out.checked += 1
                out.bad_checksums += not _checksum_holds(b, at, head.covered)
            out.offsets.append(at)
            out.ends.append(out.samples + head.samples)
            out.kbits += head.kbits
            parts.append(b[at + HEAD + CRC * head.has_crc + head.side : at + head.size])
        out.rate, first, locked = head.rate, False, True
        at += head.size
    out.data = b"".join(parts)
    if out.tags.get("payload_bytes", "").isdigit():
        out.data = out.data[: int(out.tags["payload_bytes"])]
    return out


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def feature(s: Stream) -> str:
    """Counts, exact duration, mean bit rate, and a checksum of all seek offsets with the first and the last of them."""
    seek = zlib.crc32(np.asarray(s.offsets, "<u8").tobytes())
    ends = f"{s.offsets[0]}..{s.offsets[-1]}" if s.offsets else ""
    return f"frames={len(s.offsets)};table={s.table_frames};samples={s.samples};us={s.duration_us};kbps={s.kbits // max(1, len(s.offsets))};crc={s.checked - s.bad_checksums}/{s.checked};skipped={s.skipped_bytes};seek={ends}:{seek:08x}"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, step = 0, 500
        while at < batch.num_rows:
            part = batch.slice(at, step)
            raws = [(x or "").encode() for x in part.column(1).to_pylist()]
            media = [write(padded(raw)) for raw in raws]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
            at += step


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, frames long, bad_checksums long, seek_offsets array<long>, seek_points array<long>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = read(b)
            rows.append((doc_id, n, len(s.data), hashlib.sha256(s.data).hexdigest(), zlib.crc32(s.data[-64:]), len(b or b""), hashlib.sha256(b or b"").hexdigest(), feature(s), s.duration_us, len(s.offsets), s.bad_checksums, s.offsets, s.table_points))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 13
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, filled with zeros to a positive multiple of 64, as a stream. Null reads as empty."""
    return id_text(docs).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Durations, frames, checksums and seek offsets of streams (doc_id, n_bytes, media), from the stored bytes alone.

    Equal streams give equal values; repeated rows and null ids are kept. A null stream reads as an empty one. A stream
    without a frame has no offsets, rate 0 and duration 0. seek_offsets: where each audio frame starts; seek_points: the places
    that the stream's own table names, if it has one.
    """
    return media.mapInArrow(_describe, SCHEMA)
