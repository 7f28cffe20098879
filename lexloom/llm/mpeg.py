"""Media columns: MPEG audio (operator 2).

``mux`` stores any payload in a valid MPEG-1 Layer III stream: an ID3v2 tag with the payload's
length, a frame with a Xing table of the variable bitrate, then mono frames at 44.1 kHz with CRC,
whose side information is silent and whose remaining bytes (which decoders skip as ancillary
data) carry the payload, and an ID3v1 tag. ``parse`` reads such a stream, or any of MPEG-1, 2 or 2.5,
Layer I to III: it reads ID3v2 text frames and ID3v1 fields, resynchronises on frame headers (a
header counts if it is valid, its CRC holds where it covers the side information of Layer III, and
another header, a tag or the end follows), reads Xing, Info and VBRI tables and compares them with
the frames that are there, and gives exact durations as samples over the rate, and the byte offset of
every frame for seeking. ``to_media`` stores durations and offsets beside the stream.

Defined results: a null or empty text has a payload of 64 zero bytes; equal texts have equal
streams; a stream without frames has 0 samples; bytes between frames are skipped and counted; rows
with a null or repeated id are media like others; an empty table gives an empty result; columns other
than id and text may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import lean, pieces
from lexloom.llm.storage import materialise

#: Fixed values of ISO 11172-3 and 13818-3: kbit/s by index of MPEG-1 Layers I, II and III, and of MPEG-2
#: (and 2.5) Layer I, and Layers II and III; sampling rates of MPEG-1, which MPEG-2 halves and MPEG-2.5
#: quarters; bytes of Layer III's side information for one channel and for two, of MPEG-1 and of the others.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_1_II = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
KBITS_1_I = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
KBITS_2_I = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SIDE = {1: (17, 32), 2: (9, 17), 4: (9, 17)}
SIDE_MONO = SIDE[1][0]
UNIT = 64


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = (r << 1 ^ (0x8005 if r & 0x8000 else 0)) & 0xFFFF
        table.append(r)
    return table


_CRC = _crc_table()
_crc_known: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The CRC of a frame's protected part: last two header bytes and side information."""
    r = _crc_known.get(data)
    if r is None:
        r = 0xFFFF
        for b in data:
            r = r << 8 & 0xFFFF ^ _CRC[r >> 8 ^ b]
        if len(_crc_known) < 4096:
            _crc_known[data] = r
    return r


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    samples: int
    side: int
    protected: bool
    layer: int


def _header(second: int, third: int, fourth: int) -> Header | None:
    """What the three bytes after 0xFF say, if they make a header."""
    if second >> 5 != 7:
        return None
    divisor, layer = {0: 4, 2: 2, 3: 1}.get(second >> 3 & 3), 4 - (second >> 1 & 3)
    index, rate, pad = third >> 4, third >> 2 & 3, third >> 1 & 1
    if divisor is None or layer == 4 or not 0 < index < 15 or rate == 3:
        return None
    kbits = ((KBITS_1_I, KBITS_1_II, KBITS) if divisor == 1 else (KBITS_2_I, KBITS_2, KBITS_2))[layer - 1][index]
    hertz = RATES[rate] // divisor
    samples = 384 if layer == 1 else 576 if layer == 3 and divisor > 1 else 1152
    size = (12_000 * kbits // hertz + pad) * 4 if layer == 1 else samples * 125 * kbits // hertz + pad
    return Header(size, hertz, samples, SIDE[divisor][fourth >> 6 != 3] if layer == 3 else 0, not second & 1, layer)


#: Headers that were met, by their last three bytes without what does not matter.
_met: dict[int, Header | None] = {}


def header_at(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    key = data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3] & 0xC0
    if key not in _met:
        _met[key] = _header(data[at + 1], data[at + 2], data[at + 3])
    return _met[key]


_ROOM = [144_000 * k // 44100 - 4 - 2 - SIDE_MONO if k else 0 for k in KBITS]


def _frame(index: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4, 0xC0))
    side = bytes(SIDE_MONO)
    return b"".join((head, crc16(head[2:] + side).to_bytes(2, "big"), side, body, bytes(_ROOM[index] - len(body))))


def _id3v2(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        text = b"\x03" + k.encode() + b"\0" + v.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def mux(payload: bytes) -> bytes:
    """An MPEG stream that carries the payload."""
    return muxed(payload)[0]


def muxed(payload: bytes) -> tuple[bytes, list[int]]:
    """The stream, and where the frames with payload begin."""
    most = _ROOM[14]
    frames = [_frame(14, payload[i : i + most]) for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(frames) * most :]:
        frames.append(_frame(next(i for i in range(1, 15) if _ROOM[i] >= len(rest)), rest))
    total = sum(map(len, frames)) + (size := len(_frame(8, b"")))
    marks, at = [size], size
    for f in frames[:-1]:
        marks.append(at := at + len(f))
    toc = bytes(min(255, 256 * marks[min(len(marks) - 1, i * len(frames) // 100)] // total) for i in range(100)) if frames else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = b"TAG" + bytes(124) + b"\xff"
    head = _id3v2({"payload-bytes": str(len(payload))})
    return b"".join((head, _frame(8, xing), *frames, tag)), [len(head) + m for m in marks[: len(frames)]]


@dataclass
class Parsed:
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[str, int, int, bytes] | None = None  # kind, frames, bytes, places of percents
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bodies: list[bytes] = field(default_factory=list)
    skipped: int = 0
    bad_crc: int = 0
    first: int = 0  # where the frame with the table is
    end: int = 0

    def payload(self) -> bytes:
        data = b"".join(self.bodies)
        return data[: int(self.tags.get("payload-bytes", len(data)))]

    def table_holds(self) -> bool:
        """Whether the table has the number of frames, the bytes and the places that are there."""
        if self.table is None:
            return False
        kind, frames, size, places = self.table
        sound = frames == len(self.offsets) and size == self.end - self.first
        if kind == "VBRI" or not places:
            return sound
        at = [o - self.first for o in self.offsets] or [0]
        return sound and all(p == min(255, 256 * at[min(len(at) - 1, i * len(self.offsets) // 100)] // max(size, 1)) for i, p in enumerate(places) if self.offsets)


#: How ID3v2 text is encoded.
_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _id3v2_into(data: bytes, end: int, into: dict[str, str]) -> None:
    """Text frames of versions 2.3 and 2.4."""
    at, version = 10, data[3]
    while at + 10 <= end and data[at : at + 1] == b"T":
        size = sum(b << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0) if version == 4 else (24, 16, 8, 0), strict=True))
        body = data[at + 10 : at + 10 + size]
        if body and body[0] < 4:
            text = body[1:].decode(_ENCODINGS[body[0]], "replace").rstrip("\0")
            name, _, value = text.partition("\0") if data[at : at + 4] == b"TXXX" else (data[at : at + 4].decode("latin-1"), "", text)
            into[name] = value
        at += 10 + size


def _id3v1_into(tag: bytes, into: dict[str, str]) -> None:
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 125)):
        if value := tag[a:b].split(b"\0")[0].decode("latin-1").strip():
            into.setdefault(name, value)
    if not tag[125] and tag[126]:
        into.setdefault("track", str(tag[126]))


def _table(body: bytes, frame: bytes) -> tuple[str, int, int, bytes] | None:
    """The table of a first frame, if it has one."""
    if body[:4] in (b"Xing", b"Info") and len(body) >= 8:
        flags, at, read = int.from_bytes(body[4:8], "big"), 8, []
        for k in (1, 2):
            read.append(int.from_bytes(body[at : at + 4], "big") if flags & k else -1)
            at += 4 * bool(flags & k)
        return body[:4].decode(), read[0], read[1], body[at : at + 100] if flags & 4 else b""
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        return "VBRI", frames, size, frame[62 : 62 + entries * width] if scale else b""
    return None


def parse(data: bytes) -> Parsed:
    out = Parsed()
    at, end = 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        at = 10 + sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        _id3v2_into(data, min(at, end), out.tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        _id3v1_into(data[end:], out.tags)
    first, out.end = True, end
    while at < end:
        h = header_at(data, at)
        after = at + h.size if h else end + 1
        sound = h is not None and after <= end
        if sound and h.protected and h.layer == 3:
            sound = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.bad_crc += not sound and (after == end or header_at(data, after) is not None)
        if sound and (after == end or header_at(data, after) is not None or data[after : after + 3] == b"TAG"):
            body = data[at + 4 + 2 * h.protected + h.side : after]
            table = _table(body, data[at:after]) if first and h.layer == 3 else None
            if table:
                out.table, out.first = table, at
            else:
                out.offsets.append(at)
                out.bodies.append(body)
                out.rate = h.rate
                out.samples += h.samples
            first = False
            at = after
            continue
        to = data.find(b"\xff", at + 1, end)  # resynchronise
        to = end if to < 0 else to
        out.skipped += to - at
        at = to
    return out


MEDIA = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("media", T.BinaryType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_rate", T.LongType()),
    T.StructField("seek_offsets", T.ArrayType(T.LongType())),
])
FEATURES = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("samples", T.LongType()),
    T.StructField("sample_rate", T.LongType()),
    T.StructField("seek_offsets", T.ArrayType(T.LongType())),
])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes of its UTF-8, media, the stream that carries it, its exact duration
    as samples and sample_rate, and seek_offsets, where its frames begin."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = T.StructType([slim.schema["id"], *MEDIA.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            raws = batch.column("body").cast(pa.binary()).to_pylist()
            rows = []
            for raw in raws:
                raw = raw or b""
                media, offsets = muxed(raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
                rows.append((len(raw), media, 1152 * len(offsets), RATES[0], offsets))
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return slim.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored stream: what ``FEATURES`` lists. ``feature`` has frames, exact duration, checksum
    failures, skipped bytes, the bitrate table's frames and whether it holds, a CRC of the seek
    offsets, and whether duration and offsets are those stored beside the stream."""
    slim = media.select(F.col(id_col).alias("id"), *MEDIA.names)
    schema = T.StructType([slim.schema["id"], *FEATURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.column("media")), 0)).astype(np.int64))
            at = 0
            while at < whole.num_rows:  # some 4 MB of streams at a time
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 4_000_000)))
                part = whole.slice(at, end - at)
                at = end
                rows = []
                for n, raw, samples, rate, offsets in zip(*(part.column(c).to_pylist() for c in MEDIA.names), strict=True):
                    p = parse(raw or b"")
                    payload = p.payload()
                    seek = zlib.crc32(struct.pack(f">{len(p.offsets)}Q", *p.offsets))
                    same = (samples, rate, offsets) == (p.samples, p.rate, p.offsets)
                    table = f"{p.table[1]}/{'ok' if p.table_holds() else 'off'}" if p.table else "none"
                    feature = f"frames={len(p.offsets)};duration={p.samples}/{p.rate or 1};bad_crc={p.bad_crc};skipped={p.skipped};table={table};seek={seek:08x};stored={'ok' if same else 'off'}"
                    rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), feature, p.samples, p.rate, p.offsets))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return slim.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``to_media`` stored in the shared folder, read back, and its ``features``."""
    stored, _ = materialise(to_media(docs, id_col, text_col), "mpeg")
    return features(stored, id_col)
