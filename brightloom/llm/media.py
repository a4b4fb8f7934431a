"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

``parse`` reads a stream as players do: it skips and reads ID3v2 and ID3v1
tags, resynchronises on frame headers (a header counts if its fields are legal,
its checksum holds where it has one, and the next frame or the end follows), and
reads Xing/Info and VBRI tables. Durations are exact: samples over a rate.
``media_columns`` applies it to a table of files.

``build`` stores any bytes losslessly as a playable stream: MPEG-1 layer III
frames of silence whose ancillary data are the bytes, each frame protected by
its CRC, the whole by the music CRC of the info tag, which also has the frame
count, byte count and a seek table. ``payload`` reads the bytes back.

Defined results: null or empty bytes have no frames and duration 0; garbage
gives ``resyncs`` and no frames; damaged frames are passed over and counted. A
file that cannot be read at all has nulls and what went wrong in ``error``.
A null or empty text has one block of padding as payload. Nulls, repeated rows
and other columns pass as they come. One file is held in memory at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brightloom.llm.common import require, sliced

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by (MPEG 1?, layer), Hz by version.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _table(poly: int, reflected: bool) -> list[int]:
    """CRC-16 of each byte, or of each 16-bit word for the reflected form."""
    out = []
    for i in range(65536 if reflected else 256):
        c = i if reflected else i << 8
        for _ in range(16 if reflected else 8):
            c = (c >> 1) ^ (poly if c & 1 else 0) if reflected else ((c << 1) ^ (poly if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return out


_FRAME_CRC, _MUSIC_CRC = _table(0x8005, False), _table(0xA001, True)


def frame_crc(data: bytes) -> int:
    """The checksum of protected frames: over the last two header bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _FRAME_CRC[(c >> 8) ^ b]
    return c


def music_crc(data: bytes) -> int:
    """The info tag's checksum over all audio frames, two bytes a step."""
    c, table, even = 0, _MUSIC_CRC, len(data) & ~1
    words = memoryview(data)[:even]
    for w in struct.unpack(f"<{even // 2}H", words):
        c = table[c ^ w]
    if len(data) & 1:
        c ^= data[-1]
        for _ in range(8):
            c = (c >> 1) ^ (0xA001 if c & 1 else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    hertz: int
    padding: int
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbps // self.hertz + self.padding) * 4
        return self.samples * 125 * self.kbps // self.hertz + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.version, self.layer, self.hertz


_HEADERS: dict[bytes, Header | None] = {}


def header(data: bytes, at: int) -> Header | None:
    """The frame header at a place, if its fields are legal (free format is not)."""
    raw = data[at : at + 4]
    if raw not in _HEADERS:
        if len(_HEADERS) > 10_000:
            _HEADERS.clear()
        _HEADERS[raw] = _header(raw)
    return _HEADERS[raw]


def _header(raw: bytes) -> Header | None:
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or raw[3] & 3 == 2:
        return None
    return Header(version, layer, not raw[1] & 1, _RATES[version == 3, layer][rate], _HERTZ[version][hertz], raw[2] >> 1 & 1, raw[3] >> 6 == 3)


def _intact(data: bytes, at: int, h: Header) -> bool:
    """Whether the frame is whole and its checksum, if it has one that covers known bytes, holds."""
    if at + h.size > len(data):
        return False
    if not h.protected or h.layer != 3:
        return True
    return int.from_bytes(data[at + 4 : at + 6]) == frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side])


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1")
    return raw[1:].decode(kind, "replace").rstrip("\0")


def id3v2(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of a leading ID3v2.2, 2.3 or 2.4 tag, and the tag's length (0: none); frames that a cut leaves short are left out."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 0x7F:
        return {}, 0
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    length = 10 + size + (10 if version == 4 and flags & 0x10 else 0)
    body, at, tags = data[10 : 10 + size], 0, {}
    if flags & 0x80 and version < 4:  # in 2.4 unsynchronisation is a matter of each frame
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2:  # extended header: its size leaves out itself in 2.3
        at = 4 + int.from_bytes(body[:4]) if version < 4 else _syncsafe(body[:4].ljust(4, b"\0"))
    wide = 4 if version > 2 else 3
    head = 10 if version > 2 else 6
    while at + head <= len(body) and body[at]:
        raw = body[at + wide : at + 2 * wide]
        n = _syncsafe(raw) if version == 4 else int.from_bytes(raw)
        name, held = body[at : at + wide].decode("latin-1"), body[at + head : at + head + n]
        at += head + n
        if len(held) < n:
            break
        if version == 4 and body[at - n - 1] & 2:
            held = held.replace(b"\xff\0", b"\xff")
        if name in ("TXXX", "TXX"):
            key, _, value = _text(held).partition("\0")
            tags[f"TXXX:{key}"] = value.lstrip("﻿")
        elif name[0] == "T":
            tags[name] = _text(held)
    return tags, length


def id3v1(data: bytes) -> tuple[dict[str, str], int]:
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return {}, 0
    part = lambda a, b: data[len(data) - 128 + a : len(data) - 128 + b].split(b"\0")[0].decode("latin-1").strip()
    fields = {"title": part(3, 33), "artist": part(33, 63), "album": part(63, 93), "year": part(93, 97)}
    return {k: v for k, v in fields.items() if v}, 128


@dataclass
class Stream:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    kind: tuple[int, int, int] | None = None
    offsets: list[int] = field(default_factory=list)  # of audio frames, from the start of the file
    sizes: list[int] = field(default_factory=list)
    sides: list[int] = field(default_factory=list)  # bytes of each frame before its main data
    samples: int = 0
    table: dict = field(default_factory=dict)  # of the Xing, Info or VBRI header
    resyncs: int = 0
    skipped: int = 0  # bytes passed over while out of step
    crc_checked: int = 0
    music_ok: bool | None = None

    @property
    def hertz(self) -> int:
        return self.kind[2] if self.kind else 0

    @property
    def duration_us(self) -> int:
        """Rounded down; ``samples`` over ``hertz`` is exact."""
        return self.samples * 1_000_000 // self.hertz if self.hertz else 0


def _vbr_table(frame: bytes, h: Header) -> dict:
    """The Xing, Info or VBRI header of a first frame; empty if it has none."""
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(frame[at + 4 : at + 8]), at + 8
        out: dict = {"name": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4])
                p += 4
        if flags & 4:
            out["toc"] = list(frame[p : p + 100])
            p += 100
        p += 4 * (flags >> 3 & 1)
        if len(frame) >= p + 36 and frame[p : p + 4].isalnum():
            out |= {"encoder": frame[p : p + 9].decode("latin-1"), "music_crc": int.from_bytes(frame[p + 32 : p + 34])}
            out["tag_ok"] = music_crc(frame[: p + 34]) == int.from_bytes(frame[p + 34 : p + 36])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        count, scale, width, per = struct.unpack_from(">4H", frame, 54)
        count = min(count, (len(frame) - 62) // width) if 1 <= width <= 4 else 0
        step = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width]) * scale for i in range(count)]
        return {"name": "VBRI", "bytes": int.from_bytes(frame[46:50]), "frames": int.from_bytes(frame[50:54]), "toc": list(accumulate(step)), "frames_per_entry": per}
    return {}


def parse(data: bytes | None) -> Stream:
    """Reads a stream, damaged or not."""
    out = Stream()
    if not data:
        return out
    out.tags, at = id3v2(data)
    more, tail = id3v1(data)
    out.tags |= more
    end, synced, first = len(data) - tail, True, True
    data = data[:end] if tail else data
    while at + 4 <= end:
        h = header(data, at)
        good = h is not None and (out.kind is None or h.kind == out.kind) and _intact(data, at, h)
        if good and (not synced or out.kind is None) and at + h.size < end:
            # Out of step, or at the start: one header is no proof, the next must follow.
            after = header(data, at + h.size)
            good = after is not None and after.kind == h.kind
        if not good:
            out.resyncs += synced
            synced = False
            step = data.find(b"\xff", at + 1)
            step = end if step < 0 else step
            out.skipped += step - at
            at = step
            continue
        synced, out.kind = True, h.kind
        out.crc_checked += h.protected and h.layer == 3
        if first and (table := _vbr_table(data[at : at + h.size], h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.sides.append(4 + 2 * h.protected + h.side)
            out.samples += h.samples
        first = False
        at += h.size
    if at < end and synced:
        out.skipped += end - at
    if "music_crc" in out.table and out.offsets:
        audio = data[out.offsets[0] : out.offsets[-1] + out.sizes[-1]]
        out.music_ok = music_crc(audio) == out.table["music_crc"]
    return out


# Storing bytes as a stream

_SIDE = bytes(17)  # layer III, one channel, two granules without any code bits: silence


def _frame_start(kbps_at: int) -> bytes:
    """Header, checksum and side information of an MPEG-1 layer III frame, 48 kHz, one channel, protected."""
    head = bytes((0xFF, 0xFA, kbps_at << 4 | 1 << 2, 0xC0))
    return head + frame_crc(head[2:] + _SIDE).to_bytes(2) + _SIDE


_STARTS = [(_frame_start(i), 3 * r) for i, r in enumerate(_RATES[True, 3]) if r]  # at 48 kHz a frame has 3 bytes for each kbit/s
_ROOM = [size - len(start) for start, size in _STARTS]


def _tag(values: dict[str, str]) -> bytes:
    frames = b""
    for key, value in values.items():
        body = b"\0" + f"{key}\0{value}".encode("latin-1")
        frames += b"TXXX" + len(body).to_bytes(4) + b"\0\0" + body
    n = len(frames)
    return b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frames


def build(payload: bytes) -> bytes:
    """``payload`` as a stream: full frames of the highest rate, the last of the lowest that holds the rest."""
    start, size = _STARTS[-1]
    room = _ROOM[-1]
    frames = [start + payload[i : i + room] for i in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(frames) * room :]:
        k = next(i for i, r in enumerate(_ROOM) if r >= len(rest))
        frames.append((_STARTS[k][0] + rest).ljust(_STARTS[k][1], b"\0"))
    audio = b"".join(frames)
    info_start, info_size = _STARTS[6]
    total = info_size + len(audio)
    places = [info_size + size * (i * len(frames) // 100) for i in range(100)]
    toc = bytes(min(255, 256 * p // total) for p in places)
    info = info_start + b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + total.to_bytes(4) + toc
    info += b"LAME3.100" + bytes(23) + music_crc(audio).to_bytes(2)
    info += music_crc(info).to_bytes(2)
    return _tag({"payload": str(len(payload))}) + info.ljust(info_size, b"\0") + audio


def payload(data: bytes, stream: Stream) -> bytes:
    """The bytes that ``build`` stored, from a parsed stream; raises ValueError if the stream is damaged."""
    size = int(stream.tags.get("TXXX:payload", -1))
    out = b"".join(data[o + s : o + n] for o, n, s in zip(stream.offsets, stream.sizes, stream.sides, strict=True))
    if stream.skipped or stream.music_ok is False or stream.table.get("frames") != len(stream.offsets) or not 0 <= size <= len(out):
        raise ValueError("the stream is damaged")
    return out[:size]


# Columns

COLUMNS = (
    "mpeg string, sample_rate int, n_frames bigint, n_samples bigint, duration_us bigint, seek_offsets array<bigint>, "
    "tags map<string,string>, vbr string, vbr_frames bigint, vbr_toc array<bigint>, music_crc_ok boolean, "
    "crc_checked bigint, resyncs bigint, skipped_bytes bigint, error string"
)
_NAMES = {3: "1", 2: "2", 0: "2.5"}


def _row(s: Stream) -> tuple:
    kind = f"{_NAMES[s.kind[0]]}.{s.kind[1]}" if s.kind else None
    return (
        kind, s.hertz, len(s.offsets), s.samples, s.duration_us, s.offsets, s.tags, s.table.get("name"),
        s.table.get("frames"), s.table.get("toc"), s.music_ok, s.crc_checked, s.resyncs, s.skipped, None,
    )


def _parsed(data: bytes | None) -> tuple:
    """``_row`` of the file; where it can't be read, nulls and what went wrong, so that one bad file costs no other."""
    try:
        return _row(parse(data))
    except Exception as e:  # noqa: BLE001
        return (*[None] * (len(COLUMNS.split(", ")) - 1), f"{type(e).__name__}: {e}")


def media_columns(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with a struct ``media`` of ``COLUMNS`` parsed from the bytes in ``content``."""
    require(files, content)
    schema = T.StructType([f for f in files.schema.fields if f.name != "media"]).add("media", T._parse_datatype_string(COLUMNS))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema).field("media").type
        for batch in sliced(batches, content):
            names = [n for n in batch.schema.names if n != "media"]
            rows = [dict(zip([f.name for f in kind], _parsed(v.as_py()), strict=True)) for v in batch[content]]
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + [pa.array(rows, kind)], [*names, "media"])

    return files.mapInArrow(run, schema)


def stored_payloads(docs: DataFrame, block: int = 576) -> DataFrame:
    """Texts stored as streams and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, duration_us, seek_offsets. The payload is the text in UTF-8 with bytes 255 up to
    a positive multiple of ``block``.
    """
    require(docs, "doc_id", "text")
    fields = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_us bigint, seek_offsets array<bigint>"
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for f in T._parse_datatype_string(fields):
        schema = schema.add(f)

    def run(batches: Iterable) -> Iterator:
        import zlib
        from hashlib import sha256

        import pyarrow as pa

        kinds = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema.fields[1:-1]] + [pa.list_(pa.int64())]
        for batch in sliced(batches, "text"):
            rows = []
            for value in batch["text"]:
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                media = build(raw + b"\xff" * (-len(raw) % block or block * (not raw)))
                stream = parse(media)
                back = payload(media, stream)
                seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
                feature = (
                    f"mpeg{_NAMES[stream.kind[0]]}.{stream.kind[1]};hz={stream.hertz};frames={len(stream.offsets)};samples={stream.samples};"
                    f"us={stream.duration_us};{stream.table['name']}={stream.table['bytes']};music={stream.table['music_crc']:04x};seek={seek:08x}"
                )
                rows.append((len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha256(media).hexdigest(), feature, stream.duration_us, stream.offsets))
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch["doc_id"]] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
