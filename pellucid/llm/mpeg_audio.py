"""MPEG audio columns: a Layer III writer for byte payloads and a reader that trusts nothing.

The writer keeps a payload of bytes losslessly in the ancillary data of silent MPEG-1 Layer III frames.
The reader takes any stream but free-format ones: it skips tags, resynchronises on frame headers, reads the Xing or
VBRI table, verifies the checksums of all three layers and returns the exact duration as a fraction and the byte
offset of every frame. Frames with a bad checksum count on, as they sound for their time, and are listed by number.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import pick, ship, slices, texts, to_batch

# Fixed values of the MPEG audio standard: bit rates in kbit/s by (MPEG-1?, layer), index 1 to 14; sample rates by version bits.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Layer II: bits of a subband's allocation, by subband, for MPEG-1, for MPEG-1 under 56 kbit/s a channel and for MPEG-2.
ALLOCATION = (4,) * 11 + (3,) * 12 + (2,) * 7, (4,) * 2 + (3,) * 10, (4,) * 4 + (3,) * 7 + (2,) * 19
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: What the writer makes: MPEG-1 Layer III with checksum, 80 kbit/s, 48 kHz, one channel: 240 bytes a frame,
#: 4 of header, 2 of checksum, 17 of side information (all zero: silence), 192 of payload, 25 of stuffing.
HEADER = bytes((0xFF, 0xFA, 0x64, 0xC0))
FRAME, UNIT, SIDE, RATE, SAMPLES = 240, 192, 17, 48000, 1152


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(4096)
def parse_header(raw: bytes) -> Header | None:
    """A frame header, or None if the four bytes are none (free-format streams count as none)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4
    rate_at = raw[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate_at == 3 or raw[3] & 3 == 2:
        return None
    kbps, rate, pad = BITRATES[version == 3, layer][bits - 1], SAMPLE_RATES[version][rate_at], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbps * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + pad
    return Header(version, layer, not raw[1] & 1, kbps, rate, raw[3] >> 6 == 3, size, samples)


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of MPEG audio over all or the first `bits` bits: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc, bits = 0xFFFF, 8 * len(data) if bits is None else bits
    for i, byte in enumerate(data):
        n = min(8, bits - 8 * i)
        crc ^= (byte >> 8 - n << 8 - n) << 8
        for _ in range(n):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _guarded(h: Header, raw: bytes, body: bytes) -> int:
    """How many bits of a frame's body its checksum covers: side information (III), allocation (I, II) and scfsi (II)."""
    if h.layer == 3:
        return 8 * h.side
    channels, joint = 1 if h.mono else 2, raw[3] >> 6 == 1
    bound = 4 * (raw[3] >> 4 & 3) + 4 if joint else 32
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + bound)
    kbps, widths = h.kbps // channels, ALLOCATION[0 if h.version == 3 else 2]
    if h.version == 3:
        if kbps < 56:
            widths = ALLOCATION[1][: 12 if h.rate == 32000 else 8]
        elif kbps < 96 or h.rate == 48000:
            widths = widths[:27]
    value, size, at, used = int.from_bytes(body[:48], "big"), 8 * len(body[:48]), 0, 0
    for band, width in enumerate(widths):
        shared = channels == 2 and band >= bound
        for _ in range(1 if shared else channels):
            if value >> max(0, size - at - width) & (1 << width) - 1:
                used += 2 if shared else 1
            at += width
    return at + 2 * used


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _head(header: bytes, side: bytes) -> bytes:
    return header + struct.pack(">H", crc16(header[2:4] + side)) + side


_SILENT = _head(HEADER, bytes(SIDE))


def write_mpeg(payload: bytes, unpadded: int | None = None) -> bytes:
    """A stream that holds the payload (a positive multiple of 192 bytes), 192 bytes a frame.

    Layout: ID3v2.4 tag (payload length before padding), a frame with the Xing table, data frames, ID3v1 tag.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 192 bytes")
    n = len(payload) // UNIT
    text = b"\x03payload\x00" + str(len(payload) if unpadded is None else unpadded).encode()
    frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    body = b"".join([_SILENT + payload[i : i + UNIT] + bytes(FRAME - len(_SILENT) - UNIT) for i in range(0, len(payload), UNIT)])
    toc = bytes(min(255, 256 * (1 + i * n // 100) // (n + 1)) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    first = (_SILENT + xing).ljust(FRAME, b"\x00")
    id3v1 = b"TAG" + b"payload".ljust(124, b"\x00") + b"\xff"
    return b"ID3\x04\x00\x00" + _syncsafe(len(frame)) + frame + first + body + id3v1


@dataclass
class Stream:
    """What the reader finds. duration is samples / rate exactly; offsets are those of all frames, bad_frames the
    numbers of those whose checksum is wrong (their payload is not covered by it and stays)."""

    tags: dict = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    frames: int = 0
    bad_checksums: int = 0
    bad_frames: list = field(default_factory=list)
    skipped: int = 0
    xing: dict | None = None
    vbri: dict | None = None
    offsets: list = field(default_factory=list)
    kbps: dict = field(default_factory=dict)
    payload: bytes = b""

    @property
    def duration(self) -> tuple[int, int]:
        if not self.rate:
            return 0, 1
        g = math.gcd(self.samples, self.rate) or 1
        return self.samples // g, self.rate // g

    def seek(self, seconds: float) -> int | None:
        """Offset of the frame that sounds at that time."""
        at = int(seconds * self.rate * self.frames / self.samples) if self.samples else -1
        return self.offsets[at] if 0 <= at < len(self.offsets) else None


def _tags(data: bytes, out: Stream) -> tuple[int, int]:
    """Reads the tags; where the audio starts and ends."""
    start, end = 0, len(data)
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = 0
        for b in data[start + 6 : start + 10]:
            size = size << 7 | b & 127
        at, stop = start + 10, min(start + 10 + size, len(data))
        wide = data[start + 3] == 3  # version 2.3 has plain sizes
        while at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if wide else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            body = data[at + 10 : min(at + 10 + n, stop)]
            if data[at : at + 1] == b"T" and body:
                coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                out.tags[data[at : at + 4].decode()] = body[1:].decode(coding, "replace").strip("\x00")
            at += 10 + n
        start = min(start + 10 + size + (10 if data[start + 5] & 16 else 0), len(data))
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    return start, end


def read_mpeg(data: bytes) -> Stream:
    """Reads any MPEG audio stream; bytes that belong to no frame are skipped and counted.

    A header counts only if its frame ends at another header or where the audio ends. Empty data gives an
    empty stream. payload: the ancillary data of silent Layer III frames in units of 192 bytes.
    """
    out = Stream()
    at, end = _tags(data, out)
    parts, locked = [], False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        after = at + h.size if h else 0
        if not h or after > end or not locked and after != end and parse_header(data[after : after + 4]) is None:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at, locked = found, False
            continue
        locked = True
        head = 6 if h.checked else 4
        side = data[at + head : at + head + h.side] if h.layer == 3 else b""
        bad = False
        if h.checked:
            guarded = side if h.layer == 3 else data[at + 6 : after]
            bits = _guarded(h, data[at : at + 4], guarded)
            bad = crc16(data[at + 2 : at + 4] + guarded[: (bits + 7) // 8], 16 + bits) != data[at + 4] << 8 | data[at + 5]
            out.bad_checksums += bad
        body = at + head + len(side)
        if out.xing is None and not out.frames and data[body : body + 4] in (b"Xing", b"Info"):
            out.xing = _xing(data[body : min(after, body + 120)])
        elif out.vbri is None and not out.frames and h.layer == 3 and data[at + 36 : at + 40] == b"VBRI" and after >= at + 62:
            out.vbri = _vbri(data[at + 36 : after])
        else:
            if bad:
                out.bad_frames.append(out.frames)
            out.offsets.append(at)
            out.frames += 1
            out.samples += h.samples
            out.rate = out.rate or h.rate
            out.kbps[h.kbps] = out.kbps.get(h.kbps, 0) + 1
            if side and not any(side) and after - body >= UNIT:
                parts.append(data[body : body + UNIT])
        at = after
    out.skipped += max(0, end - at)
    out.payload = b"".join(parts)
    return out


def _xing(raw: bytes) -> dict:
    flags, at, out = int.from_bytes(raw[4:8], "big"), 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(raw[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["toc"] = raw[at : at + 100]
    return out


def _vbri(raw: bytes) -> dict:
    """stretches: bytes of each stretch of frames_each frames, multiplied out."""
    size, frames, n, scale, width, each = struct.unpack(">IIHHHH", raw[10:26])
    stretches = [int.from_bytes(raw[a : a + width], "big") * scale for a in range(26, min(len(raw), 26 + n * width) - width + 1, width)] if 0 < width <= 4 else []
    return {"frames": frames, "bytes": size, "frames_each": each, "stretches": stretches}


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
STREAM = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("tags", pa.map_(pa.string(), pa.string())), ("rate", pa.int32()), ("samples", pa.int64()), ("duration_num", pa.int64()), ("duration_den", pa.int64()), ("n_frames", pa.int64()),
    ("bad_checksums", pa.int64()), ("bad_frames", pa.list_(pa.int64())), ("skipped", pa.int64()), ("kbps", pa.map_(pa.int32(), pa.int64())), ("xing", pa.struct([("frames", pa.int64()), ("bytes", pa.int64()), ("toc", pa.binary())])), ("vbri", pa.struct([("frames", pa.int64()), ("bytes", pa.int64()), ("frames_each", pa.int64()), ("stretches", pa.list_(pa.int64()))])), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()),
])
_STREAM_DDL = "doc_id long, n_bytes long, media binary, tags map<string, string>, rate int, samples long, duration_num long, duration_den long, n_frames long, bad_checksums long, bad_frames array<long>, skipped long, kbps map<int, long>, xing struct<frames: bigint, bytes: bigint, toc: binary>, vbri struct<frames: bigint, bytes: bigint, frames_each: bigint, stretches: array<bigint>>, offsets array<long>, payload binary"


def media_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), write_mpeg(raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as MPEG audio: doc_id, n_bytes (before padding), media (the stream's bytes).

    Texts are padded with spaces to a positive multiple of 192 bytes; null counts as empty. A row's result
    depends on its text alone, so repeated rows get equal streams and nothing is shuffled. Very long texts are
    stored whole, in as many frames as they take; null ids stay null; other columns, whatever their names, are
    not looked at; an empty table gives an empty result.
    """

    def run(batches):
        for part in slices(batches):
            made = [media_of(x) for x in texts(part)]
            yield to_batch(SCHEMA, {"doc_id": part.column(0), "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_streams(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads streams back, all that the reader finds: tags, exact duration (duration_num / duration_den seconds), the Xing
    or VBRI table, the byte offset of every frame, the numbers of those with a bad checksum, the payload, and the stream itself. Null: empty stream."""

    def run(batches):
        for part in slices(batches, "media"):
            rows = [_columns(read_mpeg(m or b"")) for m in part.column(2).to_pylist()]
            yield to_batch(STREAM, {k: part.column(i) for i, k in enumerate(STREAM.names[:3])} | {k: [r[k] for r in rows] for k in STREAM.names[3:]})

    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, _STREAM_DDL)


def _columns(s: Stream) -> dict:
    a, b = s.duration
    return {
        "tags": list(s.tags.items()), "rate": s.rate, "samples": s.samples, "duration_num": a, "duration_den": b, "n_frames": s.frames, "bad_checksums": s.bad_checksums, "bad_frames": s.bad_frames, "skipped": s.skipped, "kbps": sorted(s.kbps.items()),
        "xing": s.xing, "vbri": s.vbri, "offsets": s.offsets, "payload": s.payload,
    }


def feature():
    """Column: duration, frame figures and seek points of what read_streams returns as JSON with sorted keys."""
    n = F.size("offsets")
    points = F.when(n > 0, F.array(*[F.get("offsets", F.floor(n * i / 4).cast("int")) for i in range(4)])).otherwise(F.array().cast("array<long>"))
    swapped = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 16, "0"), i, 2) for i in range(15, 0, -2)])
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    rates = F.array_sort(F.transform(F.map_entries("kbps"), lambda x: F.concat(F.lit('"'), x["key"].cast("string"), F.lit('":'), x["value"].cast("string"))))
    offsets = F.md5(F.unhex(F.array_join(F.transform("offsets", swapped), "")))
    return F.format_string(
        '{"bad_checksums":%d,"duration":"%d/%d","frames":%d,"kbps":{%s},"offsets_md5":"%s","rate":%d,"samples":%d,"seek":[%s],"skipped":%d,"vbr_frames":%s}',
        "bad_checksums", "duration_num", "duration_den", "n_frames", F.array_join(rates, ","), offsets, "rate", "samples", listed(points), "skipped", F.coalesce(F.coalesce("xing.frames", "vbri.frames").cast("string"), F.lit("null")),
    )


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """What read_streams finds, with the sizes and digests of payload and stream and the feature beside."""
    stream = F.coalesce("media", F.lit(b""))
    return read_streams(media, media_col).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256), "tail_crc32": F.crc32(F.substring("payload", -16, 16)),
        "media_bytes": F.octet_length(stream).cast("long"), "media_sha256": F.sha2(stream, 256), "feature": feature(),
    })
