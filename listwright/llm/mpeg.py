"""Operator 10: media columns as MPEG audio streams.

A text's bytes travel as the ancillary data of silent Layer III frames: a valid stream of variable bitrate, with an ID3v2
tag, an information frame with frame count, byte count and table of contents, protected frames and an ID3v1 tag."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import fewer, tune, written

UNIT = 64
# Fixed values of the MPEG audio format: kbit/s by bitrate index (0 is free format, 15 is bad), Hz by rate index.
KBITS_V1 = {
    1: (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
KBITS_V2 = {
    1: (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    3: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_START, CRC_POLYNOMIAL = 0xFFFF, 0x8005


@dataclass(frozen=True)
class Header:
    """One frame header: version 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5; size is the whole frame's, in bytes; bound is the
    first subband of Layer I that both channels share (32: none)."""

    version: int
    layer: int
    protected: bool
    kbits: int
    hertz: int
    padding: int
    mono: bool
    samples: int
    size: int
    bound: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def guarded(self) -> int | None:
        """Bytes behind the checksum that it covers: side information, or Layer I's bit allocation. Those of Layer II depend
        on its allocation tables and are not known here."""
        if self.layer == 3:
            return self.side
        return (16 if self.mono else (self.bound + 32) // 2) if self.layer == 1 else None

    @property
    def kin(self) -> tuple:
        """What all frames of one stream have in common."""
        return self.version, self.layer, self.hertz


@lru_cache(4096)
def header(word: bytes) -> Header | None:
    """The header of four bytes; None unless they can begin a frame (free format is not taken for one)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word[3] & 3 == 2:
        return None
    kbits, hertz, padding = (KBITS_V1 if version == 3 else KBITS_V2)[layer][rate], HERTZ[version][hz], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + padding
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, kbits, hertz, padding, word[3] >> 6 == 3, samples, size, bound)


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for b in range(256):
        r = b << 8
        for _ in range(8):
            r = (r << 1 ^ CRC_POLYNOMIAL if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return tuple(out)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """The frame checksum: over the header's last two bytes and the side information."""
    table, r = _crc_table(), CRC_START
    for b in data:
        r = (r << 8 & 0xFFFF) ^ table[r >> 8 ^ b]
    return r


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _from_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode() + b"\0"
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


@cache
def _sizes() -> list[tuple[int, bytes]]:
    """(body bytes, header) of the frames that are written: MPEG-1 Layer III, 32 kHz, mono, protected, by bitrate."""
    out = []
    for rate in range(1, 15):
        word = bytes((0xFF, 0xFA, rate << 4 | 2 << 2, 0xC0))
        out.append((header(word).size - 4 - 2 - 17, word))
    return out


def _frame(word: bytes, body: bytes) -> bytes:
    h = header(word)
    side = bytes(h.side)
    return b"".join((word, crc16(word[2:4] + side).to_bytes(2, "big"), side, body, bytes(h.size - 6 - h.side - len(body))))


def media_of(payload: bytes, n_bytes: int) -> bytes:
    """A stream that holds the payload: full frames of the highest bitrate, then the smallest frame that holds the rest."""
    sizes = _sizes()
    most, top = sizes[-1]
    frames = [_frame(top, payload[i : i + most]) for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(frames) * most :]:
        frames.append(_frame(next(w for room, w in sizes if room >= len(rest)), rest))
    info_word = next(w for room, w in sizes if room >= 4 + 4 + 4 + 4 + 100 + 4)
    total = header(info_word).size + sum(map(len, frames))
    starts = np.cumsum([header(info_word).size, *map(len, frames)])[:-1]
    toc = bytes(min(255, int(starts[min(len(frames) - 1, i * len(frames) // 100)]) * 256 // total) for i in range(100))
    info = b"Xing" + struct.pack(">III", 0xF, len(frames), total) + toc + struct.pack(">I", 0)
    tag = _text_frame("n_bytes", str(n_bytes)) + _text_frame("payload_bytes", str(len(payload))) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    head = b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag
    return b"".join((head, _frame(info_word, info), *frames, b"TAG" + bytes(124) + b"\xff"))


@dataclass
class Audio:
    """What a stream holds; offsets are the byte offsets of the frames with sound, gaps what was skipped (offset, bytes)."""

    tags: dict[str, str] = field(default_factory=dict)
    info: dict | None = None
    hertz: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    kbits: list[int] = field(default_factory=list)
    bad_crc: list[int] = field(default_factory=list)
    gaps: list[tuple[int, int]] = field(default_factory=list)
    body: bytes = b""

    @property
    def variable(self) -> bool:
        return len(set(self.kbits)) > 1

    @property
    def duration_us(self) -> int:
        """The exact duration is samples / hertz seconds; this is that in whole microseconds, rounded down."""
        return self.samples * 1_000_000 // self.hertz if self.hertz else 0

    def seek(self, second: float) -> int | None:
        """The offset of the frame that sounds at a time."""
        if not self.offsets or not 0 <= second * self.hertz < self.samples:
            return None
        return self.offsets[int(second * self.hertz) * len(self.offsets) // self.samples]


def _text(part: bytes) -> tuple[str, str]:
    """(description, value) of a user text: Latin-1, UTF-16 with or without a mark, or UTF-8."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(part[0] if part else 0, "latin-1")
    wide = kind.startswith("utf-16")
    body, at = part[1:], -1
    if not wide:
        at = body.find(b"\0")
    else:
        at = next((i for i in range(0, len(body) - 1, 2) if body[i : i + 2] == b"\0\0"), -1)
    key, value = (body, b"") if at < 0 else (body[:at], body[at + 1 + wide :])
    return key.decode(kind, "replace"), value.decode(kind, "replace").rstrip("\0")


def _id3(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(bytes of the ID3v2 tag at a place, its user texts); 0 bytes if there is none. Versions 2.2 to 2.4; where the flags say
    so, the zeros that were put behind FF bytes are taken out again."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 0x7F or data[at + 3] not in (2, 3, 4):
        return 0, {}
    version, flags = data[at + 3], data[at + 5]
    size = _from_syncsafe(data[at + 6 : at + 10])
    body, found, i = data[at + 10 : at + 10 + size], {}, 0
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and version > 2 and len(body) >= 4:  # an extended header
        i = _from_syncsafe(body[:4]) if version == 4 else int.from_bytes(body[:4], "big") + 4
    user, head = (b"TXX", 6) if version == 2 else (b"TXXX", 10)
    while i + head <= len(body) and body[i]:
        raw = body[i + len(user) : i + 2 * len(user)]
        n = _from_syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        part = body[i + head : i + head + n]
        if version == 4 and body[i + 9] & 2:
            part = part.replace(b"\xff\0", b"\xff")
        if version == 4 and body[i + 9] & 1:  # its length without those zeros stands first
            part = part[4:]
        if body[i : i + len(user)] == user:
            key, value = _text(part)
            found[key] = value
        i += head + n
    return 10 + size + (10 if flags & 0x10 and version == 4 else 0), found


def _info(frame: bytes, h: Header) -> dict | None:
    """The variable-bitrate table of a frame: Xing or Info behind the side information, or VBRI at its fixed place."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, i = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out: dict = {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = int.from_bytes(frame[i : i + 4], "big"), i + 4
        if flags & 4:
            out["toc"], i = frame[i : i + 100], i + 100
        if flags & 8:
            out["quality"] = int.from_bytes(frame[i : i + 4], "big")
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack_from(">IIHHH", frame, 46)
        table = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "table": table}
    return None


def _synced(data: bytes, at: int, end: int, kin: tuple | None) -> Header | None:
    """The header at a place, if a frame begins there: it must fit, be of the stream's kind, and be followed by the end or
    by another header of its kind."""
    h = header(data[at : at + 4])
    if h is None or at + h.size > end or (kin and h.kin != kin):
        return None
    after = header(data[at + h.size : at + h.size + 4])
    return h if at + h.size == end or (after and after.kin == h.kin) or (kin and end - at - h.size < 4) else None


def audio_of(data: bytes) -> Audio:
    """Parse a stream; bytes that are neither tag nor frame are skipped until headers agree again."""
    out, parts, at, end, kin, first = Audio(), [], 0, len(data), None, True
    if data[-128:-125] == b"TAG":
        end -= 128
    while at < end:
        size, tags = _id3(data, at)
        if size:
            out.tags |= tags
            at += size
            continue
        h = _synced(data, at, end, kin)
        if h is None:
            begun = at
            at += 1
            while at < end and not (data[at] == 0xFF and _synced(data, at, end, kin)) and data[at : at + 3] != b"ID3":
                near = [x for x in (data.find(b"\xff", at + 1, end), data.find(b"ID3", at + 1, end)) if x > 0]
                at = min(near, default=end)
            out.gaps.append((begun, min(at, end) - begun))
            continue
        frame, kin = data[at : at + h.size], h.kin
        start = 4 + 2 * h.protected
        if h.protected and h.guarded is not None and crc16(frame[2:4] + frame[6 : 6 + h.guarded]) != int.from_bytes(frame[4:6], "big"):
            out.bad_crc.append(at)
        info = _info(frame, h) if first and h.layer == 3 else None
        first = False
        if info:
            out.info = info
        else:
            out.offsets.append(at)
            out.kbits.append(h.kbits)
            out.samples += h.samples
            out.hertz = h.hertz
            parts.append(frame[start + h.side :] if h.layer == 3 else frame[start:])
        at += h.size
    out.body = b"".join(parts)
    return out


def payload_of(audio: Audio) -> bytes:
    """The payload that media_of() stored; an error if a checksum, a count or a length does not hold."""
    n = int(audio.tags["payload_bytes"])
    payload = audio.body[:n]
    whole = len(payload) == n and f"{zlib.crc32(payload):08x}" == audio.tags["payload_crc32"]
    if not whole or audio.bad_crc or audio.gaps or not audio.info or audio.info["frames"] != len(audio.offsets):
        raise ValueError("damaged stream")
    return payload


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): a stream for each text, in a written table. Null texts count as empty: 64 zero bytes."""
    tune(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            media = []
            for t in b["text"]:
                raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                media.append(media_of(raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)))
            yield pd.DataFrame({"key": b["key"], "media": media})

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return written(rows.mapInPandas(each, f"key {kind}, media binary"), "media")


def parsed(media: DataFrame) -> DataFrame:
    """(key, tags, hertz, samples, duration_us, offsets, kbits, bad_crc, gaps, payload) of streams (key, media): the exact
    duration is samples / hertz. A null stream is an empty one. The payload is null where checks fail."""
    kind = media.schema["key"].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in b["media"]:
                a = audio_of(bytes(data) if data is not None else b"")
                try:
                    payload = payload_of(a)
                except (KeyError, ValueError):
                    payload = None
                out.append((a.tags, a.hertz, a.samples, a.duration_us, a.offsets, a.kbits, a.bad_crc, [{"at": x, "bytes": n} for x, n in a.gaps], payload))
            got = pd.DataFrame(out, columns=["tags", "hertz", "samples", "duration_us", "offsets", "kbits", "bad_crc", "gaps", "payload"])
            got.insert(0, "key", b["key"].to_numpy())
            yield got

    shape = "tags map<string,string>, hertz int, samples long, duration_us long, offsets array<long>, kbits array<int>, bad_crc array<long>, gaps array<struct<at:long,bytes:long>>, payload binary"
    return media.mapInPandas(each, f"key {kind}, {shape}")


def op10_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document. The digest is made beside the parser, so that neither payloads nor seek tables leave their
    task. Null texts count as empty; repeated ids stay separate rows; no documents give no rows."""
    media = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for data in map(bytes, b["media"]):
                a = audio_of(data)
                payload, n = payload_of(a), int(a.tags["n_bytes"])
                seek = zlib.crc32(np.array(a.offsets, "<i8").tobytes())
                feature = f"frames={len(a.offsets)};hertz={a.hertz};samples={a.samples};us={a.duration_us};vbr={int(a.variable)};seek={seek:08x}"
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            got = pd.DataFrame(out, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            got.insert(0, "doc_id", b["key"].to_numpy())
            yield got

    return fewer(media).mapInPandas(each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
