"""Media columns: MPEG-1 Layer III streams that carry a payload, and a reader for such streams.

Stored form of a payload (a positive multiple of 192 bytes): an ID3v2.3 tag with an extended header and its CRC-32,
a table frame (`Xing`, or `Info` if all frames have one bitrate: frame count, byte count, 100 seek points), then one mono
48 kHz frame for each 192 bytes. A frame holds header, CRC-16, silent side information, the 192 bytes as
ancillary data and zeros; its bitrate is 80 kbit/s, or 96 kbit/s where the bytes are not all ASCII.

The reader takes any Layer III stream: it skips tags, searches for a header that is confirmed by the next one,
follows frame lengths, searches again where the chain breaks, reads the table frame, checks every CRC, and gives the exact
duration as samples over the rate and the byte offset of each frame.

Defined cases: null and empty texts become one unit of spaces; equal texts give equal stored bytes (nothing of the row but
its text is stored); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_path, text_or_empty

UNIT, SAMPLES = 192, 1152
# Fixed values of the format: kbit/s by index for version 1 and for versions 2 and 2.5, and Hz by version bits.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def crc16(data: bytes) -> int:
    """MPEG's CRC: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    length: int
    hertz: int
    kbits: int
    samples: int
    side: int
    protected: bool


def header(four: bytes) -> Header | None:
    """A Layer III frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0 or four[1] >> 1 & 3 != 1:
        return None
    version, rate, speed = four[1] >> 3 & 3, four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or rate in (0, 15) or speed == 3 or four[3] & 3 == 2:
        return None
    first, mono = version == 3, four[3] >> 6 == 3
    kbits, hertz = (KBITS_1 if first else KBITS_2)[rate], HERTZ[version][speed]
    length = (144_000 if first else 72_000) * kbits // hertz + (four[2] >> 1 & 1)
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return Header(length, hertz, kbits, 1152 if first else 576, side, not four[1] & 1)


def _prefix(kbits: int) -> bytes:
    """Header, CRC and silent side information of our frames."""
    head = bytes((0xFF, 0xFA, KBITS_1.index(kbits) << 4 | 1 << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + bytes(17))) + bytes(17)


_FRAMES = {k: (_prefix(k), bytes(144_000 * k // 48_000 - 23 - UNIT)) for k in (80, 96)}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _tag(values: dict[str, str]) -> bytes:
    frames = b""
    for name, value in values.items():
        body = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
        frames += b"TXXX" + struct.pack(">IH", len(body), 0) + body
    extended = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(frames))
    return b"ID3\3\0\x40" + _synchsafe(len(extended) + len(frames)) + extended + frames


def encode(payload: bytes, n_bytes: int) -> bytes:
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload's length must be a positive multiple of 192")
    frames = []
    if payload.isascii():
        a, z = _FRAMES[80]
        frames = [a + payload[i : i + UNIT] + z for i in range(0, len(payload), UNIT)]
    else:
        for i in range(0, len(payload), UNIT):
            part = payload[i : i + UNIT]
            a, z = _FRAMES[80 if part.isascii() else 96]
            frames.append(a + part + z)
    sizes = [len(x) for x in frames]
    head, _ = _FRAMES[80]
    total = 240 + sum(sizes)
    offsets, at = [], 240
    for n in sizes:
        offsets.append(at)
        at += n
    toc = bytes(min(255, 256 * offsets[len(offsets) * i // 100] // total) for i in range(100))
    table = (b"Xing" if len({*sizes}) > 1 else b"Info") + struct.pack(">III", 7, len(frames), total) + toc
    tag = _tag({"payload-bytes": str(n_bytes), "payload-crc32": str(zlib.crc32(payload))})
    return tag + head + table + bytes(240 - len(head) - len(table)) + b"".join(frames)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    tag_crc_ok: bool | None = None
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    hertz: int = 0
    samples: int = 0
    kbits: set[int] = field(default_factory=set)
    offsets: list[int] = field(default_factory=list)
    ancillary: list[bytes] = field(default_factory=list)
    checked: int = 0
    crc_errors: int = 0
    resyncs: int = 0
    skipped: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def _read_tag(data: bytes, out: Stream) -> int:
    """Parse an ID3v2.3 or v2.4 tag at the start; its length."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    body, at, crc = data[10 : 10 + size], 0, None
    if data[5] & 0x40 and data[3] == 3 and len(body) >= 10:
        length, flags = struct.unpack_from(">IH", body)
        crc = struct.unpack_from(">I", body, 10)[0] if flags & 0x8000 and len(body) >= 14 else None
        at = 4 + length
    frames = body[at:]
    if crc is not None:
        out.tag_crc_ok = zlib.crc32(frames) == crc
    at = 0
    while at + 10 <= len(frames) and frames[at]:
        name = frames[at : at + 4].decode("latin-1")
        n = sum(b << s for b, s in zip(frames[at + 4 : at + 8], (21, 14, 7, 0))) if data[3] == 4 else struct.unpack_from(">I", frames, at + 4)[0]
        text = frames[at + 11 : at + 10 + n].decode("latin-1")
        if name == "TXXX":
            name, _, text = text.partition("\0")
        if name:
            out.tags[name] = text
        at += 10 + n
    return 10 + size + (10 if data[5] & 0x10 else 0)


_SYNC = re.compile(rb"\xff[\xe2\xe3\xf2\xf3\xfa\xfb]")


def decode(data: bytes, ancillary: int = UNIT) -> Stream:
    """Parse a stream. `ancillary`: that many bytes after the side information of each audio frame are kept."""
    out, heads, sums = Stream(), {}, {}
    at, end = _read_tag(data, out), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    locked, first = False, True
    while at + 4 <= end:
        four = data[at : at + 4]
        h = heads[four] if four in heads else heads.setdefault(four, header(four))
        # Out of step, a header counts only if another one, or the end, follows its frame.
        if h is None or at + h.length > end or not (locked or at + h.length == end or header(data[at + h.length : at + h.length + 4])):
            out.resyncs += locked or first
            found = _SYNC.search(data, at + 1, end)
            out.skipped += (found.start() if found else end) - at
            at, locked, first = found.start() if found else end, False, False
            continue
        locked, body = True, at + 4 + 2 * h.protected
        side = data[body : body + h.side]
        if h.protected:
            key = four[2:] + side
            want = sums[key] if key in sums else sums.setdefault(key, crc16(key))
            out.checked += 1
            out.crc_errors += want != int.from_bytes(data[at + 4 : at + 6], "big")
        mark = data[body + h.side : body + h.side + 4] if first else b""
        first = False
        if mark in (b"Xing", b"Info"):
            p, out.table = body + h.side + 8, mark.decode()
            flags = int.from_bytes(data[p - 4 : p], "big")
            if flags & 1:
                out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                out.toc = data[p : p + 100]
        else:
            out.offsets.append(at)
            out.samples += h.samples
            out.kbits.add(h.kbits)
            out.hertz = out.hertz or h.hertz
            out.ancillary.append(data[body + h.side : body + h.side + ancillary])
        at += h.length
    return out


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, samples long, frame_offsets array<int>"


def store(docs: DataFrame, path: str) -> None:
    """Write each text's stream to Parquet under path, a row for each document."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 128):
                media, sizes = [], []
                for x in texts.slice(at, 128).cast(pa.binary()).to_pylist():
                    n = max(1, -(-len(x) // UNIT)) * UNIT
                    media.append(encode(x.ljust(n), len(x)))
                    sizes.append(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 128], pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    arrow_map(rows, run, STORED).write.options(**{"compression": "zstd", "parquet.block.size": 32 << 20, "parquet.enable.dictionary": "false"}).parquet(path)


def read(spark, path: str) -> DataFrame:
    """Parse the stored streams: payload digests, features, exact duration and seek offsets."""

    def run(batches):
        names = [x.split()[0] for x in READ.split(", ")]
        for batch in batches:
            ids, media = batch.column("doc_id").to_pylist(), batch.column("media")
            for at in range(0, len(ids), 128):
                rows = []
                for doc_id, data in zip(ids[at : at + 128], media.slice(at, 128).to_pylist()):
                    s = decode(data)
                    payload = b"".join(s.ancillary)
                    if s.crc_errors or s.tag_crc_ok is False or s.table_frames != len(s.offsets) or s.tags["payload-crc32"] != str(zlib.crc32(payload)):
                        raise ValueError(f"the stored stream of document {doc_id} is damaged")
                    feature = f"mpeg1-l3 {s.hertz}Hz {s.table.lower()} kbits={'/'.join(map(str, sorted(s.kbits)))} frames={len(s.offsets)} samples={s.samples} seconds={s.samples}/{s.hertz} crc={s.checked} resyncs={s.resyncs} toc={zlib.crc32(s.toc):08x}"
                    rows.append((doc_id, int(s.tags["payload-bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.seconds, s.samples, s.offsets))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return arrow_map(spark.read.schema(STORED).parquet(path).select("doc_id", "media"), run, READ)


def media_columns(docs: DataFrame) -> DataFrame:
    path = new_path(docs.sparkSession, "media")
    store(docs, path)
    return read(docs.sparkSession, path)
