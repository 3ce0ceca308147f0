"""Media columns: bytes kept as 8-bit audio in Matroska, and packet tables parsed from it.

``store`` writes a payload as one PCM track: EBML header, segment information,
track entry, cues, and clusters of laced simple blocks. ``parse`` reads any
Matroska bytes: variable-length ids and sizes (unknown sizes too), clusters,
simple blocks and block groups, all four kinds of lacing, and cues. Each frame
becomes a packet with track, timestamp and byte range.

Defined results: null text is empty, and an empty payload is padding alone;
equal texts give equal media; damaged bytes raise ``ValueError``; null media
has no packets; an empty table gives no rows; other columns are not read.
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

from aspectra.llm.common import arrow_map

# Fixed values of the format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING_FLAG, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS))

FRAME = 192
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_A_BLOCK = 8
FRAMES_A_CLUSTER = 128
PACKETS = "doc_id long, track int, timestamp_ms long, keyframe boolean, first_byte long, end_byte long"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def vint(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer, of the least width unless one is given."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(content)) + content


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID_LENGTH, 4) + number(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
_AUDIO = element(AUDIO, element(SAMPLING_RATE, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING_FLAG, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + _AUDIO))


def padded(text: bytes) -> bytes:
    """Text with bytes 32 up to a positive multiple of a frame."""
    return text + b" " * (-len(text) % FRAME if text else FRAME)


def store(payload: bytes) -> bytes:
    """The payload as the one track of a Matroska file; its length is a multiple of a frame."""
    frames = len(payload) // FRAME
    clusters = []
    for first in range(0, frames, FRAMES_A_CLUSTER):
        blocks = [number(TIMESTAMP, first * FRAME_MS)]
        for at in range(first, min(frames, first + FRAMES_A_CLUSTER), FRAMES_A_BLOCK):
            n = min(FRAMES_A_BLOCK, frames - at)
            head = b"\x81" + ((at - first) * FRAME_MS).to_bytes(2, "big", signed=True)
            head += b"\x80" if n == 1 else bytes((0x84, n - 1))  # keyframe; several frames of equal size share a block
            blocks.append(element(SIMPLE_BLOCK, head + payload[at * FRAME : (at + n) * FRAME]))
        clusters.append(element(CLUSTER, b"".join(blocks)))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_MS)) + element(MUXER, b"aspectra") + element(WRITER, b"aspectra"))
    places = np.cumsum([0, *map(len, clusters)])[:-1].tolist()

    def cues(base: int) -> bytes:
        points = (element(CUE_POINT, number(CUE_TIME, i * FRAMES_A_CLUSTER * FRAME_MS) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + element(CUE_CLUSTER, (base + p).to_bytes(8, "big")))) for i, p in enumerate(places))
        return element(CUES, b"".join(points))

    base = len(info) + len(_TRACKS) + len(cues(0))  # positions have a fixed width, so the cues' length doesn't depend on them
    return _HEADER + element(SEGMENT, b"".join((info, _TRACKS, cues(base), *clusters)))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp ms, keyframe, first byte, end byte)."""

    doc_type: str = ""
    codec: str = ""
    rate: float = 0.0
    channels: int = 1
    bits: int = 0
    duration_ms: float = 0.0
    scale: int = 1_000_000
    frame_ns: int = 0
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # place in the segment, timestamp
    cues: list[tuple[int, int]] = field(default_factory=list)


def read_vint(data: bytes, at: int) -> tuple[int, int, int]:
    """Value with the marker, value without it (-1: unknown), and the place after it."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("not a variable-length integer")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return raw, -1 if value == (1 << 7 * width) - 1 else value, at + width


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames by its lacing, and where the first one starts."""
    if not kind:
        return [end - at], at
    count = data[at] + 1
    at += 1
    if kind == 2:  # equal sizes
        if (end - at) % count:
            raise ValueError("frames of equal size don't fill their block")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    if kind == 1:  # sums of bytes, of which one under 255 ends a size
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:  # a first size, then signed differences
        _, size, at = read_vint(data, at)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            _, step, at = read_vint(data, at)
            sizes.append(sizes[-1] + step - ((1 << 7 * (at - before) - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("frames are longer than their block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """Packets, clusters and cues of Matroska bytes."""
    out = Media()
    stack = [(0, len(data))]  # element id and end of the open masters
    at, segment, cluster_time, cue_time = 0, 0, 0, 0
    try:
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1][1]:
                stack.pop()
            here = at
            _, _, after = read_vint(data, at)
            ident = int.from_bytes(data[at:after], "big")
            _, size, at = read_vint(data, after)
            if ident == CLUSTER:
                while len(stack) > 1 and stack[-1][0] in (CLUSTER, BLOCK_GROUP):  # one of unknown size ends where the next begins
                    stack.pop()
                out.clusters.append((here - segment, 0))
            end = stack[-1][1] if size < 0 else at + size
            if end > len(data):
                raise ValueError("an element ends after the data")
            if ident in MASTERS:
                stack.append((ident, end))
                if ident == SEGMENT:
                    segment = at
                continue
            if ident in (SIMPLE_BLOCK, BLOCK):
                _, track, place = read_vint(data, at)
                flags = data[place + 2]
                when = cluster_time + int.from_bytes(data[place : place + 2], "big", signed=True)
                sizes, first = frame_sizes(data, place + 3, end, flags >> 1 & 3)
                for i, n in enumerate(sizes):
                    stamp = when * out.scale + i * out.frame_ns
                    out.packets.append((track, stamp // 1_000_000, ident == BLOCK or flags >= 128, first, first + n))
                    first += n
            elif ident == TIMESTAMP:
                cluster_time = int.from_bytes(data[at:end], "big")
                out.clusters[-1] = (out.clusters[-1][0], cluster_time)
            elif ident == CUE_TIME:
                cue_time = int.from_bytes(data[at:end], "big")
            elif ident == CUE_CLUSTER:
                out.cues.append((cue_time, int.from_bytes(data[at:end], "big")))
            elif ident == DOC_TYPE:
                out.doc_type = data[at:end].decode()
            elif ident == CODEC_ID:
                out.codec = data[at:end].decode()
            elif ident in (SAMPLING_RATE, DURATION):
                value = struct.unpack(">d" if size == 8 else ">f", data[at:end])[0]
                if ident == SAMPLING_RATE:
                    out.rate = value
                else:
                    out.duration_ms = value * out.scale / 1_000_000
            elif ident in (CHANNELS, BIT_DEPTH, TIMESTAMP_SCALE, DEFAULT_DURATION):
                value = int.from_bytes(data[at:end], "big")
                if ident == CHANNELS:
                    out.channels = value
                elif ident == BIT_DEPTH:
                    out.bits = value
                elif ident == TIMESTAMP_SCALE:
                    out.scale = value
                else:
                    out.frame_ns = value
            at = end
    except (IndexError, struct.error) as error:
        raise ValueError("the media data is cut off") from error
    return out


def payload_of(media: Media, data: bytes, track: int = 1) -> bytes:
    return b"".join([data[a:b] for t, _, _, a, b in media.packets if t == track])


def store_column(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes counted, and the media that hold them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select("doc_id", F.col("text").cast("binary").alias("text")), write, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of the ``media`` column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packets = parse(data).packets if data is not None else []
                if packets:
                    columns = [[doc_id] * len(packets), *zip(*packets)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "track", "timestamp_ms", "keyframe", "first_byte", "end_byte"])

    return arrow_map(media.select("doc_id", "media"), read, PACKETS)


def feature_of(media: Media, payload: bytes) -> str:
    """The container's facts and the samples' level and peak, as text."""
    samples = np.frombuffer(payload, np.uint8)
    level = np.bincount(samples, minlength=256)
    mean = float((level * np.arange(256)).sum()) / len(samples)
    return f"{media.doc_type};codec={media.codec};rate={media.rate:.0f};bits={media.bits};channels={media.channels};clusters={len(media.clusters)};cues={len(media.cues)};packets={len(media.packets)};ms={media.duration_ms:.0f};mean={mean:.4f};peak={int(samples.max())};crossings={int(np.count_nonzero(np.diff(samples >= 96)))}"


def media_features(media: DataFrame) -> DataFrame:
    """Read each media value back: digests of payload and file, and features; null or damaged media say so as feature, their other columns are null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FEATURES.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = parse(data) if data is not None else None
                    payload = payload_of(found, data) if found else b""
                except ValueError:
                    found, payload = None, b""
                if not payload:
                    rows.append((doc_id, n, None, None, None, None, None, "none" if data is None else "damaged"))
                    continue
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(found, payload)))
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return arrow_map(media.select("doc_id", "n_bytes", "media"), read, FEATURES)
