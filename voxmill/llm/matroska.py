"""Matroska media columns: a writer for 8-bit PCM, and a parser to packet tables.

The parser reads variable-length EBML elements, of known or unknown size,
clusters, SimpleBlocks and BlockGroups with all four kinds of lacing, and cues.
It gives one packet per frame with track, timestamp and byte range, so that a
frame is `data[begin:begin + size]` of the stored bytes, without a copy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

# Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID, CRC32 = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC, 0xBF
DOC_TYPE, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x4282, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = frozenset((INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367))

#: Samples of a frame, frames of a laced block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, HERTZ = 576, 8, 32, 8000


class MatroskaError(ValueError):
    """The bytes are no Matroska file that this parser can read."""


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int]] = field(default_factory=list)  # track, timestamp in ns, begin, size
    clusters: list[tuple[int, int]] = field(default_factory=list)  # begin, timestamp in ticks
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time in ticks, track, begin of the cluster
    scale: int = 1_000_000
    duration: float = 0.0
    lacings: set[int] = field(default_factory=set)


# ---- reading


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """A variable-length integer, the place behind it, and whether all its value bits are set (size unknown)."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MatroskaError(f"integer cut off at {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, begin of the element, begin of its content, end of its content) of the elements in a range."""
    while at < end:
        begin = at
        name, at, _ = vint(data, at, keep_marker=True)
        size, at, unknown = vint(data, at)
        stop = at + size
        if unknown:  # up to the next element that cannot lie inside this one
            stop, outer = at, {CLUSTER} | TOP_LEVEL if name == CLUSTER else set()
            while stop < end and name == CLUSTER:
                inner, then, _ = vint(data, stop, keep_marker=True)
                if inner in outer:
                    break
                n, then, _ = vint(data, then)
                stop = then + n
            stop = end if name != CLUSTER else stop
        if stop > end:
            raise MatroskaError(f"element {name:X} at {begin} is longer than what holds it")
        yield name, begin, at, stop
        at = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return {0: 0.0}.get(b - a) if b == a else struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(begin, size) of a block's frames. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise MatroskaError("fixed lacing of unequal frames")
        size = (end - at) // n
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            value, at, _ = vint(data, at)
            size = value if not i else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Tracks, packets, clusters and cues of a file. Raises MatroskaError for anything that isn't one."""
    media, seen = Media(), False
    try:
        for name, _, a, b in elements(data, 0, len(data)):
            if name == EBML:
                kinds = [data[x:y].rstrip(b"\0") for n, _, x, y in elements(data, a, b) if n == DOC_TYPE]
                seen = kinds in ([b"matroska"], [b"webm"])
            elif name == SEGMENT and seen:
                _segment(data, a, b, media)
    except (IndexError, struct.error) as e:
        raise MatroskaError(str(e)) from e
    if not seen:
        raise MatroskaError("no EBML header of a Matroska file")
    return media


def _segment(data: bytes, a: int, b: int, media: Media) -> None:
    for name, begin, x, y in elements(data, a, b):
        if name == INFO:
            for n, _, p, q in elements(data, x, y):
                if n == TIMESTAMP_SCALE:
                    media.scale = _uint(data, p, q)
                elif n == DURATION:
                    media.duration = _float(data, p, q)
        elif name == TRACKS:
            for n, _, p, q in elements(data, x, y):
                if n == TRACK_ENTRY:
                    _track(data, p, q, media)
        elif name == CLUSTER:
            _cluster(data, begin, x, y, media)
        elif name == CUES:
            for n, _, p, q in elements(data, x, y):
                if n == CUE_POINT:
                    _cue(data, p, q, a, media)


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    track: dict = {}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}
    for name, _, x, y in elements(data, a, b):
        if name == AUDIO:
            for n, _, p, q in elements(data, x, y):
                if n == RATE:
                    track["rate"] = _float(data, p, q)
                elif n in names:
                    track[names[n]] = _uint(data, p, q)
        elif name == CODEC_ID:
            track["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif name in names:
            track[names[name]] = _uint(data, x, y)
    media.tracks[track.get("number", 0)] = track


def _cluster(data: bytes, begin: int, a: int, b: int, media: Media) -> None:
    base = 0
    for name, _, x, y in elements(data, a, b):
        if name == TIMESTAMP:
            base = _uint(data, x, y)
            media.clusters.append((begin, base))
        elif name == SIMPLE_BLOCK:
            _block(data, x, y, base, media)
        elif name == BLOCK_GROUP:
            for n, _, p, q in elements(data, x, y):
                if n == BLOCK:
                    _block(data, p, q, base, media)


def _block(data: bytes, a: int, b: int, base: int, media: Media) -> None:
    track, at, _ = vint(data, a)
    kind = data[at + 2] >> 1 & 3
    media.lacings.add(kind)
    ns = (base + int.from_bytes(data[at : at + 2], "big", signed=True)) * media.scale
    step = media.tracks.get(track, {}).get("default_ns", 0)
    for i, (begin, size) in enumerate(lace(data, at + 3, b, kind)):
        media.packets.append((track, ns + i * step, begin, size))


def _cue(data: bytes, a: int, b: int, origin: int, media: Media) -> None:
    time, found = 0, []
    for name, _, x, y in elements(data, a, b):
        if name == CUE_TIME:
            time = _uint(data, x, y)
        elif name == CUE_POSITIONS:
            own = {n: _uint(data, p, q) for n, _, p, q in elements(data, x, y)}
            found.append((own.get(CUE_TRACK, 0), origin + own.get(CUE_CLUSTER, 0)))
    media.cues += [(time, *x) for x in found]


# ---- writing


def _size(n: int) -> bytes:
    width = max(1, -(-(n + 1).bit_length() // 7))
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
_STEP = FRAME * 1_000_000_000 // HERTZ
_TRACK = _element(TRACKS, _element(TRACK_ENTRY, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(DEFAULT_DURATION, _STEP) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", HERTZ)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A Matroska file with one track of 8-bit samples, fixed lacing and cues. The payload's length is a multiple of FRAME."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    ms, span = FRAME * 1000 // HERTZ, FRAME * LACED
    head = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) // FRAME * ms)) + _element(MUXING_APP, b"voxmill") + _element(WRITING_APP, b"voxmill")) + _TRACK
    parts, cues, at = [head], [], len(head)
    for start in range(0, len(payload), span * BLOCKS):
        time, blocks = start // FRAME * ms, []
        for p in range(start, min(start + span * BLOCKS, len(payload)), span):
            frames = min(span, len(payload) - p) // FRAME
            relative = (p - start) // FRAME * ms
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big") + b"\x84" + bytes((frames - 1,)) + payload[p : p + span]))
        cluster = _element(CLUSTER, _number(TIMESTAMP, time) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEADER + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def payload_of(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of FRAME."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


# ---- DataFrames


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per packet: id, packet (from 0), track, codec, timestamp_ns, begin, size, and error.

    A file that can't be parsed, or is null, gives one row with null packet
    fields and the reason in error. Other columns are not read.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "packet", "track", "codec", "timestamp_ns", "begin", "size", "error"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            owner, rows = [], []
            for i, value in enumerate(batch.column(1)):
                try:
                    media = parse(value.as_py() or b"")
                    rows += [(k, t, media.tracks.get(t, {}).get("codec"), ns, at, n, None) for k, (t, ns, at, n) in enumerate(media.packets)]
                    owner += [i] * len(media.packets)
                except MatroskaError as e:
                    rows.append((None, None, None, None, None, None, str(e)))
                    owner.append(i)
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    schema = f"id {kind}, packet long, track int, codec string, timestamp_ns long, begin long, size long, error string"
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as a Matroska file, read back: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and media if asked for.

    Everything behind n_bytes comes from parsing the stored bytes; payload
    bytes are gathered by the packets' byte ranges. Null text counts as empty,
    which is one frame of padding. Equal texts give equal values; repeated
    rows are kept, null ids stay null, other columns are not read.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(raw: bytes) -> tuple:
        data = write(payload_of(raw))
        media = parse(data)
        back = b"".join([data[a : a + n] for _, _, a, n in media.packets])
        last = media.packets[-1]
        starts = [a for a, _ in media.clusters]
        feature = f"matroska;codec={media.tracks[1]['codec']};packets={len(media.packets)};clusters={len(starts)};cues={sum(c in starts for _, _, c in media.cues)};last_ns={last[1]};ms={media.duration:.0f}"
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature) + ((data,) if keep_media else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [one(x or b"") for x in part.column(1).cast(pa.binary()).to_pylist()]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types + [pa.binary()] * keep_media, strict=True))], names + ["media"] * keep_media)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return df.select(df[id_col].alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
