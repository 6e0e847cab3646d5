"""Matroska audio as a media column: writing, parsing into packet tables, and features.

Only the element kinds that timing and packets need are known by name; all others are skipped by their length, as the
format asks. The parser reads the container alone, of files of this writer or any other: EBML numbers of variable and
unknown length, the segment's timestamp scale, tracks with their default durations, clusters with their timestamps, simple
blocks and block groups with all four kinds of lacing, and cues. It gives one packet for each laced frame with its track,
timestamp, duration, byte range, whether it is a key frame and whether a cue points at it. Payloads are byte ranges of the
media column; they are never decoded.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element ids of the format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: What stands beside clusters: one of these ends a cluster of unknown length.
_BESIDE = (CLUSTER, CUES, INFO, TRACKS, SEEK, TAGS, CHAPTERS, ATTACHMENTS)
#: Nanoseconds of one timestamp unit where a file does not say.
USUAL_SCALE = 1_000_000

#: One frame is 576 samples of 8 bits; at 8000 samples a second it lasts 72 ms.
FRAME, SAMPLE_RATE, FRAME_MS = 576, 8000, 72
#: Frames in a laced block, and blocks in a cluster; a cluster then lasts less than a block's 16-bit offset can tell.
LACED, BLOCKS = 8, 32


def number(value: int, width: int = 0) -> bytes:
    """An EBML number: as short as it can be, or of ``width`` bytes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def unsigned(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], at: int, lacing: int) -> bytes:
    head = number(1) + at.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing == NO_LACING:
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        head += number(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += number(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def write(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples. Lacing goes round none, Xiph, fixed and EBML from block to block."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, b"\x45\xfa\x00\x00") + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio
    body, at, done, cues = [info, element(TRACKS, element(TRACK_ENTRY, entry))], 0, 0, []
    at = sum(map(len, body))
    k = 0
    while done < len(frames):
        start, blocks = done, [unsigned(TIMESTAMP, done * FRAME_MS)]
        for _ in range(BLOCKS):
            if done < len(frames):
                lacing = k % 4
                some = frames[done : done + (1 if lacing == NO_LACING else LACED)]
                blocks.append(_block(some, (done - start) * FRAME_MS, lacing if len(some) > 1 else NO_LACING))
                done, k = done + len(some), k + 1
        cluster = element(CLUSTER, b"".join(blocks))
        place = unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at)
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start * FRAME_MS) + element(CUE_POSITIONS, place)))
        body.append(cluster)
        at += len(cluster)
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_number(data: bytes, at: int) -> tuple[int | None, int]:
    """An EBML number and the place after it; None for an unknown length (all bits set)."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """id, where it begins, and its body's range, of the elements between ``at`` and ``end``.

    One of unknown length is taken to the end, or, a cluster, to the next element that stands beside clusters.
    """
    while at < end:
        width = 9 - data[at].bit_length()
        kind, body = int.from_bytes(data[at : at + width], "big"), at + width
        size, body = read_number(data, body)
        if size is None:
            to = end
            if kind == CLUSTER:
                to = next((b for k, b, _, _ in elements(data, body, end) if k in _BESIDE), end)
        else:
            to = body + size
        if to > end:
            raise ValueError(f"element {kind:#x} at byte {at} reaches beyond its parent")
        yield kind, at, body, to
        at = to


def _int(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """Of a block: track, relative timestamp, flags, lacing and the byte ranges of its frames."""
    track, at = read_number(data, at)
    relative, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at, lacing = at + 3, flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, flags, lacing, [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING:
        for i in range(n - 1):
            value, to = read_number(data, at)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * (to - at) - 1) - 1))
            at = to
    else:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laces at byte {at} are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, flags, lacing, out


Packet = tuple[int, int, int | None, int, int, int, bool, bool]
Cue = tuple[int, int, int, int | None]


def _cues(data: bytes, at: int, end: int, scale: int) -> Iterator[Cue]:
    """time in nanoseconds, track, the cluster's place in the segment, the block's place in the cluster, of each cue."""
    for point, _, a, b in elements(data, at, end):
        if point == CUE_POINT:
            parts = list(elements(data, a, b))
            time = next((_int(data, c, d) for kind, _, c, d in parts if kind == CUE_TIME), 0)
            for kind, _, c, d in parts:
                if kind == CUE_POSITIONS:
                    said = {name: _int(data, e, f) for name, _, e, f in elements(data, c, d) if name in (CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE)}
                    yield time * scale, said.get(CUE_TRACK, 0), said.get(CUE_CLUSTER, 0), said.get(CUE_RELATIVE)


def _durations(data: bytes, at: int, end: int) -> dict[int, int]:
    """Default durations of tracks in nanoseconds, by their numbers."""
    out = {}
    for kind, _, a, b in elements(data, at, end):
        if kind == TRACK_ENTRY:
            said = {name: _int(data, c, d) for name, _, c, d in elements(data, a, b) if name in (TRACK_NUMBER, DEFAULT_DURATION)}
            if DEFAULT_DURATION in said:
                out[said.get(TRACK_NUMBER, 0)] = said[DEFAULT_DURATION]
    return out


def parse(data: bytes) -> tuple[list[Packet], list[Cue]]:
    """Packets (track, timestamp, duration, offset, size, lacing, key frame, whether a cue points at it), and cues.

    Times are nanoseconds. A frame's duration is its track's default one, or its share of its block group's, else
    unknown; a laced frame comes after those before it in its block, at the block's own time where durations are unknown.
    A block group is a key frame unless it refers to another block. A cue points at the first frame of the block whose
    place it tells, else at the first of its track at its time in its cluster.
    """
    packets: list[Packet] = []
    cues: list[Cue] = []
    for kind, _, body, to in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        parts = list(elements(data, body, to))
        scale, durations, blocks = USUAL_SCALE, {}, {}
        for part, _, a, b in parts:
            if part == INFO:
                scale = next((_int(data, c, d) for name, _, c, d in elements(data, a, b) if name == TIMESTAMP_SCALE), scale)
            elif part == TRACKS:
                durations = _durations(data, a, b)
        for part, begin, a, b in parts:
            if part != CLUSTER:
                continue
            base = 0
            for what, start, c, d in elements(data, a, b):
                if what == TIMESTAMP:
                    base = _int(data, c, d)
                elif what in (SIMPLE_BLOCK, BLOCK_GROUP):
                    inner = [(SIMPLE_BLOCK, start, c, d)] if what == SIMPLE_BLOCK else list(elements(data, c, d))
                    refers = any(name == REFERENCE for name, *_ in inner)
                    lasts = next((_int(data, e, f) * scale for name, _, e, f in inner if name == BLOCK_DURATION), None)
                    for name, _, e, f in inner:
                        if name not in (SIMPLE_BLOCK, BLOCK):
                            continue
                        track, relative, flags, lacing, ranges = frames_of(data, e, f)
                        time, each = (base + relative) * scale, durations.get(track)
                        if each is None and lasts is not None:
                            each = lasts // len(ranges)
                        blocks.setdefault((begin - body, start - a), len(packets))
                        blocks.setdefault((begin - body, track, time), len(packets))
                        key = flags > 127 if what == SIMPLE_BLOCK else not refers
                        packets += [(track, time + i * (each or 0), each, at, size, lacing, key, False) for i, (at, size) in enumerate(ranges)]
        for part, _, a, b in parts:
            if part == CUES:
                for time, track, place, inside in _cues(data, a, b, scale):
                    cues.append((time, track, place, inside))
                    hit = blocks.get((place, inside) if inside is not None else (place, track, time))
                    if hit is not None:
                        packets[hit] = (*packets[hit][:7], True)
    return packets, cues


PACKET = "struct<track:int,timestamp:long,duration:long,offset:long,size:int,lacing:int,key:boolean,cued:boolean>"
_PACKETS = pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("duration", pa.int64()), ("offset", pa.int64()), ("size", pa.int32()), ("lacing", pa.int32()), ("key", pa.bool_()), ("cued", pa.bool_())])
CUE = "struct<time:long,track:int,cluster:long,block:long>"


def pad(text: bytes) -> bytes:
    """``text`` and bytes 255 up to a positive multiple of one frame."""
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def media_column(texts: DataFrame, text_col: str, out: str = "media") -> DataFrame:
    """Adds the Matroska form of each text's padded UTF-8 bytes. Null is empty."""

    @F.pandas_udf("binary")
    def stored(s):
        return s.map(lambda t: write(pad((t or "").encode())))

    return texts.withColumn(out, stored(text_col))


def packet_table(media: DataFrame, media_col: str, *keep: str | Column) -> DataFrame:
    """One row for each packet of each file; null files have none, damaged ones are an error."""

    @F.pandas_udf(f"array<{PACKET}>")
    def packets(s):
        names = [f.name for f in _PACKETS]
        return s.map(lambda m: [dict(zip(names, p)) for p in parse(bytes(m))[0]] if m is not None else [])

    return media.select(*keep, F.inline(packets(media_col)))


def cue_table(media: DataFrame, media_col: str, *keep: str | Column) -> DataFrame:
    """One row for each cue of each file: time in nanoseconds, track, and the places of its cluster and, if told, block."""

    @F.pandas_udf(f"array<{CUE}>")
    def cues(s):
        return s.map(lambda m: [dict(zip(("time", "track", "cluster", "block"), c)) for c in parse(bytes(m))[1]] if m is not None else [])

    return media.select(*keep, F.inline(cues(media_col)))


_DIGEST = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cues int, packets array<{PACKET}>"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part, rows, flat, ends = batch.slice(at, 128), [], [], [0]
            for text in part.column(1).cast(pa.binary()).to_pylist():
                media = write(pad(text or b""))
                packets, cues = parse(media)
                payload = b"".join([media[p[3] : p[3] + p[4]] for p in packets])
                rows.append((len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(cues)))
                flat += packets
                ends.append(len(flat))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
            table = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat), _PACKETS)], fields=list(_PACKETS))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table)
            columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cues", "packets"])


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as Matroska, reads it back by its packet table and digests both; with a feature of the packets.

    feature: packets, cues, duration in ms, and packets by lacing, as text. Null texts are empty ones, and an empty text
    is one frame of bytes 255. Equal texts give equal files. Null ids, repeated rows and other columns change nothing.
    A task holds one Arrow batch of texts and one file at a time.
    """
    done = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digests, _DIGEST)
    count = lambda name, kind: F.concat(F.lit(f" {name}="), F.size(F.filter("packets", lambda p: p["lacing"] == kind)))
    feature = F.concat(
        F.lit("packets="), F.size("packets"), F.lit(" cues="), F.col("cues"),
        F.lit(" cued="), F.size(F.filter("packets", lambda p: p["cued"])),
        F.lit(" ms="), F.expr("(element_at(packets, -1).timestamp + element_at(packets, -1).duration) div 1000000"),
        count("none", NO_LACING), count("xiph", XIPH), count("fixed", FIXED), count("ebml", EBML_LACING),
    )
    return done.select(F.col("doc_id").alias(id_col), *done.columns[1:7], feature.alias("feature"))
