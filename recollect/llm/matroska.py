"""Media columns (operator 4): Matroska files in a binary column, and their packet table.

``mux`` stores bytes as 8-bit PCM samples of one audio track: frames of ``frame`` bytes,
``laced`` frames to a block, ``blocks`` blocks to a cluster, and cues to every cluster.
``parse`` reads variable-length EBML elements (also of unknown size), clusters, simple
blocks and block groups with Xiph, EBML, fixed-size or no lacing, and cues, and gives
a row for each frame: track, timestamp, cluster and byte range in the file.

Null media gives no packets; in a file that ends early or is damaged the packets that lie wholly
before that point are kept. In the query null text counts as empty, repeated rows give
a row each, null ids stay null, and an empty table gives no rows. Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

# Element ids of the public Matroska specification (fixed values).
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
EBML_VERSION, READ_VERSION, ID_LENGTH, SIZE_LENGTH, TYPE_VERSION, TYPE_READ_VERSION, TRACK_UID = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285, 0x73C5
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {EBML, SEGMENT}
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16
XIPH, FIXED, EBML_LACING = 1, 2, 3


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    cluster: int
    block: int
    lace: int
    keyframe: bool
    offset: int
    size: int


def size_bytes(n: int) -> bytes:
    """A size as a variable-length integer of least width."""
    for width in range(1, 9):
        if n < (1 << (7 * width)) - 1:
            return (n | 1 << (7 * width)).to_bytes(width, "big")
    raise ValueError("too large for an EBML size")


def element(ident: int, data: bytes | int | float | str) -> bytes:
    if isinstance(data, int):
        data = data.to_bytes(max(1, (data.bit_length() + 7) // 8), "big")
    elif isinstance(data, float):
        data = struct.pack(">d", data)
    elif isinstance(data, str):
        data = data.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(data)) + data


def _lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """The flag bits and body of a block with these frames."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == FIXED:
        return FIXED << 1, head + b"".join(frames)
    if kind == XIPH:
        for n in sizes[:-1]:
            head += b"\xff" * (n // 255) + bytes([n % 255])
        return XIPH << 1, head + b"".join(frames)
    head += size_bytes(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
        head += (b - a + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return EBML_LACING << 1, head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, laced: int = LACED, blocks: int = BLOCKS, lacing: int | None = None) -> bytes:
    """A Matroska file with ``payload`` as the samples of track 1; ``lacing`` None: fixed where sizes are equal, else EBML.

    A block holds 256 frames at most, and a cluster as long a time as its blocks' 16-bit times reach (32,767 ms).
    """
    if not (frame > 0 and 0 < laced <= 256 and blocks > 0) or (blocks - 1) * frame * laced * 1000 // RATE > 32_767:
        raise ValueError("a cluster of these blocks is longer than their 16-bit times reach")
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, float(RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(CODEC_ID, "A_PCM/INT/LIT") + element(DEFAULT_DURATION, frame * 10**9 // RATE) + audio)
    body = [element(INFO, element(TIMESTAMP_SCALE, 10**6) + element(MUXING_APP, "recollect") + element(WRITING_APP, "recollect")), element(TRACKS, track)]
    at, cues = sum(map(len, body)), []
    step = frame * laced * blocks
    for begin in range(0, max(len(payload), 1), step):
        time = begin * 1000 // RATE
        parts = [element(TIMESTAMP, time)]
        for b in range(begin, min(begin + step, len(payload)), frame * laced):
            frames = [payload[i : min(i + frame, len(payload))] for i in range(b, min(b + frame * laced, len(payload)), frame)]
            kind = lacing or (FIXED if len(frames[-1]) == frame else EBML_LACING)
            flags, data = _lace(frames, kind)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - time, 0x80 | flags) + data))
        cues.append(element(CUE_POINT, element(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    versions = {EBML_VERSION: 1, READ_VERSION: 1, ID_LENGTH: 4, SIZE_LENGTH: 8}
    head = b"".join(element(i, v) for i, v in versions.items()) + element(DOC_TYPE, "matroska") + element(TYPE_VERSION, 4) + element(TYPE_READ_VERSION, 2)
    return element(EBML, head) + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def integer(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, position after it) of a variable-length integer; -1 for an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("damaged integer")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << (7 * width)) - 1
    return (-1 if value == (1 << (7 * width)) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements between two positions; one of unknown size ends where ``stop`` ids begin."""
    end = min(end, len(data))
    while at < end:
        try:
            ident, begin = integer(data, at, keep_marker=True)
            size, begin = integer(data, begin)
        except (ValueError, IndexError):
            return
        if ident in stop:
            return
        last = begin + size if size >= 0 else end
        yield ident, begin, last
        if size < 0 and ident not in TOP:
            last = begin
            for _, _, last in elements(data, begin, end, LEVEL_1 | TOP):  # noqa: B007
                pass
        at = last


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames in a block's body."""
    if not kind:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if kind == FIXED:
        size = (end - at) // n
        return [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH:
            size = 0
            while True:
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        elif not i:
            size, at = integer(data, at)
        else:
            before = at
            size, at = integer(data, at)
            if size < 0:
                size = (1 << (7 * (at - before))) - 1
            size += sizes[-1] - (1 << (7 * (at - before) - 1)) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("damaged lacing")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], dict[int, str]]:
    """Packets, cues (time in ns, track, byte position of the cluster) and the codec of each track."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    codecs: dict[int, str] = {}
    durations: dict[int, int] = {}
    scale, cluster, block = 10**6, -1, -1
    for top, a, b in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        for ident, c, d in elements(data, a, b):
            if ident == INFO:
                scale = next((_uint(data, x, y) for i, x, y in elements(data, c, d) if i == TIMESTAMP_SCALE), scale)
            elif ident == TRACKS:
                for entry, e, f in elements(data, c, d):
                    if entry == TRACK_ENTRY:
                        fields = {i: (x, y) for i, x, y in elements(data, e, f)}
                        number = _uint(data, *fields.get(TRACK_NUMBER, (0, 0)))
                        codecs[number] = data[slice(*fields.get(CODEC_ID, (0, 0)))].decode("ascii", "replace")
                        durations[number] = _uint(data, *fields.get(DEFAULT_DURATION, (0, 0)))
            elif ident == CUES:
                for point, e, f in elements(data, c, d):
                    if point != CUE_POINT:
                        continue
                    fields = list(elements(data, e, f))
                    time = next((_uint(data, x, y) for i, x, y in fields if i == CUE_TIME), 0)
                    for i, x, y in fields:
                        if i == CUE_TRACK_POSITIONS:
                            inner = {j: _uint(data, u, v) for j, u, v in elements(data, x, y)}
                            cues.append((time * scale, inner.get(CUE_TRACK, 0), a + inner.get(CUE_CLUSTER_POSITION, 0)))
            elif ident == CLUSTER:
                cluster, time = cluster + 1, 0
                for inner, e, f in elements(data, c, d, LEVEL_1 | TOP):
                    if inner == TIMESTAMP:
                        time = _uint(data, e, f)
                    found = [(e, f, True)] if inner == SIMPLE_BLOCK else [(x, y, False) for i, x, y in elements(data, e, f) if i == BLOCK] if inner == BLOCK_GROUP else []
                    for x, y, simple in found:
                        block += 1
                        try:
                            track, at = integer(data, x)
                            shift, flags = struct.unpack_from(">hB", data, at)
                            frames = _frames(data, at + 3, y, flags >> 1 & 3)
                        except (ValueError, IndexError, struct.error):
                            continue
                        for lace, (offset, size) in enumerate(frames):
                            if offset + size <= len(data) and y <= len(data):
                                packets.append(Packet(track, (time + shift) * scale + lace * durations.get(track, 0), cluster, block, lace, simple and bool(flags & 0x80), offset, size))
    return packets, cues, codecs


def payload_of(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([mux(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "track long, timestamp_ns long, cluster long, block long, lace long, keyframe boolean, offset long, size long"


def packets(table: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame of each file: the id, track, timestamp, cluster, block, place in the lace, key frame, byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column(0), batch.column(1), strict=True):
                found = parse(data.as_py())[0] if data.is_valid else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(found), batch.schema.types[0]), *map(pa.array, zip(*found, strict=True))], [id_col, *Packet._fields])

    kind = table.schema[id_col].dataType.simpleString()
    return table.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {PACKETS}")


def features(table: DataFrame) -> DataFrame:
    """Per stored file: digests of the samples read back, and a feature string of the packets and samples."""

    def row(data: bytes):
        found, cues, codecs = parse(data)
        samples = b"".join(data[p.offset : p.offset + p.size] for p in found)
        x = np.frombuffer(samples, np.uint8).astype(np.int64)
        d = x - 128
        feature = f"codec={','.join(codecs.values())};packets={len(found)};clusters={found[-1].cluster + 1 if found else 0};cues={len(cues)};end_ms={len(x) * 1000 // RATE};mean={int(x.sum() * 1000 // max(len(x), 1))};energy={int((d * d).sum() // max(len(x), 1))};crossings={int(((d[1:] < 0) != (d[:-1] < 0)).sum())}"
        return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row(m.as_py()) for m in batch.column(2)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return table.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_matroska(spark, sf_dir: str) -> DataFrame:
    return features(common.materialize(media(common.documents(spark, sf_dir)), "media", compression="zstd"))


QUERIES = {"op4_matroska": op4_matroska}
ORACLES: dict[str, str] = {}
