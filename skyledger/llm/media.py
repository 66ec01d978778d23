"""Media columns: ISO media files with one track, written losslessly and described by walking their boxes.

`describe` reads a file's nested boxes and sample tables and returns codec, duration, sample count and the byte ranges of
key samples; payload bytes are located, never decoded. `wrap` stores bytes as 8-bit mono samples: ftyp, moov with one audio
track (sample entry `raw `, unsigned 8 bit), and mdat, in chunks of CHUNK samples of FRAME bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type

from skyledger.session import materialize

FRAME = 192  # bytes of a stored sample
CHUNK = 64  # samples of a chunk
RATE = 19_200  # 8-bit samples a second, so a stored sample lasts 1/100 s
TAIL = 16
KEY_EVERY = 100  # every 100th sample is a key sample, as one second is
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"moof", b"traf", b"mvex"}


# -- reading ----------------------------------------------------------------------------------------------------


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, payload start, payload end) of the boxes in [start, end); a cut or overlong box ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def leaves(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    for kind, a, b in boxes(data, start, len(data) if end is None else end):
        if kind in NESTED:
            yield (*path, kind), a, b
            yield from leaves(data, a, b, (*path, kind))
        else:
            yield (*path, kind), a, b


def _entries(data: memoryview, at: int, end: int, form: str) -> list[tuple[int, ...]]:
    """Rows of a table box: version and flags, a count, then rows; never more than the box holds."""
    if at + 8 > end:
        return []
    n = min(struct.unpack_from(">I", data, at + 4)[0], (end - at - 8) // struct.calcsize(form))
    return [struct.unpack_from(form, data, at + 8 + k * struct.calcsize(form)) for k in range(n)]


class Track:
    """Sample tables of one track, as far as they were found."""

    def __init__(self):
        self.codec, self.timescale, self.duration, self.handler = "", 0, 0, ""
        self.sizes: list[int] | int = []
        self.count, self.chunks, self.runs, self.times, self.keys = 0, [], [], [], None

    def ranges(self, wanted: list[int]) -> list[tuple[int, int]]:
        """[start, end) bytes of samples by number (from 0, ascending), from chunk offsets, samples per chunk and sizes."""
        out, sample, k = [], 0, 0
        for chunk, offset in enumerate(self.chunks):
            per = next((r[1] for r in reversed(self.runs) if r[0] <= chunk + 1), 0)
            at = offset
            while k < len(wanted) and wanted[k] < sample + per:
                skip = range(sample, wanted[k])
                begin = at + (len(skip) * self.sizes if isinstance(self.sizes, int) else sum(self.sizes[i] for i in skip if i < len(self.sizes)))
                size = self.sizes if isinstance(self.sizes, int) else self.sizes[wanted[k]] if wanted[k] < len(self.sizes) else 0
                out.append((begin, begin + size))
                k += 1
            sample += per
        return out


def describe(content: bytes | None) -> dict | None:
    """Codec, duration, samples and key sample ranges of the first track with samples; None where there is no movie box."""
    if not content:
        return None
    data, tracks, movie, brand, media = memoryview(content), [], (0, 0), "", []
    for path, a, b in leaves(data):
        kind = path[-1]
        track = tracks[-1] if tracks else None
        if kind == b"ftyp" and b - a >= 4:
            brand = bytes(data[a : a + 4]).decode("latin-1")
        elif kind == b"mdat":
            media.append((a, b))
        elif kind == b"trak":
            tracks.append(Track())
        elif kind in (b"mvhd", b"mdhd") and b - a >= 20:
            long = data[a] == 1 and b - a >= 32
            scale, duration = struct.unpack_from(">IQ", data, a + 20) if long else struct.unpack_from(">II", data, a + 12)
            if kind == b"mvhd":
                movie = (scale, duration)
            elif track:
                track.timescale, track.duration = scale, duration
        elif track is None:
            continue
        elif kind == b"hdlr" and b - a >= 12:
            track.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and b - a >= 16:
            track.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stsz" and b - a >= 12:
            size, count = struct.unpack_from(">II", data, a + 4)
            track.count = count if size else min(count, (b - a - 12) // 4)
            track.sizes = size if size else list(struct.unpack_from(f">{track.count}I", data, a + 12))
        elif kind == b"stsc":
            track.runs = _entries(data, a, b, ">III")
        elif kind == b"stco":
            track.chunks = [r[0] for r in _entries(data, a, b, ">I")]
        elif kind == b"co64":
            track.chunks = [r[0] for r in _entries(data, a, b, ">Q")]
        elif kind == b"stts":
            track.times = _entries(data, a, b, ">II")
        elif kind == b"stss":
            track.keys = [r[0] - 1 for r in _entries(data, a, b, ">I")]
    track = next((t for t in tracks if t.count), tracks[0] if tracks else None)
    if track is None:
        return None
    ticks = track.duration or sum(n * d for n, d in track.times)
    scale = track.timescale or movie[0]
    keys = track.keys if track.keys is not None else list(range(track.count))  # no table: every sample is a key
    return {
        "brand": brand, "handler": track.handler, "codec": track.codec, "timescale": scale, "duration_s": ticks / scale if scale else None, "n_samples": track.count,
        "keyframes": [{"start": s, "stop": e} for s, e in track.ranges([k for k in keys if k < track.count]) if e <= len(content)], "media": [{"start": s, "stop": e} for s, e in media],
    }


# -- writing ----------------------------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def wrap(payload: bytes, frame: int = FRAME, chunk: int = CHUNK, rate: int = RATE) -> bytes:
    """An ISO media file that holds `payload` (a positive multiple of `frame` bytes) as samples of `frame` bytes."""
    n = len(payload) // frame
    if n < 1 or n * frame != len(payload):
        raise ValueError(f"{len(payload)} bytes are no positive multiple of {frame}")
    n_chunks = -(-n // chunk)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ticks = n * frame
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    runs = [(1, min(chunk, n), 1)] + ([(n_chunks, n - chunk * (n_chunks - 1), 1)] if n_chunks > 1 and n % chunk else [])
    keys = range(1, n + 1, KEY_EVERY)

    def movie(at: int) -> bytes:
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, frame)),
            full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), full(b"stsz", struct.pack(">II", frame, n)),
            full(b"co64", struct.pack(">I", n_chunks), struct.pack(f">{n_chunks}Q", *[at + k * chunk * frame for k in range(n_chunks)])),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        info = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        # version 1 headers: 64-bit times and durations, no clock in them, so equal texts give equal files
        media = box(b"mdia", box(b"mdhd", struct.pack(">IQQIQHH", 1 << 24, 0, 0, rate, ticks, 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"text bytes\0"), info)
        head = box(b"tkhd", struct.pack(">IQQIIQ", (1 << 24) | 3, 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhHH", 0, 0, 0x0100, 0), matrix, bytes(8))
        return box(b"moov", box(b"mvhd", struct.pack(">IQQIQIH", 1 << 24, 0, 0, rate, ticks, 0x10000, 0x0100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), box(b"trak", head, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    head = 8 if len(payload) < 2**32 - 8 else 16
    return kind + movie(len(kind) + len(movie(0)) + head) + box(b"mdat", payload)


def padded(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """UTF-8 bytes of a text with blanks up to a positive multiple of `frame`, and their number before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (frame * max(1, -(-len(data) // frame)) - len(data)), len(data)


# -- columns ----------------------------------------------------------------------------------------------------

ARROW_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
ARROW_DESCRIPTION = pa.struct([("brand", pa.string()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("keyframes", ARROW_RANGES), ("media", ARROW_RANGES)])


def media_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text as a media file; a null text is stored as an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [padded(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in rows], pa.int64()), pa.array([wrap(p) for p, _ in rows], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def described(files: DataFrame, column: str = "media") -> DataFrame:
    """All columns of `files`, and `description` of the media file in `column` (null where it is none)."""
    kept = [c for c in files.columns if c != "description"]
    at = kept.index(column)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = pa.array([describe(m.as_py()) for m in part.column(at)], ARROW_DESCRIPTION)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*kept, "description"])

    return files.select(*kept).mapInArrow(walk, files.select(*kept).schema.add("description", from_arrow_type(ARROW_DESCRIPTION)))


def payload_of(content: bytes, description: dict) -> bytes:
    """The bytes of all media data boxes."""
    return b"".join(content[r["start"] : r["stop"]] for r in description["media"])


def digest(docs: DataFrame) -> DataFrame:
    """Stores all rows, reads them back, and returns checksums of what was read and a feature of each file's boxes.

    feature: codec, seconds, samples, number of key samples, and the crc32 of their byte ranges.
    """
    stored = materialize(media_of(docs), compression="zstd")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in range(6)]
                for cell in part.column(2):
                    content = cell.as_py()
                    d = describe(content)
                    payload = payload_of(content, d)
                    marks = ",".join(f"{r['start']}-{r['stop']}" for r in d["keyframes"])
                    feature = f"{d['codec'].strip()};{d['duration_s']:.2f}s;{d['n_samples']} samples;{len(d['keyframes'])} keys;{zlib.crc32(marks.encode()):08x}"
                    for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(content), hashlib.sha256(content).hexdigest(), feature), strict=True):
                        column.append(value)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["doc_id", "n_bytes", *names])

    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
