"""Media columns: ISO base media containers.

Writing wraps a payload as an uncompressed 24 x 24 grey video track, one frame
of 576 bytes a sample. Reading walks the nested boxes, decodes the sample
tables and reports codec, duration and the byte ranges of keyframes; payloads
are never decoded, only located.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import by_text_chunks, texts_of

SIDE = 24
FRAME = SIDE * SIDE
FILLER = b"\xff"
TIMESCALE = 25
KEY_EVERY = 25
FRAMES_A_CHUNK = 64
#: Boxes whose body is again boxes.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))
#: No box of the format lies this deep; files that nest deeper are broken.
MAX_DEPTH = 32
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """``data`` filled up with 255 to a positive multiple of a frame."""
    frames = max(1, -(-len(data) // FRAME))
    return data + FILLER * (frames * FRAME - len(data))


def write_container(payload: bytes) -> bytes:
    """An ISO media file whose samples are the payload's frames of 576 bytes, with a keyframe every ``KEY_EVERY``."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    frames = len(payload) // FRAME
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp42")
    big = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    start = len(ftyp) + big
    entry = _box(
        b"raw ",
        struct.pack(">6xH16xHHIIIH", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1),
        b"\x04grey".ljust(32, b"\0"),
        struct.pack(">Hh", 40, -1),  # 40: eight bits of grey
    )
    whole, rest = divmod(frames, FRAMES_A_CHUNK)
    runs = [(1, FRAMES_A_CHUNK)] * bool(whole) + [(whole + 1, rest)] * bool(rest)
    chunks = [start + i * FRAMES_A_CHUNK * FRAME for i in range(whole + bool(rest))]
    wide = chunks[-1] > 0xFFFFFFFF
    keys = range(1, frames + 1, KEY_EVERY)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, n, 1) for a, n in runs]),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks)),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
        minf,
    )
    tkhd = _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, frames, 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, frames, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))
    mdat = struct.pack(">I4s", len(payload) + 8, b"mdat") if big == 8 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16)
    return b"".join((ftyp, mdat, payload, _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def boxes(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, body start, body end) of every box, outermost first; a box that runs past its parent or nests over ``MAX_DEPTH`` deep is an error."""
    end = len(data) if end is None else end
    if len(path) > MAX_DEPTH:
        raise ValueError(f"boxes nest deeper than {MAX_DEPTH} at {start}")
    while start < end:
        if end - start < 8:
            raise ValueError(f"{end - start} stray bytes at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"truncated box at {start}")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has size {size}, its parent ends at {end}")
        yield (here := (*path, kind)), start + head, start + size
        if kind in CONTAINERS:
            yield from boxes(data, start + head, start + size, here)
        start += size


def read_tracks(data: bytes | memoryview) -> list[dict]:
    """Codec, timescale, duration, sample ranges (offset, length) and keyframe numbers of each track.

    Only headers and sample tables are read. A file without ``moov`` has no tracks.
    """
    tracks: list[dict] = []
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 0, "duration": 0, "times": [], "runs": [], "sizes": [], "chunks": [], "keys": None, "width": 0, "height": 0})
        if not tracks or b"trak" not in path:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd" and struct.unpack_from(">I", data, a + 4)[0]:
            t["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1").strip()
            t["width"], t["height"] = struct.unpack_from(">HH", data, a + 40) if b - a >= 44 else (0, 0)
        elif kind == b"stts":
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["times"] = list(struct.iter_unpack(">II", data[a + 8 : a + 8 + 8 * n]))
        elif kind == b"stsc":
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["runs"] = list(struct.iter_unpack(">III", data[a + 8 : a + 8 + 12 * n]))
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, a + 4)
            if size * n > len(data):
                raise ValueError(f"{n} samples of {size} bytes in a file of {len(data)}")
            t["sizes"] = [size] * n if size else list(struct.unpack_from(f">{n}I", data, a + 12))
        elif kind in (b"stco", b"co64"):
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["chunks"] = list(struct.unpack_from(f">{n}{'I' if kind == b'stco' else 'Q'}", data, a + 8))
        elif kind == b"stss":
            n = struct.unpack_from(">I", data, a + 4)[0]
            t["keys"] = list(struct.unpack_from(f">{n}I", data, a + 8))
    for t in tracks:
        ranges, k = [], 0
        for i, (first, per_chunk, _) in enumerate(t["runs"]):
            last = t["runs"][i + 1][0] if i + 1 < len(t["runs"]) else len(t["chunks"]) + 1
            for chunk in range(first, last):
                at = t["chunks"][chunk - 1]
                for size in t["sizes"][k : k + per_chunk]:
                    ranges.append((at, size))
                    at += size
                k += per_chunk
        if len(ranges) != len(t["sizes"]):
            raise ValueError(f"{len(t['sizes'])} samples, {len(ranges)} of them in chunks")
        t["ranges"] = ranges
        t["keys"] = list(range(1, len(ranges) + 1)) if t["keys"] is None else t["keys"]
        if not all(0 < k <= len(ranges) for k in t["keys"]):
            raise ValueError(f"a keyframe number is not among 1 to {len(ranges)}")
    return tracks


def sample_bytes(data: bytes | memoryview, ranges: list[tuple[int, int]]) -> bytes:
    """The bytes of the ranges in order; neighbouring ranges are read as one."""
    view, joined = memoryview(data), []
    for at, size in ranges:
        if joined and joined[-1][1] == at:
            joined[-1][1] = at + size
        else:
            joined.append([at, at + size])
    return b"".join(view[a:b] for a, b in joined)


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: dict[str, list] = {f.name: [] for f in SCHEMA}
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
        data = text.encode("utf-8", "surrogatepass")
        media = write_container(padded(data))
        (track,) = read_tracks(media)
        payload = sample_bytes(media, track["ranges"])
        keys = [track["ranges"][k - 1] for k in track["keys"]]
        ranges = ",".join(f"{a}+{n}" for a, n in keys)
        seconds = track["duration"] / track["timescale"]
        feature = f"codec={track['codec']};size={track['width']}x{track['height']};seconds={seconds:.2f};samples={len(track['ranges'])};keyframes={len(keys)};first={ranges.split(',')[0]};ranges_crc32={zlib.crc32(ranges.encode())}"
        row = (
            doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature,
            track["codec"], seconds, [{"offset": a, "length": n} for a, n in keys],
        )
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)
    return pa.RecordBatch.from_pydict(out, schema=SCHEMA)


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()),
        ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)
_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string,"
    " codec string, seconds double, keyframes array<struct<offset: long, length: long>>"
)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each text's UTF-8 bytes losslessly as frames of an ISO media file, read them back and describe the file.

    One row a row of ``docs``; null text counts as empty and, like it, is one
    frame of filler; equal texts give equal values; an empty table gives an
    empty frame; columns other than doc_id and text are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(by_text_chunks(_rows), _DDL)


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for key, data in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
        try:
            for i, t in enumerate(read_tracks(data or b"")):
                keys = [t["ranges"][k - 1] for k in t["keys"]]
                rows.append((key, i, t["codec"], t["duration"] / t["timescale"] if t["timescale"] else None, [{"offset": a, "length": n} for a, n in keys], None))
        except (ValueError, struct.error, IndexError) as e:
            rows.append((key, -1, None, None, None, str(e)))
    names = ["key", "track", "codec", "seconds", "keyframes", "error"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), SCHEMA.field("keyframes").type, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=names)


def describe_files(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, track, codec, seconds, keyframes, error) of media files, as the ``binaryFile`` source gives them.

    A broken file (truncated, too deeply nested, with counts that its size or
    its other tables rule out) gives one row with track -1 and the reason; null
    or empty content has no tracks.
    """
    return files.select(F.col(key).cast("string").alias("key"), F.col(content).alias("content")).mapInArrow(
        by_text_chunks(_describe, "content"), "key string, track int, codec string, seconds double, keyframes array<struct<offset: long, length: long>>, error string"
    )
