import hashlib
import struct
import zlib

import pytest
from llm_helpers import frame

from timberline.llm import media


def test_round_trip_and_tables():
    payload = media.padded(bytes(range(256)) * 200)
    data = media.write_container(payload)
    (track,) = media.read_tracks(data)
    assert media.sample_bytes(data, track["ranges"]) == payload
    assert track["codec"] == "raw" and (track["width"], track["height"]) == (24, 24)
    assert len(track["ranges"]) == len(payload) // 576 == track["duration"]
    assert track["keys"] == list(range(1, len(track["ranges"]) + 1, media.KEY_EVERY))
    assert all(data[a : a + n] == payload[k * 576 : (k + 1) * 576] for k, (a, n) in enumerate(track["ranges"]))
    kinds = [p[-1] for p, _, _ in media.boxes(data)]
    assert kinds[:3] == [b"ftyp", b"mdat", b"moov"] and {b"stts", b"stsc", b"stsz", b"stco", b"stss"} <= set(kinds)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 64, 576 * 64 + 1])
def test_padding(n):
    p = media.padded(b"a" * n)
    assert len(p) == max(1, -(-n // 576)) * 576 and p[:n] == b"a" * n and set(p[n:]) <= {255}


def test_sizes_wide_offsets_and_no_keyframe_table():
    stbl = media._box(b"stbl", media._full(b"stsz", struct.pack(">II3I", 0, 3, 5, 7, 9)), media._full(b"stsc", struct.pack(">I3I3I", 2, 1, 2, 1, 2, 1, 1)), media._full(b"co64", struct.pack(">I2Q", 2, 100, 1 << 33)))
    data = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">QQIQ", 0, 0, 1000, 1 << 34), version=1), media._box(b"minf", stbl))))
    (t,) = media.read_tracks(data)
    assert t["ranges"] == [(100, 5), (105, 7), (1 << 33, 9)] and t["keys"] == [1, 2, 3] and t["duration"] == 1 << 34


def test_broken_files_are_reported(spark):
    good = media.write_container(media.padded(b"x"))
    rows = [("a", bytearray(good)), ("b", bytearray(good[:100])), ("c", None), ("d", bytearray(b""))]
    got = {r.key: r for r in media.describe_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a"].codec == "raw" and got["a"].keyframes[0].length == 576
    assert got["b"].track == -1 and got["b"].error and set(got) == {"a", "b"}


def test_awkward_rows(awkward, none):
    text = {r.doc_id: r.text or "" for r in awkward.select("doc_id", "text").collect()}
    got = media.media_columns(awkward).collect()
    assert len(got) == awkward.count() and media.media_columns(none).count() == 0
    for r in got:
        payload = media.padded(text[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes) == (len(text[r.doc_id].encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        container = media.write_container(payload)
        assert (r.media_bytes, r.media_sha256) == (len(container), hashlib.sha256(container).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (4, 5)}) == 1 and frame is not None


def words(*values):
    return b"".join(v.to_bytes(4, "big") for v in values)


def by_hand():
    """Two samples of 3 and 2 bytes in one chunk at byte 16, timescale 10, duration 20, the second a keyframe; put together from the format's text."""

    def box(kind, *parts):
        return words(8 + sum(map(len, parts))) + kind + b"".join(parts)

    stbl = box(
        b"stbl",
        box(b"stsd", words(0, 1, 16), b"jpeg", words(0, 1)),
        box(b"stts", words(0, 1, 2, 10)),
        box(b"stss", words(0, 1, 2)),
        box(b"stsc", words(0, 1, 1, 2, 1)),
        box(b"stsz", words(0, 0, 2, 3, 2)),
        box(b"stco", words(0, 1, 16)),
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", words(0, 0, 0, 10, 20, 0)), box(b"minf", stbl))))
    return box(b"ftyp") + box(b"mdat", b"abcde") + moov


def test_a_file_written_by_hand():
    data = by_hand()
    (t,) = media.read_tracks(data)
    assert (t["codec"], t["timescale"], t["duration"], t["keys"]) == ("jpeg", 10, 20, [2])
    assert t["ranges"] == [(16, 3), (19, 2)] and media.sample_bytes(data, t["ranges"]) == b"abcde"


def test_the_stored_form_is_fixed():
    """Every field, counted out from the format; the digest keeps the form from changing unnoticed."""
    data = media.write_container(media.padded(b"abc"))
    assert data[:24] == struct.pack(">I4s4sI4s4s", 24, b"ftyp", b"isom", 512, b"isom", b"mp42")
    assert data[24:32] == struct.pack(">I4s", 584, b"mdat") and data[32:35] == b"abc" and data[35:608] == b"\xff" * 573
    assert struct.unpack_from(">I4s", data, 608) == (len(data) - 608, b"moov")
    at = data.index(b"stsz") + 8
    assert struct.unpack_from(">II", data, at) == (576, 1) and struct.unpack_from(">II", data, data.index(b"stco") + 8) == (1, 32)
    assert hashlib.sha256(data).hexdigest() == "98f1a5d90700f6550188087f97615d306e519031cc0719d12b29d62507fb92bd"


def test_hostile_files_are_reported(spark):
    nested = b""
    for _ in range(2000):
        nested = media._box(b"moov", nested)
    many = media._box(b"moov", media._box(b"trak", media._box(b"mdia", media._box(b"minf", media._box(b"stbl", media._full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)))))))
    keyless = by_hand().replace(b"stss" + words(0, 1, 2), b"stss" + words(0, 1, 0))
    rows = [(name, bytearray(data)) for name, data in (("nested", nested), ("many", many), ("keyless", keyless), ("good", by_hand()))]
    got = {r.key: r for r in media.describe_files(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[k].track == -1 and got[k].error for k in ("nested", "many", "keyless")) and got["good"].seconds == 2.0
