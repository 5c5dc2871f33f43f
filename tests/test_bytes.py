"""Dates and pixels read from bytes, files hashed in blocks, and a store fed from a stream."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_files import box, jpeg, write
from trove.functions import paths
from trove.operators import layers
from trove.plans import actions
from trove.sources import catalog, pixels, stamps
from trove.streaming import incremental


def tiff(order, entries, extra=b""):
    """One directory; an entry's value of more than four bytes lies behind it."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries))
    tail = b""
    at = 10 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if isinstance(value, bytes):
            out += struct.pack(order + "HHII", tag, kind, len(value), at + len(tail))
            tail += value
        else:
            out += struct.pack(order + "HHII", tag, kind, count, value)
    return out + struct.pack(order + "I", 0) + tail + extra


def exif(order, original=None, created=None):
    """A directory that points to the EXIF directory behind it."""
    dates = [(t, 2, 0, v.encode() + b"\0") for t, v in ((stamps.ORIGINAL, original), (stamps.CREATED, created)) if v]
    sub = tiff(order, dates)[8:]
    head = tiff(order, [(stamps.EXIF_IFD, 4, 1, 26)])
    moved = bytearray(sub)
    for k in range(len(dates)):
        at = 2 + 12 * k + 8
        moved[at : at + 4] = struct.pack(order + "I", struct.unpack_from(order + "I", sub, at)[0] + 18)
    return head + bytes(moved)


@pytest.mark.parametrize("order", "<>")
def test_embedded_dates(order):
    both, late = exif(order, "1987:11:09 03:04:05", "1990:01:01 00:00:00"), exif(order, None, "1990:01:01 00:00:01")
    assert stamps.embedded(both, "nef")[0] == "1987-11-09 03:04:05"
    assert stamps.embedded(jpeg(b"Exif\0\0" + both), "jpg")[0] == "1987-11-09 03:04:05"
    assert stamps.embedded(jpeg(b"Exif\0\0" + late), "jpg")[0] == "1990-01-01 00:00:01"
    assert stamps.embedded(exif(order, "0000:00:00 00:00:00", "1990:02:30 00:00:00"), "dng") == (None, None)
    packet = b'<x:xmpmeta xmp:CreateDate="1987-11-09"></x:xmpmeta>'
    assert stamps.embedded(tiff(order, [(stamps.XMP_TAG, 7, 0, packet)]), "tif") == (None, packet.decode())
    assert stamps.embedded(jpeg(b"http://x\0" + packet), "jpg") == (None, packet.decode())
    for n in range(len(both)):
        stamps.embedded(both[:n], "nef")
        stamps.embedded(jpeg(b"Exif\0\0" + both)[:n], "jpg")


def test_film_dates():
    seconds = stamps.QUICKTIME_EPOCH + 86400
    old, new = b"\0" * 4 + struct.pack(">I", seconds), b"\1\0\0\0" + struct.pack(">Q", seconds)
    for header in (old, new):
        film = box(b"ftyp", b"isom") + box(b"mdat", b"film") + box(b"moov", box(b"mvhd", header + b"\0" * 8))
        assert stamps.embedded(film, "mov") == ("1970-01-02 00:00:00", None)
    assert stamps.embedded(box(b"moov", box(b"mvhd", b"\0" * 16)), "mp4") == (None, None)


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(values, colour, depth=8, kinds=(0, 1, 2, 3, 4), palette=b""):
    """A PNG whose rows use the given filters in turn."""
    height, width, channels = values.shape
    step, rows, above = max(1, channels * depth // 8), b"", None
    for y in range(height):
        line = values[y].astype(">u2").tobytes() if depth == 16 else np.packbits(((values[y].ravel()[:, None] >> np.arange(depth - 1, -1, -1)) & 1).ravel()).tobytes()
        kind, above = kinds[y % len(kinds)], above or bytes(len(line))
        at = lambda row, i: row[i] if i >= 0 else 0
        out = []
        for i, x in enumerate(line):
            a, b, c = at(line, i - step), above[i], at(above, i - step)
            near = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
            out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        rows += bytes([kind, *out])
        above = line
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "channels", "depth"), [(0, 1, 1), (0, 1, 2), (0, 1, 4), (0, 1, 8), (0, 1, 16), (2, 3, 8), (2, 3, 16), (4, 2, 8), (6, 4, 8), (6, 4, 16)])
def test_png_pixels(colour, channels, depth):
    values = np.random.default_rng(depth).integers(0, 1 << depth, (11, 7, channels))
    got = pixels.decode(png(values, colour, depth), "png")
    assert (got == (values * (255 // ((1 << depth) - 1)) if depth < 8 else values)).all()


def test_palettes_and_plain_formats():
    rng = np.random.default_rng(1)
    index, palette = rng.integers(0, 16, (5, 6, 1)), rng.integers(0, 256, (16, 3)).astype(np.uint8)
    assert (pixels.decode(png(index, 3, 4, palette=palette.tobytes()), "png") == palette[index[..., 0]]).all()
    v = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    padded = np.concatenate((v[::-1, :, ::-1].reshape(5, 18), np.zeros((5, 2), np.uint8)), axis=1)
    bmp = b"BM" + struct.pack("<IIIIiiHHI", 0, 0, 54, 40, 6, 5, 1, 24, 0) + b"\0" * 20 + padded.tobytes()
    tga = bytes([0, 0, 2]) + b"\0" * 9 + struct.pack("<HHBB", 6, 5, 24, 0x20) + v[..., ::-1].tobytes()
    rle = bytes([0, 0, 10]) + b"\0" * 9 + struct.pack("<HHBB", 6, 5, 24, 0x20) + b"".join(bytes([128]) + p[::-1].tobytes() for p in v.reshape(-1, 3))
    text = b"P3 # note\n6 5\n255\n" + b" ".join(b"%d" % x for x in v.ravel())
    pam = b"P7\nWIDTH 6\nHEIGHT 5\nDEPTH 3\nMAXVAL 255\nTUPLTYPE RGB\nENDHDR\n" + v.tobytes()
    qoi = b"qoif" + struct.pack(">IIBB", 6, 5, 3, 0) + b"".join(b"\xfe" + p.tobytes() for p in v.reshape(-1, 3)) + b"\0" * 7 + b"\1"
    found = [pixels.decode(x, e) for x, e in ((bmp, "bmp"), (tga, "tga"), (rle, "tga"), (text, "ppm"), (pam, "pam"), (qoi, "qoi"), (b"P6 6 5 255\n" + v.tobytes(), "png"), (png(v, 2), "gif"))]
    assert all((f == v).all() for f in found)
    assert len({pixels.pixel_key(f) for f in found}) == 1
    deep = rng.integers(0, 65536, (5, 6, 4)).astype(np.uint16)
    assert (pixels.decode(b"farbfeld" + struct.pack(">II", 6, 5) + deep.astype(">u2").tobytes(), "ff") == deep).all()
    assert (pixels.to_eight_bits(deep) == deep >> 8).all() and pixels.to_eight_bits(deep[..., :2]).shape == (5, 6, 1)
    runs = b"qoif" + struct.pack(">IIBB", 4, 2, 4, 0) + bytes([0xFE, 9, 9, 9, 0xC0 | 2, 0x40 | 0b111001, 0x80 | 33, 0x88, (9 * 15 + 255 * 11) % 64, 0xFF, 1, 2, 3, 4])
    assert pixels.decode(runs, "qoi").reshape(-1, 4).tolist() == [[9, 9, 9, 255]] * 4 + [[10, 9, 8, 255], [11, 10, 9, 255], [9, 9, 9, 255], [1, 2, 3, 4]]
    for x in (bmp, tga, rle, text, pam, qoi, png(v, 2)):
        for n in range(0, len(x), 7):
            pixels.decode(x[:n], "qoi")


def test_picture_signatures():
    """A scaled copy has nearly the same signatures, another picture has not; gray and colour differ in chroma."""
    y, x = np.mgrid[0:96, 0:128] / 96.0
    scene = np.dstack([128 + 90 * np.sin(5 * x + 2 * y), 128 + 90 * np.cos(3 * y), 90 + 60 * np.sin(7 * x * y)]).astype(np.uint8)
    small, other = scene[::2, ::2], np.random.default_rng(2).integers(0, 256, (96, 128, 3)).astype(np.uint8)
    apart = lambda f, a, b: bin((f(a) ^ f(b)) & (1 << 64) - 1).count("1")
    for f in (pixels.phash, pixels.dhash):
        assert apart(f, scene, small) <= 6 and apart(f, scene, other) > 12
    gray = np.repeat(scene[..., :1], 3, axis=2)
    assert pixels.chroma(gray) == 0 < pixels.chroma(scene) and pixels.chroma(scene[..., :1]) is None
    spread = scene.astype(int).max(axis=2) - scene.astype(int).min(axis=2)
    assert pixels.chroma(scene) == int(spread.sum()) // spread.size


def test_scan_in_blocks(spark, tmp_path):
    """Files over a limit are hashed where they lie, to the same result."""
    body = random.Random(3).randbytes(200_000)
    write(str(tmp_path), "a.mp4", box(b"ftyp", b"isom") + box(b"mdat", body)), write(str(tmp_path), "b.jpg", jpeg(b"Exif\0\0" + exif(">", "1987:11:09 03:04:05")))
    write(str(tmp_path), "c.png", png(np.ones((2, 2, 3), int), 2)), write(str(tmp_path), "d.avi", b"junk" * 1000)
    rows = [{r.rel: r for r in catalog.scan_tree(spark, str(tmp_path), dates=True, large=n).collect()} for n in (1 << 30, 1000)]
    for rel in ("a.mp4", "d.avi"):
        assert all(rows[0][rel][c] == rows[1][rel][c] for c in ("size", "shallow", "decoded", "bytes_hash", "payload_hash"))
    assert rows[0]["a.mp4"].payload_hash == hashlib.sha256(body).hexdigest() and rows[0]["a.mp4"].shallow == hashlib.md5(body[: 64 * 1024]).hexdigest()
    assert not rows[0]["d.avi"].decoded
    assert rows[0]["b.jpg"].embedded_date == "1987-11-09 03:04:05" and rows[0]["c.png"].pixel_hash.startswith("2x2x3:") and rows[0]["c.png"].chroma == 0


def test_missing_sources_are_reported(spark, tmp_path):
    there = write(str(tmp_path), "t/1", b"someone else's")
    source = write(str(tmp_path), "s/2", b"two")
    plan = spark.createDataFrame([(str(tmp_path / "s/1"), there), (source, str(tmp_path / "t/2"))], "source string, target string")
    outcome = actions.run_plan(plan)
    for _ in range(2):  # reading the outcome twice moves nothing again
        got = {os.path.basename(r.source): (r.moved, r.error) for r in outcome.collect()}
        assert got["2"] == (True, None) and not got["1"][0] and "is gone" in got["1"][1]
    noted = actions.stamp(str(tmp_path / "t/2"))
    actions.transfer(source, str(tmp_path / "t/2"), noted=noted)  # the same move again: done before
    with pytest.raises(FileNotFoundError):
        actions.transfer(source, there, noted=noted)


def test_newest_entry_of_a_batch_counts(spark, tmp_path):
    schema = "volume string, rel_path string, size long, modified long, shallow string"
    rows = [("v", "a", 1, 5, "old"), ("v", "a", 2, 9, "new"), ("v", "a", 3, 7, "between"), ("v", "b", 1, 1, "b")]
    source = str(tmp_path / "in")
    full = spark.createDataFrame(rows, schema)
    for c in layers.LAYERS[1:]:
        full = full.withColumn(c, F.lit(None).cast("boolean" if c == "date_resolved" else "long" if c in ("phash", "dhash") else "int" if c == "chroma" else "string"))
    full.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(full.schema).parquet(source)
    incremental.maintain(spark, stream, str(tmp_path / "store"), str(tmp_path / "check"), full.limit(0)).awaitTermination(120)
    assert {(r.rel_path, r.shallow) for r in layers.load(spark, str(tmp_path / "store"), full.limit(0)).collect()} == {("a", "new"), ("b", "b")}


def test_path_guards(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "a")
    assert paths.require_dir(str(tmp_path / "link")) == os.path.realpath(tmp_path / "a")
    with pytest.raises(ValueError, match="no folder"):
        paths.require_dir(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="tree"):
        paths.require_disjoint(str(tmp_path / "a"), str(tmp_path / "link/b"))
