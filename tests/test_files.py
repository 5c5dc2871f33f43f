"""Decoders, listings and carried-out moves on temporary folders."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from trove.operators import compare
from trove.plans import actions
from trove.sources import catalog, decoders


def box(kind, data):
    return struct.pack(">I4s", 8 + len(data), kind) + data


def jpeg(meta=b"", scan=b"picture"):
    seg = lambda k, d: bytes([0xFF, k]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + (seg(0xE1, meta) if meta else b"") + seg(0xDB, b"table") + seg(0xDA, b"head") + scan + b"\xff\xd9"


def png(data=b"idat", meta=b""):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"crc!"
    return b"\x89PNG\r\n\x1a\n" + (chunk(b"tEXt", meta) if meta else b"") + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def avi(data):
    movi = b"movi" + data
    return b"RIFF\0\0\0\0AVI " + struct.pack("<4sI", b"LIST", len(movi)) + movi + b"\0" * (len(movi) & 1)


def m2ts(n, tail=b"\0"):
    return b"".join(struct.pack(">I", i) + b"\x47" + tail * 187 for i in range(n))


SAMPLES = [("a.jpg", jpeg(), jpeg(b"exif")), ("a.png", png(), png(meta=b"x")), ("a.mp4", box(b"ftyp", b"isom") + box(b"mdat", b"film"), box(b"ftyp", b"isom") + box(b"moov", b"date") + box(b"mdat", b"film")), ("a.m2ts", m2ts(3), m2ts(3))]


@pytest.mark.parametrize(("name", "one", "two"), SAMPLES)
def test_metadata_does_not_count(name, one, two):
    ext = name.rpartition(".")[2]
    assert decoders.payload(one, ext) == decoders.payload(two, ext) is not None


@pytest.mark.parametrize("data", [s[1] for s in SAMPLES] + [avi(b"abc")])
def test_every_truncation_is_harmless(data):
    for n in range(len(data)):
        for ext in ("jpg", "png", "heic", "mp4", "avi", "m2ts"):
            decoders.payload(data[:n], ext)


def test_payloads():
    assert decoders.payload(avi(b"abc"), "avi") == b"abc"
    assert decoders.payload(jpeg(), "png") == decoders.payload(jpeg(), "jpg")  # by content
    assert decoders.payload(b"text", "jpg") is None
    assert len(decoders.payload(m2ts(4), "mts")) == 4 * 187
    assert decoders.sniff(b"MM\0*" + b"\0" * 9) == "tiff"


def raw_tiff(order, strip, tile=b""):
    """A directory with a short strip, and a sub-directory with a tile."""
    e = lambda tag, kind, n, v: struct.pack(order + "HHII", tag, kind, n, v)
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    first = struct.pack(order + "H", 3) + e(273, 4, 1, 200) + e(279, 4, 1, len(strip)) + e(330, 4, 1, 100) + struct.pack(order + "I", 0)
    sub = struct.pack(order + "H", 2) + e(324, 4, 1, 300) + e(325, 4, 1, len(tile)) + struct.pack(order + "I", 0)
    out = bytearray(400)
    for at, part in ((0, head), (8, first), (100, sub), (200, strip), (300, tile)):
        out[at : at + len(part)] = part
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_raw_files(order):
    assert decoders.payload(raw_tiff(order, b"strip", b"the larger tile"), "nef") == b"the larger tile"
    data = raw_tiff(order, b"strip")
    assert decoders.payload(data, "tif") == b"strip"
    for n in range(len(data)):
        decoders.payload(data[:n], "dng")
    fuji = b"FUJIFILMCCD-RAW ".ljust(100, b"\0") + struct.pack(">II", 108, 4) + b"datatail"
    assert decoders.payload(fuji, "raf") == b"data"
    assert decoders.payload(b"ftyp" * 9, "cr3") is None


def write(root, name, data):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_scan_and_compare(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(a, "x/1.jpg", jpeg()), write(a, "x/2.png", png()), write(a, "notes.txt", b"no")
    write(b, "y/1.JPG", jpeg(b"exif")), write(b, "y/3.png", png(b"other")), write(b, "broken.jpg", b"junk")
    t = catalog.scan_trees(spark, [a, b]).cache()
    got = {(os.path.basename(r.path), r.category) for r in compare.compare_trees(t.filter(F.col("tree") == a), t.filter(F.col("tree") == b)).collect()}
    assert got == {("1.jpg", "duplicate"), ("1.JPG", "duplicate"), ("2.png", "a_only"), ("3.png", "b_only"), ("broken.jpg", "unreadable")}
    assert compare.deep_scan_counts(t.filter(F.col("tree") == a), t.filter(F.col("tree") == b)).head().kept == 1


def test_moves_never_overwrite(spark, tmp_path):
    one, two, there = write(str(tmp_path), "s/1", b"one"), write(str(tmp_path), "s/2", b"two"), write(str(tmp_path), "t/2", b"old")
    plan = spark.createDataFrame([(one, str(tmp_path / "t/1")), (two, there), (str(tmp_path / "none"), str(tmp_path / "t/3")), (one, None)], "source string, target string")
    got = {(r.source, r.target): r for r in actions.run_plan(plan.coalesce(1)).collect()}
    assert got[one, str(tmp_path / "t/1")].moved
    assert not os.path.exists(one)
    assert not got[two, there].moved
    assert open(there, "rb").read() == b"old"
    assert open(two, "rb").read() == b"two"
    actions.prune_empty(str(tmp_path))
    assert os.path.isdir(tmp_path / "s")


def test_purge_proves_again(spark, tmp_path):
    keep = write(str(tmp_path), "k/a.jpg", jpeg())
    same, other, gone = write(str(tmp_path), "s/a.jpg", jpeg(b"exif")), write(str(tmp_path), "s/b.jpg", jpeg(scan=b"else")), write(str(tmp_path), "s/c.jpg", jpeg())
    link = str(tmp_path / "s/d.jpg")
    os.link(keep, link)
    rows = [(p, str(tmp_path / "p" / os.path.basename(p)), k) for p, k in [(same, keep), (other, keep), (gone, keep + "x"), (link, keep)]]
    got = {os.path.basename(r.source): r.moved for r in actions.purge_proven(spark.createDataFrame(rows, "source string, target string, keeper string")).collect()}
    assert got == {"a.jpg": True, "b.jpg": False, "c.jpg": False, "d.jpg": False}


def test_pasted_lines(spark):
    lines = spark.createDataFrame([("a\tb",), ("a",), ("a\t",), ("c\td\r",), ("x\ty\tz",)], "value string")
    assert {tuple(r) for r in catalog.pasted(lines, "a", "b").collect()} == {("a", "b"), ("c", "d")}
