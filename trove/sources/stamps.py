"""The capture date that a file itself carries, read from its bytes.

Order: EXIF (the original's date, else the creation's) or a film's header, the CIFF heap, then the XMP packet. Raw files
on a TIFF structure are read as EXIF. No input raises; a file without a date has none.
"""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.dates import timestamp_text, xmp_date
from trove.functions.paths import VIDEO
from trove.sources.decoders import boxes, ciff_date, xmp_packet

#: EXIF and TIFF tags, and the seconds from 1904 (QuickTime) to 1970.
EXIF_IFD, ORIGINAL, CREATED, XMP_TAG = 0x8769, 0x9003, 0x9004, 0x02BC
QUICKTIME_EPOCH = 2082844800
_MAX_IFDS, _MAX_ENTRIES = 8, 4096
_ASCII_DATE = re.compile(rb"([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})")


class Tiff:
    """The directories of a TIFF structure."""

    def __init__(self, data: bytes) -> None:
        if data[:4] not in (b"II*\0", b"MM\0*", b"IIRO", b"IIU\0"):
            raise ValueError("no TIFF")
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"

    def _number(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def entries(self, at: int) -> Iterator[tuple[int, int, int, int]]:
        """(tag, type, count, place of the value or of its offset) of one directory."""
        n = self._number("H", at)
        if n > _MAX_ENTRIES:
            raise ValueError("directory too long")
        for k in range(n):
            e = at + 2 + 12 * k
            yield self._number("H", e), self._number("H", e + 2), self._number("I", e + 4), e + 8

    def directories(self) -> Iterator[int]:
        """Where the chained directories begin."""
        at, seen = self._number("I", 4), 0
        while at and seen < _MAX_IFDS:
            yield at
            seen += 1
            at = self._number("I", at + 2 + 12 * self._number("H", at))

    def value(self, count: int, place: int) -> bytes:
        """The bytes of a value of one-byte items."""
        lo = place if count <= 4 else self._number("I", place)
        out = self.data[lo : lo + count]
        if len(out) < count:
            raise ValueError("value past the end")
        return out

    def dates(self) -> dict[int, str]:
        """The EXIF dates by tag."""
        out: dict[int, str] = {}
        for ifd in self.directories():
            for tag, _, _, place in self.entries(ifd):
                if tag != EXIF_IFD:
                    continue
                for t, kind, count, p in self.entries(self._number("I", place)):
                    if t in (ORIGINAL, CREATED) and kind == 2 and t not in out:
                        found = exif_text(self.value(count, p))
                        if found:
                            out[t] = found
        return out

    def packet(self) -> bytes | None:
        """The XMP packet that a directory points to."""
        for ifd in self.directories():
            for tag, kind, count, place in self.entries(ifd):
                if tag == XMP_TAG and kind in (1, 7):
                    return self.value(count, place) if 0 < count <= 4 << 20 else None
        return None


def exif_text(value: bytes) -> str | None:
    """YYYY-MM-DD HH:MM:SS of an EXIF date, if it is a moment on the calendar."""
    m = _ASCII_DATE.match(value.strip(b"\0 "))
    try:
        return str(datetime.datetime(*map(int, m.groups()))) if m else None
    except ValueError:
        return None


def exif_block(data: bytes) -> bytes | None:
    """The TIFF structure inside a JPEG, PNG, HEIF or raw file."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:8] == b"FUJIFILM":
        at = int.from_bytes(data[84:88], "big")
        return exif_block(data[at:]) if data[at : at + 2] == b"\xff\xd8" else None
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            if data[at + 1] == 0xFF:
                at += 1
                continue
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + n]
            at += 2 + n
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            n, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + n]
            at += 12 + n
        return None
    if data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at >= 0 and data[at + 6 : at + 8] in (b"II", b"MM") else None
    return None


def film_date(data: bytes) -> str | None:
    """The creation time in a film's movie header, in UTC."""
    for kind, i, j in boxes(data):
        if kind == b"moov":
            for inner, a, _ in boxes(data, i, j):
                if inner == b"mvhd":
                    seconds = int.from_bytes(data[a + 4 : a + 12] if data[a] == 1 else data[a + 4 : a + 8], "big")
                    return _moment(seconds - QUICKTIME_EPOCH) if seconds else None
    return None


def _moment(seconds: int) -> str:
    return str(datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds))


def embedded(data: bytes, ext: str) -> tuple[str | None, str | None]:
    """The date in a file's binary structures and, where there is none, its XMP packet."""
    movie = ext.lower() in VIDEO

    def by_exif() -> str | None:
        block = exif_block(data)
        found = Tiff(block).dates() if block else {}
        return found.get(ORIGINAL) or found.get(CREATED)

    def by_heap() -> str | None:
        seconds = ciff_date(data)
        return _moment(seconds) if seconds else None

    for read in (lambda: film_date(data) if movie else by_exif(), by_heap):
        try:
            found = read()
        except (ValueError, struct.error, IndexError, OverflowError):
            continue
        if found:
            return found, None
    try:
        if ext.lower() in ("tif", "tiff"):
            packet = Tiff(data).packet()
            return None, packet.decode("utf-8", "replace") if packet else None
        return None, xmp_packet(data)
    except (ValueError, struct.error, IndexError):
        return None, None


def embedded_date(content: Column, ext: Column) -> Column:
    """The capture date of binary columns, null without one."""

    @F.pandas_udf("date string, packet string")
    def read(c: pd.Series, e: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([embedded(bytes(x), y or "") if x is not None else (None, None) for x, y in zip(c, e, strict=True)], columns=["date", "packet"])

    found = read(content, ext)
    return F.coalesce(timestamp_text(found["date"]), xmp_date(found["packet"]))


def dated_files(files: DataFrame, ext: Column) -> DataFrame:
    """files (with content) and embedded_date."""
    return files.withColumn("embedded_date", embedded_date(F.col("content"), ext))
