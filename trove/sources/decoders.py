"""The picture or film data inside media files, without metadata: what is hashed to find copies.

Each decoder takes a file's bytes and gives its payload, or raises ValueError where the bytes are not what they should
be. payload() picks one by extension and, if that one fails, by content; sources/raw.py adds RAW files. Formats that need
an image library are left to a decoder that the caller adds to DECODERS; without one they have no payload and fall back
to their bytes' hash.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOVIE_HEAD = 1 << 20
_PACKET, _BODY = 192, 187


def jpeg(data: bytes) -> bytes:
    """All segments but APP1, and all from the start of scan on."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    out, at = [data[:2]], 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken JPEG segment")
        kind = data[at + 1]
        if kind == 0xFF:  # fill byte
            at += 1
            continue
        if kind == 0xDA:
            return b"".join([*out, data[at:]])
        if kind == 0x01 or 0xD0 <= kind <= 0xD9:
            out.append(data[at : at + 2])
            at += 2
            continue
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if end > len(data) or end < at + 4:
            raise ValueError("JPEG segment past the end")
        if kind != 0xE1:
            out.append(data[at:end])
        at = end


def png(data: bytes) -> bytes:
    """IDAT chunks up to IEND."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    out, at = [], 8
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + n > len(data):
            raise ValueError("PNG chunk past the end")
        if kind == b"IEND":
            break
        if kind == b"IDAT":
            out.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if not out:
        raise ValueError("no PNG picture data")
    return b"".join(out)


def boxes(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the contents of each ISO-BMFF box in a range."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        n, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if n == 1:
            if lo + 16 > hi:
                raise ValueError("broken box")
            n, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif n == 0:
            n = hi - lo
        if n < head or lo + n > hi:
            raise ValueError("box past the end")
        yield kind, lo + head, lo + n
        lo += n


def mp4(data: bytes, head: int | None = None) -> bytes:
    """Top-level mdat boxes, up to head bytes of them."""
    found = [data[i:j] for kind, i, j in boxes(data) if kind == b"mdat"]
    if not found:
        raise ValueError("no film data")
    out = b"".join(found)
    return out if head is None else out[:head]


def film_ranges(path: str) -> list[tuple[int, int]]:
    """Where a film file's top-level mdat boxes lie, read by seeking; none for other files."""
    found, at = [], 0
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        while at + 8 <= size:
            f.seek(at)
            head = f.read(16)
            n, kind, skip = *struct.unpack_from(">I4s", head), 8
            if n == 1 and len(head) == 16:
                n, skip = struct.unpack_from(">Q", head, 8)[0], 16
            elif n == 0:
                n = size - at
            if n < skip or at + n > size or not kind.isalnum():
                return []
            if kind == b"mdat":
                found.append((at + skip, at + n))
            at += n
    return found


def heif(data: bytes) -> bytes:
    """The extents of the primary item, or of the tiles that it is derived from."""
    meta = next(((i, j) for kind, i, j in boxes(data) if kind == b"meta"), None)
    if meta is None:
        raise ValueError("no meta box")
    inner = {kind: (i, j) for kind, i, j in boxes(data, meta[0] + 4, meta[1])}
    if not {b"pitm", b"iloc"} <= inner.keys():
        raise ValueError("no primary item")
    i = inner[b"pitm"][0]
    primary = int.from_bytes(data[i + 4 : i + 4 + (2 if data[i] == 0 else 4)], "big")
    wanted = [primary]
    if b"iref" in inner:
        i, j = inner[b"iref"]
        wide = 4 if data[i] else 2
        for kind, a, _ in boxes(data, i + 4, j):
            if kind == b"dimg" and int.from_bytes(data[a : a + wide], "big") == primary:
                n = int.from_bytes(data[a + wide : a + wide + 2], "big")
                wanted = [int.from_bytes(data[a + wide + 2 + k * wide : a + wide + 2 + (k + 1) * wide], "big") for k in range(n)]
    places = _locations(data, *inner[b"iloc"])
    idat = inner.get(b"idat")
    out = []
    for item in wanted:
        if item not in places:
            raise ValueError("item without a place")
        method, extents = places[item]
        base = idat[0] if method == 1 and idat else 0
        for offset, n in extents:
            if base + offset + n > len(data):
                raise ValueError("item past the end")
            out.append(data[base + offset : base + offset + n] if n else data[base + offset :])
    return b"".join(out)


def _locations(data: bytes, at: int, end: int) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    version = data[at]
    sizes = data[at + 4] >> 4, data[at + 4] & 15, data[at + 5] >> 4, data[at + 5] & 15 if version else 0
    at += 6

    def number(n: int) -> int:
        nonlocal at
        if at + n > end:
            raise ValueError("broken item table")
        at += n
        return int.from_bytes(data[at - n : at], "big")

    out = {}
    for _ in range(number(2 if version < 2 else 4)):
        item = number(2 if version < 2 else 4)
        method = number(2) & 15 if version else 0
        number(2)
        base = number(sizes[2])
        extents = []
        for _ in range(number(2)):
            number(sizes[3])
            offset = number(sizes[0])
            extents.append((base + offset, number(sizes[1])))
        out[item] = (method, extents)
    return out


def avi(data: bytes) -> bytes:
    """The movi lists of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI")
    out, at = [], 12
    while at + 8 <= len(data):
        kind, n = struct.unpack_from("<4sI", data, at)
        if kind == b"LIST" and data[at + 8 : at + 12] == b"movi":
            out.append(data[at + 12 : at + 8 + n])
        at += 8 + n + (n & 1)
    if not out:
        raise ValueError("no film data")
    return b"".join(out)


def transport_stream(data: bytes) -> bytes:
    """Of 192-byte packets what follows timestamp and sync byte; a stream of 188-byte packets whole."""
    if len(data) >= _PACKET and data[4] == 0x47 and (len(data) < 2 * _PACKET or data[_PACKET + 4] == 0x47):
        return b"".join(data[i + 5 : i + 5 + _BODY] for i in range(0, len(data) - _PACKET + 1, _PACKET))
    if data[:1] == b"\x47" and (len(data) <= 188 or data[188] == 0x47):
        return data
    raise ValueError("no transport stream")


def film(data: bytes, head: int | None = None) -> bytes:
    """A film by its content, whatever it is called."""
    for decoder in (mp4, avi, transport_stream):
        try:
            out = decoder(data)
        except (ValueError, struct.error, IndexError):
            continue
        return out if head is None else out[:head]
    raise ValueError("no film")


DECODERS: dict[str, Callable[[bytes], bytes]] = {
    "jpg": jpeg, "jpeg": jpeg, "png": png, "heic": heif, "heif": heif, "avif": heif,
    **dict.fromkeys(("mp4", "m4v", "mov", "avi", "mts", "m2ts"), film),
}


def sniff(data: bytes) -> str | None:
    """The kind of a file by its first bytes: an extension of DECODERS, or one of tiff, raf, crw, cr3."""
    head = data[:192]
    if head[:2] == b"\xff\xd8":
        return "jpg"
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if head[4:8] == b"ftyp":
        brand = head[8:12]
        return "cr3" if brand == b"crx " else "avif" if brand in (b"avif", b"avis") else "heic" if brand in (b"heic", b"heix", b"mif1", b"msf1", b"hevc") else "mp4"
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return "avi"
    if head[:8] == b"FUJIFILM":
        return "raf"
    if head[6:14] == b"HEAPCCDR":
        return "crw"
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    if len(head) >= 189 and head[4] == 0x47 or len(head) > 188 and head[0] == head[188] == 0x47:
        return "m2ts"
    return None


def sniffed(content: Column) -> Column:
    """The kind of binary columns by their content."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else sniff(bytes(x)))

    return run(content)


def payload(data: bytes, ext: str, head: int | None = None, rescue: bool = True) -> bytes | None:
    """A file's payload, of films at most head bytes of it; None where it can't be read. No input raises."""
    for kind in dict.fromkeys((ext.lower(), sniff(data) if rescue else None)):
        decoder = DECODERS.get(kind or "")
        if decoder is None:
            continue
        try:
            out = decoder(data)
        except Exception:  # noqa: BLE001, S112  a broken file is a file without a payload
            continue
        return out[:head] if head is not None and decoder is film else out
    return None


def ciff_date(data: bytes, depth: int = 10) -> int | None:
    """The capture time (seconds) of a CIFF file's heap: tag 0x180E, searched through its directories."""
    if data[6:14] != b"HEAPCCDR":
        return None

    def search(lo: int, hi: int, left: int) -> int | None:
        if left == 0 or hi - lo < 6:
            return None
        table = lo + int.from_bytes(data[hi - 4 : hi], "little")
        if not lo <= table <= hi - 4:
            return None
        n = int.from_bytes(data[table : table + 2], "little")
        for k in range(n):
            at = table + 2 + 10 * k
            if at + 10 > hi:
                return None
            tag, size, offset = struct.unpack_from("<HII", data, at)
            if tag == 0x180E and lo + offset + 4 <= hi:
                return int.from_bytes(data[lo + offset : lo + offset + 4], "little")
            if tag >> 8 in (0x28, 0x30) and lo + offset + size <= hi:
                found = search(lo + offset, lo + offset + size, left - 1)
                if found is not None:
                    return found
        return None

    return search(int.from_bytes(data[2:6], "little"), len(data), depth)


def xmp_packet(data: bytes, scan: int = 16 << 20, most: int = 4 << 20) -> str | None:
    """The XMP packet that begins in a file's first bytes; without an end, as much of it as may be."""
    starts = [x for x in (data.find(b"<?xpacket", 0, scan), data.find(b"<x:xmpmeta", 0, scan)) if x >= 0]
    if not starts:
        return None
    lo = min(starts)
    hi = data.find(b"</x:xmpmeta", lo, lo + most)
    return data[lo : hi + 12 if hi >= 0 else lo + most].decode("utf-8", "replace")


def payload_hashes(content: Column, ext: Column, prefix: int = 64 * 1024, head: int | None = None) -> Column:
    """(payload_hash, head_hash) of binary columns: sha256 of the whole payload, md5 of its first bytes; nulls without one.

    head: of films only so many bytes count (MOVIE_HEAD nominates, the whole payload proves).
    """
    import hashlib

    @F.pandas_udf("payload_hash string, head_hash string")
    def run(c: pd.Series, e: pd.Series) -> pd.DataFrame:
        found = [None if x is None else payload(bytes(x), y or "", head) for x, y in zip(c, e, strict=True)]
        return pd.DataFrame({"payload_hash": [None if p is None else hashlib.sha256(p).hexdigest() for p in found], "head_hash": [None if p is None else hashlib.md5(p[:prefix]).hexdigest() for p in found]})  # noqa: S324

    return run(content, ext)
