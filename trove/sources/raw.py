"""The sensor data inside RAW files, found by their structure and not decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from trove.sources.decoders import DECODERS, boxes

#: TIFF tags of picture data (offsets, sizes), of sub-directories, and Panasonic's offset; magic numbers.
STRIPS, TILES, SUB_IFDS, PANASONIC = (273, 279), (324, 325), 330, 280
TIFF_MAGIC = (42, 85, 21330, 20306)
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 13: 4}


class _Tiff:
    """Directories of a TIFF file as dicts of tag to numbers."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or self.number(2, "H") not in TIFF_MAGIC:
            raise ValueError("no TIFF")

    def number(self, at: int, kind: str) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def values(self, at: int) -> list[int]:
        kind, n = self.number(at + 2, "H"), self.number(at + 4, "I")
        size = _SIZES.get(kind, 0)
        if kind not in (1, 3, 4, 13) or n * size > len(self.data):
            return []
        place = at + 8 if n * size <= 4 else self.number(at + 8, "I")
        return list(struct.unpack_from(self.order + str(n) + {1: "B", 2: "H", 4: "I"}[size], self.data, place))

    def directories(self) -> Iterator[dict[int, list[int]]]:
        todo, seen = [self.number(4, "I")], set()
        while todo:
            at = todo.pop(0)
            if at == 0 or at in seen or at + 2 > len(self.data):
                continue
            seen.add(at)
            n = self.number(at, "H")
            found = {self.number(at + 2 + 12 * k, "H"): self.values(at + 2 + 12 * k) for k in range(n)}
            todo += found.get(SUB_IFDS, [])
            if at + 6 + 12 * n <= len(self.data):
                todo.append(self.number(at + 2 + 12 * n, "I"))
            yield found


def tiff(data: bytes) -> bytes:
    """The largest of all strips, tiles and Panasonic blocks."""
    best = b""
    for found in _Tiff(data).directories():
        for offsets, sizes in (STRIPS, TILES):
            if offsets in found and len(found[offsets]) == len(found.get(sizes, ())):
                part = b"".join(data[i : i + n] for i, n in zip(found[offsets], found[sizes], strict=True))
                best = max(best, part, key=len)
        if found.get(PANASONIC):
            best = max(best, data[found[PANASONIC][0] :], key=len)
    if not best:
        raise ValueError("no picture data")
    return best


def raf(data: bytes) -> bytes:
    """What the header's table names as sensor data."""
    if data[:16] != b"FUJIFILMCCD-RAW ":
        raise ValueError("no RAF")
    offset, n = struct.unpack_from(">II", data, 100)
    if offset >= len(data):
        raise ValueError("data past the end")
    return data[offset : offset + n]


def ciff_entries(data: bytes, lo: int, hi: int, depth: int = 10) -> Iterator[tuple[int, bytes]]:
    """(tag, value) of a CIFF heap and the heaps in it."""
    if depth == 0 or hi - lo < 6:
        return
    table = lo + int.from_bytes(data[hi - 4 : hi], "little")
    if not lo <= table <= hi - 6:
        return
    for k in range(int.from_bytes(data[table : table + 2], "little")):
        at = table + 2 + 10 * k
        if at + 10 > hi:
            return
        tag, n, offset = struct.unpack_from("<HII", data, at)
        if tag & 0xC000 == 0x4000:  # the value is in the entry
            yield tag & 0x3FFF, data[at + 2 : at + 10]
        elif lo + offset + n <= hi:
            if tag & 0x3800 in (0x2800, 0x3000):
                yield from ciff_entries(data, lo + offset, lo + offset + n, depth - 1)
            else:
                yield tag & 0x3FFF, data[lo + offset : lo + offset + n]


def crw(data: bytes) -> bytes:
    """From an offset that follows from the sensor's size to the end-of-image mark."""
    if data[:2] != b"II" or data[6:14] != b"HEAPCCDR":
        raise ValueError("no CRW")
    sensor = next((v for t, v in ciff_entries(data, int.from_bytes(data[2:6], "little"), len(data)) if t == 0x1031), b"")
    if len(sensor) < 6:
        raise ValueError("no sensor size")
    width, height = struct.unpack_from("<HH", sensor, 2)
    body = data[540 + width * height // 4 :]
    if not body:
        raise ValueError("data past the end")
    end = body.find(b"\xff\xd9")
    return body if end < 0 else body[: end + 2]


def cr3(data: bytes) -> bytes:
    """The largest first sample of all tracks."""
    inside = lambda span, kind: next(((i, j) for k, i, j in boxes(data, *span) if k == kind), None)
    moov = inside((0, len(data)), b"moov")
    if moov is None:
        raise ValueError("no CR3")
    best = b""
    for kind, i, j in boxes(data, *moov):
        span = (i, j) if kind == b"trak" else None
        for name in (b"mdia", b"minf", b"stbl"):
            span = inside(span, name) if span else None
        if span is None:
            continue
        table = {k: a for k, a, _ in boxes(data, *span)}
        if b"stsz" not in table or not ({b"stco", b"co64"} & table.keys()):
            continue
        size = struct.unpack_from(">I", data, table[b"stsz"] + 4)[0] or struct.unpack_from(">I", data, table[b"stsz"] + 12)[0]
        offset = struct.unpack_from(">Q", data, table[b"co64"] + 8)[0] if b"co64" in table else struct.unpack_from(">I", data, table[b"stco"] + 8)[0]
        if offset + size <= len(data):
            best = max(best, data[offset : offset + size], key=len)
    if not best:
        raise ValueError("no sample")
    return best


def any_raw(data: bytes) -> bytes:
    """A RAW file by its content."""
    if data[:16] == b"FUJIFILMCCD-RAW ":
        return raf(data)
    if data[6:14] == b"HEAPCCDR":
        return crw(data)
    return cr3(data) if data[4:8] == b"ftyp" else tiff(data)


def register(extensions: list[str]) -> None:
    """Let payload() read these extensions, and TIFF, RAF, CRW and CR3 by content."""
    DECODERS.update(dict.fromkeys([*extensions, "tiff", "raf", "crw", "cr3"], any_raw))
