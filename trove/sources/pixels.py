"""Pixels of pictures that need no image library, and their signatures.

decode() reads PNG (not interlaced), BMP, PNM and PAM, TGA, QOI and farbfeld into an array of rows, columns and channels,
8 or 16 bits deep. Films and other formats have no pixels here; a caller adds decoders to PIXEL_DECODERS. A picture's key
is the hash of its size, channels and pixels, whatever its container. Signatures: a median hash of the low frequencies of
a shrunk gray picture, and a gradient hash of its rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PIXELS = 1 << 28  # larger pictures are refused: one would not fit a task


def _sized(width: int, height: int) -> tuple[int, int]:
    if not (0 < width * height <= MOST_PIXELS):
        raise ValueError("no picture of that size")
    return width, height


def png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, parts, palette, clear = 8, [], None, None
    head = None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[6] or not parts:
        raise ValueError("interlaced or broken PNG")
    width, height, depth, colour = head[:4]
    _sized(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    stride, step = (width * channels * depth + 7) // 8, max(1, channels * depth // 8)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), height * (stride + 1)), np.uint8).reshape(height, stride + 1)
    rows = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        above = rows[y] = _unfilter(int(raw[y, 0]), raw[y, 1:], above, step)
    if depth == 16:
        out = rows.reshape(height, width, channels, 2)
        values = (out[..., 0].astype(np.uint16) << 8) | out[..., 1]
    elif depth == 8:
        values = rows.reshape(height, width, channels)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * channels]
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8).reshape(height, width, channels)
        if colour == 0:
            values = values * np.uint8(255 // ((1 << depth) - 1))
    if colour != 3:
        return values
    if palette is None:
        raise ValueError("no palette")
    out = palette[values[..., 0]]
    if clear is not None:
        alpha = np.concatenate((clear, np.full(max(0, 256 - len(clear)), 255, np.uint8)))
        out = np.dstack((out, alpha[values[..., 0]]))
    return out


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row without its filter: none, the pixel to the left, the one above, their mean, or the nearest of three."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        padded = np.concatenate((line, np.zeros(-len(line) % step, np.uint8))).reshape(-1, step)
        return np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, up = bytearray(line.tobytes()), above.tobytes()
    if kind == 3:
        for i in range(len(out)):
            out[i] = (out[i] + ((out[i - step] if i >= step else 0) + up[i] >> 1)) & 255
    elif kind == 4:
        for i in range(len(out)):
            a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
            near = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
            out[i] = (out[i] + near) & 255
    else:
        raise ValueError("unknown filter")
    return np.frombuffer(bytes(out), np.uint8)


def bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("no BMP")
    start, head, width, height, _, depth, packed = struct.unpack_from("<IIiiHHI", data, 10)
    down, height = height < 0, abs(height)
    _sized(width, height)
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("packed BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, start).reshape(height, stride)[:, : width * depth // 8].reshape(height, width, depth // 8)
    rows = rows if down else rows[::-1]
    if depth == 8:
        return np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)[:, 2::-1][rows[..., 0]]
    return rows[..., 2::-1].copy()


def pnm(data: bytes) -> np.ndarray:
    if data[:2] == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        given = dict(x.split(None, 1) for x in head.decode("ascii").splitlines()[1:] if " " in x)
        width, height, channels, top = (int(given[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        kind = 6
    else:
        m = re.match(rb"P([1-6])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)", data)
        if not m:
            raise ValueError("no PNM")
        kind, width, height = int(m[1]), int(m[3]), int(m[5])
        at, top = m.end(), 1
        if kind not in (1, 4):
            n = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
            at, top = n.end(), int(n[1])
        channels, body = 3 if kind in (3, 6) else 1, data[at + 1 :]
    _sized(width, height)
    count = width * height * channels
    if kind == 4:
        values = 1 - np.unpackbits(np.frombuffer(body, np.uint8, (width + 7) // 8 * height).reshape(height, -1), axis=1)[:, :width]
    elif kind < 4:
        numbers = body.split() if kind > 1 else [bytes([c]) for c in body if c in b"01"]
        values = np.array(numbers[:count], int)
        values = 1 - values if kind == 1 else values
    else:
        values = np.frombuffer(body, ">u2" if top > 255 else "u1", count)
    values = values.reshape(height, width, channels)
    if top not in (255, 65535):
        full = 65535 if top > 255 else 255
        values = (values.astype(np.uint64) * full + top // 2) // top
    return values.astype(np.uint16 if top > 255 else np.uint8)


def tga(data: bytes) -> np.ndarray:
    skip, mapped, kind = data[0], data[1], data[2]
    width, height, depth, flags = struct.unpack_from("<HHBB", data, 12)
    _sized(width, height)
    size = depth // 8
    if mapped or kind not in (2, 3, 10, 11) or depth not in (8, 24, 32):
        raise ValueError("no plain TGA")
    at, need = 18 + skip, width * height * size
    if kind < 8:
        flat = data[at : at + need]
    else:
        out = bytearray()
        while len(out) < need:
            n = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + size] * n
                at += 1 + size
            else:
                out += data[at + 1 : at + 1 + n * size]
                at += 1 + n * size
        flat = bytes(out[:need])
    rows = np.frombuffer(flat, np.uint8, need).reshape(height, width, size)
    rows = rows if flags & 0x20 else rows[::-1]
    return rows.copy() if size == 1 else np.dstack((rows[..., 2::-1], rows[..., 3:]))


def qoi(data: bytes) -> np.ndarray:
    if data[:4] != b"qoif":
        raise ValueError("no QOI")
    width, height, channels = struct.unpack_from(">IIB", data, 4)
    _sized(width, height)
    out = np.empty((width * height, 4), np.uint8)
    seen, (r, g, b, a), at, i = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, 0
    while i < len(out):
        x, run = data[at], 1
        at += 1
        if x == 0xFE:
            (r, g, b), at = data[at : at + 3], at + 3
        elif x == 0xFF:
            (r, g, b, a), at = data[at : at + 4], at + 4
        elif x < 0x40:
            r, g, b, a = seen[x]
        elif x < 0x80:
            r, g, b = (r + (x >> 4 & 3) - 2) & 255, (g + (x >> 2 & 3) - 2) & 255, (b + (x & 3) - 2) & 255
        elif x < 0xC0:
            dg, y = (x & 63) - 32, data[at]
            at += 1
            r, g, b = (r + dg - 8 + (y >> 4)) & 255, (g + dg) & 255, (b + dg - 8 + (y & 15)) & 255
        else:
            run = (x & 63) + 1
        seen[(r * 3 + g * 5 + b * 7 + a * 11) % 64] = (r, g, b, a)
        out[i : i + run] = (r, g, b, a)
        i += run
    return out.reshape(height, width, 4)[..., :channels]


def farbfeld(data: bytes) -> np.ndarray:
    if data[:8] != b"farbfeld":
        raise ValueError("no farbfeld")
    width, height = _sized(*struct.unpack_from(">II", data, 8))
    return np.frombuffer(data, ">u2", width * height * 4, 16).reshape(height, width, 4).astype(np.uint16)


PIXEL_DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"png": png, "bmp": bmp, "dib": bmp, **dict.fromkeys(("pbm", "pgm", "ppm", "pnm", "pam"), pnm), "tga": tga, "qoi": qoi, "ff": farbfeld}


def _by_content(data: bytes) -> str | None:
    marks = {b"\x89PNG": "png", b"BM": "bmp", b"qoif": "qoi", b"farbfeld": "ff", **{b"P%d" % k: "pnm" for k in range(1, 8)}}
    return next((kind for mark, kind in marks.items() if data.startswith(mark)), None)


def decode(data: bytes, ext: str) -> np.ndarray | None:
    """Pixels by extension, else by content; None where there are none. No input raises."""
    for kind in dict.fromkeys((ext.lower(), _by_content(data))):
        if kind in PIXEL_DECODERS:
            try:
                return PIXEL_DECODERS[kind](data)
            except Exception:  # noqa: BLE001, S112  a broken file is a file without pixels
                continue
    return None


def to_eight_bits(pixels: np.ndarray) -> np.ndarray:
    """Three or four channels of 8 bits, or the first channel alone where there are other numbers of them."""
    eight = (pixels >> 8).astype(np.uint8) if pixels.dtype == np.uint16 else pixels
    return eight if eight.shape[2] in (3, 4) else eight[..., :1]


def rgba(pixels: np.ndarray) -> np.ndarray:
    """Four channels of 8 bits: what rasters without a payload of their own are hashed by."""
    eight = (pixels >> 8).astype(np.uint8) if pixels.dtype == np.uint16 else pixels
    colour = eight[..., :3] if eight.shape[2] > 2 else np.repeat(eight[..., :1], 3, axis=2)
    alpha = eight[..., -1:] if eight.shape[2] in (2, 4) else np.full((*eight.shape[:2], 1), 255, np.uint8)
    return np.concatenate((colour, alpha), axis=2)


def pixel_key(pixels: np.ndarray) -> str:
    """width x height x channels and the hash of the pixels."""
    height, width, channels = pixels.shape
    return f"{width}x{height}x{channels}:{hashlib.sha256(np.ascontiguousarray(pixels).tobytes()).hexdigest()}"


def chroma(pixels: np.ndarray) -> int | None:
    """Whole mean of the spread of the three channels; None with fewer."""
    eight = to_eight_bits(pixels)
    if eight.shape[2] < 3:
        return None
    colour = eight[..., :3].astype(np.int16)
    return int((colour.max(axis=2) - colour.min(axis=2)).sum() // (eight.shape[0] * eight.shape[1]))


def _weights(size: int, to: int) -> np.ndarray:
    """A Lanczos filter with three lobes as a matrix from size samples to `to`."""
    scale = max(1.0, size / to)
    centre = (np.arange(to)[:, None] + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def shrink(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The gray picture at another size, in whole values of 0 to 255."""
    eight = to_eight_bits(pixels).astype(np.float64)
    gray = np.floor(eight[..., :3] @ (0.2126, 0.7152, 0.0722)) if eight.shape[2] >= 3 else eight[..., 0]
    return np.clip(np.rint(_weights(gray.shape[0], height) @ gray @ _weights(gray.shape[1], width).T), 0, 255)


def _bits(flags: np.ndarray) -> int:
    """64 booleans as a signed number, the first the lowest bit."""
    return int.from_bytes(np.packbits(flags.ravel(), bitorder="little").tobytes(), "little", signed=True)


def phash(pixels: np.ndarray) -> int:
    """Bit i: is the i-th of the 64 lowest frequencies of the picture above their median?"""
    small = shrink(pixels, 16, 16)
    basis = np.cos(np.pi / 16 * (np.arange(16)[None, :] + 0.5) * np.arange(16)[:, None])
    low = (basis @ small @ basis.T)[:8, :8]
    return _bits(low > np.median(low))


def dhash(pixels: np.ndarray) -> int:
    """Bit i: is value i of eight rows of nine below the next one?"""
    small = shrink(pixels, 9, 8)
    return _bits(small[:, :-1] < small[:, 1:])


def pixel_layers(content: Column, ext: Column) -> Column:
    """pixel_hash, phash, dhash, chroma and pixels (their number) of binary columns; nulls without pixels."""

    @F.pandas_udf("pixel_hash string, phash long, dhash long, chroma int, pixels long")
    def run(c: pd.Series, e: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(c, e, strict=True):
            p = None if x is None else decode(bytes(x), y or "")
            rows.append((None,) * 5 if p is None else (pixel_key(p), phash(p), dhash(p), chroma(p), p.shape[0] * p.shape[1]))
        out = pd.DataFrame(rows, columns=["pixel_hash", "phash", "dhash", "chroma", "pixels"])
        return out.astype({"phash": "Int64", "dhash": "Int64", "chroma": "Int32", "pixels": "Int64"})

    return run(content, ext)
