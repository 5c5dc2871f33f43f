"""What the operators of this subpackage share: word rules, staged tables, vectorised word hashing."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from trove.sources.storage import discard, shared_folder
from trove.sources.storage import stored as stage

__all__ = ["SPACE_CHARS", "WORD", "chain", "discard", "hash_words", "mix", "n_words", "shared_folder", "stage", "text_bytes", "window_hashes"]

#: A word is a run of anything but the space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --- vectorised hashing of words -------------------------------------------------------------------------------

_U = np.uint64
_LONG = 64  # bytes; longer words are hashed one by one
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # one a stream
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], _U)
_SEP = np.zeros(257, bool)
_SEP[[32, 9, 10, 11, 12, 13, 256]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), applied elementwise; one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the pairs (a, b), elementwise. Not linear, so differences of repeated elements don't cancel."""
    x = a * _U(0xD1342543DE82EF95) + b
    x = (x ^ (x >> _U(29))) * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    edge = np.diff(np.concatenate(([True], _SEP[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hash_words(data: np.ndarray, streams: int = 1) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word starts, ends and, for each stream, 64-bit hashes of the words of one text's bytes.

    Words are read eight bytes at a time, all words together, each step mixed into what came before; words of up to
    eight bytes and equal length never collide. Words over _LONG bytes are hashed by blake2b.
    """
    starts, ends = word_spans(data)
    size = ends - starts
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    out = [mix(size.astype(_U) * _U(0xE7037ED1A0B428DB) + _U(_SEEDS[k])) for k in range(streams)]
    live, step = np.arange(len(starts)), 0
    while True:
        live = live[(size[live] > step) & (size[live] <= _LONG)]
        if not len(live):
            break
        lane = lanes[starts[live] + step] & _MASK[np.minimum(size[live] - step, 8)]
        for h in out:
            h[live] = mix(h[live] ^ lane)
        step += 8
    for i in np.flatnonzero(size > _LONG):
        digest = blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8 * streams).digest()
        for k, h in enumerate(out):
            h[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
    return starts, ends, out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every window of size words, in order: windows of one, two, four, ... words are chained."""
    n = len(words)
    if n < size:
        return np.empty(0, _U)
    power, width, done, covered = words, 1, None, 0
    while True:
        if size & width:
            done = power if done is None else chain(done[: n - covered - width + 1], power[covered:])
            covered += width
        if covered == size:
            return done[: n - size + 1]
        power = chain(power[:-width], power[width:])
        width *= 2


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column's batch and its n + 1 offsets; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]
