"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice; lossless decoding.

The lattice of a text has an edge for each vocabulary piece that matches at each place. Edges weigh a piece's probability
(by its rank in the model, raised to alpha). The forward pass sums the weights of all paths up to each place, the
backward pass draws edges from the end in proportion, so a segmentation comes with its probability, each draw's in whole multiples of 2**-32. No piece
reaches over the start of a run of spaces or over a line break, so the lattice falls into units (a word with the spaces
before it); a worker filters each distinct unit once, a chunk's new ones together, and every occurrence is sampled by itself.

Draws are hashes of seed, row key, unit and step, and are compared with whole numbers that a unit gets from its own
characters alone: a row's segmentation is the same in every run, however the table is dealt. Characters without a piece are spelled in byte pieces, as is the piece alphabet's own space mark, so decoding
gives back every text exactly. The vocabulary is a parameter and is never trained here; the driver reads the model file
and sends it to the executors (half a megabyte).

Defined cases: null or empty text has no pieces and decodes to the empty text; a null key counts as 0; rows with equal
keys and texts (ties, repeated rows) get equal segmentations; very long texts and units are taken whole; an empty table gives an empty result;
other columns pass through encode_documents unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm.common import mix

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 11
DRAW_BITS = 32  # chances are whole multiples of 2**-32
_CHUNK_CHARS = 1 << 21
_HELD_EDGES = 6_000_000  # 16 bytes each; a worker that holds more starts anew
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_MARK = "▁"
_UNKNOWN = 1 << 24  # ids from here on stand for a code point that is spelled in bytes


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Vocabulary:
    """A model's pieces as a trie in arrays, with their log weights and bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self._ladders: _Ladders | None = None
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        pieces, self.bytes_of, self.byte_id = {}, [], np.full(256, -1, np.int64)
        rank = np.full(n, float(n))
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                pieces[piece] = i
                self.bytes_of.append(piece.replace(_MARK, " ").encode())
                rank[i] = min(float(n), -sp.get_score(i))
        self.log_weight = np.log(1 / (rank + 10)) - np.log(np.sum(1 / (rank + 10)))
        self.unknown_weight = float(self.log_weight.min()) - 2.0
        alphabet = sorted(set("".join(pieces)))
        self.letters = np.full(0x110000, -1, np.int32)
        self.letters[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        self.letters[ord(" ")], self.letters[ord(_MARK)] = self.letters[ord(_MARK)], -1
        self.width = len(alphabet)
        edges: dict[int, int] = {}
        ends = [-1]
        number = {c: k for k, c in enumerate(alphabet)}
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                edge = node * self.width + number[c]
                node = edges.setdefault(edge, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.edges = np.array(sorted(edges), np.int64)
        self.nodes = np.array([edges[e] for e in self.edges.tolist()], np.int64)
        self.size_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start_of = np.concatenate(([0], np.cumsum(self.size_of)))
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def ladders(self, alpha: float) -> _Ladders:
        """Those of the chunks before, or new ones where these have grown large or were cut short."""
        held = self._ladders
        if held is None or held.alpha != alpha or len(held.made[2]) > _HELD_EDGES or len(held.numbers) > len(held.made[0]):
            held = self._ladders = _Ladders(self, alpha)
        return held

    def lattice(self, codes: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, length and id of all edges over a row of units; unit_end: where each character's unit ends."""
        letters = self.letters[codes]
        start = np.arange(len(codes))
        node, at, depth = np.zeros(len(codes), np.int64), start, 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(codes), bool)
        while len(at):
            here = at + depth
            inside = here < unit_end[at]
            at, node, here = at[inside], node[inside], here[inside]
            edge = node * self.width + letters[here]
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            good = (letters[here] >= 0) & (self.edges[place] == edge)
            at, node = at[good], self.nodes[place[good]]
            depth += 1
            ends = self.ends[node]
            real = ends >= 0
            if depth == 1:
                single[at[real]] = True
            out.append((at[real], np.full(int(real.sum()), depth, np.int64), ends[real]))
        spelled = np.flatnonzero(~single)
        out.append((spelled, np.ones(len(spelled), np.int64), _UNKNOWN + codes[spelled].astype(np.int64)))
        a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return a, b, c

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids with unknown characters in byte pieces, and how many pieces each id became."""
        times = np.ones(len(ids), np.int64)
        odd = np.flatnonzero(ids >= _UNKNOWN)
        if not len(odd):
            return ids, times
        spelled = [self.byte_id[np.frombuffer(chr(int(x) - _UNKNOWN).encode(), np.uint8)] for x in ids[odd]]
        times[odd] = [len(s) for s in spelled]
        out = np.repeat(ids, times)
        first = np.cumsum(times)[odd] - times[odd]
        out[np.concatenate([np.arange(f, f + len(s)) for f, s in zip(first, spelled, strict=True)])] = np.concatenate(spelled)
        return out, times

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of rows of pieces: their bytes, without the space before the first."""
        size = self.size_of[ids]
        ends = np.cumsum(size)
        where = np.repeat(self.start_of[ids] - (ends - size), size) + np.arange(int(size.sum()))
        data = self.all_bytes[where].tobytes()
        cut = np.concatenate(([0], ends))[offsets]
        return [data[lo + (data[lo : lo + 1] == b" ") : hi] for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _filter(vocabulary: Vocabulary, units: list[str], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The forward pass over distinct units.

    Gives the first place of each unit, its length, and edges by the place where they end: that place's number in the
    upper bits and the running sum of their chances in the lower DRAW_BITS (rising throughout), their lengths and ids.
    Sums never reach over a place, so a unit's edges do not depend on the units beside it.
    """
    codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    length = np.array([len(u) for u in units], np.int64)
    first = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(units)), length)
    start, size, ids = vocabulary.lattice(codes, (first + length)[owner])
    weight = alpha * np.where(ids < _UNKNOWN, vocabulary.log_weight[np.minimum(ids, len(vocabulary.log_weight) - 1)], vocabulary.unknown_weight)
    end = start + size
    begin = first[owner[start]]
    depth = end - begin
    wide = 1 + int(size.max(initial=0))
    order = np.argsort((depth * (len(codes) + 1) + end) * wide + size)  # no two edges have equal keys; a unit's are in one order, whatever stands beside it
    start, end, weight, ids, size, depth = start[order], end[order], weight[order], ids[order], size[order], depth[order]
    begins = start == first[owner[start]]
    total = np.zeros(len(codes) + 1)  # by the place where paths end; a unit's own beginning counts as 0
    bounds = np.flatnonzero(np.diff(depth, prepend=-1)).tolist()
    value = np.empty(len(start))
    for lo, hi in zip(bounds, [*bounds[1:], len(start)], strict=True):
        v = np.where(begins[lo:hi], 0.0, total[start[lo:hi]]) + weight[lo:hi]
        at = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
        high = np.maximum.reduceat(v, at)
        spread = np.diff(np.append(at, hi - lo))
        total[end[lo:hi][at]] = high + np.log(np.add.reduceat(np.exp(v - np.repeat(high, spread)), at))
        value[lo:hi] = v
    order = np.argsort(end * wide + size)
    end, ids, size, value = end[order], ids[order], size[order], value[order]
    chance = np.exp(value - total[end])
    at = np.flatnonzero(np.diff(end, prepend=-1))
    spread = np.diff(np.append(at, len(end)))
    sums, rank = chance.copy(), 1
    while len(at := at[spread > rank]):
        spread = spread[spread > rank]
        sums[at + rank] += sums[at + rank - 1]
        rank += 1
    steps = np.minimum(np.rint(sums * (1 << DRAW_BITS)).astype(np.int64), 1 << DRAW_BITS)
    steps[np.append(np.flatnonzero(np.diff(end)), len(end) - 1)] = 1 << DRAW_BITS
    return first, length, (end << DRAW_BITS) + steps, size, ids


class _Ladders:
    """Units that a worker has met and what _filter gives for them, so that later chunks filter new ones only."""

    def __init__(self, vocabulary: Vocabulary, alpha: float) -> None:
        self.vocabulary, self.alpha, self.places = vocabulary, alpha, 0
        self.numbers = _Numbers()
        self.made = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))

    def filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What _filter gives for all units, once those without it have got it."""
        new = list(islice(self.numbers, len(self.made[0]), None))
        if new:
            first, length, ladder, size, ids = _filter(self.vocabulary, new, self.alpha)
            made = (first + self.places, length, ladder + (self.places << DRAW_BITS), size.astype(np.int32), ids.astype(np.int32))
            self.made = tuple(np.concatenate(x) for x in zip(self.made, made, strict=True))
            self.places += int(length.sum())
        return self.made


def segment(vocabulary: Vocabulary, texts: list[str], keys: np.ndarray, alpha: float = ALPHA, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pieces of all texts in a row, and each text's first (with the end of the last)."""
    held = vocabulary.ladders(alpha)
    numbered = [np.fromiter(map(held.numbers.__getitem__, _UNIT.findall(" " + t if t else "")), np.int64) for t in texts]
    count = np.array([len(x) for x in numbered], np.int64)
    offsets = np.concatenate(([0], np.cumsum(count)))
    unit = np.concatenate([*numbered, np.empty(0, np.int64)])
    if not len(unit):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first, length, ladder, size, ids = held.filled()
    rows = mix(keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    place = np.arange(len(unit)) - np.repeat(offsets[:-1], count)
    stream = mix(np.repeat(rows, count) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    begin = first[unit]
    at = begin + length[unit]
    live = np.argsort(unit)  # occurrences of a unit together, so that a step reads the ladder from its beginning to its end
    steps, drawn, n = [], [], np.zeros(len(unit), np.int64)
    step = 0
    while len(live):
        draw = (mix(stream[live] + np.uint64(step)) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
        edge = np.searchsorted(ladder, (at[live] << DRAW_BITS) + draw, "right")
        steps.append(live)
        drawn.append(ids[edge])
        n[live] += 1
        at[live] -= size[edge]
        live = live[at[live] > begin[live]]
        step += 1
    ends = np.cumsum(n)
    pieces = np.empty(int(ends[-1]), np.int64)
    for k, (who, what) in enumerate(zip(steps, drawn, strict=True)):
        pieces[ends[who] - 1 - k] = what
    pieces, times = vocabulary.spell(pieces)
    after = np.concatenate(([0], np.cumsum(times)))
    return pieces, after[np.concatenate(([0], ends))[offsets]]


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    key = hash(model)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(model)
    return _vocabularies[key]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about _CHUNK_CHARS characters."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > _CHUNK_CHARS:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs with the columns pieces (array of int) and lossless (their decoding equals the text; null counts as empty).

    Columns of docs that bear these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).field("text").to_pylist()]
            for lo, hi in _chunks([len(t) for t in texts]):
                part = texts[lo:hi]
                keys = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.int64)
                pieces, offsets = segment(vocabulary, part, keys, alpha, seed)
                same = [d == t.encode() for d, t in zip(vocabulary.decode(pieces, offsets), part, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(same, pa.bool_())], ["row", "pieces", "lossless"])

    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, pieces array<int>, lossless boolean")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in ("pieces", "lossless")], "pieces", "lossless")


def decode_documents(encoded: DataFrame, model_path: str = MODEL_PATH, pieces: str = "pieces") -> DataFrame:
    """encoded with a column decoded: the text of its pieces (null pieces: the empty text)."""
    held = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(held.value)
        for batch in batches:
            found = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
            texts = vocabulary.decode(np.concatenate([*found, np.empty(0, np.int64)]), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["row", "decoded"])

    packed = encoded.select(F.struct("*").alias("row"), F.col(pieces).alias("pieces"))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, decoded string")
    return out.select("row.*", "decoded")


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = encode_documents(docs)
    return made.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "lossless", "pieces")


QUERIES = {"op3_sentence_pieces": op3_sentence_pieces}
ORACLES: dict[str, str] = {}
