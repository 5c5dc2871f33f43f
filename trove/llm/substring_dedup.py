"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of BLOCK words. The blocks are indexed by hash, and every
rolling window of BLOCK words of every document probes the index. Any WINDOW = 2 * BLOCK words hold a whole block, so a
repeat of WINDOW words or more has a hit. Hits are then extended: the windows of WINDOW words around each hit are
compared by 96 bits of two hashes of their words (with the bucket's bits, which grow with the input, over 100), and runs of windows that also start in a document with a smaller doc_id are
the maximal exact repeats; their words are removed. Windows are judged on the input, not on what is left.

How it is dealt: rows are hashed by id and text, so that rows of one id or without one are spread, into groups of about
GROUP_BYTES. A group sends each distinct hash once, packed,
to the bucket that the hash's upper bits name, so a passage of very many documents costs a bucket one entry a group, and
no pairs of documents are ever formed. Buckets answer with the hashes that concern the group. Each of the three passes
(probe, extend, remove) is stored in the shared folder, and its shuffle files are dropped before the next one begins.

Defined cases: null text has no words; a null doc_id is larger than all others; rows that share a doc_id are not
repeats of each other, but both of any smaller one; texts of fewer than WINDOW words lose nothing; very long texts are
taken whole; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm.common import hash_words, stage, text_bytes, window_hashes

WINDOW, BLOCK = 50, 25
GROUP_BYTES, BUCKET_ITEMS, LEAST_PARTS = 4 << 20, 1_500_000, 256
_LOW = 38  # bits of a hash that an entry holds; the bucket's number stands for its upper bits
_FLAGS = np.uint64(2)
_NULL_ID = np.iinfo(np.int64).max
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])  # 96 bits of a window's hash; the bucket's number adds to them


def _parts(total: int, most: int, least: int) -> int:
    """Into how many parts a total goes: LEAST_PARTS of them while they are at least `least` large, more so that none is over `most`."""
    return max(1, -(-total // most), min(LEAST_PARTS, total // least))


class _Group:
    """A group's documents and the hashes of their words."""

    def __init__(self, table: pa.Table, streams: int) -> None:
        table = table.combine_chunks()
        self.ids = table.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy()
        self.data, offsets = text_bytes(table.column("text"))
        self.bounds = list(itertools.pairwise(offsets.tolist()))
        self.words = [hash_words(self.data[lo:hi], streams)[2] for lo, hi in self.bounds]

    def rolling(self, size: int, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of size words, and of how many of them each document has the first."""
        found = [window_hashes(w[stream], size) for w in self.words]
        return np.concatenate([*found, np.empty(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)) % np.uint64(buckets)


def _anchor_ids(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower bits of each hash as one number."""
    return _bucket(hashes, buckets) << np.uint64(_LOW) | hashes & np.uint64((1 << _LOW) - 1)


def _pack(values: np.ndarray) -> bytes:
    """The lower five bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array and where each begins and the last ends."""
    if not len(buckets):
        return buckets, np.zeros(1, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    return buckets[starts], np.append(starts, len(buckets))


def _probe(buckets: int):  # noqa: ANN202
    """A group's entries: each distinct hash with two flags, is it a reference block here, do two documents here have it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = _Group(table, 1)
        hashes, first = group.rolling(BLOCK)
        ids = _anchor_ids(hashes, buckets)
        owner = np.repeat(np.arange(len(group.ids), dtype=np.int32), np.diff(first))
        block = (np.arange(len(ids)) - first[:-1][owner]) % BLOCK == 0 if len(ids) else np.empty(0, bool)
        order = np.argsort(ids, kind="stable")
        ids, owner, block = ids[order], owner[order], block[order]
        ids, at = _by_bucket(ids)
        many = owner[at[:-1]] != owner[at[1:] - 1]
        block = np.logical_or.reduceat(block, at[:-1]) if len(ids) else block
        entry = (ids & np.uint64((1 << _LOW) - 1)) << _FLAGS | many.astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)
        names, at = _by_bucket(ids >> np.uint64(_LOW))
        packed = [_pack(entry[i:j]) for i, j in itertools.pairwise(at.tolist())]
        return pa.table({"bucket": pa.array(names.astype(np.int64)), "gid": pa.array([key[0].as_py()] * len(names), pa.int64()), "entries": pa.array(packed, pa.binary())})

    return run


def _hits(table: pa.Table) -> pa.Table:
    """A bucket's answer to each group: those of its hashes that are a block somewhere and that two documents have."""
    bucket = table.column("bucket")[0].as_py()
    gids = table.column("gid").to_pylist()
    parts = [_unpack(x.as_py()) for x in table.column("entries")]
    sizes = np.array([len(x) for x in parts])
    entries = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    order = np.argsort(entries >> _FLAGS, kind="stable")  # in a hash, by group
    entries, owner = entries[order], owner[order]
    _, at = _by_bucket(entries >> _FLAGS)
    block = np.bitwise_or.reduceat(entries, at[:-1])
    good = (block & np.uint64(1) != 0) & ((block & np.uint64(2) != 0) | (np.diff(at) > 1))
    keep = np.repeat(good, np.diff(at))
    entries, owner = entries[keep] >> _FLAGS, owner[keep]
    order = np.argsort(owner, kind="stable")
    names, at = _by_bucket(owner[order])
    return pa.table({"gid": pa.array([gids[k] for k in names.tolist()], pa.int64()), "bucket": pa.array([bucket] * len(names), pa.int64()), "hits": pa.array([_pack(entries[order[i:j]]) for i, j in itertools.pairwise(at.tolist())], pa.binary())})


def _window_keys(group: _Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all windows of WINDOW words, their upper bits (for buckets) and each document's first."""
    a, first = group.rolling(WINDOW, 0)
    b, _ = group.rolling(WINDOW, 1)
    keys = np.empty(len(a), _KEY)
    keys["a"], keys["b"] = a, (b & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return keys, b, first


def _extend(buckets: int):  # noqa: ANN202
    """A group's windows that hold a hit: each distinct one with the smallest doc_id that has it here."""

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        empty = pa.table({"bucket": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})
        if not hits.num_rows or not docs.num_rows:
            return empty
        wanted = np.sort(np.concatenate([np.uint64(n) << np.uint64(_LOW) | _unpack(x) for n, x in zip(hits.column("bucket").to_pylist(), hits.column("hits").to_pylist(), strict=True)]))
        group = _Group(docs, 2)
        hashes, first = group.rolling(BLOCK)
        ids = _anchor_ids(hashes, buckets)
        found = wanted[np.minimum(np.searchsorted(wanted, ids), len(wanted) - 1)] == ids
        keys, upper, starts = _window_keys(group)
        total = np.concatenate(([0], np.cumsum(found)))
        owner = np.repeat(np.arange(len(group.ids), dtype=np.int64), np.diff(starts))
        place = np.arange(len(keys)) - starts[:-1][owner] + first[:-1][owner]  # where the window begins among the rolling ones
        held = total[place + WINDOW - BLOCK + 1] > total[place]
        keys, upper, doc = keys[held], upper[held], group.ids[owner[held]]
        if not len(keys):
            return empty
        order = np.lexsort((doc, keys["b"], keys["a"]))
        keys, upper, doc = keys[order], upper[order], doc[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        keys, upper, doc = keys[new], upper[new], doc[new]
        bucket = _bucket(upper, buckets)
        order = np.lexsort((doc, bucket))
        keys, bucket, doc = keys[order], bucket[order], doc[order]
        names, at = _by_bucket(bucket)
        rows = []
        for i, j in itertools.pairwise(at.tolist()):
            ids, ends = _by_bucket(doc[i:j])
            rows.append((keys[i:j].tobytes(), ids.tobytes(), np.diff(ends).astype(np.int32).tobytes()))
        return pa.table({"bucket": pa.array(names.astype(np.int64)), "gid": pa.array([key[0].as_py()] * len(names), pa.int64()), **{n: pa.array([r[k] for r in rows], pa.binary()) for k, n in enumerate(("keys", "ids", "counts"))}})

    return run


def _earlier(table: pa.Table) -> pa.Table:
    """A bucket's answer to each group: those of its windows that a document with a smaller doc_id has in another group."""
    gids = table.column("gid").to_pylist()
    keys = [np.frombuffer(x.as_py(), _KEY) for x in table.column("keys")]
    doc = np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(n.as_py(), np.int32)) for i, n in zip(table.column("ids"), table.column("counts"), strict=True)])
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) for x in keys])
    key = np.concatenate(keys)
    order = np.lexsort((doc, key["b"], key["a"]))
    key, doc, owner = key[order], doc[order], owner[order]
    _, at = _by_bucket(key)
    later = doc > np.repeat(doc[at[:-1]], np.diff(at))
    key, owner = key[later], owner[later]
    order = np.argsort(owner, kind="stable")
    names, at = _by_bucket(owner[order])
    return pa.table({"gid": pa.array([gids[k] for k in names.tolist()], pa.int64()), "keys": pa.array([key[order[i:j]].tobytes() for i, j in itertools.pairwise(at.tolist())], pa.binary())})


def _remove(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A group's documents without the words of repeats."""
    group = _Group(docs, 2)
    keys, _, starts = _window_keys(group)
    owner = np.repeat(np.arange(len(group.ids), dtype=np.int64), np.diff(starts))
    order = np.lexsort((group.ids[owner], keys["b"], keys["a"]))
    ranked = keys[order]
    _, at = _by_bucket(ranked)
    doc = group.ids[owner[order]]
    late = doc > np.repeat(doc[at[:-1]], np.diff(at)) if len(doc) else np.empty(0, bool)
    if answers.num_rows and len(ranked):
        known = np.sort(np.concatenate([np.frombuffer(x, _KEY) for x in answers.column("keys").to_pylist()]), order=("a", "b"))
        # the group's distinct windows that are among the known ones: both are sorted
        distinct = ranked[at[:-1]]
        both = np.concatenate((known, distinct))
        ranks = np.lexsort((both["b"], both["a"]))  # stable: a known key comes before its twin
        both_sorted = both[ranks]
        twin = np.concatenate(([False], both_sorted[1:] == both_sorted[:-1])) & (ranks >= len(known))
        hit = np.zeros(len(distinct), bool)
        hit[ranks[twin] - len(known)] = True
        late |= np.repeat(hit, np.diff(at))
    flagged = np.zeros(len(keys), bool)
    flagged[order] = late
    n_words, n_removed, spans, kept = [], [], [], []
    for k, (lo, hi) in enumerate(group.bounds):
        text = group.data[lo:hi].tobytes()
        n = len(group.words[k][0])
        n_words.append(n)
        begins = np.flatnonzero(flagged[starts[k] : starts[k + 1]])
        if not len(begins):
            n_removed.append(0)
            spans.append([])
            kept.append(b" ".join(text.split()))
            continue
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
        n_removed.append(int(gone.sum()))
        spans.append([{"first": int(i), "end": int(j)} for i, j in turn.reshape(-1, 2)])
        kept.append(b" ".join(itertools.compress(text.split(), ~gone)))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, kind), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first and end of each removed run of words) and kept_text (kept words, one space between)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    groups, buckets = _parts(size, GROUP_BYTES, 1 << 17), _parts(size // 6, BUCKET_ITEMS, 40_000)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long").alias("gid"), F.col("doc_id"), F.col("text"))
    probes = dealt.groupBy("gid").applyInArrow(_probe(buckets), "bucket long, gid long, entries binary")
    hits = stage(probes.groupBy("bucket").applyInArrow(_hits, "gid long, bucket long, hits binary"), "hits")
    windows = dealt.groupBy("gid").cogroup(hits.groupBy("gid")).applyInArrow(_extend(buckets), "bucket long, gid long, keys binary, ids binary, counts binary")
    answers = stage(windows.groupBy("bucket").applyInArrow(_earlier, "gid long, keys binary"), "repeats")
    return dealt.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(_remove, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<first int, end int>>, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
ORACLES: dict[str, str] = {}
