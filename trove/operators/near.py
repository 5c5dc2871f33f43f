"""Near signatures, met by bands and compared in blocks of rows.

Two 64-bit signatures within t agree on one of t + 1 bands, so rows meet by (kind, a band of one signature): no pair is
missed, and each row is sent once a band. Signatures of texts are far from even, a band may be shared by a tenth of all
rows; so a band's rows are dealt into blocks of some BLOCK rows, every two blocks are a group, and a group's rows are
compared by vectors, _TILE at a time. A pair counts where its first common band is, so it is found once and nothing has to
be made distinct. What a group's pairs are reduced to (all pairs, links that span them, the nearest of each row) is decided
inside the group: pairs as such are never dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.signatures import COLOUR_DIFF, COLOUR_MIN, GRAY_MAX, band_cuts, bands

BANDED_MAX = 12  # above it bands are too short to prune, and rows meet by kind
BLOCK = 8192
_TILE = 1 << 18
_KEYS = ["kind", "band", "bits", "i", "j"]


class Block:
    """The rows of one block: signatures h (the banded one) and g, chroma (-1: unknown), and all columns."""

    def __init__(self, rows: pa.Table, h: str, g: str) -> None:
        self.rows, self.n = rows, rows.num_rows
        self.h, self.g = (rows.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in (h, g))
        self.chroma = rows.column("chroma").cast(pa.int64()).fill_null(-1).to_numpy()

    def take(self, order: np.ndarray) -> Block:
        out = object.__new__(Block)
        out.rows, out.n, out.h, out.g, out.chroma = self.rows.take(pa.array(order)), self.n, self.h[order], self.g[order], self.chroma[order]
        return out


def _compatible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """signatures.chroma_compatible on arrays."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    gray = (lo <= GRAY_MAX) & (hi >= COLOUR_MIN)
    far = (hi - lo >= COLOUR_DIFF) & (hi >= np.minimum(lo * 2, 255))
    return (lo < 0) | ~(gray | far)


def hits(x: Block, y: Block, band: int, masks: list[int], h_limit: int, g_limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in x, in y) of near rows whose first common band this is. If y is x, each pair once."""
    coloured = max(x.chroma.max(initial=-1), y.chroma.max(initial=-1)) >= COLOUR_MIN  # else all are compatible
    step = max(1, _TILE // max(y.n, 1))
    for at in range(0, x.n, step):
        lo = at + 1 if y is x else 0
        if lo >= y.n:
            continue
        near = np.flatnonzero(np.bitwise_count(x.g[at : at + step, None] ^ y.g[None, lo:]) <= g_limit)
        i, j = np.divmod(near, y.n - lo)
        i, j = i + at, j + lo
        differ = x.h[i] ^ y.h[j]
        keep = np.bitwise_count(differ) <= h_limit
        if y is x:
            keep &= i < j
        for m in masks[:band]:
            keep &= (differ & np.uint64(m)) != 0
        if coloured:
            keep &= _compatible(x.chroma[i], y.chroma[j])
        yield i[keep], j[keep]


def near(x: DataFrame, y: DataFrame | None, p_limit: int, d_limit: int, found: Callable[[Block, Block, Iterator], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """found(x's block, y's block, their hits) of every group, for rows with kind, phash, dhash, chroma and others; y None: pairs of x itself.

    Rows without a kind or a signature are near to none.
    """
    h, g, h_limit, g_limit = ("phash", "dhash", p_limit, d_limit) if p_limit < d_limit else ("dhash", "phash", d_limit, p_limit)
    banded = h_limit <= BANDED_MAX
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in band_cuts(h_limit)]

    def keyed(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("kind").isNotNull() & F.col("phash").isNotNull() & F.col("dhash").isNotNull())
        each = F.explode(bands(F.col(h), h_limit)) if banded else F.struct(F.lit(0).alias("band"), F.lit(0).cast("long").alias("bits"))
        return df.withColumn("_at", each).select("*", "_at.band", "_at.bits").drop("_at")

    counts = lambda df, n, least=1: df.groupBy("kind", "band", "bits").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least).select("kind", "band", "bits", F.ceil(F.col("rows") / BLOCK).cast("int").alias(n))
    block = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c not in ("kind", "band", "bits")]), F.col(n)).cast("int")
    mates = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = keyed(x)
    own = [*x.columns, "band", "bits"]
    if y is None:
        rows = one.join(counts(one, "m", 2), ["kind", "band", "bits"]).withColumn("k", block(one, "m")).withColumn("t", mates("m"))
        dealt = rows.select(*own, F.least("k", "t").alias("i"), F.greatest("k", "t").alias("j"), (F.col("k") > F.col("t")).alias("right"))
    else:
        two = keyed(y)
        many = counts(one, "m").join(counts(two, "w"), ["kind", "band", "bits"])
        left = one.join(many, ["kind", "band", "bits"]).select(*own, block(one, "m").alias("i"), mates("w").alias("j"), F.lit(False).alias("right"))
        right = two.join(many, ["kind", "band", "bits"]).select(*[c for c in y.columns], "band", "bits", block(two, "w").alias("j"), mates("m").alias("i"), F.lit(True).alias("right"))
        dealt = left.unionByName(right, allowMissingColumns=True)
    self_join = y is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
        side = rows.column("right")
        a = Block(rows.filter(pc.invert(side)), h, g)
        b = a if self_join and i == j else Block(rows.filter(side), h, g)
        if a.n and b.n:
            yield from found(a, b, lambda u, v: hits(u, v, band, masks, h_limit, g_limit))

    spark = x.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *_KEYS).groupBy(*_KEYS).applyInArrow(run, schema)


def _paths(rows: pa.Table) -> list[str | None]:
    return rows.column("path").to_pylist()


def pairs_found(x: Block, y: Block, compared: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of all near items, a before b; the distance is of the first signature."""
    names = _paths(x.rows) if y is x else _paths(x.rows) + _paths(y.rows)
    split = [n.split("/") for n in names]
    rank, last, at = np.empty(len(names), np.int64), None, -1
    for k in sorted(range(len(names)), key=split.__getitem__):
        at += names[k] != last
        last, rank[k] = names[k], at
    text, off = pa.array(names, pa.string()), 0 if y is x else x.n
    px, py = (b.rows.column("phash").to_numpy().astype(np.int64).view(np.uint64) for b in (x, y))
    for i, j in compared(x, y):
        apart = np.bitwise_count(px[i] ^ py[j]).astype(np.int64)
        j = j + off
        keep = rank[i] != rank[j]
        i, j, apart = i[keep], j[keep], apart[keep]
        if len(i):
            swap = rank[i] > rank[j]
            yield pa.RecordBatch.from_arrays([text.take(pa.array(np.where(swap, j, i))), text.take(pa.array(np.where(swap, i, j))), pa.array(apart)], ["a", "b", "distance"])


def join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j in root, in which every row names its component's first one."""
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            return
        i, j, a, b = i[live], j[live], a[live], b[live]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root[:] = up


def links_found(x: Block, y: Block, compared: Callable) -> Iterator[pa.RecordBatch]:
    """(a, b) of ids: links that join what the near pairs join, fewer than there are rows."""
    ids = x.rows.column("id").to_numpy() if y is x else np.concatenate([x.rows.column("id").to_numpy(), y.rows.column("id").to_numpy()])
    root, off = np.arange(len(ids)), 0 if y is x else x.n
    for i, j in compared(x, y):
        join_roots(root, i, j + off)
    joined = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[joined]), pa.array(ids[root[joined]])], ["a", "b"])


def nearest_found(x: Block, y: Block, compared: Callable) -> Iterator[pa.RecordBatch]:
    """(b_id, distance, path, pixels, size) of the nearest x of each y: by distance, then more pixels, then path."""
    names, pixels = _paths(x.rows), x.rows.column("pixels").to_pylist()
    order = sorted(range(x.n), key=lambda k: (pixels[k] is not None, -(pixels[k] or 0), names[k] is not None, (names[k] or "").split("/")))
    x = x.take(np.array(order, np.int64))
    best = np.full(y.n, 65 * x.n, np.int64)
    px, py = (b.rows.column("phash").to_numpy().astype(np.int64).view(np.uint64) for b in (x, y))
    for i, j in compared(x, y):
        np.minimum.at(best, j, np.bitwise_count(px[i] ^ py[j]).astype(np.int64) * x.n + i)
    hit = np.flatnonzero(best < 65 * x.n)
    won = x.rows.take(pa.array(best[hit] % x.n))
    yield from pa.table({"b_id": pa.array(y.rows.column("id").to_numpy()[hit]), "distance": pa.array(best[hit] // x.n)} | {c: won.column(c) for c in ("path", "pixels", "size")}).to_batches()
