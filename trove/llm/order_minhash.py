"""Near-dedup by Order MinHash, verified by banded alignment.

A document's k-mers are its five-word shingles, each labelled by its occurrence, so that repeats count. For each of
SKETCHES hash functions the ELL labelled k-mers of least hash are taken and kept in the order in which they stand in the
text; the hash of that sequence is a bucket. Documents that share a bucket are candidates: the chance rises with edit
similarity, not only with the overlap of sets.

A candidate pair is a near copy if an alignment of its words inside a diagonal band, whose width follows from SIMILARITY,
needs at most 1 - SIMILARITY edits for each word of the longer text. The alignment alone decides. It is the bit-parallel
form of the banded edit distance, and is not begun where the words that both texts have are too few for it to succeed (an
edit changes one word, so this bound is exact). Counts of words by hash, BINS bytes a text, tell the same more weakly and
spare most pairs that are not similar the way of their texts to a task. Candidates beyond a bucket's hubs (see clusters.py)
are compared by these counts in blocks of their bucket; where they leave partners, their texts are sent to the block, which
counts words more finely and aligns what is left, but not what its links connect already.

Equal word sequences are one class from the start. Classes are the components of the verified links. A document gets the
smallest doc_id of its class as class id.

Recall of the candidates: on the 10,000 documents of the test tables 0.99 of all pairs with an edit similarity of 0.8 or
more share a bucket (tests/llm measures it on a planted corpus).

Defined cases: documents of fewer than five words are shingled as one whole; documents without words (null text too)
are one class of equals in the class table, and are all kept by first_of_each; repeated rows share a class; ties in hash
are broken by place; a null doc_id is never a class id unless all ids of the class are null; very long texts are taken
whole; the rows are read again, by a hash of the text, where texts are needed; an empty table gives an empty result; other columns pass through first_of_each, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trove.llm.clusters import SALT_ROWS, resolve
from trove.llm.common import SPACE_CHARS, chain, discard, hash_words, mix, stage, text_bytes, window_hashes

SHINGLE, SIMILARITY, SKETCHES, ELL = 5, 0.8, 16, 2
BROADCAST_IDS = 200_000  # contents of candidates that are sent to all executors, 16 bytes each; more are joined
SALTS, BINS = 16, 256
_AT_ONCE = 1 << 20  # ranks that are held at a time
BLOCK_ROWS = 400  # members of a bucket in one block; larger buckets are compared block by block
BLOCK_WORDS = 400_000  # words in one block, 8 bytes each
GROUP_ROWS, FINE_BINS = 1000, 4096  # rows of blocks that a Python worker takes at a time; finer counts, taken there
_ROWS = 64  # documents at a time in a Python worker; verification holds as many pairs
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's shingles; a shorter text is one shingle."""
    return window_hashes(words, size) if len(words) >= size else window_hashes(words, len(words)) if len(words) else words


def occurrences(grams: np.ndarray) -> np.ndarray:
    """Which occurrence of its value each element is, from 0."""
    if not len(grams):
        return grams
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    out = np.zeros(len(grams), np.uint64)
    if not new.all():
        place = np.arange(len(grams))
        out[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return out


def label(values: np.ndarray) -> np.ndarray:
    """The values with their occurrences: distinct hashes."""
    return chain(occurrences(values), values)


relabel = label  # under a name that columns do not take


def sketch(grams: np.ndarray, seeds: np.ndarray = _SEEDS, ell: int = ELL) -> np.ndarray:
    """One bucket for each seed: the hash of the ell labelled k-mers of least hash, in text order."""
    if not len(grams):
        return np.empty(0, np.uint64)
    labelled = label(grams)
    ell = min(ell, len(labelled))
    out = seeds.copy()
    step = max(1, _AT_ONCE // len(labelled))
    for at in range(0, len(seeds), step):
        ranks = (labelled ^ seeds[at : at + step, None]) * np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(32)
        least = np.argpartition(ranks, ell - 1, axis=1)[:, :ell]
        least.sort(axis=1)
        for k in range(ell):
            out[at : at + step] = chain(out[at : at + step], labelled[least[:, k]])
    return mix(out + seeds)


def _documents(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """Word hashes and bytes of each text."""
    data, offsets = text_bytes(texts)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        yield hash_words(data[lo:hi])[2][0], data[lo:hi].tobytes()


def content_of(text: bytes) -> bytes:
    return blake2b(b" ".join(text.split()), digest_size=16).digest()


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, key, content, n_words, bins, buckets); key and content are 128-bit hashes of the text and of its words themselves, in order."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            key, content, size, bins, found = [], [], [], [], []
            for words, text in _documents(part.column(1)):
                key.append(md5(text, usedforsecurity=False).digest())
                content.append(content_of(text))
                size.append(len(words))
                bins.append(np.minimum(np.bincount((words >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes())
                found.append(sketch(shingles(words)).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.binary()), pa.array(content, pa.binary()), pa.array(size, pa.int32()), pa.array(bins, pa.binary()), lists], ["doc_id", "key", "content", "n_words", "bins", "buckets"])


def edit_distance_within(a: list[int], b: list[int], limit: int) -> int | None:
    """Edit distance of two sequences if it is at most limit, else None.

    Only a band of 2 * limit + 1 diagonals is computed. The differences between neighbouring cells of a row are two bit
    vectors as wide as the band, which slides by one cell a row.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    if not b:
        return len(a)
    limit = min(limit, len(a))
    # bit i of a row's vectors stands for column row - limit + i of a; b's tokens are the rows
    width = 2 * limit + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << (i + limit))  # shifted, so that columns before the first are bits too
    plus, minus = full & ~((1 << limit) - 1), 0
    score, n, cut = limit, len(a), len(b)
    plus = full << limit & full
    for row in range(cut):
        same = at.get(b[row], 0) >> row & full
        zero = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | ~(zero | plus)
        down = zero & plus
        # the diagonal at the band's upper end is followed until it meets the last column
        if row + limit < n:
            score += 0 if zero & top else 1
        else:
            bit = 1 << (n - 1 - row + limit)
            score += 1 if up & bit else -1 if down & bit else 0
        zero_next = zero >> 1
        plus, minus = (down | ~(zero_next | up)) & full, zero_next & up & full
    return score if score <= limit else None


def similar(a: np.ndarray, b: np.ndarray, labelled_a: np.ndarray, labelled_b: np.ndarray, least: float = SIMILARITY) -> bool:
    """The test of a candidate pair, on word hashes in order and on labelled ones."""
    high = max(len(a), len(b))
    limit = int((1 - least) * high + 1e-9)
    if high - min(len(a), len(b)) > limit or high - len(np.intersect1d(labelled_a, labelled_b, assume_unique=True)) > limit:
        return False
    return edit_distance_within(a.tolist(), b.tolist(), limit) is not None


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (content, words): the hashes of its words, eight bytes each."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            found = [(content_of(text), words.tobytes()) for words, text in _documents(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found, strict=True)], ["content", "words"])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _fine(words: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((words >> np.uint64(52)).astype(np.int64), minlength=FINE_BINS), 255).astype(np.uint8)


def _blocks(rows: pa.Table) -> pa.Table:
    """(bucket, low, high, block, id, size, label, bins, buckets[, words]) to what may be similar across labels.

    A cell holds blocks low and high of a bucket; a pair is looked at in the bucket of the first sketch that both share.
    Without words: the (bucket, id) that have a partner by their counts. With words: verified links (a, b), but none
    between what links of the cell connect already.
    """
    cell = np.stack([rows.column(k).to_numpy() for k in ("bucket", "low", "high")])
    size, block = rows.column("size").to_numpy(), rows.column("block").to_numpy()
    order = np.lexsort((size, *cell[::-1]))
    cell, size, block = cell[:, order], size[order], block[order]
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    bins = _matrix(rows.column("bins"), BINS)[order]
    counted = bins.sum(axis=1, dtype=np.int64)
    sketches = rows.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)[order]
    words = [np.frombuffer(w, np.uint64) for w in rows.column("words").take(pa.array(order)).to_pylist()] if "words" in rows.column_names else None
    cuts = np.flatnonzero(np.concatenate(([True], (cell[:, 1:] != cell[:, :-1]).any(axis=0), [True])))
    found, links = np.zeros(len(order), bool), []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        bucket, low, high = cell[:, lo].tolist()
        ends = lo + np.searchsorted(size[lo:hi], (size[lo:hi] + 1e-6) / SIMILARITY, "right")
        fine, up, labelled = None, {}, {}

        def root(x):  # noqa: ANN001, ANN202
            while (above := up.setdefault(x, x)) != x:  # noqa: B023
                up[x] = x = up[above]  # noqa: B023
            return x

        for i in range(lo, hi - 1):
            other = label[i + 1 : ends[i - lo]] != label[i]
            if low != high:
                other &= block[i + 1 : ends[i - lo]] != block[i]
            at = i + 1 + np.flatnonzero(other)
            limit = 2 * np.floor((1 - SIMILARITY) * size[at] + 1e-9)
            near = counted[i] + counted[at] - 2 * np.minimum(bins[at], bins[i]).sum(axis=1, dtype=np.int64) <= limit
            at, limit = at[near], limit[near]
            if not len(at):
                continue
            first = (sketches[at] == sketches[i]).argmax(axis=1)
            here = (sketches[at, first] == sketches[i, first]) & (sketches[i, first] == bucket)
            at, limit = at[here], limit[here]
            if words is None:
                found[at] = True
                found[i] |= bool(len(at))
                continue
            if fine is None:
                fine = np.stack([_fine(w) for w in words[lo:hi]])
                total = fine.sum(axis=1, dtype=np.int64)
            at = at[total[i - lo] + total[at - lo] - 2 * np.minimum(fine[at - lo], fine[i - lo]).sum(axis=1, dtype=np.int64) <= limit]
            for k in at.tolist():
                x, y = root(int(label[i])), root(int(label[k]))
                if x != y:
                    one, two = (labelled[m] if m in labelled else labelled.setdefault(m, relabel(words[m])) for m in (i, k))
                    if similar(words[i], words[k], one, two):
                        links.append((i, k))
                        up[max(x, y)] = min(x, y)
    ids = rows.column("id").combine_chunks().take(pa.array(order))
    if words is None:
        return pa.table({"bucket": pa.array(cell[0][found]), "id": ids.filter(pa.array(found))})
    a, b = (ids.take(pa.array([x[k] for x in links], pa.int64())) for k in (0, 1))
    return pa.table({"a": a, "b": b})


def _could_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_a, n_b, bins_a, bins_b) to the (a, b) that their counts allow: an edit changes two counts by one at most."""
    for part in batches:
        n = part.num_rows
        x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(n, BINS).astype(np.int16) for k in (4, 5))
        high = np.maximum(part.column(2).to_numpy(), part.column(3).to_numpy())
        yield part.select([0, 1]).filter(pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) <= 2 * np.floor((1 - SIMILARITY) * high + 1e-9)))


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, words_a, words_b) to the similar (a, b); a's words are kept while it stays the same."""
    last, words, labelled = None, np.empty(0, np.uint64), np.empty(0, np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            keep = []
            for a, one, two in zip(part.column(0).to_pylist(), part.column(2), part.column(3), strict=True):
                if a != last:
                    last, words = a, np.frombuffer(one.as_py(), np.uint64)
                    labelled = label(words)
                other = np.frombuffer(two.as_py(), np.uint64)
                keep.append(similar(words, other, labelled, label(other)))
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def text_key() -> Column:
    """128 bits that tell texts apart, as _sketch_batches has them."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, key, content and n_words; every content's label and class_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(_sketch_batches, f"doc_id {kind}, key binary, content binary, n_words int, bins binary, buckets array<long>")
    made = stage(made, "sketches")
    members = stage(made.groupBy("content").agg(F.min("key").alias("key"), F.min("doc_id").alias("first_id"), F.max("n_words").alias("n_words"), F.first("bins").alias("bins"), F.first("buckets").alias("buckets")), "contents")
    buckets = members.filter("n_words > 0").select(F.col("content").alias("id"), F.col("n_words").alias("size"), F.explode("buckets").alias("bucket"))

    scratch: list[DataFrame] = []

    def clean() -> None:
        discard(*scratch)
        scratch.clear()

    def words_of(ids: DataFrame) -> DataFrame:
        """content and words of some contents."""
        ids = stage(members.select("content", "key").join(ids, "content", "left_semi").select("key"), "asked")
        small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # the size is known to be small
        found = docs.select(text_key().alias("key"), "text").join(F.broadcast(ids) if small else ids, "key", "left_semi").dropDuplicates(["key"])
        scratch.extend((ids, stage(found.select("text").mapInArrow(_word_batches, "content binary, words binary"), "words")))
        return scratch[-1]

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs of one content are dealt over tasks, SALT_ROWS each."""
        of = lambda s: members.select(F.col("content").alias(s), F.col("n_words").alias(f"n_{s}"), F.col("bins").alias(f"bins_{s}"))
        could = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
        pairs = stage(could.mapInArrow(_could_batches, "a binary, b binary"), "pairs")
        scratch.append(pairs)
        one = words_of(pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct())
        often = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
        left = one.withColumnsRenamed({"content": "a", "words": "words_a"}).join(often, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        full = pairs.join(often, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts").cast("int")).join(one.withColumnsRenamed({"content": "b", "words": "words_b"}), "b").join(left, ["a", "salt"])
        return full.select("a", "b", "words_a", "words_b").mapInArrow(_verify_batches, "a binary, b binary")

    def cells(rest: DataFrame, facts: DataFrame) -> DataFrame:
        """rest with facts, grouped; a large bucket is dealt into blocks, and each two of these meet in a cell."""
        many = rest.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_WORDS)).cast("int").alias("blocks"))
        rows, words = rest.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
        groups = rows // GROUP_ROWS + words // BLOCK_WORDS + 1
        dealt = rest.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("beside", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"low": F.least("block", "beside"), "high": F.greatest("block", "beside")}).drop("blocks", "beside").join(facts, "id")
        return dealt.groupBy(F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(groups)))

    def meet(rest: DataFrame) -> DataFrame:
        """The links of what is left: blocks are first compared by counts of words, then the texts that have a partner by these are sent."""
        facts = members.select(F.col("content").alias("id"), "bins", "buckets")
        some = cells(rest, facts).applyInArrow(_blocks, "bucket long, id binary").distinct()
        some = stage(rest.join(some, ["bucket", "id"], "left_semi"), "partners")
        words = words_of(some.select(F.col("id").alias("content")).distinct()).withColumnRenamed("content", "id")
        scratch.append(some)
        return cells(some, facts.join(words, "id")).applyInArrow(_blocks, "a binary, b binary")

    labels, _ = resolve(buckets, verify, SIMILARITY, [], lambda x, y: F.lit(0), clean, meet)
    named = stage(members.join(labels.withColumnRenamed("id", "content"), "content", "left").select("content", "first_id", F.coalesce("label", "content").alias("label")), "labelled")
    # the members of a large class are dealt over SALTS tasks
    salt = F.pmod(F.xxhash64("content"), F.lit(SALTS)).cast("int")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("least"), F.count("*").alias("n")).filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("n")
    joined = named.withColumn("salt", salt).join(smallest.withColumn("many", F.lit(True)), ["label", "salt"], "left")
    return made.select("doc_id", "key", "content", "n_words"), joined.select("content", "label", F.when(F.col("many"), F.col("least")).otherwise(F.col("first_id")).alias("class_id"))


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row."""
    rows, named = _classes(docs)
    return rows.join(named, "content").select("doc_id", "class_id")


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id (among rows of one id and text, one). Rows without words stay."""
    rows, named = _classes(docs)
    first = rows.filter("n_words > 0").join(named, "content").groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    first = stage(first.select(F.col("doc_id").alias("first_id"), F.col("key").alias("first_key")).distinct(), "firsts")
    wide = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_key().alias("key"), (F.translate(F.coalesce("text", F.lit("")), SPACE_CHARS, "") == "").alias("blank"))
    kept = wide.filter("not blank").join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    one = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(1)))).filter("n = 1").select("row")
    return one.unionByName(wide.filter("blank").select("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
ORACLES: dict[str, str] = {}
