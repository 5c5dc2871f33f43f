"""Perceptual signatures, their distance and the tests of likeness, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest distances that count as similar, and the limits of the colour gate.
PHASH_LIMIT = DHASH_LIMIT = 6
GRAY_MAX, COLOUR_MIN, COLOUR_DIFF = 6, 10, 35


def bits(flags: Column) -> Column:
    """An array of up to 64 booleans as a long, the first the lowest bit."""
    return F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def median_hash(vector: Column) -> Column:
    """Bit i: is value i above the median of all?"""
    ranked = F.array_sort(vector)
    n = F.size(vector)
    middle = (F.get(ranked, ((n - 1) / 2).cast("int")).cast("double") + F.get(ranked, (n / 2).cast("int")).cast("double")) / 2
    return F.get(F.transform(F.array(middle), lambda m: bits(F.transform(vector, lambda v: v.cast("double") > m))), F.lit(0))


def gradient_hash(vector: Column) -> Column:
    """Bit i: is value i below the next one? The last value has no bit."""
    n = F.size(vector)
    return bits(F.zip_with(F.slice(vector, F.lit(1), n - 1), F.slice(vector, F.lit(2), n - 1), lambda a, b: a < b))


def mean_chroma(r: Column, g: Column, b: Column) -> Column:
    """Aggregate: whole mean of the spread of the three channels; null without pixels."""
    return F.floor(F.avg(F.greatest(r, g, b) - F.least(r, g, b)))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def chroma_compatible(a: Column, b: Column) -> Column:
    """False for gray against colour and for saturations too far apart; unknown chroma passes."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    gray = (lo <= GRAY_MAX) & (hi >= COLOUR_MIN)
    far = (hi - lo >= COLOUR_DIFF) & (hi >= F.least(lo * 2, F.lit(255)))
    return F.coalesce(~(gray | far), F.lit(True))


def hashes_similar(pa: Column, da: Column, pb: Column, db: Column, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT) -> Column:
    """Both signatures near; a missing second one is not similar."""
    return F.coalesce((distance(pa, pb) <= p_limit) & (distance(da, db) <= d_limit), F.lit(False))


def better_side(a_pixels: Column, a_bytes: Column, b_pixels: Column, b_bytes: Column) -> Column:
    """`a` or `b`: more bytes, then more pixels, then a."""
    return F.when(a_bytes > b_bytes, "a").when(b_bytes > a_bytes, "b").when(b_pixels > a_pixels, "b").otherwise("a")


def band_cuts(threshold: int) -> list[tuple[int, int]]:
    """First bit and end of each of threshold + 1 bands."""
    n = threshold + 1
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def bands(signature: Column, threshold: int) -> Column:
    """Array of (band, bits): two signatures within threshold agree on one of threshold + 1 bands at least."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(signature, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1)).alias("bits")) for i, (lo, hi) in enumerate(band_cuts(threshold))])


def band_pairs(p: Column, d: Column, p_limit: int, d_limit: int) -> Column:
    """Array of hashes of a band of p and a band of d: two pairs of signatures within both limits share one of them at least."""
    return F.flatten(F.transform(bands(p, p_limit), lambda x: F.transform(bands(d, d_limit), lambda y: F.xxhash64(x["band"], x["bits"], y["band"], y["bits"]))))


def simhashes(rows: DataFrame, key: str, tokens: dict[str, Column], n_bits: int = 60) -> DataFrame:
    """key and, for each name of tokens, the SimHash of that array of words by their md5; keys without words have no row.

    Bit i is set where more than half of the words set it. Bits are counted four at a time, in lanes of 16 bits of a
    long, over at most 32768 words, so one pass needs 16 sums a signature, added up before anything is shuffled. The
    arrays have equal lengths.
    """
    lanes, mask = range(16), 0x0001000100010001
    word = F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in tokens.items()])).alias("pos", "w")
    hashed = rows.select(key, word).select(key, F.shiftright("pos", 15).alias("part"), *[F.conv(F.substring(F.md5(f"w.{n}"), 1, 15), 16, 10).cast("long").alias(n) for n in tokens])
    sums = hashed.groupBy(key, "part").agg(F.count("*").alias("words"), *[F.sum(F.shiftright(n, i).bitwiseAND(F.lit(mask))).alias(f"{n}_{i}") for n in tokens for i in lanes])
    counts = lambda n: F.array(*[F.shiftright(f"{n}_{i % 16}", 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(n_bits)])
    parts = sums.groupBy(key).agg(F.sum("words").alias("words"), *[F.collect_list(counts(n)).alias(n) for n in tokens])  # a part for each 32768 words

    def joined(n: str) -> Column:
        total = F.aggregate(F.slice(n, F.lit(2), F.size(n)), F.get(n, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        return F.aggregate(F.transform(total, lambda c, i: F.when(c * 2 > F.col("words"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

    return parts.select(key, *[joined(n).alias(n) for n in tokens])
