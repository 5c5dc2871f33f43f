"""Comparing trees: by short hash, with proof of pairs, and over many sets.

Catalog columns: tree, path, shallow, decoded; for proof also bytes_hash, payload_hash, pixel_hash (the last two null
where the item can't be decoded) and video.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.functions.hashes import reason, verdict
from trove.functions.paths import parts

EVIDENCE = ("bytes_hash", "payload_hash", "pixel_hash", "video")


def scan_stats(files: DataFrame) -> DataFrame:
    """Files and unreadable ones of each tree."""
    return files.groupBy("tree").agg(F.count("*").alias("files"), F.count_if(~F.col("decoded")).alias("unreadable"))


def compare_trees(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, path, shallow, category of every file: duplicate, a_only, b_only, or unreadable (of b; a's are left out)."""
    both = a.filter("decoded").select(F.lit("a").alias("side"), "path", "shallow").unionByName(b.filter("decoded").select(F.lit("b").alias("side"), "path", "shallow"))
    sides = both.groupBy("shallow").agg(F.max((F.col("side") == "a").cast("int")).alias("in_a"), F.max((F.col("side") == "b").cast("int")).alias("in_b"))
    kind = F.when(F.col("in_a") + F.col("in_b") == 2, "duplicate").otherwise(F.concat("side", F.lit("_only")))
    found = both.join(sides, "shallow").select("side", "path", "shallow", kind.alias("category"))
    return found.unionByName(b.filter("not decoded").select(F.lit("b").alias("side"), "path", "shallow", F.lit("unreadable").alias("category")))


def duplicate_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each hash that both trees hold: counts and first paths; members are compare_trees' duplicates."""
    first = lambda side: F.array_join(F.min(F.when(F.col("side") == side, parts(F.col("path")))), "/")
    found = compare_trees(a, b).filter(F.col("category") == "duplicate")
    return found.groupBy("shallow").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"), first("a").alias("first_a"), first("b").alias("first_b"))


def compare_sets(a: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each candidate tree: files, duplicates (in a), unique, shared (in another candidate), unreadable."""
    hashes = a.filter("decoded").select("shallow").distinct().withColumn("in_a", F.lit(True))
    spread = candidates.filter("decoded").select("tree", "shallow").distinct().groupBy("shallow").agg(F.count("*").alias("trees"))
    marked = candidates.join(hashes, "shallow", "left").join(spread, "shallow", "left")
    fresh = F.col("decoded") & F.col("in_a").isNull()
    return marked.groupBy("tree").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("decoded") & F.col("in_a").isNotNull()).alias("duplicates"),
        F.count_if(fresh & (F.col("trees") == 1)).alias("only_here"),
        F.count_if(fresh & (F.col("trees") > 1)).alias("shared"),
        F.count_if(~F.col("decoded")).alias("unreadable"),
    )


def unique_in_a(a: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many distinct hashes of a no candidate holds."""
    return a.filter("decoded").select("shallow").distinct().join(candidates.filter("decoded").select("shallow"), "shallow", "left_anti").agg(F.count("*").alias("a_unique"))


def set_totals(counts: DataFrame) -> DataFrame:
    """All candidates together, from compare_sets."""
    return counts.agg(F.sum("duplicates").alias("duplicates"), F.sum(F.col("files") - F.col("duplicates") - F.col("unreadable")).alias("candidates_only"))


def in_other_tree(files: DataFrame, other: DataFrame) -> DataFrame:
    """Files whose hash the other tree holds, each once."""
    return files.filter("decoded").join(other.filter("decoded").select("shallow").distinct(), "shallow", "left_semi")


def not_in_others(files: DataFrame, *others: DataFrame) -> DataFrame:
    """Files whose hash no other tree holds, each once."""
    out = files.filter("decoded")
    for o in others:
        out = out.join(o.filter("decoded").select("shallow"), "shallow", "left_anti")
    return out


def nominated_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): all pairs of one short hash. As many as the two sides' product in each bucket; deep_scan does without them."""
    return a.filter("decoded").select("shallow", F.col("path").alias("a")).join(b.filter("decoded").select("shallow", F.col("path").alias("b")), "shallow").select("a", "b")


def prove_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """(a, b, verdict, reason) of given pairs, evidence from files."""
    side = lambda s: files.select(F.col("path").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in EVIDENCE])
    col = lambda s: lambda c: F.col(f"{s}_{c}")
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", verdict(col("a"), col("b")).alias("verdict"), reason(col("a"), col("b")).alias("reason"))


def class_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The nominated pairs of classes of equal evidence: verdict, sizes, first a. Copies are one class, so their pairs are not formed."""

    def classes(files: DataFrame, s: str) -> DataFrame:
        first = F.array_join(F.min(parts(F.col("path"))), "/").alias(f"{s}_first")
        return files.filter("decoded").groupBy("shallow", *EVIDENCE).agg(F.count("*").alias(f"{s}_n"), first).select("shallow", *[F.col(c).alias(f"{s}_{c}") for c in EVIDENCE], f"{s}_n", f"{s}_first")

    col = lambda s: lambda c: F.col(f"{s}_{c}")
    return classes(a, "a").join(classes(b, "b"), "shallow").withColumn("verdict", verdict(col("a"), col("b")))


def _b_classes(pairs: DataFrame) -> DataFrame:
    same = F.col("verdict") == "same"
    keys = ["shallow", *[f"b_{c}" for c in EVIDENCE]]
    return pairs.groupBy(*keys).agg(
        F.max("b_n").alias("b_n"),
        F.coalesce(F.sum(F.when(same, F.col("a_n"))), F.lit(0)).alias("kept"),
        F.coalesce(F.sum(F.when(~same, F.col("a_n"))), F.lit(0)).alias("lost"),
        F.array_join(F.min(F.when(same, parts(F.col("a_first")))), "/").alias("keeper"),
    )


def deep_scan_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """checked, kept, covered, removed pairs: a pair that fails is covered if its b is proven by another."""
    per = _b_classes(class_pairs(a, b))
    proven = F.col("kept") > 0
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(
        total((F.col("kept") + F.col("lost")) * F.col("b_n")).alias("checked"),
        total(F.col("kept") * F.col("b_n")).alias("kept"),
        total(F.when(proven, F.col("lost") * F.col("b_n"))).alias("covered"),
        total(F.when(~proven, F.col("lost") * F.col("b_n"))).alias("removed"),
    )


def _of_classes(b: DataFrame, per: DataFrame) -> DataFrame:
    """b's files with the columns of their class."""
    match = (F.col("shallow") == F.col("k_shallow")) & F.col("video").eqNullSafe(F.col("b_video"))
    for c in EVIDENCE[:3]:
        match &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return b.filter("decoded").join(per.withColumnRenamed("shallow", "k_shallow"), match)


def confirmed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): each proven b once, with the first a that proves it."""
    return _of_classes(b, _b_classes(class_pairs(a, b)).filter("kept > 0")).select(F.col("keeper").alias("a"), F.col("path").alias("b"))


def removed_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """(b, candidates): b's files that share a short hash with files of a, so many of them, none of which proves them. A row a file."""
    return _of_classes(b, _b_classes(class_pairs(a, b)).filter("kept = 0")).select(F.col("path").alias("b"), F.col("lost").alias("candidates"))


def removed_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, reason): every pair of a b that no a proves. As many as the product in each bucket; removed_files does without them."""
    open_b = b.join(confirmed(a, b).select(F.col("b").alias("path")), "path", "left_anti")
    pairs = nominated_pairs(a, open_b)
    return prove_pairs(pairs, a.unionByName(b)).select("a", "b", "reason")


def originals(compared: DataFrame, dated: DataFrame) -> DataFrame:
    """b's own files and its unreadable ones that have a date, each once. dated: (path, capture_date)."""
    own = compared.filter(F.col("category") == "b_only").select("path")
    rescued = compared.filter(F.col("category") == "unreadable").join(dated.filter("capture_date is not null").select("path"), "path", "left_semi").select("path")
    return own.union(rescued).distinct()


def promoted(originals_: DataFrame, removed: DataFrame) -> DataFrame:
    """Originals and the b of removed files or pairs, each once."""
    return originals_.union(removed.select(F.col("b").alias("path"))).distinct()
