"""Similar items by two 64-bit signatures within a Hamming distance.

Item columns: path, kind (family; null ones are left out), phash, dhash, chroma (may be null), pixels, size; for exact
copies also shallow, decoded, payload_hash. Near signatures are met by bands and compared in blocks (see near.py); groups
and best matches compare signature classes, not items. Items are used more than once: give a stored table, whose
signatures are computed (see layers.fill).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.paths import parts
from trove.functions.signatures import DHASH_LIMIT, PHASH_LIMIT, better_side, distance
from trove.operators.duplicates import exact_extras
from trove.operators.graph import components
from trove.operators.near import links_found, near, nearest_found, pairs_found

SIGNATURE = ("kind", "phash", "dhash", "chroma")


def signature_classes(items: DataFrame) -> DataFrame:
    """The distinct signatures, with id: items that share one are compared once."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in SIGNATURE])
    return items.filter("kind is not null").select(*SIGNATURE).distinct().withColumn("id", key)


def class_id() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in SIGNATURE])


def similar_links(classes: DataFrame, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT) -> DataFrame:
    """(a, b) of ids of similar signature classes: not all pairs, but links that connect what they connect."""
    return near(classes.select(*SIGNATURE, "id"), None, p_limit, d_limit, links_found, "a long, b long")


def similar_pairs(items: DataFrame, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT) -> DataFrame:
    """(a, b, distance) of all similar pairs of one set, a before b."""
    named = items.filter("path is not null").select("path", *SIGNATURE)
    return near(named, None, p_limit, d_limit, pairs_found, "a string, b string, distance long")


def similar_groups(items: DataFrame, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT) -> DataFrame:
    """keeper, path, distance (to the keeper), size, pixels of every member but the keeper, exact extras left out.

    Groups are single-linkage components; the keeper is the largest by bytes, pixels, smallest path.
    """
    extras = exact_extras(items)
    rest = items.join(extras.select("path"), "path", "left_anti").filter("kind is not null").withColumn("id", class_id())
    links = similar_links(signature_classes(rest), p_limit, d_limit)
    labelled = rest.join(components(links), "id", "left").withColumn("group", F.coalesce("label", "id"))
    # items of one signature are a group, unless its second signature is missing: then they are not similar
    alone = F.when(F.col("dhash").isNull(), F.xxhash64("path")).otherwise(F.col("group"))
    labelled = labelled.withColumn("group", alone)
    best = F.min_by(F.struct("path", "phash"), F.struct((-F.col("size")).alias("s"), (-F.col("pixels")).alias("x"), parts(F.col("path")).alias("p")))
    keepers = labelled.groupBy("group").agg(best.alias("best"), F.count("*").alias("n")).filter("n > 1")
    members = labelled.join(keepers, "group").filter(F.col("path") != F.col("best.path"))
    return members.select(F.col("best.path").alias("keeper"), "path", distance(F.col("best.phash"), F.col("phash")).alias("distance"), "size", "pixels")


def exact_between(a: DataFrame, b: DataFrame) -> DataFrame:
    """(keeper, path): b's files equal in full to the first a of their short hash. A later a of that hash is not asked."""
    first = F.min_by(F.struct("path", "payload_hash"), parts(F.col("path")))
    lookup = a.filter("decoded and kind is not null").groupBy("shallow").agg(first.alias("first"))
    found = b.filter("decoded and kind is not null").join(lookup, "shallow").filter(F.col("payload_hash") == F.col("first.payload_hash"))
    return found.select(F.col("first.path").alias("keeper"), "path")


def best_matches(a: DataFrame, b: DataFrame, p_limit: int = PHASH_LIMIT, d_limit: int = DHASH_LIMIT) -> DataFrame:
    """For each b that is no exact copy its nearest a: by distance, then more pixels, then a's order; and which is better."""
    rest = b.join(exact_between(a, b).select("path"), "path", "left_anti").filter("kind is not null").withColumn("b_id", class_id())
    # of an a-class only its best item can win
    first = F.struct((-F.col("pixels")).alias("x"), parts(F.col("path")).alias("p"), F.col("path"), F.col("pixels"), F.col("size"))
    ac = a.filter("kind is not null").groupBy(*SIGNATURE).agg(F.min(first).alias("top")).select(*SIGNATURE, "top.path", "top.pixels", "top.size")
    kind = {c: a.schema[c].dataType.simpleString() for c in ("path", "pixels", "size")}
    found = near(ac, signature_classes(rest), p_limit, d_limit, nearest_found, f"b_id long, distance long, path {kind['path']}, pixels {kind['pixels']}, size {kind['size']}")
    nearest = found.groupBy("b_id").agg(F.min(F.struct("distance", (-F.col("pixels")).alias("x"), parts(F.col("path")).alias("p"), "path", "pixels", "size")).alias("best"))
    out = rest.join(nearest, "b_id").select(F.col("best.path").alias("a"), F.col("path").alias("b"), F.col("best.distance").alias("distance"), F.col("best.pixels").alias("a_pixels"), F.col("pixels").alias("b_pixels"), F.col("best.size").alias("a_bytes"), F.col("size").alias("b_bytes"))
    side = better_side(F.col("a_pixels"), F.col("a_bytes"), F.col("b_pixels"), F.col("b_bytes"))
    return out.withColumns({"a_is_better": side == "a", "b_is_better": side == "b", "removable": side == "a"})
