"""Groups of equal items and the choice of the one to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.functions.hashes import verdict
from trove.functions.paths import name_length, parts
from trove.operators.graph import components


def keeper_order() -> list[Column]:
    """Dated first, then the larger, the shorter name, the path."""
    return [F.col("dated").desc(), F.col("size").desc(), name_length(F.col("path")), parts(F.col("path"))]


def leader_order() -> list[Column]:
    return [name_length(F.col("path")), parts(F.col("path"))]


def exact_extra_order() -> list[Column]:
    """Bytes, pixels, path."""
    return [F.col("size").desc(), F.col("pixels").desc(), parts(F.col("path"))]


def find_duplicates(files: DataFrame, key: Column) -> DataFrame:
    """(key, path) of all files whose key two or more share."""
    keyed = files.withColumn("key", key)
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return keyed.join(many, "key").select("key", "path", "n")


def rank_in(files: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return files.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def content_groups(files: DataFrame) -> DataFrame:
    """files with group (a content class): equal by bytes, payload or pixels, inside one (shallow, decoded) bucket.

    Each class of equal evidence is compared, not each file. Equality by any layer is joined into components, which
    equals comparing with each group's leader wherever evidence is consistent.
    """
    keys = ["shallow", "decoded", "bytes_hash", "payload_hash", "pixel_hash", "video"]
    classes = files.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("id", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]))
    one, two = classes.alias("x"), classes.alias("y")
    col = lambda s: lambda c: F.col(f"{s}.{c}")
    near = (F.col("x.shallow") == F.col("y.shallow")) & (F.col("x.decoded") == F.col("y.decoded")) & (F.col("x.id") < F.col("y.id"))
    links = one.join(two, near).filter(verdict(col("x"), col("y")) == "same").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    labels = components(links)
    named = classes.join(labels, "id", "left").select(*keys, F.coalesce("label", "id").alias("group"))
    match = F.lit(True)
    for k in keys:
        match &= F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}"))
    return files.alias("f").join(named.alias("c"), match).select("f.*", "c.group")


def confirmed_groups(files: DataFrame) -> DataFrame:
    """content_groups with rank (1: the keeper) and keeper (its path). Keepers come from an aggregate, ranks from a window of the group."""
    grouped = rank_in(content_groups(files), ["group"], keeper_order())
    best = F.min_by("path", F.struct((~F.col("dated")).alias("u"), (-F.col("size")).alias("s"), name_length(F.col("path")).alias("l"), parts(F.col("path")).alias("p")))
    keepers = grouped.groupBy("group").agg(best.alias("keeper"), F.count("*").alias("members"))
    return grouped.join(keepers, "group")


def exact_extras(files: DataFrame) -> DataFrame:
    """(keeper, path): extra copies by short, then full hash; the keeper is the largest, by bytes and pixels."""
    decoded = files.filter("decoded and payload_hash is not null")
    best = F.min_by("path", F.struct((-F.col("size")).alias("s"), (-F.col("pixels")).alias("x"), parts(F.col("path")).alias("p")))
    keepers = decoded.groupBy("shallow", "payload_hash").agg(best.alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return decoded.join(keepers, ["shallow", "payload_hash"]).filter("path <> keeper").select("keeper", "path")


def merge_flat(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """path, action (keep or drop) of two flat folders' files: of each group of one key the larger stays, then the shorter name, then the first."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).withColumn("key", key)
    order = F.struct((-F.col("size")).alias("s"), name_length(F.col("path")).alias("l"), "side", parts(F.col("path")).alias("p"))
    best = both.groupBy(F.col("key").alias("k")).agg(F.min(order).alias("best"))  # summed up before it is dealt: a group of many copies is no hot spot
    return both.withColumn("order", order).join(best, F.col("key").eqNullSafe(F.col("k"))).select("path", "key", F.when(F.col("order") == F.col("best"), "keep").otherwise("drop").alias("action"))
