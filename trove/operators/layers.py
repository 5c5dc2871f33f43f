"""The layer store: what has been computed for each item, valid while its size and time stay.

A store is a table (volume, rel_path, size, modified, layers...); a layer that has not been computed is null. A resolved
but unknown date is date_resolved with a null capture_date, and a hit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("volume", "rel_path")
LAYERS = ("shallow", "bytes_hash", "content_hash", "pixel_hash", "phash", "chroma", "dhash", "date_resolved", "capture_date")


def lookup(files: DataFrame, store: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """files (volume, rel_path, size, modified) with their layers where an entry is still valid, else nulls."""
    held = store.select(*KEY, F.col("size").alias("s_size"), F.col("modified").alias("s_modified"), *layers)
    joined = files.join(held, list(KEY), "left")
    valid = (F.col("size") == F.col("s_size")) & F.col("modified").eqNullSafe(F.col("s_modified"))
    return joined.select(*files.columns, valid.isNotNull().alias("known"), F.coalesce(valid, F.lit(False)).alias("valid"), *[F.when(valid, F.col(c)).alias(c) for c in layers])


def reuse_counts(looked_up: DataFrame, layer: str) -> DataFrame:
    """How many items have a layer already and how many need it computed."""
    return looked_up.agg(F.count_if(F.col(layer).isNotNull()).alias("reused"), F.count_if(F.col(layer).isNull()).alias("computed"))


def reuse_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What one request added to the counters: after less before."""
    names = ("reused", "computed")
    return after.select(*[F.col(c).alias(f"n_{c}") for c in names]).join(F.broadcast(before.select(*names))).select(*[(F.col(f"n_{c}") - F.col(c)).alias(c) for c in names])  # one row each


def fill(looked_up: DataFrame, layer: str, compute) -> DataFrame:  # noqa: ANN001
    """Compute a layer for the rows that lack it only: compute gets and gives a DataFrame."""
    have, lack = looked_up.filter(F.col(layer).isNotNull()), looked_up.filter(F.col(layer).isNull())
    return have.unionByName(compute(lack).select(*looked_up.columns))


def upsert(store: DataFrame, fresh: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """The store with fresh rows: layers of an unchanged item are completed, those of a changed one are reset."""
    o, n = store.alias("o"), fresh.alias("n")
    joined = o.join(n, (F.col("o.volume") == F.col("n.volume")) & (F.col("o.rel_path") == F.col("n.rel_path")), "full_outer")
    only_old, same = F.col("n.rel_path").isNull(), (F.col("o.size") == F.col("n.size")) & F.col("o.modified").eqNullSafe(F.col("n.modified"))
    pick = lambda c: F.when(only_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    merged = lambda c: F.when(only_old, F.col(f"o.{c}")).when(same, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(*[pick(c) for c in (*KEY, "size", "modified")], *map(merged, layers))


def merge(target: DataFrame, source: DataFrame, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Two stores: the target's entries stay, their missing layers and missing entries come from the source."""
    t, s = target.alias("t"), source.alias("s")
    joined = t.join(s, (F.col("t.volume") == F.col("s.volume")) & (F.col("t.rel_path") == F.col("s.rel_path")), "full_outer")
    return joined.select(*[F.coalesce(f"t.{c}", f"s.{c}").alias(c) for c in (*KEY, "size", "modified", *layers)])


def under(path: Column, folder: str) -> Column:
    """Is a path a folder or below it?"""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/") if folder else F.lit(True)


def invalidate(store: DataFrame, volume: str, folder: str) -> DataFrame:
    """The store without a branch or file."""
    return store.filter(~((F.col("volume") == volume) & under(F.col("rel_path"), folder)))


def prune(store: DataFrame, present: DataFrame) -> DataFrame:
    """The store without entries of items that are gone."""
    return store.join(present.select(*KEY), list(KEY), "left_semi")


def rekey(store: DataFrame, mounts: dict[str, str]) -> DataFrame:
    """Move entries under a mount's path to that mount's own volume, the longest path first. mounts: path to volume."""
    full = F.concat_ws("/", "volume", "rel_path")
    volume, rel = F.col("volume"), F.col("rel_path")
    for path in sorted(mounts, key=len):
        below = full.startswith(path.rstrip("/") + "/")
        volume = F.when(below, F.lit(mounts[path])).otherwise(volume)
        rel = F.when(below, F.substr(full, F.lit(len(path.rstrip("/")) + 2))).otherwise(rel)
    return store.select(volume.alias("volume"), rel.alias("rel_path"), *[c for c in store.columns if c not in KEY])


def _counts() -> list[Column]:
    deep = F.col("bytes_hash").isNotNull() | F.col("content_hash").isNotNull()
    return [
        F.count("*").alias("files"),
        F.count_if(F.col("shallow").isNotNull()).alias("shallow_done"),
        F.count_if(deep).alias("deep_done"),
        F.count_if(F.col("phash").isNotNull()).alias("phash_done"),
        F.count_if(F.coalesce("date_resolved", F.lit(False))).alias("dates_done"),
    ]


def coverage(store: DataFrame, volume: str | None = None, folder: str = "") -> DataFrame:
    """How many items below a folder have each layer."""
    return (store if volume is None else store.filter(F.col("volume") == volume)).filter(under(F.col("rel_path"), folder)).agg(*_counts())


def coverage_by_folder(store: DataFrame) -> DataFrame:
    """The same for all folders at once: each item counts in all of its ancestors, the top one being ""."""
    p = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/"))
    return store.withColumn("folder", F.explode(above)).groupBy("volume", "folder").agg(*_counts())


def save(store: DataFrame, path: str) -> int:
    """Write a new version of a stored table beside the others; readers see it when it is complete. Gives its number."""
    spark = store.sparkSession
    version = (current_version(spark, path) or 0) + 1
    store.write.parquet(f"{path}/version={version}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, newest first, by the marker that a finished write leaves."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath() for s in fs.listStatus(hadoop)]
    done = [int(p.getName().partition("=")[2]) for p in names if p.getName().startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(done, reverse=True)


def current_version(spark: SparkSession, path: str) -> int | None:
    """The latest complete version."""
    return next(iter(versions(spark, path)), None)


def load(spark: SparkSession, path: str, empty: DataFrame | None = None) -> DataFrame | None:
    """The newest version that can be read; `empty` where there is none. Older layouts lack newer layers, which are null then.

    A store is a cache: broken files count as missing, and a version without a readable file is passed over.
    """
    for version in versions(spark, path):
        try:
            store = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/version={version}")
        except Exception as e:  # noqa: BLE001  no file's schema can be read
            if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "CANNOT_READ_FILE_FOOTER" not in str(e) and "FAILED_READ_FILE" not in str(e):
                raise
            continue
        if not set(KEY) <= set(store.columns):
            continue
        if empty is not None:
            for f in empty.schema:
                if f.name not in store.columns:
                    store = store.withColumn(f.name, F.lit(None).cast(f.dataType))
            store = store.select(*empty.columns)
        return store
    return empty


def new_volume() -> str:
    """An id for a volume that has none."""
    return uuid.uuid4().hex
