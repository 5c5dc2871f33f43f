"""Listings of files as tables, and parsers of pasted lists."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.functions.hashes import PREFIX, bytes_hash
from trove.functions.paths import RAW, extension, is_event_name, is_supported, is_video, parts, relative_to, split_event
from trove.sources.decoders import film_ranges, payload_hashes
from trove.sources.pixels import pixel_layers
from trove.sources.raw import register
from trove.sources.stamps import embedded_date


register(RAW)


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, modified, content of the supported media below a folder. Content is not read unless it is used.

    Spark lists linked files like others; without_links drops those of a local folder.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    files = reader.load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content").filter(is_supported(F.col("path")))


def without_links(files: DataFrame) -> DataFrame:
    """files (with path) but those that are symbolic links. Executors must see the folder under the driver's path."""
    @F.pandas_udf("boolean")
    def linked(path: pd.Series) -> pd.Series:
        return path.map(os.path.islink)

    return files.filter(~linked("path"))


#: files over this are never held as one value: they are read in blocks where they lie
LARGE = 1 << 30
_BLOCK = 1 << 16


def _large_file(path: str, prefix: int) -> tuple[str, str, str | None, str | None]:
    """sha256 and md5 of a file's bytes, and md5 of the head and sha256 of all of its film data; read in blocks."""
    whole, quick, film, head = hashlib.sha256(), hashlib.md5(), hashlib.sha256(), b""  # noqa: S324
    ranges = film_ranges(path)
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            whole.update(block)
            quick.update(block)
        for lo, hi in ranges:
            f.seek(lo)
            while lo < hi and (block := f.read(min(_BLOCK, hi - lo))):
                film.update(block)
                head += block[: prefix - len(head)]
                lo += len(block)
    return whole.hexdigest(), quick.hexdigest(), hashlib.md5(head).hexdigest() if ranges else None, film.hexdigest() if ranges else None  # noqa: S324


def _hash_large(files: DataFrame, prefix: int) -> DataFrame:
    @F.pandas_udf("bytes_hash string, quick string, head_hash string, payload_hash string")
    def run(path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_large_file(p, prefix) for p in path], columns=["bytes_hash", "quick", "head_hash", "payload_hash"])

    return files.withColumn("h", run("path"))


def scan_tree(spark: SparkSession, root: str, prefix: int = PREFIX, dates: bool = False, large: int = LARGE) -> DataFrame:
    """The catalog of a tree: tree, path, rel, size, modified, shallow, decoded, bytes_hash, payload_hash, pixel_hash, phash,
    dhash, chroma, pixels, video and, if asked for, embedded_date.

    Files over `large` bytes are listed like others, but hashed by path in blocks; they have no pixels and no date here.
    """
    files = without_links(list_files(spark, root))
    ext = extension(F.col("path"))
    small = files.filter(F.col("size") <= large).withColumn("h", payload_hashes(F.col("content"), ext, prefix)).withColumn("p", pixel_layers(F.col("content"), ext))
    small = small.withColumn("h", F.struct(bytes_hash(F.col("content")).alias("bytes_hash"), F.md5("content").alias("quick"), "h.head_hash", "h.payload_hash"))
    small = small.withColumn("embedded_date", embedded_date(F.col("content"), ext) if dates else F.lit(None).cast("string"))
    empty = F.lit(None).cast("struct<pixel_hash:string,phash:bigint,dhash:bigint,chroma:int,pixels:bigint>")
    big = _hash_large(files.filter(F.col("size") > large).drop("content"), prefix).withColumn("p", empty).withColumn("embedded_date", F.lit(None).cast("string"))
    hashed = small.drop("content").unionByName(big)
    return hashed.select(
        F.lit(root).alias("tree"), "path", relative_to(F.col("path"), F.lit(root.rstrip("/"))).alias("rel"), "size", "modified",
        F.coalesce("h.head_hash", "h.quick").alias("shallow"), F.col("h.payload_hash").isNotNull().alias("decoded"), "h.bytes_hash", "h.payload_hash",
        "p.pixel_hash", "p.phash", "p.dhash", "p.chroma", "p.pixels", is_video(F.col("path")).alias("video"), *(["embedded_date"] if dates else []),
    )


def scan_trees(spark: SparkSession, roots: list[str], prefix: int = PREFIX) -> DataFrame:
    """Several trees in one table."""
    trees = [scan_tree(spark, r, prefix) for r in roots]
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out


def event_files(files: DataFrame) -> DataFrame:
    """Files at year/event/ or below, with event (year, event, file)."""
    return files.withColumn("event", split_event(F.col("rel"))).filter("event is not null")


def event_folders(files: DataFrame, folder: str) -> DataFrame:
    """(mmdd, event, files) of the MM-DD folders directly in a folder."""
    p = parts(relative_to(F.col("path"), F.lit(folder)))
    inside = files.withColumn("event", F.get(p, F.lit(0))).filter((F.size(p) >= 2) & is_event_name(F.col("event")))
    return inside.groupBy(F.substring("event", 1, 5).alias("mmdd"), "event").agg(F.count("*").alias("files"))


def in_path_order(files: DataFrame) -> DataFrame:
    return files.orderBy(parts(F.col("path")))


def pasted(lines: DataFrame, *names: str, line: str = "value") -> DataFrame:
    """Tab-separated lines as columns; lines with another number of fields, or an empty one, are skipped."""
    fields = F.split(F.regexp_replace(line, "\r$", ""), "\t")
    good = lines.filter((F.size(fields) == len(names)) & (F.size(F.filter(fields, lambda x: F.trim(x) == "")) == 0))
    return good.select(*[F.trim(F.get(fields, F.lit(i))).alias(n) for i, n in enumerate(names)])


def pasted_paths(lines: DataFrame, line: str = "value") -> DataFrame:
    """A path a line; blank lines and what stands after a tab are left out."""
    path = F.trim(F.get(F.split(F.regexp_replace(line, "\r$", ""), "\t"), F.lit(0)))
    return lines.select(path.alias("path")).filter("path <> ''")


def tool_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON rows of an external date tool as (path, tags map)."""
    tags = F.from_json(line, "map<string,string>")
    return lines.select(F.try_element_at(tags, F.lit("SourceFile")).alias("path"), tags.alias("tags")).filter("path is not null")
