"""Paths as strings: components, names, extensions, prefixes. All expressions are JVM-side."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of the media that are listed.
RAW = "3fr ari arw bay cr2 cr3 crw dcr dcs dng erf fff iiq kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl sr2 srf srw x3f tif tiff".split()
IMAGE = "avif bmp dds exr ff gif hdr ico jpeg jpg pam pbm pgm png ppm qoi tga webp".split()
VIDEO = "avi m2ts m4v mov mp4 mts".split()
HEIF = "heic heif".split()


def parts(path: Column) -> Column:
    """Path components; arrays of them compare as paths do, component by component."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    """The last component, or "file" where there is none."""
    name = F.element_at(parts(path), -1)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("file")).otherwise(name)


def name_length(path: Column) -> Column:
    """Bytes of the last component; 0 where there is none."""
    return F.coalesce(F.octet_length(F.element_at(parts(path), -1)), F.lit(0))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component, empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(RAW + IMAGE + VIDEO + HEIF)


def is_video(path: Column) -> Column:
    return extension(path).isin(VIDEO)


def lossy_family(path: Column) -> Column:
    """0 for JPEG, 1 for HEIF and AVIF, else null."""
    ext = extension(path)
    return F.when(ext.isin("jpg", "jpeg"), 0).when(ext.isin("heic", "heif", "avif"), 1)


def is_event_name(name: Column) -> Column:
    """Does a folder name begin with MM-DD?"""
    return name.rlike("^[0-9]{2}-[0-9]{2}")


def relative_to(path: Column, root: Column) -> Column:
    """The path below root, null outside of it."""
    return F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))


def rebase(path: Column, root: Column, new_root: Column) -> Column:
    """The same relative path under another root; files outside root go to its top level."""
    inside = relative_to(path, root)
    return F.concat_ws("/", new_root, F.coalesce(inside, file_name(path)))


def split_event(rel: Column) -> Column:
    """(year, event, file) of year/event/.../file; null for shallower paths."""
    p = parts(rel)
    return F.when(F.size(p) >= 3, F.struct(F.get(p, F.lit(0)).alias("year"), F.get(p, F.lit(1)).alias("event"), file_name(rel).alias("file")))


def common_parent_purgatory(roots: list[str]) -> str:
    """A purgatory folder beside the shared parent of all roots."""
    parents = [r.rstrip("/").split("/")[:-1] for r in roots if r.rstrip("/")]
    if not parents:
        return "purgatory"
    common = parents[0]
    for other in [r.rstrip("/").split("/") for r in roots if r.rstrip("/")]:
        while common and other[: len(common)] != common:
            common = common[:-1]
    return "/".join([*common, "purgatory"]) if common else "purgatory"


def event_purgatory(folder: str) -> str:
    """The sibling `<name>-purgatory` of a folder."""
    head, _, name = folder.rstrip("/").rpartition("/")
    return f"{head or '.'}/{name or 'photos'}-purgatory"


def resolved(path: str) -> str:
    """A local path without links and dots; missing ends stay as they are written."""
    return os.path.realpath(os.path.expanduser(path))


def require_dir(path: str) -> str:
    """The resolved path of a local folder; refuses anything else."""
    found = resolved(path)
    if not os.path.isdir(found):
        raise ValueError(f"{path} is no folder")
    return found


def require_disjoint(a: str, b: str, resolve: bool = True) -> None:
    """Refuse trees that are equal or nested, links followed unless resolve is off (for folders that are not local)."""
    x, y = (resolved(p) if resolve else p for p in (a, b))
    x, y = (p.rstrip("/").split("/") for p in (x, y))
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        raise ValueError(f"{a} and {b} are the same tree or one holds the other")


def short_path(path: Column, keep: int = 2) -> Column:
    """The last components of a path, with dots for what is left out."""
    p = parts(path)
    return F.when(F.size(p) <= keep, path).otherwise(F.concat(F.lit(".../"), F.array_join(F.slice(p, -keep, keep), "/")))


def json_row(*columns: str) -> Column:
    """A result row as JSON text, in the order of its columns."""
    return F.to_json(F.struct(*columns))


def bytes_text(n: Column) -> Column:
    """A size with its unit."""
    units = F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB")))
    step = F.when(n < 1024, 0).otherwise(F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(4))).cast("int")
    return F.when(step == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), step)), F.lit(" "), F.get(units, step)))


def size_delta_text(a: Column, b: Column) -> Column:
    """By how many percent b is larger (+) or smaller than a."""
    delta = F.round((b - a) * 100.0 / a, 0).cast("long")
    return F.when(a == 0, F.lit("")).otherwise(F.concat(F.when(delta > 0, F.lit("+")).otherwise(F.lit("")), delta.cast("string"), F.lit("%")))
