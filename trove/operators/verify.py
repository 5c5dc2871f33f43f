"""Do items sit in the folder that their capture date implies?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions.binding import let
from trove.functions.dates import date_triple, days_between, folder_date_of
from trove.functions.paths import parent

STATUSES = ("ok", "mismatch", "outside", "undated")


def with_folder_dates(files: DataFrame) -> DataFrame:
    """files (with path) and folder_date, the date of the nearest dated folder. Each distinct folder is parsed once, however many files it holds."""
    held = files.withColumn("_folder", parent(F.col("path")))
    folders = held.select("_folder").distinct()
    return held.join(folders.withColumn("folder_date", folder_date_of(F.concat("_folder", F.lit("/")))), "_folder").drop("_folder")


def verify_dates(files: DataFrame, folder: Column | None = None) -> DataFrame:
    """path, exif_date, folder_date, status, days_off of (path, capture_date). A month-only folder matches any of its days.

    days_off is 0 for ok, null for outside and undated, and 0 where a date is not on the calendar.
    """
    def judged(x: Column) -> Column:
        taken, there = x["taken"], x["there"]
        exif = F.when(taken.isNotNull(), F.format_string("%04d-%02d-%02d", taken["year"], taken["month"], taken["day"]))
        same = there.isin(exif, F.format_string("%04d-%02d", taken["year"], taken["month"]))
        status = F.when(taken.isNull(), "undated").when(there.isNull(), "outside").when(same, "ok").otherwise("mismatch")
        first = F.when(F.length(there) == 7, F.concat(there, F.lit("-01"))).otherwise(there)
        days = F.when(taken.isNull() | there.isNull(), F.lit(None)).when(same, F.lit(0).cast("long")).otherwise(days_between(exif, first))
        return F.struct(exif.alias("exif_date"), there.alias("folder_date"), status.alias("status"), days.alias("days_off"))

    dated = files.select("path", "capture_date", folder.alias("folder_date")) if folder is not None else with_folder_dates(files.select("path", "capture_date"))
    facts = F.struct(date_triple(F.col("capture_date")).alias("taken"), F.col("folder_date").alias("there"))
    return dated.select("path", let(facts, judged).alias("v")).select("path", "v.exif_date", "v.folder_date", "v.status", "v.days_off")


def verify_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("status").agg(F.count("*").alias("files"))


def far_off(verified: DataFrame, days: int = 10) -> DataFrame:
    """Mismatches of at least so many days."""
    return verified.filter((F.col("status") == "mismatch") & (F.col("days_off") >= days))


def with_status(verified: DataFrame, status: str) -> DataFrame:
    return verified if status == "all" else verified.filter(F.col("status") == status)


def text_filter(rows: DataFrame, query: str, columns: tuple[str, ...] = ("path", "keeper", "candidate", "a", "b")) -> DataFrame:
    """Rows that hold the text, whatever its case, in any of the columns that they have."""
    test = F.lit(False)
    for c in columns:
        if c in rows.columns:
            test |= F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return rows.filter(test)


def within_distance(rows: DataFrame, limit: int) -> DataFrame:
    return rows.filter(F.col("distance") <= limit)


def carried_dates(paths: DataFrame, given: DataFrame, extracted: DataFrame) -> DataFrame:
    """path, capture_date: the given one (`unknown` stays unknown, null), else the extracted one."""
    joined = paths.join(given.select("path", F.col("date").alias("given")), "path", "left").join(extracted.select("path", F.col("capture_date").alias("found")), "path", "left")
    return joined.select("path", F.when(F.col("given") == "unknown", F.lit(None)).otherwise(F.coalesce("given", "found")).alias("capture_date"))


def resolve_dates(files: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """path, capture_date, date_source of (path, embedded_date): the embedded date, the external tool's, the folder's. External rows are asked for the undated only."""
    undated = files.filter("embedded_date is null")
    tool = undated.join(external.select("path", F.col("capture_date").alias("tool_date")), "path", "left") if external is not None else undated.withColumn("tool_date", F.lit(None).cast("string"))
    late = with_folder_dates(tool).select("path", F.coalesce("tool_date", "folder_date").alias("capture_date"), F.when(F.col("tool_date").isNotNull(), "tool").when(F.col("folder_date").isNotNull(), "folder").alias("date_source"))
    return files.filter("embedded_date is not null").select("path", F.col("embedded_date").alias("capture_date"), F.lit("embedded").alias("date_source")).unionByName(late)


def top_rows(rows: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """The first n rows with, in each, how many more there are. A total order makes it repeatable."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(n).crossJoin(F.broadcast(total)).withColumn("more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")  # total is one row


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 100) -> DataFrame:
    """One page of a table, from 0."""
    return rows.orderBy(*order).offset(page * size).limit(size)
