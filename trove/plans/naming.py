"""Names that collide with nothing, whatever their case.

The n-th claim of a taken name becomes `stem (n).ext`. The exact rule is sequential within a folder, because a name that
was made up can collide with a real one; folders are independent of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.functions.paths import parts


def split_name(name: str) -> tuple[str, str]:
    at = name.rfind(".")
    return (name, "") if at < 0 else (name[:at], name[at:])


class Names:
    """The names of one folder. Numbers that are known to be taken are not tried again."""

    def __init__(self, existing: Iterator[str] = ()) -> None:
        self.taken = {n.lower() for n in existing}
        self.next: dict[str, int] = {}

    def claim(self, name: str) -> str:
        out = name
        if name.lower() in self.taken:
            stem, ext = split_name(name)
            n = self.next.get(name.lower(), 1)
            while (out := f"{stem} ({n}){ext}").lower() in self.taken:
                n += 1
            self.next[name.lower()] = n + 1
        self.taken.add(out.lower())
        return out


def base_name(name: Column) -> Column:
    """A name without case and made-up numbers: names can collide in a folder only if these are equal."""
    return F.regexp_replace(F.lower(name), r"( \([0-9]+\))+(?=(\.[^.]*)?$)", "")


def claim_names(claims: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """dir, seq, name and the name given, in order of seq in each folder. existing: (dir, name) already there.

    Only folders in which two claims, or a claim and a file, may meet are dealt sequentially: names that nobody else in
    their folder has, and that don't end as made-up ones do, are given as they are.
    """
    claims = claims.select("dir", "seq", "name")
    there = existing.select("dir", "name") if existing is not None else claims.select("dir", "name").limit(0)
    base = base_name(F.col("name"))
    rows = claims.withColumn("old", F.lit(False)).unionByName(there.withColumns({"seq": F.lit(-1).cast(claims.schema["seq"].dataType), "old": F.lit(True)})).withColumn("base", base)
    crowd = rows.groupBy("dir", "base").agg(F.count("*").alias("n"))
    rows = rows.join(crowd, ["dir", "base"])
    free = rows.filter("n = 1 and not old").select("dir", "seq", "name", F.col("name").alias("given"))

    def deal(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq", kind="stable")
        names = Names(group.loc[group["old"], "name"])
        mine = group.loc[~group["old"], ["dir", "seq", "name"]].copy()
        mine["given"] = [names.claim(n) for n in mine["name"]]
        return mine

    kind = claims.schema["seq"].dataType.simpleString()
    dealt = rows.filter("n > 1").groupBy("dir", "base").applyInPandas(deal, f"dir string, seq {kind}, name string, given string")
    return free.unionByName(dealt)


def numbered_names(claims: DataFrame) -> DataFrame:
    """The common case without Python: the k-th claim of a name in a folder, by seq, is `stem (k - 1).ext`. Right where no claim looks like a made-up name."""
    n = F.row_number().over(Window.partitionBy("dir", F.lower("name")).orderBy("seq")) - 1
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    ext = F.regexp_extract("name", r"\.[^.]*$", 0)
    return claims.select("dir", "seq", "name", F.when(n == 0, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext)).alias("given"))


def in_path_order(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with seq, the sort key of their path, for claims in path order."""
    return rows.withColumn("seq", F.array_join(parts(F.col(path)), "\x01"))
