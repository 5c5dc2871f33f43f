"""Line dedup by site-relative frequency.

Documents are grouped by host (source). The number of a host's pages that contain a line is divided by the host's pages,
and lines over a boilerplate ratio are dropped from all of its documents. Copies of a page count once (see lines.py), so
a page that was copied many times is not taken for boilerplate.

RATIO is a choice: in the test tables lines recur on 1 to 13 % of a site's pages, so a ratio of 10 % leaves most of them.

The boilerplate lines of all hosts are counted first. Up to BROADCAST_LINES of them go to the executors as they are;
beyond that they meet the documents by a shuffled join.

Defined cases: null text stays null; blank lines stay; a null host is a host of its own; hosts with few pages lose
nothing (a line must be on LEAST_PAGES pages); a line at exactly the ratio stays; very long texts are read whole;
repeated rows are treated alike; an empty table gives an empty result; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.functions.binding import let
from trove.llm.common import discard, stage
from trove.llm.lines import frequent_lines, host_key, line_keys, line_rows, split_lines, sql_frequent, sql_plain

RATIO, LEAST_PAGES, BROADCAST_LINES = 0.02, 5, 20_000


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """host, key, pages, host_pages of the boilerplate lines, as a stored table."""
    lines = stage(docs.select(host_key(F.col(host)).alias("host"), F.array_compact(line_keys(F.col("text"))).alias("keys")), "line-keys")
    found = stage(frequent_lines(line_rows(lines), ratio, least), "boilerplate")
    discard(lines)
    return found


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least: int = LEAST_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """row (the document's struct, as it was), text without boilerplate, n_lines, n_dropped."""
    found = boilerplate(docs, host, ratio, least)
    rows = docs.select(F.struct("*").alias("row"), F.col("text"), host_key(F.col(host)).alias("host"))
    if found.limit(broadcast_lines + 1).count() <= broadcast_lines:  # the size is known to be small
        bad = F.broadcast(found.groupBy("host").agg(F.collect_list("key").alias("bad")))
        joined = rows.join(bad, "host", "left")
    else:
        rows = rows.withColumn("id", F.xxhash64("host", "text"))
        own = rows.select("id", "host", "text").select("id", "host", F.explode(F.array_distinct(F.array_compact(line_keys(F.col("text"))))).alias("key")).distinct()
        per = own.join(found.select("host", "key"), ["host", "key"]).groupBy("id").agg(F.collect_list("key").alias("bad"))  # at most the document's lines
        joined = rows.join(per, "id", "left")

    def without(keys: Column) -> Column:
        """The lines that are kept; keys: those of all lines. Only boilerplate that the document holds is looked through line by line."""
        held = F.array_intersect(keys, F.col("bad"))
        rest = lambda found: F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(found, F.get(keys, i)), F.lit(False)))
        return let(held, lambda found: F.when(F.size(found) == 0, lines).otherwise(rest(found)))

    lines = split_lines(F.col("text"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(let(line_keys(F.col("text")), without))
    joined = joined.select("row", F.col("text").alias("old"), kept.alias("kept"))
    n = F.when(F.col("old").isNull(), 0).otherwise(F.regexp_count("old", F.lit("\n")) + 1).cast("long")
    return joined.select("row", F.array_join("kept", "\n").alias("text"), n.alias("n_lines"), (n - F.coalesce(F.size("kept"), F.lit(0)).cast("long") * F.when(F.col("old").isNull(), 0).otherwise(1)).alias("n_dropped"))


def cleaned(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs with boilerplate lines dropped; n_chars, if there is one, follows the text."""
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return drop_lines(docs, **options).select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_lines(docs).select("row.doc_id", "n_lines", "n_dropped", "text")


ORACLES = {
    "op9_line_dedup": f"""with {sql_frequent(RATIO, LEAST_PAGES)},
y as (select x.*, f.key is not null as bad from x left join frequent f on f.host = x.host and f.key = {sql_plain('x.line')}),
z as (select rid, count(*) as n_lines, count(*) filter (bad) as n_dropped, coalesce(string_agg(line, chr(10) order by place) filter (not bad), '') as text from y group by rid)
select doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dropped, 0)::bigint as n_dropped, case when d.text is null then null else z.text end as text from d left join z using (rid)"""
}
QUERIES = {"op9_line_dedup": op9_line_dedup}
