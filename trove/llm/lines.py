"""Lines of documents and how many of a host's pages hold them; JVM-side expressions only.

A line's key is a hash of its normalised text: lower case, digits as 0, white space as one space, trimmed. A text is
normalised at once, before it is split. Blank lines have no key. A host's pages are told apart by a hash of the set of
all their line keys, so that copies of a page count once and pages that only share some lines count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.llm.common import SPACE_CHARS


def has_word(line: Column) -> Column:
    return F.translate(line, SPACE_CHARS, "") != ""


def plain_lines(text: Column) -> Column:
    """The normalised lines of a text, blank ones empty; null for null."""
    plain = F.translate(F.lower(text), "123456789\t\x0b\x0c\r", "000000000    ")
    return F.transform(split_lines(F.regexp_replace(plain, " {2,}", " ")), lambda x: F.trim(x))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line in order, null for blank ones."""
    return F.transform(plain_lines(text), lambda x: F.when(x != "", F.xxhash64(x)))


def host_key(host: Column) -> Column:
    """A host that is never null."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def keyed_lines(text: Column) -> Column:
    """Of the lines with a word: array of (key, words). Null text has none."""
    lines = F.filter(F.coalesce(plain_lines(text), F.array().cast("array<string>")), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("key"), (F.octet_length(x) - F.octet_length(F.translate(x, " ", "")) + 1).alias("words")))


def line_rows(docs: DataFrame, *others: str) -> DataFrame:
    """A row for each distinct line of a document: host, key, page (what tells the page apart), others. docs: host, keys (those of its lines)."""
    rows = docs.select("host", *others, F.sort_array(F.array_distinct("keys")).alias("keys"))
    return rows.select("host", *others, F.xxhash64("keys").alias("page"), F.explode("keys").alias("key"))


def frequent_lines(rows: DataFrame, ratio: float, least: int, most: int | None = None) -> DataFrame:
    """host, key, pages, host_pages of the lines on at least `least` of their host's pages and on more than ratio of them (or more than `most`).

    Counts are summed before they are shuffled by line, so a line or host with many rows is no hot spot.
    """
    counts = rows.select("host", "key", "page").distinct().groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    totals = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    over = F.col("pages") > F.col("host_pages") * ratio
    return counts.join(totals, "host").filter(over if most is None else over | (F.col("pages") > most))


#: DuckDB: the normalised text of line {0}
def sql_plain(line: str) -> str:
    return f"trim(regexp_replace(translate(lower({line}), '123456789', '000000000'), '[ \\t\\x0B-\\x0D]+', ' ', 'g'), ' ')"


#: DuckDB: common tables d, l (the lines with a word) and `frequent`, from documents
def sql_frequent(ratio: float, least: int, most: int | None = None) -> str:
    over = f"pages > host_pages * {ratio}" + ("" if most is None else f" or pages > {most}")
    return f"""d as (select row_number() over () as rid, * from documents),
x as (select rid, doc_id, coalesce('=' || source, '') as host, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from d),
l as (select rid, host, line, {sql_plain('line')} as key from x where {sql_plain('line')} <> ''),
g as (select rid, host, list_sort(list(distinct key)) as page from l group by rid, host),
m as (select distinct host, page from g),
c as (select host, key, count(*) as pages from (select host, unnest(page) as key from m) group by host, key),
t as (select host, count(*) as host_pages from m group by host),
frequent as (select host, key from c join t using (host) where pages >= {least} and ({over}))"""
