"""Quality rules with cross-document line frequency; DataFrame and SQL functions only.

Base rules count words, characters, symbols, repeated lines and words in repeated 3-word windows of each document.
Then normalised lines are hashed, the distinct documents that hold a line are counted for each host (source), lines on
too many of them are removed, and a document that these removals deplete is rejected. Copies of a page count once for
this (see lines.py), so a page is not rejected for having been copied.

Limits: a line is removed if at least LEAST_DOCS distinct documents of its host hold it and these are more than MAX_SHARE
of them or more than MAX_DOCS; a document is depleted if less than LEAST_LEFT of its words are left.

Defined cases: null or empty text has no words and fails the base rules; a null host is a host of its own; very long
texts are counted whole; a line at exactly a limit's share stays; repeated rows are judged alike; an empty table gives an empty result; other columns pass
through good_documents unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.functions.binding import let
from trove.llm.common import SPACE_CHARS, WORD, stage
from trove.llm.lines import frequent_lines, has_word, host_key, keyed_lines, line_rows, split_lines, sql_frequent

MIN_WORDS, MAX_SHARE, MAX_DOCS, LEAST_DOCS, LEAST_LEFT = 50, 0.05, 10_000, 10, 0.3
SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more in the text. Windows are compared by 64-bit hashes."""

    def covered(places: Column) -> Column:
        steps = F.zip_with(F.slice(places, F.lit(1), F.size(places) - 1), F.slice(places, F.lit(2), F.size(places) - 1), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))

    def twins(pairs: Column) -> Column:  # sorted by hash, then place
        same = F.filter(pairs, lambda p, i: (F.get(pairs, i - 1)["h"] == p["h"]) | F.coalesce(F.get(pairs, i + 1)["h"] == p["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twins))

    def text(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(hashes, windows))

    return let(words, text).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """The counts of one text, by name."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(split_lines(whole), has_word)
    return {
        "n_words": F.regexp_count(whole, F.lit(WORD)).cast("long"),
        "word_chars": F.char_length(F.translate(whole, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.array_remove(F.split(whole, "[\\x20\\x09-\\x0D]+"), "")),
    }


def judge_documents(docs: DataFrame, host: str = "source", max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS, least_docs: int = LEAST_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """A row for each document: id (a hash of doc_id, host and text), doc_id, the counts, base_failed, words_removed, kept."""
    narrow = docs.select(
        F.xxhash64(F.col("doc_id"), host_key(F.col(host)), F.coalesce(F.col("text"), F.lit(""))).alias("id"),
        F.col("doc_id"),
        host_key(F.col(host)).alias("host"),
        keyed_lines(F.col("text")).alias("lines"),
        *[c.alias(n) for n, c in base_rules(F.col("text")).items()],
    )
    narrow = stage(narrow, "quality-counts")
    bad = frequent_lines(line_rows(narrow.select("host", F.col("lines.key").alias("keys"))), max_share, least_docs, max_docs).select("host", "key", F.lit(True).alias("bad"))
    each = narrow.select("id", "host", F.explode("lines").alias("line")).select("id", "host", "line.key", "line.words")
    each = each.groupBy("id", "host", "key").agg(F.max("words").alias("words"), F.count("*").alias("times"))  # twins of a row count their lines alike
    lost = each.join(bad, ["host", "key"]).groupBy("id").agg(F.collect_set("key").alias("bad"))  # at most the document's own lines
    gone = F.aggregate("lines", F.lit(0), lambda s, x: s + F.when(F.array_contains(F.col("bad"), x["key"]), x["words"]).otherwise(0))
    joined = narrow.join(lost, "id", "left").withColumn("words_removed", F.when(F.col("bad").isNull(), 0).otherwise(gone).cast("long"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed") >= F.col("n_words") * least_left
    names = list(base_rules(F.lit("")))
    return joined.select("id", "doc_id", *names, base_failed.alias("base_failed"), "words_removed", (~base_failed & left).alias("kept"))


def good_documents(docs: DataFrame, host: str = "source", **options) -> DataFrame:  # noqa: ANN003
    """docs without those that the rules reject."""
    good = judge_documents(docs, host, **options).filter("kept").select("id").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id"), host_key(F.col(host)), F.coalesce(F.col("text"), F.lit(""))).alias("id"))
    return rows.join(good, "id", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_documents(docs).drop("id")


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES = {
    "op7_quality": f"""with {sql_frequent(MAX_SHARE, LEAST_DOCS, MAX_DOCS)},
w as (select rid, unnest(regexp_extract_all(text, '{WORD}')) as word, generate_subscripts(regexp_extract_all(text, '{WORD}'), 1) as i from d),
w3 as (select rid, i, word, lead(word, 1) over (partition by rid order by i) as b, lead(word, 2) over (partition by rid order by i) as c from w),
k as (select *, count(*) over (partition by rid, word, b, c) as n from w3),
q as (select rid, i, c is not null and n > 1 as here from k),
v as (select rid, count(*) filter (here or coalesce(before_1, false) or coalesce(before_2, false)) as n_repeat_words from
    (select *, lag(here, 1) over (partition by rid order by i) as before_1, lag(here, 2) over (partition by rid order by i) as before_2 from q) group by rid),
n as (select rid, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(len(regexp_extract_all(line, '{WORD}'))) filter (f.key is not null), 0) as words_removed
    from l left join frequent f on f.host = l.host and f.key = l.key group by rid),
a as (select doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as n_words, coalesce(length(translate(text, {_SPACE}, '')), 0)::bigint as word_chars,
    coalesce(length(text) - length(translate(text, '{SYMBOLS}', '')), 0)::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(words_removed, 0)::bigint as words_removed from d left join v using (rid) left join n using (rid)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select *, not base_failed and n_words - words_removed >= n_words * {LEAST_LEFT} as kept from b"""
}
QUERIES = {"op7_quality": op7_quality}
