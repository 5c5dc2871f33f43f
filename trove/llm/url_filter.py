"""URL filters: host and path rules, and for URLs that no rule fits the ratio of two character language models.

Two smoothed variable-order Markov models are counted, over all URLs that a rule accepts and over all that a rule
rejects (four fifths of them by hash). A model backs off from its longest context to shorter ones, each order smoothed by
the one below. A URL's score is the difference of its log-likelihoods, divided by its length. The other fifth calibrates
the threshold: the cut of the score with the best balanced accuracy.

Counts are exact: a byte and the bytes before it are one integer of ORDERS symbols (a gram), and the model is a stored
table of the grams' counts in both classes, which grows with the input. Lower orders are its sums. What each gram of the
URLs adds to a score is made by joins, order by order, and joined to the grams of the distinct URLs. Scores are summed in
fixed point, so they don't depend on the order of rows. Nothing is gathered on the driver but sums of classes and bins.

Defined cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed; urls are scored
whole (all after "://", with query and fragment), however long; where one class has no URL there is no model and all
that no rule blocks is allowed; of cuts that are equally good the one nearest to 0 is taken, and a score at the cut is
allowed; repeated rows are judged alike; an empty table gives an empty result; other columns pass
through filter_urls' input unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.llm.common import stage, text_bytes

ORDERS, BITS = 5, 9  # a gram is the byte itself in the lowest BITS, then the bytes before it; 0 stands before a text
SMOOTHING = 4.0
FIXED, SALTS = 1 << 32, 8
#: (verdict, host/path): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def scored_text(url: Column) -> Column:
    """The whole url after "://", its host in lower case, query and fragment included; empty if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host, _ = host_and_path(url)
    return F.coalesce(F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)", 1)), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's text and gram."""
    data, offsets = text_bytes(array)
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(data)) + (owner + 1) * ORDERS
    symbols = np.zeros(len(data) + (len(lengths) + 1) * ORDERS, np.int64)  # each text stands after a run of zeros
    symbols[place] = data.astype(np.int64) + 1
    out = np.zeros(len(data), np.int64)
    for k in range(ORDERS):
        out |= symbols[place - k] << (BITS * k)
    return owner, out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(accepted, text) to (gram, accepted, rejected)."""
    for b in batches:
        owner, found = grams(b.column(1))
        accepted = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)[owner]
        ids, at = np.unique(found, return_inverse=True)
        n = [np.bincount(at[side], minlength=len(ids)).astype(np.int64) for side in (accepted, ~accepted)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, n)], ["gram", "accepted", "rejected"])


def text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, gram, times), times the gram is in the text."""
    for b in batches:
        owner, found = grams(b.column(1))
        order = np.lexsort((found, owner))
        owner, found = owner[order], found[order]
        starts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])][: len(found)])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[starts])), pa.array(found[starts]), pa.array(np.diff(np.r_[starts, len(found)]))], ["id", "gram", "times"])


def last(gram: Column, k: int) -> Column:
    """The last k symbols of a gram."""
    return gram.bitwiseAND(F.lit((1 << (BITS * k)) - 1).cast("long"))


class Model:
    """Counts of both classes: a stored table of gram, accepted, rejected. Scores texts."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts = counts

    def gains(self, asked: DataFrame) -> DataFrame:
        """gram, gain: what each asked gram adds to a score, times FIXED."""
        sums = (F.sum("accepted"), F.sum("rejected"))
        made = None
        for k in range(ORDERS):
            own = last(F.col("gram"), k + 1)
            own_counts = self.counts.groupBy(own.alias("gram")).agg(sums[0].alias("ga"), sums[1].alias("gr"))
            context_counts = self.counts.groupBy(last(F.shiftright("gram", BITS), k).alias("context")).agg(sums[0].alias("ca"), sums[1].alias("cr"))
            here = asked.select(own.alias("gram")).distinct() if k < ORDERS - 1 else asked
            here = here.join(own_counts, "gram", "left").withColumn("context", last(F.shiftright("gram", BITS), k)).join(context_counts, "context", "left")
            if made is None:
                here = here.withColumns({"la": F.lit(1 / 256), "lr": F.lit(1 / 256)})
            else:
                here = here.withColumn("low", last(F.col("gram"), k)).join(made.select(F.col("gram").alias("low"), F.col("pa").alias("la"), F.col("pr").alias("lr")), "low")
            p = [(F.coalesce("g" + x, F.lit(0)) + SMOOTHING * F.col("l" + x)) / (F.coalesce("c" + x, F.lit(0)) + SMOOTHING) for x in "ar"]
            made = here.select("gram", p[0].alias("pa"), p[1].alias("pr"))
        return made.select("gram", F.round((F.ln("pa") - F.ln("pr")) * FIXED).cast("long").alias("gain"))

    def scores(self, array: pa.Array) -> np.ndarray:
        """Of a few texts."""
        df = self.counts.sparkSession.createDataFrame(list(enumerate(array.to_pylist())), "place int, text string")
        return np.array([r.score for r in score_with(self, df, "text").orderBy("place").collect()])


def train(labelled: DataFrame) -> Model | None:
    """From (accepted boolean, text string); None where a class is empty."""
    counts = labelled.select("accepted", "text").mapInArrow(count_grams, "gram long, accepted long, rejected long").groupBy("gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    counts = stage(counts, "url-grams")
    total = counts.agg(F.sum("accepted"), F.sum("rejected")).first()
    return Model(counts) if all(total) else None


def score_with(model: Model, df: DataFrame, text: str) -> DataFrame:
    """df with a column score. A gram of many texts is dealt over SALTS parts."""
    texts = df.select(F.col(text).alias("text")).filter(F.col("text") != "").distinct().select(F.xxhash64("text").alias("id"), "text")
    found = texts.mapInArrow(text_grams, "id long, gram long, times long")
    gains = stage(model.gains(found.select("gram").distinct()), "url-gains").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = found.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(gains, ["gram", "salt"])
    scored = joined.groupBy("id").agg((F.sum(F.col("times") * F.col("gain")) / FIXED / F.sum("times")).alias("score"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in df.columns]
    rows = df.select(F.struct("*").alias("row"), F.xxhash64(F.col(text)).alias("id"))
    return rows.join(scored, "id", "left").select(*columns, F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrate(model: Model, held_out: DataFrame) -> tuple[float, float]:
    """The threshold with the best balanced accuracy on (accepted, text), and that accuracy."""
    return best_cut(score_with(model, held_out.select("accepted", "text"), "text"))


def best_cut(scored: DataFrame) -> tuple[float, float]:
    """The same from (accepted, score)."""
    bins = scored.groupBy(F.greatest(F.least(F.floor(F.col("score") * 100), F.lit(1000)), F.lit(-1000)).alias("bin"), "accepted").count().collect()
    n = {True: 0, False: 0}
    for r in bins:
        n[r.accepted] += r["count"]
    if not min(n.values()):
        return 0.0, 0.5
    best, low = (-1.0, 0, 0), {True: 0, False: 0}
    by_bin: dict[int, dict[bool, int]] = {}
    for r in bins:
        by_bin.setdefault(r.bin, {})[r.accepted] = r["count"]
    for cut in [*sorted(by_bin), 1001]:
        accuracy = (low[False] / n[False] + 1 - low[True] / n[True]) / 2
        best = max(best, (accuracy, -abs(cut), cut))
        for k, v in by_bin.get(cut, {}).items():
            low[k] += v
    return best[2] / 100, best[0]


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and score (null where the model was not asked)."""
    host, path = host_and_path(F.col(url))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), scored_text(F.col(url)).alias("text"))
    rule, by_rule = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "by_rule": by_rule})
    labelled = ruled.filter(F.col("by_rule").isNotNull()).select((F.col("by_rule") == "allow").alias("accepted"), "text")
    fold = F.pmod(F.xxhash64("text"), F.lit(5))
    model = train(labelled.filter(fold < 4))
    if model is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    judged = stage(score_with(model, ruled, "text"), "url-scores")
    held_out = judged.filter(F.col("by_rule").isNotNull() & (fold == 4))
    threshold, _ = best_cut(held_out.select((F.col("by_rule") == "allow").alias("accepted"), "score"))
    by_model = F.when((F.col("text") == "") | (F.col("score") >= threshold), F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), F.when(F.col("by_rule").isNull(), F.col("score")).alias("score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLES: dict[str, str] = {}
