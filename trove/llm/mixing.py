"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the keys are range-sorted (keys are uniform, so equal
ranges of them hold equal shares), prefix sums of word counts are computed over the ranges and then within them, and
the order is cut at the source's exact budget. A budget above the source's size repeats whole epochs first.

Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share 100 % of all words by weight and stop
at 3 times the source's size; the excess goes to the others by weight until none is above. That fixed point is got in
closed form: in order of size over weight, sources are full until the level that the rest would get is lower.

Defined cases: null or empty text has size 0 and is taken 0 times; a null source is a source of its own; ties and
repeated rows are ordered by key, doc_id and size, and rows that agree in these are interchangeable; very long texts are
counted whole; an empty table gives an empty result; other columns of the input are not read by mix_documents and pass
through mixed_corpus, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trove.llm.common import WORD, n_words, stage

KEY_BITS, RANGE_ROWS = 60, 1024


def random_key(doc_id: Column, seed: int = 7) -> Column:
    """60 bits of the md5 of seed and id: the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target (double), budget (long, the target's whole words). One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by_name))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    t = t.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("source_size").over(before) * max_epochs, F.lit(0)).alias("full_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # full where size * max / weight < (all - full before) / (weight left); whole numbers decide
    full = F.col("source_size") * max_epochs * (F.col("all_weight") - F.col("weight_before")) < F.col("weight") * (F.col("all_size") - F.col("full_before"))
    t = t.withColumn("full", full)
    rest = F.col("all_size") - F.sum(F.when(F.col("full"), F.col("source_size") * max_epochs).otherwise(0)).over(every)
    left = F.col("all_weight") - F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every)
    target = F.when(F.col("full"), (F.col("source_size") * max_epochs).cast("double")).otherwise((F.col("weight") * rest).cast("double") / left.cast("double"))
    return t.withColumn("target", target).select("source", "source_size", "target", F.least(F.floor("target"), F.col("source_size") * max_epochs).alias("budget"))


def mix_documents(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """docs' ids and sources with size, source_size, target and taken. Only narrow rows are shuffled."""
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"))
    narrow = stage(narrow, "mix-sizes")
    # a source's ranges grow in number and in size with its own rows, so a hot source has more of them, not larger ones
    rows = F.col("rows").cast("double")
    bits = F.greatest(F.ceil(F.log2(rows / F.greatest(F.lit(RANGE_ROWS), F.sqrt(rows)))), F.lit(0)).cast("int")
    counts = narrow.groupBy("source").agg(F.count("*").alias("rows")).select(F.col("source").alias("of"), bits.alias("bits"))
    narrow = narrow.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.call_function("shiftright", "key", F.lit(KEY_BITS) - F.col("bits"))).drop("of", "bits")
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = narrow.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn("first", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)))
    targets = source_targets(narrow, max_epochs, weights)
    ranges = firsts.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source"))).select("f.source", "range", "first", "source_size", "target", "budget")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = placed.alias("p").join(ranges.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")) & (F.col("p.range") == F.col("r.range")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    over = F.col("budget") - epochs * F.col("source_size")
    cut = F.least(F.greatest(over - F.col("first") - F.col("inside"), F.lit(0)), F.col("size"))
    return both.select("doc_id", F.col("p.source").alias("source"), "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mixed_corpus(docs: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: a document as often as it is taken, its last copy cut after the words that fill the budget.

    Rows that share doc_id, source and size get equal shares of what these take together, up to one row.
    """
    per = mix_documents(docs, max_epochs, weights, seed).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken_all"), F.count("*").alias("twins"))
    per = per.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.ceil(F.col("taken_all") / F.col("twins")).cast("long").alias("_taken"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source"), F.col("text"), n_words(F.col("text")).alias("n"))
    both = rows.join(per.filter("_taken > 0"), F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("n") == F.col("_size")))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("n")).cast("int"))))
    left = F.col("_taken") - (F.col("copy") - 1) * F.col("n")
    # the cut copy ends with the word that fills the budget, its white space as it was
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), "")
    both = both.withColumn("text", F.when(left >= F.col("n"), F.col("text")).otherwise(cut))
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return both.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES = {
    "op4_mixing": f"""
with n as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size from n group by source),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight, row_number() over (order by source nulls last) as rank from s),
b as (select *, sum(source_size) over () as all_size, sum(weight) over () as all_weight,
    coalesce(3 * sum(source_size) over (order by source_size / weight::double, rank rows between unbounded preceding and 1 preceding), 0) as full_before,
    coalesce(sum(weight) over (order by source_size / weight::double, rank rows between unbounded preceding and 1 preceding), 0) as weight_before from w),
f as (select *, 3 * source_size * (all_weight - weight_before) < weight * (all_size - full_before) as is_full from b),
t as (select source, source_size, case when is_full then (3 * source_size)::double else
    (weight * (all_size - sum(case when is_full then 3 * source_size else 0 end) over ()))::double / (all_weight - sum(case when is_full then weight else 0 end) over ())::double end as target from f),
p as (select n.doc_id, n.size, t.source_size, t.target, least(floor(t.target)::bigint, 3 * t.source_size) as budget,
    coalesce(sum(n.size) over (partition by n.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before_it
    from n join t on n.source is not distinct from t.source),
e as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p)
select doc_id, size, source_size, target, (epochs * size + least(greatest(budget - epochs * source_size - before_it, 0), size))::bigint as taken from e
"""
}
QUERIES = {"op4_mixing": op4_mixing}
