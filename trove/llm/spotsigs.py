"""Document fingerprints by SpotSigs; DataFrame and SQL functions only.

Common words (articles, prepositions, ...) are anchors. An anchor and the chain of the next two content words after it
make a signature; a document's fingerprint is its set of signatures, hashed to 32 bits. Likeness is the Jaccard
similarity of two sets. For matching, sets are partitioned by length, so that only sets whose lengths allow the
threshold meet, candidates come from the rarest signatures of each set, and the Jaccard of a pair is not computed where
the lengths bound it below the threshold.

Defined cases: a text with words but no signature is fingerprinted by its words, one without words by its whole;
empty or null text has the empty set, which is like the empty set only; repeated rows are documents of their own,
ordered by doc_id (null last), then text, and ties beyond that are equal rows; very long texts are read whole; a class
whose rows have no doc_id has none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trove.functions.binding import let
from trove.llm.clusters import resolve
from trove.llm.common import discard, stage

#: Common words of English, French, German and Spanish.
ANCHORS = """
the of and to in a is that for it on as with be by are was this from at or not but an which have has had its their they he she we you
la le les de des et en un une du que qui dans pour par sur au aux est pas avec ce se il elle son ses ne plus ou mais sont
der die das und ist von zu den mit dem ein eine einer im auf nicht für sich als auch es an werden aus er bei nach wie oder sind
el los las y del una con no su para al lo como más pero sus o este sí porque esta entre cuando muy sin
""".split()


BROADCAST_CLASSES = 100_000  # rows of 40 bytes


def spot_set(text: Column) -> Column:
    """The sorted set of a text's signatures, array of int."""
    common = sorted(set(ANCHORS))

    def chain(found: Column, content: Column) -> Column:
        # the j-th anchor, at place i, has i - j content words before it
        spots = F.transform(found, lambda a, j: F.when(F.get(content, a["i"] - j + 1).isNotNull(), F.hash(a["w"], F.get(content, a["i"] - j), F.get(content, a["i"] - j + 1))))
        return F.array_distinct(F.filter(spots, lambda s: s.isNotNull()))

    def of(words: Column) -> Column:
        found = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda a: a["w"].isin(common))
        content = F.filter(words, lambda w: ~w.isin(common))
        spots = let(F.struct(found.alias("f"), content.alias("c")), lambda s: chain(s["f"], s["c"]))
        return let(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array_distinct(F.transform(words, lambda w: F.hash(w)))))

    words = F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")
    whole = F.coalesce(text, F.lit(""))
    sets = let(words, lambda w: F.when(F.size(w) > 0, of(w)).otherwise(F.when(whole == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(whole)))))
    return F.sort_array(F.coalesce(sets, F.array().cast("array<int>")))


def fingerprint(spots: Column) -> Column:
    """A set as text: eight hex digits a signature."""
    return F.array_join(F.transform(spots, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without a look at them where their lengths bound it below least."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    out = F.when(high == 0, 1.0).when(low == 0, 0.0).otherwise(exact)
    return (out if least <= 0 else F.when(low < high * least, 0.0).otherwise(out)).cast("double")


def length_class(spots: Column, least: float = 0.8) -> Column:
    """The partition of a set's length: sets as like as least are in the same or in neighbouring ones."""
    return F.when(F.size(spots) == 0, -1).otherwise(F.floor(F.log(F.size(spots).cast("double")) / math.log(1 / least))).cast("int")


def set_print(spots: Column) -> Column:
    """128 bits that tell sets apart."""
    return F.unhex(F.md5(F.array_join(spots, ",")))


def matched_sets(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """print and class_id of the sets that two rows share or that another set is like; sets: doc_id, spots.

    A class is joined by pairs at least as like as `least`; its class_id is the smallest doc_id of its rows. Sets meet
    inside a partition of their length class and the one above it, under one of their rarest signatures.
    """
    members = sets.groupBy(set_print(F.col("spots")).alias("print")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"), F.first("spots").alias("spots"))
    # exploded signatures bear a stored number of eight bytes, not the print
    members = stage(members.withColumn("id", F.monotonically_increasing_id()), "spot-sets")
    each = members.select("id", F.size("spots").alias("size"), F.explode("spots").alias("spot"))
    seen = each.groupBy("spot").agg(F.count("*").alias("df")).filter("df > 1")  # a signature of one set brings no pair
    alone = each.join(seen, "spot")
    ranked = alone.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("df", "spot")))
    common = F.count("*").over(Window.partitionBy("id"))
    # the signatures that no other set has come first in the order, and take up that much of the prefix
    rare = ranked.withColumn("common", common).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1 - (F.col("size") - F.col("common")))
    own = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least)).cast("int")
    buckets = rare.select(F.explode(F.array(own, own + 1)).alias("part"), "spot", "id", "size").select(F.xxhash64("part", "spot").alias("bucket"), "id", "size")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = members.select(F.col("id").alias("a"), F.col("spots").alias("sa")), members.select(F.col("id").alias("b"), F.col("spots").alias("sb"))
        return pairs.join(a, "a").join(b, "b").filter(likeness(F.col("sa"), F.col("sb"), least) >= least)

    def features(ids: DataFrame) -> DataFrame:
        return members.join(ids, "id", "left_semi").select("id", F.col("spots").alias("features"))

    labels, _ = resolve(buckets, verify, least, [(features, lambda x: x * least)], lambda x, y: (x + y) * (least / (1 + least)))
    labelled = members.select("id", "print", "first_id", "rows").join(labels, "id", "left")
    named = stage(labelled.filter("rows > 1 or label is not null").select("print", "first_id", F.coalesce("label", "id").alias("label")), "spot-labels")
    smallest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    out = stage(named.join(smallest, "label").select("print", "class_id"), "spot-classes")
    discard(members, named)
    return out


def with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (with print and doc_id) and their class_id; a row that is like no other is a class of its own."""
    if classes.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES:  # the size is known to be small
        classes = F.broadcast(classes)
    found = classes.withColumn("known", F.lit(True))
    joined = rows.join(found, "print", "left")
    return joined.withColumn("class_id", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id"))).drop("known")


def match_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the documents that it is linked with, over pairs at least as like as least)."""
    sets = stage(docs.select("doc_id", spot_set(F.col("text")).alias("spots")), "spot-rows")
    rows = sets.select("doc_id", set_print(F.col("spots")).alias("print"))
    return with_class(rows, matched_sets(sets, least)).select("doc_id", "class_id")


# --- each document beside the next one -------------------------------------------------------------------------

MAX_CUTS, BUCKET_ROWS = 4096, 1000


def _buckets(docs: DataFrame) -> Column:
    """A bucket number that rises with doc_id: quantile ranges of ids, and equal parts of these where there are many rows."""
    rows = docs.count()
    n = min(MAX_CUTS, rows // BUCKET_ROWS)
    if n < 2:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0).cast("long")
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 20 * n)).head()[0]))
    parts = max(1, rows // (n * BUCKET_ROWS * 2))
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(F.get(bounds, lo + s - 1) <= F.col("doc_id"), lo + s).otherwise(lo))
    if parts > 1:
        low, high = F.get(bounds, F.greatest(at - 1, F.lit(0))), F.coalesce(F.get(bounds, at), F.lit(cuts[-1] + 1))
        part = F.least(F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * parts), F.lit(parts - 1))
        at = at.cast("long") * parts + F.greatest(part, F.lit(0))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(at).cast("long")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots and the next document's next_text, next_spots, in descending order of doc_id; the first follows the last.

    Rows are dealt to buckets of neighbouring ids; a bucket's last row gets the first row of the bucket after it.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("bucket", _buckets(texts))
    heads = texts.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    heads = stage(heads.select("bucket", F.col("head.text").alias("head_text")), "bucket-heads")  # a row a bucket
    order = heads.select("bucket").withColumn("after", F.lead("bucket").over(Window.orderBy(F.desc("bucket")))).withColumn("after", F.coalesce("after", F.max("bucket").over(Window.partitionBy())))
    heads = order.join(heads.select(F.col("bucket").alias("after"), "head_text"), "after").select("bucket", "head_text", spot_set(F.col("head_text")).alias("head_spots"))
    dealt = texts.repartition("bucket").withColumn("spots", spot_set(F.col("text")))
    down = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    dealt = dealt.withColumns({"lead_text": F.lead("text").over(down), "lead_spots": F.lead("spots").over(down)})
    both = dealt.join(heads, "bucket")
    return both.select("doc_id", "text", "spots", F.coalesce("lead_text", "head_text").alias("next_text"), F.coalesce("lead_spots", "head_spots").alias("next_spots"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = stage(docs.select("doc_id", spot_set(F.col("text")).alias("spots")), "spot-rows")
    classes = matched_sets(sets)
    discard(sets)
    rows = beside_next(docs)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    rows = rows.select("doc_id", "spots", n.cast("long").alias("n_chars"), "next_spots", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "spots", set_print(F.col("spots")).alias("print"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"), spot_set(F.col("edited")).alias("edited_spots"))
    made = rows.select(
        "doc_id", "n_chars", "edited_sha256", "print", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), "near_next", length_class(F.col("spots")).alias("length_class"),
    )
    return with_class(made, classes).drop("print")


QUERIES = {"op2_spotsigs": op2_spotsigs}
ORACLES: dict[str, str] = {}
