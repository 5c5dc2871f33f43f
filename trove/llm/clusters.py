"""Classes of similar records from buckets of candidates, without all pairs of a bucket.

A bucket's members are first compared with one hub, the member that shares buckets with most others, then with two more
where that leaves the bucket split, and where it still is with the most typical member of its largest components (the one
whose features most others have). Verified links are joined into components; later links join components, not records.
Members of a bucket that are in one component need no more comparison. What is left, pairs across the components of a
bucket, is met by what the caller gives (Order MinHash: counts of words, compared by vectors) or by features, one kind after the other: similar records must share some number k of their n features. A
record that has fewer than k features in common with all others together is out. Of the last kind, with features ordered
from rare to common, similar records share one of the first n - k + 1 of each. So no link between candidates of a bucket
is lost, and a large group of copies costs about as many comparisons as it has members. A feature of many records is
split over tasks by salts, in proportion to how many have it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trove.llm.common import discard, stage
from trove.operators.graph import components as contracted

HUBS = 3  # members of a bucket that all others are compared with: one at first, the others where it is still split
FEW_LINKS = 20_000  # links of two ids of up to 16 bytes that the driver takes in at once
SALT_ROWS = 500  # records of one feature that meet others in one task


def components(links: DataFrame) -> DataFrame:
    """(id, label) of all ids in links (a, b). Few links, whose number is known, are joined at once by the driver, more by rounds of tables."""
    links = stage(links.select("a", "b").distinct(), "links")
    if links.count() > FEW_LINKS:
        return contracted(links)
    up: dict = {}

    def root(x):  # noqa: ANN001, ANN202
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for a, b in links.collect():
        low, high = sorted((root(a), root(b)))
        up[high] = low
    kind = links.schema["a"].dataType
    return links.sparkSession.createDataFrame([(x, root(x)) for x in list(up)], StructType([StructField("id", kind), StructField("label", kind)]))


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after more links (a, b): components of the links between labels, laid over the old labels."""
    names = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    own = links.join(names("a"), "a", "left").join(names("b"), "b", "left")
    over = stage(components(own.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))), "labels")
    new = over.select(F.col("id").alias("old"), F.col("label").alias("new"))
    moved = labels.join(new, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
    return stage(moved.unionByName(over.join(labels, "id", "left_anti").select("id", "label")), "labels")


def resolve(
    buckets: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    ratio: float,
    features: list[tuple[Callable[[DataFrame], DataFrame], Callable[[Column], Column]]],
    both: Callable[[Column, Column], Column],
    done: Callable[[], None] = lambda: None,
    meet: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(id, label) of all ids with a link, and the verified links (a, b).

    buckets: (bucket, id, size); verify: pairs (a, b) to the rows of them that are similar; ratio: sizes of similar records
    are not further apart; features: kinds of features, each with a function of ids to (id, features), an array of whole
    numbers, and one that tells how many of them a record of so many shares at least with any similar one; both: the same
    for the last kind, by the numbers of two records; done: called when what verify or features gave has been stored;
    meet: in place of features, a function of what is left (bucket, id, size, label) to verified links (a, b) that join
    all labels which similar members of a bucket have.
    """
    alike = lambda x, y: F.least(x, y) >= F.greatest(x, y) * ratio - 1e-9
    size_class = F.floor(F.log(F.col("size").cast("double")) / (math.log(1 / ratio) + 1e-6))  # alike sizes are in one or in neighbouring ones

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        done()
        return out

    def left(members: DataFrame, labels: DataFrame) -> DataFrame:
        """bucket, id, size, label of those members that have one of another label and an alike size in their bucket."""
        marked = members.select("bucket", "id", "size").join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("label", "id").alias("label"), size_class.alias("c"))
        marked = stage(marked, "marked")
        around = marked.select("bucket", "label", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c")).groupBy("bucket", "c").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        rest = stage(marked.join(around.filter("low < high").select("bucket", "c"), ["bucket", "c"]).drop("c"), "rest")
        discard(marked)
        return rest

    def compare(members: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs of members and hubs (bucket, hub, hub_size, hub_label) of other labels that were not tried, and those that are similar."""
        pairs = members.join(hubs, "bucket").filter((F.col("label") != F.col("hub_label")) & alike(F.col("size"), F.col("hub_size")))
        pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        return pairs, kept(verify(pairs).select("a", "b"), "verified")

    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    live = stage(buckets.join(sizes, "bucket"), "buckets")
    held = stage(live.join(live.groupBy("id").agg(F.sum("n").alias("degree")), "id").select("bucket", "id", "size", "degree"), "buckets")
    discard(live)
    tried = None
    order = Window.partitionBy("bucket").orderBy(F.desc("degree"), "id")
    hubs = held.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= HUBS)
    hubs = stage(hubs.select("bucket", F.col("id").alias("hub"), F.col("size").alias("hub_size"), F.col("id").alias("hub_label"), "turn"), "hubs")
    tried, links = compare(held.withColumn("label", F.col("id")), hubs.filter("turn = 1").drop("turn"))
    labels = stage(components(links), "labels")
    rest = left(held, labels)
    discard(held)
    if rest.isEmpty():
        return labels, links
    more_hubs = rest.select("bucket", F.col("id").alias("hub"), F.col("size").alias("hub_size"), F.col("label").alias("hub_label")).join(hubs.filter("turn > 1").select("bucket", "hub"), ["bucket", "hub"])
    pairs, more = compare(rest, more_hubs)
    links, tried = links.unionByName(more), tried.unionByName(pairs)
    if not more.isEmpty():
        labels = joined_labels(labels, more)
    if meet is not None:
        rest = left(rest, labels)
        if rest.isEmpty():
            return labels, links
        more = kept(meet(rest), "verified")
        links = links.unionByName(more)
        return (joined_labels(labels, more), links) if not more.isEmpty() else (labels, links)
    able = None
    for turn, (kind, own) in enumerate(features):
        rest = left(rest if able is None else rest.join(able.select("id"), "id", "left_semi"), labels)
        if rest.isEmpty():
            return labels, links
        held_by = kept(kind(rest.select("id").distinct()), "features")
        each = held_by.select("id", F.explode("features").alias("feature"))
        counts = each.groupBy("feature").agg(F.count("*").alias("n")).filter("n > 1")  # a feature of one record brings no pair
        per = each.join(counts, "feature").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "feature"))).alias("common"))  # a record's own
        room = held_by.select("id", F.size("features").alias("all")).join(per, "id")
        room = room.withColumn("slots", F.size("common") - F.greatest(F.ceil(own(F.col("all")) - 1e-9), F.lit(1)).cast("int") + 1).filter("slots > 0")
        able = stage(room, "able")
        discard(held_by)
        if turn == 0:
            central = able.select("id", (F.aggregate("common", F.lit(0).cast("long"), lambda t, x: t + x["n"]) / F.col("all")).alias("central"))
            inside = rest.groupBy("bucket", "label").agg(F.count("*").alias("n")).filter("n > 1")
            largest = inside.withColumn("turn", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), "label"))).filter(F.col("turn") <= HUBS).select("bucket", "label")
            best = rest.join(central, "id").groupBy("label").agg(F.max(F.struct("central", "id", "size")).alias("best"))  # one a component, whatever the bucket
            typical = largest.join(best, "label").select("bucket", F.col("best.id").alias("hub"), F.col("best.size").alias("hub_size"), F.col("label").alias("hub_label"))
            pairs, more = compare(rest.join(able.select("id"), "id", "left_semi"), typical)
            links, tried = links.unionByName(more), tried.unionByName(pairs)
            if not more.isEmpty():
                labels = joined_labels(labels, more)
    rest = left(rest.join(able.select("id"), "id", "left_semi"), labels)
    if rest.isEmpty():
        return labels, links
    facts = rest.groupBy("id").agg(F.first("size").alias("size"), F.first("label").alias("label"))  # one size and label an id
    prefix = able.join(facts, "id").select("id", "size", "label", "all", F.size("common").alias("n"), F.posexplode(F.slice("common", F.lit(1), F.col("slots"))).alias("place", "f"))
    # at the first feature that two records share, at most what stands after it in each is shared besides
    prefix = stage(prefix.select(F.col("f.feature").alias("feature"), "id", "size", "label", "all", (F.col("n") - F.col("place")).alias("after")), "prefixes")
    # of any pair across labels, one record at least has not the feature's most frequent label
    usual = prefix.groupBy("feature", "label").agg(F.count("*").alias("n")).groupBy("feature").agg(F.max(F.struct("n", "label"))["label"].alias("usual"), F.count("*").alias("labels"), F.sum("n").alias("holders")).filter("labels > 1")
    mixed = prefix.join(usual, "feature").withColumn("salts", F.ceil(F.col("holders") / SALT_ROWS).cast("int"))
    mixed = stage(mixed.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")), "mixed")
    x = mixed.filter("label <> usual").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    y = mixed.alias("y")
    could = F.least("x.after", "y.after") >= both(F.col("x.all"), F.col("y.all")) - 1e-9
    once = (F.col("y.label") == F.col("y.usual")) | (F.col("x.id") < F.col("y.id"))
    cross = x.join(y, (F.col("x.feature") == F.col("y.feature")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label")) & once & could & alike(F.col("x.size"), F.col("y.size")))
    cross = cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = kept(verify(cross).select("a", "b"), "verified")
    links = links.unionByName(more)
    return (joined_labels(labels, more), links) if not more.isEmpty() else (labels, links)
