"""Near signatures in blocks, against all pairs one by one."""

import random

import pytest
from pyspark.sql import functions as F

from trove.operators import near, similar
from trove.operators.graph import components

SCHEMA = "path string, kind int, phash long, dhash long, chroma int, pixels long, size long, shallow string, decoded boolean, payload_hash string"


def rows(n, spread=9, top=64):
    """Items around a few signatures, some copies of others."""
    rng = random.Random(n)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    centres = [(rng.getrandbits(top), rng.getrandbits(top)) for _ in range(3)]
    out = []
    for k in range(n):
        p, d = (c ^ sum({1 << rng.randrange(top) for _ in range(rng.randrange(spread))}) for c in rng.choice(centres))
        if out and rng.random() < 0.2:
            p, d = (v & (1 << 64) - 1 for v in rng.choice(out)[2:4])
        out.append((f"/{rng.choice('ab')}/{'x' if rng.random() < 0.3 else ''}{k}.txt", rng.randrange(2), signed(p), signed(d), rng.choice([None, 0, 3, 12, 60, 120]), rng.randrange(5), rng.randrange(5), str(k), True, str(k)))
    return out


def is_near(x, y, limit=6):
    if x[1] != y[1] or any((a ^ b).bit_count() > limit if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() > limit for a, b in zip(x[2:4], y[2:4], strict=True)):
        return False
    if x[4] is None or y[4] is None:
        return True
    lo, hi = sorted((x[4], y[4]))
    return not (lo <= 6 and hi >= 10 or hi - lo >= 35 and hi >= min(2 * lo, 255))


def apart(x, y):
    return ((x[2] ^ y[2]) & (1 << 64) - 1).bit_count()


@pytest.mark.parametrize("block", [7, 8192])
@pytest.mark.parametrize("limit", [6, 13])
def test_pairs(spark, monkeypatch, block, limit):
    monkeypatch.setattr(near, "BLOCK", block)
    items = rows(90)
    want = sorted((x[0], y[0], apart(x, y)) for x in items for y in items if x[0].split("/") < y[0].split("/") and is_near(x, y, limit))
    assert sorted(map(tuple, similar.similar_pairs(spark.createDataFrame(items, SCHEMA), limit, limit).collect())) == want


@pytest.mark.parametrize("block", [7, 8192])
def test_groups_and_matches(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    items = rows(90)
    group = {x[0]: {x[0]} for x in items}
    for x in items:
        for y in items:
            if is_near(x, y) and group[x[0]] is not group[y[0]]:
                group[x[0]] |= group[y[0]]
                for p in group[y[0]]:
                    group[p] = group[x[0]]
    best = lambda xs: min((x for x in items if x[0] in xs), key=lambda x: (-x[6], -x[5], x[0].split("/")))
    want = sorted((k[0], x[0], apart(k, x)) for x in items if (k := best(group[x[0]]))[0] != x[0])
    assert sorted(map(tuple, similar.similar_groups(spark.createDataFrame(items, SCHEMA)).select("keeper", "path", "distance").collect())) == want
    a, b = items[:45], items[45:]
    want = sorted((m[0], y[0], apart(m, y)) for y in b if (m := min((x for x in a if is_near(x, y)), key=lambda x: (apart(x, y), -x[5], x[0].split("/")), default=None)))
    got = similar.best_matches(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).select("a", "b", "distance").collect()
    assert sorted(map(tuple, got)) == want


def test_links_of_a_large_group_are_few(spark):
    """3000 signatures of which every two are near: before, four and a half million links went into the components."""
    n = 3000
    items = spark.range(n).select(F.lit(0).alias("kind"), F.col("id").alias("phash"), F.lit(0).cast("long").alias("dhash"), F.lit(None).cast("int").alias("chroma")).withColumn("phash", F.expr("shiftleft(1L, cast(phash % 60 as int)) | shiftleft(1L, cast(phash div 60 as int))"))
    classes = similar.signature_classes(items)
    links = similar.similar_links(classes)
    assert links.count() <= 7 * classes.count()
    assert components(links).select("label").distinct().count() == 1


def test_empty(spark):
    none = spark.createDataFrame(rows(3), SCHEMA).limit(0)
    assert similar.similar_pairs(none).count() == similar.similar_groups(none).count() == similar.best_matches(none, none).count() == 0
