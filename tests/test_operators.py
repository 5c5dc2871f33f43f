"""Comparison, duplicates, verification, layers and plans on small relations."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trove.operators import compare, duplicates, graph, layers, verify
from trove.plans import library, naming

def files(spark, rows):
    """rows: path, shallow, bytes, payload, pixels, video, size, dated."""
    return spark.createDataFrame(rows, "path string, shallow string, bytes_hash string, payload_hash string, pixel_hash string, video boolean, size long, dated boolean").withColumn("decoded", F.col("payload_hash").isNotNull())


def test_compare_trees(spark):
    rng = random.Random(4)
    rows = [(t, f"/{t.lower()}/{k}", rng.randrange(25), rng.random() < 0.8) for t in "AB" for k in range(40)]
    t = spark.createDataFrame(rows, "tree string, path string, shallow long, decoded boolean")
    hashes = {s: {h for x, _, h, ok in rows if x == s and ok} for s in "AB"}
    want = {(p, ("duplicate" if h in hashes["B" if s == "A" else "A"] else f"{s.lower()}_only") if ok else "unreadable") for s, p, h, ok in rows if ok or s == "B"}
    assert {(r.path, r.category) for r in compare.compare_trees(t.filter("tree = 'A'"), t.filter("tree = 'B'")).collect()} == want
    groups = compare.duplicate_groups(t.filter("tree = 'A'"), t.filter("tree = 'B'")).collect()
    held = lambda s, h: sorted(p for x, p, g, ok in rows if (x, g, ok) == (s, h, True))
    assert {(g.n_a, g.n_b, g.first_a, g.first_b) for g in groups} == {(len(held("A", h)), len(held("B", h)), held("A", h)[0], held("B", h)[0]) for h in hashes["A"] & hashes["B"]}


def test_sets(spark):
    rng = random.Random(7)
    rows = [(t, f"{t}{k}", str(rng.randrange(30))) for t in "PQRS" for k in range(25)]
    t = spark.createDataFrame(rows, "tree string, path string, shallow string").withColumn("decoded", F.lit(True))
    a, c = t.filter("tree = 'P'"), t.filter("tree <> 'P'")
    of = lambda s: {h for x, _, h in rows if x == s}
    elsewhere = lambda s: set().union(*(of(x) for x in "QRS" if x != s))
    kind = {(s, p): "dup" if h in of("P") else "shared" if h in elsewhere(s) else "only" for s, p, h in rows if s != "P"}
    counts = compare.compare_sets(a, c)
    n = lambda s, k: sum(x == s and v == k for (x, _), v in kind.items())
    assert {(r.tree, r.duplicates, r.only_here, r.shared) for r in counts.collect()} == {(s, n(s, "dup"), n(s, "only"), n(s, "shared")) for s in "QRS"}
    assert compare.unique_in_a(a, c).head()[0] == len(of("P") - elsewhere("P"))
    assert tuple(compare.set_totals(counts).head()) == (sum(v == "dup" for v in kind.values()), sum(v != "dup" for v in kind.values()))


@pytest.mark.parametrize("seed", range(4))
def test_deep_scan(spark, seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("uvwxyz"[: rng.randrange(2, 7)]) for _ in range(rng.randrange(1, 6))] for _ in range(2))
    make = lambda s, xs: files(spark, [(f"/{s}/{i}", "h", x, x, x, False, 1, True) for i, x in enumerate(xs)])
    x, y = make("a", a), make("b", b)
    pairs = [(p, q) for p in a for q in b]
    want = (len(pairs), sum(p == q for p, q in pairs), sum(p != q and q in a for p, q in pairs), sum(q not in a for _, q in pairs))
    r = compare.deep_scan_counts(x, y).head()
    assert (r.checked, r.kept, r.covered, r.removed) == want
    assert compare.removed_pairs(x, y).count() == want[3]


def test_unknown_is_never_a_duplicate(spark):
    f = files(spark, [("/x/a", "0", "1", None, None, False, 1, True), ("/x/b", "0", "2", None, None, False, 1, True), ("/x/c", "9", "3", None, None, False, 1, True), ("/x/d", "9", "3", None, None, False, 1, True)])
    got = duplicates.confirmed_groups(f).select("path", "keeper").collect()
    assert {(r.path, r.keeper) for r in got} == {("/x/a", "/x/a"), ("/x/b", "/x/b"), ("/x/c", "/x/c"), ("/x/d", "/x/c")}


def test_keeper_prefers_dated_then_large_then_short(spark):
    f = files(spark, [("/x/long.jpg", "h", "1", "p", None, False, 5, True), ("/x/a.jpg", "h", "2", "p", None, False, 5, True), ("/x/big.jpg", "h", "3", "p", None, False, 9, False)])
    got = duplicates.confirmed_groups(f).orderBy("rank").collect()
    assert [r.path for r in got] == ["/x/a.jpg", "/x/long.jpg", "/x/big.jpg"]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "a long, b long")
    got = {r.id: r.label for r in graph.components(links).collect()}
    assert {got[i] for i in range(31)} == {0}
    assert {got[i] for i in (100, 101, 102)} == {100}
    assert graph.components(links.limit(0)).count() == 0


def test_verify(spark):
    rows = [("1987/11-09 fog/a.png", "1987:11:09 3:4:5"), ("1980/02-03/b.png", "1987-11-09"), ("box/c.png", "1987-11-09"), ("box/d.png", None), ("November 1987/e.png", "1987-11-09"), ("Oct 1987/f.png", "1987-11-09"), ("1987/11-09/g.png", "1987-11")]
    got = {r.path[-5]: (r.status, r.days_off, r.folder_date) for r in verify.verify_dates(spark.createDataFrame(rows, "path string, capture_date string")).collect()}
    apart = lambda *d: abs((datetime.date(*d) - datetime.date(1987, 11, 9)).days)
    assert got["a"] == ("ok", 0, "1987-11-09")
    assert got["b"] == ("mismatch", apart(1980, 2, 3), "1980-02-03")
    assert got["c"] == ("outside", None, None)
    assert got["d"][0] == got["g"][0] == "undated"
    assert got["e"] == ("ok", 0, "1987-11")
    assert got["f"] == ("mismatch", apart(1987, 10, 1), "1987-10")


def test_names(spark):
    """Random claims, many of which look like names that were made up, against a plain loop."""
    rng = random.Random(11)
    name = lambda: rng.choice(("a", "B", "b", "pic")) + rng.choice(("", "", " (1)", " (2)", " (1) (1)")) + rng.choice(("", ".gif", ".GIF"))
    claims = [(f"d{rng.randrange(4)}", k, name()) for k in range(160)]
    there = sorted({(f"d{rng.randrange(4)}", name()) for _ in range(12)})
    taken, want = {(d, n.lower()) for d, n in there}, {}
    for d, k, n in claims:
        stem, dot, ext = n.rpartition(".") if "." in n else (n, "", "")
        made, i = n, 0
        while (d, made.lower()) in taken:
            i += 1
            made = f"{stem} ({i}){dot}{ext}"
        taken.add((d, made.lower()))
        want[d, k] = made
    got = naming.claim_names(spark.createDataFrame(claims, "dir string, seq int, name string"), spark.createDataFrame(there, "dir string, name string")).collect()
    assert {(r.dir, r.seq): r.given for r in got} == want


def test_merge_plan(spark):
    rows = [("/one/1987/11-09 fog/x.png", "1", 9), ("/one/1987/11-09 fog/x too.png", "1", 9), ("/one/1987/12-24/y.gif", "2", 8), ("/two/1987/11-09/another.png", "1", 9), ("/two/1987/12-24 eve/bigger.gif", "2", 9), ("/two/1987/top.png", "3", 1)]
    f = files(spark, [(p, c, c, c, c, False, n, True) for p, c, n in rows]).withColumn("rel", F.regexp_replace("path", "^/(one|two)/", ""))
    got = {(r.target, r.action) for r in library.merge_plan(f, "/all", "/purg").collect()}
    assert got == {("/all/1987/11-09 fog/x.png", "keep"), ("/all/1987/12-24 eve/bigger.gif", "keep"), ("/purg/1987/11-09 fog/x too.png", "purge"), ("/purg/1987/11-09/another.png", "purge"), ("/purg/1987/12-24/y.gif", "purge")}


def test_consolidate_plan(spark):
    f = files(spark, [(f"/y/{p}", c, c, c, c, False, 1, True) for p, c in [("03-04/k.png", "1"), ("03-04/m.png", "2"), ("03-04 rain/l.png", "1"), ("03-04 rain/n.gif", "3"), ("05-06/q.png", "1")]])
    got = {(r.source, r.target, r.action) for r in library.consolidate_plan(f, "/y", "/purg").collect()}
    assert got == {("/y/03-04/m.png", "/y/03-04 rain/m.png", "move"), ("/y/03-04/k.png", "/y/03-04 rain/k.png", "move"), ("/y/03-04 rain/l.png", "/purg/03-04 rain/l.png", "purge")}


def test_layers(spark, tmp_path):
    schema = "volume string, rel_path string, size long, modified timestamp, shallow string, bytes_hash string, content_hash string, pixel_hash string, phash long, chroma int, dhash long, date_resolved boolean, capture_date string"
    row = lambda p, size, **k: ("v", p, size, None, *[k.get(c) for c in layers.LAYERS])
    old = spark.createDataFrame([row("d/a", 1, shallow="s", bytes_hash="b", date_resolved=True), row("d/b", 1, shallow="s", phash=1, date_resolved=True, capture_date="x")], schema)
    c = layers.coverage(old).head()
    assert (c.files, c.shallow_done, c.deep_done, c.phash_done, c.dates_done) == (2, 2, 1, 1, 2)
    fresh = spark.createDataFrame([row("d/a", 1, phash=5), row("d/b", 2, shallow="t"), row("d/c", 3)], schema)
    got = {r.rel_path: r for r in layers.upsert(old, fresh).collect()}
    assert (got["d/a"].shallow, got["d/a"].phash, got["d/b"].shallow, got["d/b"].phash, len(got)) == ("s", 5, "t", None, 3)
    assert layers.invalidate(old, "v", "d/a").count() == 1
    path = str(tmp_path / "store")
    assert layers.load(spark, path, old.limit(0)).count() == 0
    layers.save(old, path)
    layers.save(layers.upsert(layers.load(spark, path, old.limit(0)), fresh), path)
    assert layers.load(spark, path, old.limit(0)).count() == 3
    found = layers.lookup(fresh.select("volume", "rel_path", "size", "modified"), old).collect()
    assert {r.rel_path: r.valid for r in found} == {"d/a": True, "d/b": False, "d/c": False}


def test_broken_stores_are_caches(spark, tmp_path):
    rows = spark.createDataFrame([("v", "a", 1, 2, "s")], "volume string, rel_path string, size long, modified long, shallow string")
    path = str(tmp_path / "store")
    layers.save(rows, path)
    layers.save(rows.withColumn("size", F.lit(9).cast("long")), path)
    assert layers.load(spark, path, rows).head().size == 9
    for f in (tmp_path / "store" / "version=2").glob("*.parquet"):
        f.write_bytes(b"broken")
        (f.parent / f".{f.name}.crc").unlink()
    assert layers.load(spark, path, rows).head().size == 1  # the version before
    for f in (tmp_path / "store" / "version=1").glob("*.parquet"):
        f.write_bytes(b"PAR1 broken PAR1")
        (f.parent / f".{f.name}.crc").unlink()
    assert layers.load(spark, path, rows.limit(0)).count() == 0
    counts = spark.createDataFrame([(3, 4)], "reused long, computed long")
    assert tuple(layers.reuse_delta(counts, spark.createDataFrame([(10, 5)], "reused long, computed long")).head()) == (7, 1)
