"""Operators of trove.llm against brute force, on planted and on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trove.llm.common import hash_words, window_hashes
from trove.llm import clusters, html_text, line_dedup, mixing, order_minhash, quality, sentence_pieces, sharding, spotsigs, substring_dedup, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, size int, bucket string, label int"


def frame(spark, rows):
    """rows: (doc_id, text, source); the other columns bear names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", 1, "b", 2) for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(("the", "of", "and", f"w{rng.randrange(400)}", f"w{rng.randrange(5000)}")) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((3, 40, 60, 120, 300))) for _ in range(50)]
    passage = prose(rng, 70)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(6)]
    texts += [texts[4], texts[4], texts[7]]
    near = texts[9].split() if len(texts[9].split()) > 100 else prose(rng, 300).split()
    texts += [" ".join(near), " ".join([*near[:50], "changed", *near[51:]]), " ".join(near[3:])]
    texts += [None, "", " \n\t ", "one", "the the the the", "é\u2581 \U0001f984x\u00a0y", " ".join(["again"] * 3000)]
    rows = [(i * 7 % 101, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[5], "s1"), (rows[3][0], texts[8], "s2")]


ROWS = corpus()


# --- 1


def removed_by_hand(rows):
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for q in range(len(w) - 49):
            s = tuple(w[q : q + 50])
            first[s] = min(first.get(s, math.inf), key(i))
    out = collections.Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for q in range(len(w) - 49):
            if first[tuple(w[q : q + 50])] < key(i):
                gone |= set(range(q, q + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("parts", [(1, 1), (7, 5)])
def test_substring_dedup(spark, monkeypatch, parts):
    sizes = iter(parts)
    monkeypatch.setattr(substring_dedup, "_parts", lambda *_: next(sizes))
    made = substring_dedup.remove_repeats(frame(spark, ROWS)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in made)
    assert got == removed_by_hand(ROWS)
    assert all(sum(s.end - s["first"] for s in r.spans) == r.n_removed for r in made)


# --- 2


def test_beside_next(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 9)
    order = sorted(((i, t or "") for i, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()), reverse=True)
    want = collections.Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    got = collections.Counter((r.doc_id, r.text, r.next_text) for r in spotsigs.beside_next(frame(spark, ROWS)).collect())
    assert got == want


def spots_by_hand(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    common = set(spotsigs.ANCHORS)
    content = [w for w in words if w not in common]
    out, before = set(), 0
    for w in words:
        if w in common:
            if before + 1 < len(content):
                out.add((w, content[before], content[before + 1]))
        else:
            before += 1
    return out or {(w,) for w in words} or ({text} if text else set())


def test_fingerprints(spark):
    rows = [(k, t, "s") for k, (_, t, _) in enumerate(ROWS)]
    made = {r.doc_id: r for r in frame(spark, rows).select("doc_id", spotsigs.spot_set(F.col("text")).alias("s"), spotsigs.fingerprint(spotsigs.spot_set(F.col("text"))).alias("f")).collect()}
    for k, t, _ in rows:
        assert len(made[k].s) == len(spots_by_hand(t or "")) == len(made[k].f) // 8
    same = collections.defaultdict(set)
    for k, t, _ in rows:
        same[t or ""].add(made[k].f)
    assert all(len(v) == 1 for v in same.values())
    x = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([], [1]), ([1], [1, 2, 3, 4])], "a array<int>, b array<int>")
    assert [r[0] for r in x.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0, 0.25]
    assert [r[0] for r in x.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.5, 1.0, 0.0, 0.0]


def classes(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed=8):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = prose(rng, 200).split()
        for k in range(6):
            w = list(base)
            for _ in range(k * 2):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(w))
    out += [out[0], out[0], out[13]]
    return [(k, t, "s") for k, t in enumerate(out)]


def stored_documents(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_spotsigs_query(spark, tmp_path):
    """The whole query against brute force: edited texts, likenesses and classes."""
    near = near_rows()
    rows = [(i * 7 % 83 + 5, t, "s") for i, t, _ in near] + [(300, None, "s"), (301, "", "s"), (302, "one", "s"), (303, prose(random.Random(1), 3000), "s"), (304, near[2][1], "s")]
    texts = {i: t or "" for i, t, _ in rows}
    order = sorted(texts, reverse=True)
    sets = {i: spots_by_hand(t) for i, t in texts.items()}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = classes([(a, b) for a, b in itertools.combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8], sets)
    got = {r.doc_id: r for r in spotsigs.op2_spotsigs(spark, stored_documents(spark, tmp_path, rows)).collect()}
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.class_id) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), want[i])
        assert r.near_edited == pytest.approx(jaccard(sets[i], spots_by_hand(edited)))
        assert r.near_next == pytest.approx(jaccard(sets[i], spots_by_hand(after)))
    assert len(got) == len(rows)


def test_sets_without_ids_are_told_apart(spark):
    rng = random.Random(3)
    rows = [(None, prose(rng, 80), "s"), (None, prose(rng, 80), "s"), (7, prose(rng, 90), "s"), (7, prose(rng, 90), "s"), (9, "", "s"), (8, None, "s")]
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in spotsigs.match_documents(frame(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (7, 7), (7, 7), (8, 8), (9, 8)]


def test_spot_classes(spark):
    rows = near_rows()
    sets = {k: spots_by_hand(t) for k, t, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.class_id for r in spotsigs.match_documents(frame(spark, rows)).collect()}
    assert got == classes(pairs, sets)


def test_signatures_bear_short_ids(spark, monkeypatch):
    """What is exploded and shuffled names its set by a number, and classes are as by hand."""
    stored, kept = {}, spotsigs.stage
    monkeypatch.setattr(spotsigs, "stage", lambda df, name: stored.setdefault(name, dict(df.dtypes)) and kept(df, name))
    rows = near_rows()[:8]
    sets = {k: spots_by_hand(t) for k, t, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.class_id for r in spotsigs.match_documents(frame(spark, rows)).collect()} == classes(pairs, sets)
    assert stored["spot-sets"]["id"] == "bigint"


# --- 3


def test_segmentation_has_the_right_chances():
    v = sentence_pieces.Vocabulary(sentence_pieces.read_model())
    by_text = collections.defaultdict(list)
    for i, b in enumerate(v.bytes_of):
        if i > 258:
            by_text[b].append(i)

    def paths(u):
        if not u:
            yield (), 0.0
        for j in range(1, len(u) + 1):
            for k in by_text.get(u[:j].encode(), ()):
                for rest, w in paths(u[j:]):
                    yield (k, *rest), w + v.log_weight[k]

    every = dict(paths(" hello"))
    total = sum(map(math.exp, every.values()))
    n = 40_000
    pieces, at = sentence_pieces.segment(v, ["hello"] * n, np.arange(n))
    seen = collections.Counter(tuple(pieces[i:j].tolist()) for i, j in itertools.pairwise(at))
    for path, w in every.items():
        p = math.exp(w) / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_units_do_not_depend_on_their_neighbours():
    """One unit's edges, alone and at many places of chunks; a million draws end with their units."""
    v = sentence_pieces.Vocabulary(sentence_pieces.read_model())
    rng = random.Random(12)
    others = [" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randrange(1, 15))) for _ in range(60_000)]
    unit = " internationalisation"
    one = sentence_pieces._filter(v, [unit], 1.0)
    for place in (1, 2, 3, 7, 999, 30_001, 59_999):
        first, _, ladder, size, ids = sentence_pieces._filter(v, [*others[:place], unit, *others[place:]], 1.0)
        at = int(first[place])
        lo, hi = np.searchsorted(ladder, [at + 1 << 32, at + len(unit) + 1 << 32], "right")
        assert (ladder[lo:hi] - (at << 32)).tolist() == one[2].tolist()
        assert (size[lo:hi].tolist(), ids[lo:hi].tolist()) == (one[3].tolist(), one[4].tolist())
    text = "".join(others)[1:]
    pieces, at = sentence_pieces.segment(v, [text, "", text], np.array([1, 2, 3]))
    assert v.decode(pieces, at) == [text.encode(), b"", text.encode()]


def test_units_are_filtered_once(monkeypatch):
    """Chunks after the first filter new units only; pieces are the same as where each chunk begins anew."""
    v = sentence_pieces.Vocabulary(sentence_pieces.read_model())
    rng = random.Random(31)
    chunks = [[prose(rng, 200) for _ in range(4)] for _ in range(3)]
    filtered, once = [], sentence_pieces._filter
    monkeypatch.setattr(sentence_pieces, "_filter", lambda v, units, alpha: filtered.extend(units) or once(v, units, alpha))
    keys = np.arange(4)
    got = [sentence_pieces.segment(v, c, keys) for c in chunks]
    assert len(filtered) == len(set(filtered))
    monkeypatch.setattr(sentence_pieces, "_HELD_EDGES", 0)
    for c, (pieces, at) in zip(chunks, got, strict=True):
        again = sentence_pieces.segment(v, c, keys)
        assert (again[0].tolist(), again[1].tolist()) == (pieces.tolist(), at.tolist())
    assert len(filtered) > len(set(filtered))
    assert v.decode(*got[2]) == [t.encode() for t in chunks[2]]


def test_segmentation_round_trip(spark):
    docs = frame(spark, ROWS).withColumn("pieces", F.lit("clash"))
    made = sentence_pieces.encode_documents(docs)
    assert made.filter("not lossless").count() == 0
    back = sentence_pieces.decode_documents(made).collect()
    assert collections.Counter((r.doc_id, r.text or "", r.decoded) for r in back) == collections.Counter((i, t or "", t or "") for i, t, _ in ROWS)
    again = sentence_pieces.encode_documents(docs.repartition(7)).collect()
    key = lambda rs: collections.Counter((r.doc_id, r.text, tuple(r.pieces)) for r in rs)
    assert key(again) == key(made.collect())
    assert key(sentence_pieces.encode_documents(docs, seed=12).collect()) != key(made.collect())


# --- 4


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, total, out = set(names), sum(sizes.values()), {}
    while left:
        w = sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * (total - sum(out.values())) / w >= 3 * sizes[s] and sizes[s] * 3 < weight[s] * (total - sum(out.values())) / w}
        if not over:
            share = total - sum(out.values())
            return out | {s: weight[s] * share / w for s in left}
        out |= {s: 3 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing(spark):
    made = mixing.mix_documents(frame(spark, ROWS)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in made:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
    want = targets_by_hand(sizes)
    for r in made:
        assert r.target == pytest.approx(want[r.source])
        assert r.source_size == sizes[r.source]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = mixing.mix_documents(frame(spark, ROWS).repartition(5)).collect()
    key = lambda rs: collections.Counter((r.doc_id, r.size, r.source, r.taken) for r in rs)
    assert key(again) == key(made)


def test_mixed_corpus(spark):
    rows = [(i, f"word{i} " * (i + 1), f"s{i % 2}") for i in range(40)]
    plan = {r.doc_id: r.taken for r in mixing.mix_documents(frame(spark, rows)).collect()}
    got = collections.Counter()
    for r in mixing.mixed_corpus(frame(spark, rows)).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
        assert rows[r.doc_id][1].startswith(r.text)
    assert got == {k: v for k, v in plan.items() if v}


# --- 5


def url_rows():
    rng = random.Random(2)
    out = []
    for i in range(600):
        if rng.random() < 0.5:
            out.append((i, f"https://www.{rng.choice(('news', 'books'))}{rng.randrange(50)}.example.com/fr/{rng.randrange(999)}"))
        else:
            out.append((i, f"http://{rng.choice(('cheap', 'pills'))}-{rng.randrange(50)}.example.net/es/{rng.randrange(999)}"))
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/?q", "http://example.com/english", "http://xexample.com/en/", "http://com", "x://a.net/fr/b#c", "http://" + "long/" * 5000]
    return out + [(1000 + k, u) for k, u in enumerate(odd)]


def test_url_rules_and_model(spark):
    rows = url_rows()
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    for i, u in rows:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        assert (got[i].host, got[i].path) == (host, path)
        fits = [(v, r) for v, r in rules for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert got[i].rule == (fits[0][1] if fits else None)
        if fits:
            assert got[i].verdict == fits[0][0]
    assert got[1000].verdict == "allow"


def test_url_model_held_out(spark):
    rows = [(i % 2 == 0, f"books{i % 37}.fine.org/fr/{i}" if i % 2 == 0 else f"pills{i % 41}.cheap.org/buy/{i}") for i in range(800)]
    df = spark.createDataFrame(rows, "accepted boolean, text string")
    model = url_filter.train(df.limit(500))
    _, accuracy = url_filter.calibrate(model, df.subtract(df.limit(500)))
    assert accuracy > 0.97
    one = model.scores(pa.array(["books1.fine.org/fr/1", "pills1.cheap.org/buy/2"]))
    assert one[0] > 0 > one[1]
    assert url_filter.train(df.filter("accepted")) is None


# --- 6


def test_banded_distance():
    rng = random.Random(4)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a = [rng.randrange(3) for _ in range(rng.randrange(12))]
        b = [rng.randrange(3) for _ in range(rng.randrange(12))] if rng.random() < 0.5 else [x for x in a if rng.random() < 0.8]
        d, limit = full(a, b), rng.randrange(12)
        assert order_minhash.edit_distance_within(a, b, limit) == (d if d <= limit else None)


def edits(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        low = np.minimum(row[1:] + 1, row[:-1] + np.array([x != y for y in b]))
        new = np.concatenate(([i], low))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def aligned(a, b):
    high = max(len(a), len(b))
    return a == b or bool(a and b) and abs(len(a) - len(b)) <= 0.2 * high + 1e-9 and edits(a, b) <= 0.2 * high + 1e-9


def test_near_classes(spark):
    rows = near_rows() + [(200, None, "s"), (201, "", "s"), (202, "one two", "s"), (203, "one two", "s")]
    rows += [(300, "a b c d e f g h i j k l m n o p q r s t", "s"), (301, "a b c d e f g h i j k l m n o p q x y z", "s"), (302, "k l m n o p q r s t a b c d e f g h i j", "s")]  # the last one has the same words
    words = {k: WORD.findall(t or "") for k, t, _ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(words, 2) if aligned(words[a], words[b])]
    got = {r.doc_id: r.class_id for r in order_minhash.near_classes(frame(spark, rows)).collect()}
    assert got == classes(pairs, words)
    kept = sorted(r.doc_id for r in order_minhash.first_of_each(frame(spark, rows)).collect())
    assert kept == sorted({c for k, c in got.items() if words[k]} | {200, 201})


def test_leftover_texts_meet_in_blocks(spark, monkeypatch):
    """One bucket of texts that share about four fifths, in one block and in several: links join what brute force joins. Texts are not stored again."""
    rng = random.Random(41)
    base, texts = [f"p{k}" for k in range(60)], []
    for k in range(26):
        own = [f"o{rng.randrange(40)}" for _ in range(rng.choice((8, 14, 18, 24)))]
        texts.append(base[: 50 + k % 10] + own if k % 2 else own + base)
    words = [hash_words(np.frombuffer(" ".join(t).encode(), np.uint8))[2][0] for t in texts]
    want = classes([(a, b) for a, b in itertools.combinations(range(26), 2) if aligned(texts[a], texts[b])], range(26))
    assert 1 < len(set(want.values())) < 26
    for blocks in (1, 3):
        cells = [(7, min(k % blocks, j), max(k % blocks, j), k % blocks, k) for k in range(26) for j in range(blocks)]
        counts = [np.minimum(np.bincount((w >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for w in words]
        rows = pa.table({
            **{c: pa.array([x[n] for x in cells], pa.int32() if n else pa.int64()) for n, c in enumerate(("bucket", "low", "high", "block"))},
            "id": pa.array([bytes([x[4]]) for x in cells], pa.binary()), "size": pa.array([len(texts[x[4]]) for x in cells], pa.int32()),
            "label": pa.array([bytes([x[4]]) for x in cells], pa.binary()), "bins": pa.array([counts[x[4]] for x in cells], pa.binary()),
            "buckets": pa.array([[7] * 16 for _ in cells], pa.list_(pa.int64())),
        })
        partners = {r["id"][0] for r in order_minhash._blocks(rows).to_pylist()}
        links = order_minhash._blocks(rows.append_column("words", pa.array([words[x[4]].tobytes() for x in cells], pa.binary()))).to_pylist()
        assert classes([(r["a"][0], r["b"][0]) for r in links], range(26)) == want
        assert {k for r in links for k in (r["a"][0], r["b"][0])} <= partners
        assert blocks > 1 or len(links) == 26 - len(set(want.values()))
    stored, kept = [], order_minhash.stage
    monkeypatch.setattr(order_minhash, "stage", lambda df, name: stored.append(df.columns) or kept(df, name))
    order_minhash.near_classes(frame(spark, ROWS))
    assert not any("text" in c for c in stored)


def test_recall_of_candidates():
    """Pairs at all edit similarities from 0.85 on; more than 0.9 of them share a bucket."""
    rng = random.Random(15)
    found = n = 0
    for _ in range(300):
        a = [rng.randrange(4000) for _ in range(rng.choice((60, 150, 400)))]
        b = [rng.randrange(4000) if rng.random() < 0.1 else x for x in a]
        x, y = (order_minhash.sketch(order_minhash.shingles(np.array(w, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for w in (a, b))
        n += 1
        found += bool((x == y).any())
    assert found > 0.9 * n


def test_structured_words_do_not_collide(spark):
    """A Thue-Morse word of 1,024 letters and its complement, words that share long ends, and windows that are such words."""
    flip = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in flip), "".join("ba"[x] for x in flip)
    found = hash_words(np.frombuffer(f"{one} {two} {one}x x{one} abcdefgh abcdefghi abcdefgh\x00".encode(), np.uint8), 2)[2]
    assert all(len(set(h.tolist())) == 7 for h in found)
    words = [np.array([(7, 9)[x] for x in flip], np.uint64), np.array([(9, 7)[x] for x in flip], np.uint64)]
    assert window_hashes(words[0], 1024)[0] != window_hashes(words[1], 1024)[0]
    assert [len(window_hashes(words[0], k)) for k in (1, 5, 25, 50, 1024, 1025)] == [1024, 1020, 1000, 975, 1, 0]
    assert window_hashes(words[0], 50)[7] == window_hashes(words[0][7:57], 50)[0]
    rows = [(i, " ".join((one, two)[(x + i) % 2] for x in flip[:64]), "s") for i in (0, 1)]
    assert {r.n_removed for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()} == {0}
    assert len({r.class_id for r in order_minhash.near_classes(frame(spark, rows)).collect()}) == 2


def test_leftover_pairs_are_compared(spark):
    """A chain in one bucket: the hub is like its neighbours only, yet no link is lost."""
    feature = {i: set(range(i * 2, i * 2 + 40)) for i in range(12)}
    rows = [(1, i, 40) for i in feature]
    like = lambda a, b: len(feature[a] & feature[b]) >= 0.8 * len(feature[a] | feature[b])
    ok = spark.createDataFrame([(a, b) for a, b in itertools.combinations(feature, 2) if like(a, b)], "a long, b long")
    own = spark.createDataFrame([(i, sorted(fs)) for i, fs in feature.items()], "id long, features array<int>")
    labels, links = clusters.resolve(spark.createDataFrame(rows, "bucket long, id long, size int"), lambda p: p.join(ok, ["a", "b"]), 0.8, [(lambda ids: own.join(ids, "id"), lambda x: x * 0.8)], lambda x, y: (x + y) * (0.8 / 1.8))
    assert {r.label for r in labels.collect()} == {0}
    assert links.count() >= 11


# --- 7 and 9


def letters(rng, n):
    """Prose on one line, without digits: keys of lines hold all digits alike."""
    return prose(rng, n).replace("\n", "").translate(str.maketrans("0123456789", "abcdefghij"))


def boilerplate_rows():
    rng = random.Random(6)
    rows = [(i, f"{letters(rng, 80)}\nShare this page {i % 7}\n{letters(rng, 10)}", "host") for i in range(60)]
    rows += [(100 + i, "\n".join(["Share this page 3"] * 20), "host") for i in range(2)]
    copied = "\n".join(letters(rng, 30) for _ in range(3))
    return rows + [(200 + i, copied, "host") for i in range(30)] + [(300, None, "host"), (301, "", None), (302, "lone line", "other")]


def test_line_dedup_and_quality(spark):
    rows = boilerplate_rows()
    made = {r["row"].doc_id: r for r in line_dedup.drop_lines(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not x.startswith("Share this page")]
        assert made[i].text == (None if t is None else "\n".join(keep))
        assert made[i].n_dropped == len(lines) - len(keep)
    other = {r["row"].doc_id: r.text for r in line_dedup.drop_lines(frame(spark, rows), broadcast_lines=0).collect()}
    assert other == {i: r.text for i, r in made.items()}
    judged = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows)).collect()}
    assert all(judged[i].kept for i in range(60))
    assert all(judged[i].kept for i in range(200, 230))  # copies are no boilerplate
    assert not any(judged[i].kept for i in (100, 101, 300, 301, 302))


def test_base_rules(spark):
    rows = [(k, t, "s") for k, (_, t, _) in enumerate(ROWS)] + [(500, "a b c a b c a b", "s"), (501, "#x *$\n\n#x *$\n&|<>% a_b", "s")]
    got = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows)).collect()}
    for k, t, _ in rows:
        w = WORD.findall(t or "")
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


# --- 8


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i % 900, "x" * rng.randrange(400) + "é", "s") for i in range(1500)] + [(None, None, "s"), (5, "same", "s"), (5, "same", "s")]
    made = sharding.shard_documents(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in made) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in made:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(load) == list(range(8))
    assert max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_maps_are_versioned_and_edited(spark, tmp_path):
    rows = [(i, "x" * (i % 50), "s") for i in range(2000)]
    path = str(tmp_path / "maps")
    first = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, rows), 4, 256, path).collect()}
    second = sharding.shard_documents(frame(spark, rows), 5, 256, path).collect()
    moved = [r for r in second if r.shard != first[r.doc_id]]
    assert {r.shard for r in moved} == {4}
    assert 0.1 < len(moved) / len(rows) < 0.3
    assert sharding.load_map(spark, path)[0] == 2
    assert sharding.load_map(spark, path, 1)[1] != sharding.load_map(spark, path, 2)[1]


def test_half_written_maps_are_passed_over(spark, tmp_path):
    path = tmp_path / "maps"
    sharding.store_map(spark, {0: 0, 1: 1}, 1, str(path))
    (path / "version=2").mkdir()
    assert sharding.load_map(spark, str(path)) == (1, {0: 0, 1: 1})
    assert sharding.next_map(spark, {0: (5, 1), 1: (50, 2)}, 1, 2, str(path)) == (3, {0: 0, 1: 0})
    assert sharding.load_map(spark, str(tmp_path / "none")) == (0, {})


def test_sharding_query(spark, tmp_path):
    rows = [(i, "x" * (i % 90), "s") for i in range(3000)]
    made = sharding.op8_sharding(spark, stored_documents(spark, tmp_path, rows)).collect()
    load = collections.Counter()
    for r in made:
        load[r.next_shard] += r.size
        assert r.next_shard in (r.shard, 8)
    assert len(made) == 3000 and max(load.values()) <= 1.021 * sum(load.values()) / 9


# --- 10


def test_html():
    page = """<html><head><title>T</title></head><body><header class="site"><h1>Site</h1><a href=x>Home</a></header><div class="cookie-notice">We use cookies</div><nav>a b</nav>
<main><article><header><h1>Real &eacute; title</h1></header><p>First   para
 with <b>bold</b> &amp; text.<p>Second para<br>after break</p><aside>Related junk</aside><div class="ad">Buy now</div><form>Sign up<input></form><p>Third.</p><ul><li>one<li>two</ul><!-- no --><script>var a="<p>";</script>
<section id="comments"><h3>Comments</h3><p>Great article, thanks for sharing it!</p></section></article></main><div class="sidebar"><p>Side story that is quite long and looks like prose, really.</p></div><footer>(c) 2020</footer>"""
    assert html_text.extract(page).split("\n") == ["Real é title", "First para with bold & text.", "Second para after break", "Third.", "one", "two"]
    assert html_text.extract(None) == html_text.extract("") == ""
    assert html_text.extract("<p>" + "word " * 100000) == " ".join(["word"] * 100000)
    bare = "<div><a href=1>Home</a> <a href=2>About</a></div>" + "<p>A long paragraph of prose that says something about the matter at hand, at length.</p>" * 3
    assert html_text.extract(bare).count("\n") == 2


PROSE = "A long paragraph of prose, which says something about the matter at hand, and says it at some length."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="wrapper has-sidebar"><article><p>{PROSE}</p></article></div></body>',
        f'<body><form id="aspnetForm"><nav><a href=1>Home</a></nav><article><p>{PROSE}</p></article></form></body>',
        f'<body><article><div class="post-content share-enabled"><p>{PROSE}</p></div></article></body>',
        f'<body><main><div class="news-alert"><p>{PROSE}</p></div></main></body>',
        f'<body class="layout-with-sidebar no-comments"><div class="post-12 category-news tag-search"><article class="post"><p>{PROSE}</p></article></div><div class="sidebar"><p>{PROSE}</p></div></body>',
        f'<div id="content"><p>{PROSE}</div><div id="site-footer"><p>{PROSE}</p></div><div class="main-nav">{PROSE}</div>',
    ],
)
def test_names_do_not_hide_articles(page):
    assert html_text.extract(page) == PROSE


def test_math_and_cut():
    assert html_text.extract(f"<article><p>{PROSE}</p><math><mi>x</mi> = 1</math></article>") == f"{PROSE}\nx = 1"
    page = "<div>" + f"<p>{PROSE}</p>" * 3 + "<p>Not so</p>" + f"<p>{PROSE}</p>" * 3 + "</div><div><a href=1>Home</a></div><div><a href=2>News</a></div>"
    found, odds, keep = html_text.label(page, html_text.Costs())
    assert odds[3] < 0 and keep == [True] * 7 + [False] * 2  # the cut turns the short block's label, which its own costs had wrong
    assert [b.text for b in found][3] == "Not so"


def test_hostile_pages_take_time_in_proportion():
    pages = ["<button>" * 125_000, "<p>a<nav>b" * 100_000, "<div>" * 200_000 + "</p>" * 200_000, '<a ="' * 200_000, "<a '" * 250_000 + ">", "<!-" * 300_000 + "-->", "<script>" * 100_000, "<p>x y z w. " * 80_000, "<li><a href=1>a b c</a><p>A b c d." * 30_000]
    for page in pages:
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 8, page[:20]


def test_costs_are_fitted(spark):
    rows = [(i, f"http://h/{i}", f"<nav><ul><li><a href=1>Home {i}</a><li>Up</ul></nav><article><h1>Title</h1>" + f"<p>{PROSE}</p>" * 4 + "<p>Short.</p></article><footer>by us</footer>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    costs = html_text.fit_pages(pages)
    assert costs != html_text.Costs() and costs == html_text.fit_pages(pages.repartition(5))
    wrong = n = 0
    for _, _, page in rows:  # by the text alone, its markup withheld
        elements, found = html_text.parse(page)
        keep = html_text.min_cut(html_text.text_evidence(found, costs.weights).tolist(), html_text.edges_of(found, costs.smoothing))
        n += len(found)
        wrong += sum(k != (5 > i - 2 >= -0 or i in (2, 7)) for i, k in enumerate(keep) if i not in (2, 7))
    assert wrong <= 0.1 * n
    made = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert made[3] == "Title\n" + f"{PROSE}\n" * 4 + "Short."


def test_min_cut_is_least():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.6]
        cost = lambda keep: sum(max(0, x) if not k else max(0, -x) for x, k in zip(odds, keep, strict=True)) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: E731, B023
        assert cost(html_text.min_cut(odds, edges)) == pytest.approx(min(cost(k) for k in itertools.product((True, False), repeat=n)))


# --- all


def test_empty_tables(spark):
    docs = frame(spark, ROWS).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for made in (
        substring_dedup.remove_repeats(docs), spotsigs.beside_next(docs), spotsigs.match_documents(docs), sentence_pieces.encode_documents(docs), mixing.mix_documents(docs), mixing.mixed_corpus(docs),
        url_filter.filter_urls(pages), order_minhash.near_classes(docs), order_minhash.first_of_each(docs), quality.judge_documents(docs), quality.good_documents(docs),
        sharding.shard_documents(docs), line_dedup.cleaned(docs), html_text.extract_pages(pages),
    ):
        assert made.collect() == []


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = frame(spark, ROWS + boilerplate_rows())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert out.count() > 0
    assert "pieces" in corpus_pipeline.STAGES[-1][1](spark, docs, "").columns
