"""The whole pipeline against a plain version of its stages, and operators on a very long text."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import WORD, aligned, classes, frame, letters, stored_documents, targets_by_hand
from trove.llm import line_dedup, mixing, order_minhash, quality, sentence_pieces, sharding, spotsigs, substring_dedup


def plain_key(line):
    return re.sub(r"[ \t\x0b-\r]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" ")


def frequent(rows, share, least, most=None):
    """(host, key) of the lines on too many distinct pages."""
    pages = collections.defaultdict(set)
    for _, t, s in rows:
        keys = frozenset(k for x in t.split("\n") if (k := plain_key(x)))
        if keys:
            pages[s].add(keys)
    counts = collections.Counter((s, k) for s, ps in pages.items() for p in ps for k in p)
    return {x for x, n in counts.items() if n >= least and (n > share * len(pages[x[0]]) or (most is not None and n > most))}


def good(rows):
    rows = [(i, t or "", s) for i, t, s in rows]
    bad = frequent(rows, quality.MAX_SHARE, quality.LEAST_DOCS, quality.MAX_DOCS)
    for i, t, s in rows:
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lost = sum(len(WORD.findall(x)) for x in t.split("\n") if (s, plain_key(x)) in bad)
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and len(w) - lost >= quality.LEAST_LEFT * len(w):
            yield i, t, s


def without_lines(rows):
    bad = frequent(rows, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    return [(i, "\n".join(x for x in t.split("\n") if (s, plain_key(x)) not in bad), s) for i, t, s in rows]


def firsts(rows):
    words = {i: WORD.findall(t) for i, t, _ in rows}
    label = classes([(a, b) for a, b in itertools.combinations(words, 2) if aligned(words[a], words[b])], words)
    return [r for r in rows if label[r[0]] == r[0]]


def mixed(rows):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t))
    out = []
    for source, target in targets_by_hand(sizes).items():
        budget = int(target + 1e-9)
        mine = sorted((int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16), i, t) for i, t, s in rows if s == source)
        while budget > 0:
            for _, i, t in mine:
                n = len(WORD.findall(t))
                if budget > 0:
                    spans = [m.end() for m in WORD.finditer(t)]
                    out.append((i, t if n <= budget else t[: spans[budget - 1]], source))
                    budget -= n
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(20)
    menus = [f"Home {k} About Contact" for k in range(2)]
    rows = []
    for i in range(90):
        text = "\n".join([menus[0]] * (i % 3 > 0) + [letters(rng, rng.choice((30, 70))) for _ in range(2)])
        rows.append((i, text, f"s{i % 3}" if i % 10 else None))
    for k in range(12):  # near and exact copies
        w = rows[k + 30][1].split(" ")
        if k % 3:
            w[len(w) // 2] = "changed"
        rows.append((200 + k, " ".join(w), rows[k + 30][2]))
    rows += [(300, None, "s1"), (301, "", "s1"), (302, "too short", "s2"), (303, "again and " * 60, "s0")]
    want = mixed(firsts(without_lines(list(good(rows)))))
    made = corpus_pipeline.run(spark, stored_documents(spark, tmp_path, rows)).collect()
    key = lambda rs: collections.Counter((i, t, s) for i, t, s in rs)
    assert key((r.doc_id, r.text, r.source) for r in made) == key(want)
    assert all(r.lossless and r.n_chars == len(r.text) for r in made)
    v = sentence_pieces.Vocabulary(sentence_pieces.read_model())
    assert all(v.decode(np.array(r.pieces, np.int64), np.array([0, len(r.pieces)])) == [r.text.encode()] for r in made)


def test_very_long_texts(spark):
    """Three megabytes in one text, its copy and a near copy, beside a short one."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" + ("\n" if k % 50 == 0 else "") for k in range(400_000)]
    long = " ".join(words)
    near = " ".join(words[:200_000] + ["x"] * 10 + words[200_000:])
    docs = frame(spark, [(1, long, "s"), (2, long, "s"), (3, near, "s"), (4, "short text", "s")])
    assert [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).sort("doc_id").collect()] == [(1, 0), (2, 400_000), (3, 400_000), (4, 0)]
    assert {r.doc_id: r.class_id for r in order_minhash.near_classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.class_id for r in spotsigs.match_documents(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.size for r in mixing.mix_documents(docs).collect()} == {1: 400_000, 2: 400_000, 3: 400_010, 4: 2}
    judged = {r.doc_id: r for r in quality.judge_documents(docs).collect()}
    assert (judged[1].n_words, judged[1].kept, judged[4].kept) == (400_000, True, False)
    assert {r["row"].doc_id: r.n_dropped for r in line_dedup.drop_lines(docs).collect()} == dict.fromkeys((1, 2, 3, 4), 0)
    assert {r.doc_id: r.size for r in sharding.shard_documents(docs).collect()}[1] == len(long) + 1
    assert all(r.lossless for r in sentence_pieces.encode_documents(docs).select("lossless").collect())
