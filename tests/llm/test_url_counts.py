"""What the URL models gather."""

from __future__ import annotations

import math
from collections import Counter

import pytest
import pyarrow as pa

from trove.llm import url_filter


def test_url_counts_are_exact(spark):
    rows = [(i % 2 == 0, f"h{i * 7919 % 1009}.org/{i * i % 9973}/é{i * 31 % 700}") for i in range(3000)]
    model = url_filter.train(spark.createDataFrame(rows, "accepted boolean, text string"))
    texts = ["h12.org/44/é1", "zz", rows[5][1], rows[8][1] * 3]
    seen = [Counter(), Counter()]
    for accepted, text in rows:
        data = [0] * 5 + [x + 1 for x in text.encode()]
        for i in range(5, len(data)):
            for k in range(5):
                seen[not accepted].update([("c", *data[i - k : i]), ("g", *data[i - k : i + 1])])
    want = []
    for text in texts:
        data, logs = [0] * 5 + [x + 1 for x in text.encode()], [0.0, 0.0]
        for side in (0, 1):
            for i in range(5, len(data)):
                p = 1 / 256
                for k in range(5):
                    p = (seen[side]["g", *data[i - k : i + 1]] + 4 * p) / (seen[side]["c", *data[i - k : i]] + 4)
                logs[side] += math.log(p)
        want.append((logs[0] - logs[1]) / (len(data) - 5))
    assert model.scores(pa.array(texts)).tolist() == pytest.approx(want, abs=1e-8)


def test_query_and_fragment_are_judged(spark):
    rows = [(i, f"http://a{i % 9}.com/go?to=school-{i}#top") for i in range(150)]
    rows += [(1000 + i, f"http://a{i % 9}.net/es/go?to=casino-bets-{i}") for i in range(150)]
    rows += [(2000, "http://a.xyz/go?to=school-1#top"), (2001, "http://a.xyz/go?to=casino-bets-1")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[2000].score > got[2001].score
    assert (got[2000].host, got[2000].path, got[2000].rule) == ("a.xyz", "/go", None)
