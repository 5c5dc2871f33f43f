"""How many pages of a host hold a line."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import frame, letters
from trove.llm import line_dedup, lines, quality


def test_pages_that_share_their_longest_line(spark):
    rng = random.Random(8)
    notice = "This long legal notice " * 40
    own = {i: f"{letters(rng, 30)}\n{letters(rng, 30)}" for i in range(100)}
    rows = [(i, f"Home About\n{t}\n{notice}", "host") for i, t in own.items()]
    rows += [(1000 + i, "one page\nthat was copied", "host") for i in range(40)]
    made = {r["row"].doc_id: r for r in line_dedup.drop_lines(frame(spark, rows)).collect()}
    assert all((made[i].text, made[i].n_dropped) == (t, 2) for i, t in own.items())
    assert all(made[1000 + i].n_dropped == 0 for i in range(40))  # copies count once
    judged = {r.doc_id: r for r in quality.judge_documents(frame(spark, rows)).collect()}
    assert all(judged[i].words_removed == 2 + len(notice.split()) and not judged[i].kept for i in own)


def test_shared_lines_do_not_shrink_the_host(spark):
    rng = random.Random(9)
    rows = [(i, f"{letters(rng, 20)}\n" + ("the shared notice " * 30 if i < 90 else "a rare line"), "host") for i in range(100)]
    docs = frame(spark, rows).select(lines.host_key(F.col("source")).alias("host"), F.array_compact(lines.line_keys(F.col("text"))).alias("keys"))
    found = {r.pages: r.host_pages for r in lines.frequent_lines(lines.line_rows(docs), 0.05, 5).collect()}
    assert found == {90: 100, 10: 100}
