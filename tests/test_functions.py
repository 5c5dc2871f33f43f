"""Scalar rules: dates, descriptions, templates, tags, paths, signatures."""

import calendar
import random

import pytest
from pyspark.sql import functions as F

from trove.functions import dates, paths, signatures, templates

LONG = [calendar.month_name[m] for m in range(1, 13)]
SHORT = [calendar.month_abbr[m] for m in range(1, 13)]
WORDS = ["lake", "Oslo", "grandma", "two dogs", "ÄÖ", "snow and ice", "x 5"]
GAPS = [" ", "-", ", ", ".", " _ "]


def named_folders(seed=21, n=600):
    """Random (name, date, rest): a date in one of the known shapes, or spoilt in a known way, among words."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y, m = rng.randrange(1900, 2101), rng.randrange(1, 13)
        d = rng.randrange(1, calendar.monthrange(y, m)[1] + 1)
        sep, gap, gap2 = rng.choice("-_."), rng.choice(GAPS), rng.choice(GAPS)
        month = rng.choice([LONG[m - 1], SHORT[m - 1], LONG[m - 1].upper(), SHORT[m - 1].lower(), "Sept" if m == 9 else LONG[m - 1]])
        day = rng.choice([str(d), f"{d:02}"])
        full, part = f"{y}-{m:02}-{d:02}", f"{y}-{m:02}"
        plain = d > 12 or d == m  # else day and month can't be told apart
        other = rng.choice([x for x in "-_." if x != sep])
        date, text = rng.choice([
            (full, f"{y}{sep}{m:02}{sep}{d:02}"), (full, f"{y}{m:02}{d:02}"), (full if plain else None, f"{d:02}{sep}{m:02}{sep}{y}"), (full if plain else None, f"{m:02}{sep}{d:02}{sep}{y}"),
            (full, f"{day}{gap}{month}{gap2}{y}"), (full, f"{month}{gap}{day}{gap2}{y}"), (part, f"{y}{sep}{m:02}"), (part, f"{month}{gap}{y}"),
            (None, f"{y}{sep}{m:02}{other}{d:02}"), (None, f"{y} {m:02} {d:02}"), (None, f"{y}{sep}{rng.randrange(13, 100)}{sep}{d:02}"), (None, f"{y}{sep}02{sep}{rng.choice((30, 31))}"), (None, f"{rng.choice((1899, 2101, 1500))}{sep}{m:02}{sep}{d:02}"),
            (None, f"{rng.randrange(32, 100)} {month} {y}"), (None, f"{y}{sep}{m:02}{sep}{d:02}k"), (None, f"k{y}{m:02}{d:02}"), (None, f"{y}{m:02}{d:02}7"), (None, f"{month}{gap}{y}k"), (None, str(y)), (None, f"{month}"),
        ])
        before, after = rng.choice(["", rng.choice(WORDS)]), rng.choice(["", rng.choice(WORDS)])
        if before.endswith("5") and text[0].isalpha():
            before = ""  # it would be a day before the month
        out.append((f"{before}{rng.choice((' ', ' (', '_')) if before else ''}{text}{rng.choice((' ', ') ', ' - ')) if after else ''}{after}", date, " ".join(x for x in (before, after) if x)))
    return out


def given(spark, rows, f):
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, want string").withColumn("got", f(F.col("x"))).orderBy("i").collect()
    return [(r.x, r.want, r.got) for r in out if r.want != r.got]


def test_folder_dates(spark):
    names = named_folders()
    assert sum(d is not None for _, d, _ in names) > 150
    assert given(spark, [(n, d) for n, d, _ in names], dates.folder_date) == []
    leap = [("2024-02-29 leap", "2024-02-29"), ("2023-02-29 leap", None), ("1900-02-29", None), ("", None), ("11-11-2011", "2011-11-11")]
    two = [("May 1999 then 1998-04-03", "1998-04-03"), ("1998-04-03 1997-02-01", "1998-04-03"), ("April 1998, 1997-02", "1998-04")]
    assert given(spark, leap + two, dates.folder_date) == []


def test_path_dates(spark):
    names = [(n, d) for n, d, _ in named_folders(5, 200) if "/" not in n and not n[:5].replace("-", "").isdigit()]
    rows = [(f"pool/{n}/a.jpg", d) for n, d in names] + [(f"{n}/raw/b/c.jpg", d) for n, d in names] + [(f"{n}/1/2/3/c.jpg", None) for n, _ in names]
    rows += [("1987/11-09/a.png", "1987-11-09"), ("1987/11-09 fog/a.png", "1987-11-09"), ("11-09/a.png", None), ("1987/11-31/a.png", None), ("x1987/11-09/a.png", None), ("1990-01-02/1991-03-04/a.png", "1991-03-04")]
    assert given(spark, rows, dates.folder_date_of) == []


def test_descriptions_and_events(spark):
    named = [(n, rest) for n, d, rest in named_folders(9) if d is not None]
    assert given(spark, named, templates.description) == []
    rows = [("11-09 fog", "fog"), ("fog 1987", "fog 1987"), ("1987-7-4 fog", "1987-7-4 fog"), ("1987-11-09", ""), ("2013-07 2013-07-4x and 2013-07", "2013-07-4x and 2013-07"), ("k2013-07 fog 2013-07", "k2013-07 fog")]
    assert given(spark, rows, templates.description) == []
    rows = [("1987-11-09 fog on ice", "fog-on-ice"), ("Nov 1987 fog", "fog"), ("fog 1987", "fog-1987"), ("11-09", ""), ("", "")]
    assert given(spark, rows, templates.event_of) == []


@pytest.mark.parametrize(("template", "want"), [("YYYY/MM-DD <folder description>", "1987/11 fog"), ("DESC YYYY.MM.DD", "fog 1987.11"), ("DD_MM/YYYY", "11/1987"), ("YYYY/MM/DD", "1987/11/")])
def test_month_templates(spark, template, want):
    got = spark.range(1).select(templates.render(F.lit(template), F.lit(1987), F.lit(11), F.lit(None).cast("int"), F.lit("fog"))).head()[0]
    assert got == want
    assert templates.without_day(template) == spark.range(1).select(templates.without_day_token(F.lit(template))).head()[0]


def test_date_parts(spark):
    rows = [("1987:11:09 03:04:05", "1987,11,9"), ("1987-11-30", "1987,11,30"), ("1987-11", "1987,11"), ("1987:00:09", None), ("1987:11:40", None), ("1987", None), ("1987-14", None), (None, None)]
    f = lambda c: F.when(dates.date_parts(c).isNotNull(), F.concat_ws(",", dates.date_parts(c)["year"], dates.date_parts(c)["month"], dates.date_parts(c)["day"]))
    assert given(spark, rows, f) == []


def test_timestamps(spark):
    rows = [("1987:11:09 03:04:05", "1987-11-09 03:04:05"), ("1987-11-09T03:04:05.678-09:30", "1987-11-09 03:04:05"), ("1987-11-09T03:04:05Z", "1987-11-09 03:04:05"), ("1987:11:09", "1987-11-09"), ("1987:11:09 24:00:00", None), ("1987:11:31", None), ("", None), (None, None)]
    assert given(spark, rows, dates.timestamp_text) == []
    assert spark.range(1).select(dates.timestamp_text(F.lit("1987:11:09"), F.lit("06:07:08"))).head()[0] == "1987-11-09 06:07:08"


def test_paths(spark):
    row = spark.range(1).select(
        (paths.parts(F.lit("a/x")) < paths.parts(F.lit("a-b/x"))).alias("order"), paths.rebase(F.lit("/r/a/b"), F.lit("/r"), F.lit("/p")).alias("in_"), paths.rebase(F.lit("/q/a/b"), F.lit("/r"), F.lit("/p")).alias("out"),
        paths.is_supported(F.lit("/x/A.CR2")).alias("raw"), paths.is_supported(F.lit("/x/a.txt")).alias("txt"), paths.is_video(F.lit("x.MoV")).alias("video"),
    ).head()
    assert (row["order"], row.in_, row.out, row.raw, row.txt, row.video) == (True, "/p/a/b", "/p/b", True, False, True)
    assert paths.common_parent_purgatory(["/a/b/x", "/a/c"]) == "/a/purgatory"
    assert paths.event_purgatory("/a/2004") == "/a/2004-purgatory"
    with pytest.raises(ValueError, match="tree"):
        paths.require_disjoint("/a/b", "/a")
    paths.require_disjoint("/a/b", "/a/bc")


def test_signatures(spark):
    row = spark.range(1).select(signatures.distance(F.lit(0).cast("long"), F.lit(2**7 - 1)).alias("d"), signatures.distance(F.lit(-1).cast("long"), F.lit(0)).alias("all"), signatures.chroma_compatible(F.lit(3), F.lit(30)).alias("gray"), signatures.chroma_compatible(F.lit(None).cast("int"), F.lit(30)).alias("unknown")).head()
    assert (row.d, row["all"], row.gray, row.unknown) == (7, 64, False, True)


def test_bands_miss_no_pair(spark):
    random.seed(5)
    base = [random.getrandbits(63) for _ in range(20)]
    near = [(i, b ^ sum(1 << k for k in random.sample(range(63), i % 8))) for i, b in enumerate(base)]
    df = spark.createDataFrame([(i, b, n) for (i, n), b in zip(near, base, strict=True)], "i int, a long, b long")
    share = F.size(F.array_intersect(signatures.bands(F.col("a"), 6), signatures.bands(F.col("b"), 6))) > 0
    both = F.size(F.array_intersect(signatures.band_pairs(F.col("a"), F.col("b"), 6, 6), signatures.band_pairs(F.col("b"), F.col("a"), 6, 6))) > 0
    share = share & both
    for r in df.select("i", signatures.distance(F.col("a"), F.col("b")).alias("d"), share.alias("share")).collect():
        assert r.share or r.d > 6
