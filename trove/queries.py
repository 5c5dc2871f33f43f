"""Every operator as a query on the driver's tables, with the same in SQL.

There are no media files among the tables, so adapters present them as catalogs: documents are files of trees named by
source, orders are folders with dated names, line items are dated files in dated folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.functions import dates, hashes, paths, signatures, templates
from trove.operators import compare, duplicates, layers, order, similar, verify
from trove.plans import library, naming
from trove.sources import catalog, decoders, pixels
from trove.sources import stamps as embedded
from trove.sources.storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
A_TREES = [f"src{i}" for i in range(10)]
B_TREES = [f"src{i}" for i in range(10, 20)]
SETS = ["src10", "src11", "src13"]
_IN_A = ", ".join(f"'{t}'" for t in A_TREES)
_IN_B = ", ".join(f"'{t}'" for t in B_TREES)
_IN_SETS = ", ".join(f"'{t}'" for t in SETS)
TEMPLATE = "YYYY/MM-DD <folder description>"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register a function (spark, sf_dir) under a name."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- documents as a catalog of files --------------------------------------------------------------------------


def doc_catalog(spark: SparkSession, sf: str, trees: list[str] | None = None) -> DataFrame:
    d = table(spark, sf, "documents")
    if trees is not None:
        d = d.filter(F.col("source").isin(trees))
    ok = F.col("n_chars") >= 20
    payload = F.when(ok, F.regexp_replace("text", "^[^\n]*\n", ""))
    return d.select(
        F.col("source").alias("tree"),
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("size"), ok.alias("decoded"), hashes.shallow_hash(F.when(ok, F.col("text")), F.col("text"), 64).alias("shallow"),
        hashes.bytes_hash(F.col("text")).alias("bytes_hash"), payload.alias("payload"), hashes.content_hash(payload).alias("payload_hash"),
        F.when(ok & (F.col("lang") != "fr"), F.md5(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")))).alias("pixel_hash"),
        (F.col("lang") == "de").alias("video"), (F.col("doc_id") % 3 > 0).alias("dated"), (F.col("doc_id") % 1000).alias("pixels"), "doc_id",
    )


CAT = """cat as (select source as tree, '/' || source || '/' || lang || '/' || doc_id || '.txt' as path, n_chars as size, n_chars >= 20 as decoded,
    case when n_chars >= 20 then md5(substr(text, 1, 64)) else md5(text) end as shallow, sha256(text) as bytes_hash,
    case when n_chars >= 20 then sha256(regexp_replace(text, '^[^\n]*\n', '')) end as payload_hash,
    case when n_chars >= 20 and lang <> 'fr' then md5(lower(regexp_replace(text, '[^A-Za-z]', '', 'g'))) end as pixel_hash,
    lang = 'de' as video, doc_id % 3 > 0 as dated, doc_id % 1000 as pixels, doc_id from documents)"""
AB = f"{CAT}, a as (select * from cat where tree in ({_IN_A})), b as (select * from cat where tree in ({_IN_B}))"
_VERDICT = """case when {a}.bytes_hash = {b}.bytes_hash then 'same' when {a}.payload_hash is null or {b}.payload_hash is null then 'unknown'
    when {a}.payload_hash = {b}.payload_hash then 'same' when {a}.video or {b}.video then 'different'
    when {a}.pixel_hash is null or {b}.pixel_hash is null then 'unknown' when {a}.pixel_hash = {b}.pixel_hash then 'same' else 'different' end"""
PAIRS = f"""{AB}, pairs as (select a.path as a, b.path as b, {_VERDICT.format(a='a', b='b')} as verdict, a.video or b.video as film from a join b using (shallow) where a.decoded and b.decoded),
marked as (select *, bool_or(verdict = 'same') over (partition by b) as proven from pairs)"""


def _ab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return doc_catalog(spark, sf, A_TREES), doc_catalog(spark, sf, B_TREES)


query("s3_scan_stats", f"with {CAT} select tree, count(*) as files, count(*) filter (not decoded) as unreadable from cat group by tree")(lambda s, d: compare.scan_stats(doc_catalog(s, d)))
query("h1_bytes_hash", "select doc_id, sha256(text) as hash from documents")(lambda s, d: table(s, d, "documents").select("doc_id", hashes.bytes_hash(F.col("text")).alias("hash")))
query("h2_prefix_hash", "select doc_id, md5(substr(text, 1, 64)) as hash from documents")(lambda s, d: table(s, d, "documents").select("doc_id", hashes.prefix_hash(F.col("text"), 64).alias("hash")))
query("h4_shallow_hash", f"with {CAT} select path, shallow, decoded from cat")(lambda s, d: doc_catalog(s, d).select("path", "shallow", "decoded"))
query("h5_content_hash", f"with {CAT} select path, payload_hash from cat")(lambda s, d: doc_catalog(s, d).select("path", hashes.content_hash(F.col("payload")).alias("payload_hash")))
query("h6_pixel_key", f"with {CAT} select path, pixel_hash, pixels from cat")(lambda s, d: doc_catalog(s, d).select("path", "pixel_hash", "pixels"))
query("h13_strategy_hash", f"with {CAT} select doc_id, sha256(text) as exact, sha256(coalesce(case when n_chars >= 20 then regexp_replace(text, '^[^\n]*\n', '') end, text)) as image_data from documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", hashes.strategy_hash("exact", F.col("text"), F.lit(None)).alias("exact"), hashes.strategy_hash("image_data", F.col("text"), F.when(F.col("n_chars") >= 20, F.regexp_replace("text", "^[^\n]*\n", ""))).alias("image_data"))
)
query("c1_compare_files", f"""with {AB}, sides as (select shallow, bool_or(s = 'a') as in_a, bool_or(s = 'b') as in_b from
    (select 'a' as s, shallow from a where decoded union all select 'b', shallow from b where decoded) group by shallow)
select 'a' as side, path, shallow, case when in_b then 'duplicate' else 'a_only' end as category from a join sides using (shallow) where decoded
union all select 'b', path, shallow, case when in_a then 'duplicate' else 'b_only' end from b join sides using (shallow) where decoded
union all select 'b', path, shallow, 'unreadable' from b where not decoded""")(lambda s, d: compare.compare_trees(*_ab(s, d)))
query("c1_duplicate_groups", f"""with {AB} select shallow, count(*) filter (s = 'a') as n_a, count(*) filter (s = 'b') as n_b,
    array_to_string(min(string_split(path, '/')) filter (s = 'a'), '/') as first_a, array_to_string(min(string_split(path, '/')) filter (s = 'b'), '/') as first_b
from (select 'a' as s, shallow, path from a where decoded union all select 'b', shallow, path from b where decoded) group by shallow having n_a > 0 and n_b > 0""")(lambda s, d: compare.duplicate_groups(*_ab(s, d)))
query("c2_compare_sets", f"""with {AB}, c as (select * from cat where tree in ({_IN_SETS})), ah as (select distinct shallow from a where decoded),
t as (select shallow, count(distinct tree) as trees from c where decoded group by shallow)
select tree, count(*) as files, count(*) filter (decoded and shallow in (select shallow from ah)) as duplicates,
    count(*) filter (decoded and shallow not in (select shallow from ah) and trees = 1) as only_here,
    count(*) filter (decoded and shallow not in (select shallow from ah) and trees > 1) as shared, count(*) filter (not decoded) as unreadable
from c left join t using (shallow) group by tree""")(lambda s, d: compare.compare_sets(doc_catalog(s, d, A_TREES), doc_catalog(s, d, SETS)))
query("c2_a_unique", f"with {AB} select count(distinct shallow) as a_unique from a where decoded and shallow not in (select shallow from cat where decoded and tree in ({_IN_SETS}))")(lambda s, d: compare.unique_in_a(doc_catalog(s, d, A_TREES), doc_catalog(s, d, SETS)))
query("c2_totals", f"""with {AB}, c as (select *, decoded and shallow in (select shallow from a where decoded) as dup from cat where tree in ({_IN_SETS}))
select count(*) filter (dup) as duplicates, count(*) filter (decoded and not dup) as candidates_only from c""")(lambda s, d: compare.set_totals(compare.compare_sets(doc_catalog(s, d, A_TREES), doc_catalog(s, d, SETS))))
query("j2_semi", f"with {AB} select path from b where decoded and shallow in (select shallow from a where decoded)")(lambda s, d: compare.in_other_tree(*_ab(s, d)[::-1]).select("path"))
query("j3_anti", f"with {AB} select path from b where decoded and shallow not in (select shallow from a where decoded)")(lambda s, d: compare.not_in_others(*_ab(s, d)[::-1]).select("path"))
query("j5_pairs", f"with {PAIRS} select a, b from pairs")(lambda s, d: compare.nominated_pairs(*_ab(s, d)))


@query("c5_verdicts", f"with {PAIRS} select a, b, verdict, case verdict when 'unknown' then 'no proof: one of them has no readable content' when 'different' then case when film then 'not one film: other film data' else 'not one picture: other pixels' end end as reason from pairs")
def c5_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _ab(spark, sf)
    return compare.prove_pairs(compare.nominated_pairs(a, b), doc_catalog(spark, sf))


query("c4_deep_scan", f"with {PAIRS} select count(*) as checked, count(*) filter (verdict = 'same') as kept, count(*) filter (verdict <> 'same' and proven) as covered, count(*) filter (not proven) as removed from marked")(lambda s, d: compare.deep_scan_counts(*_ab(s, d)))
query("c4_confirmed", f"with {PAIRS} select array_to_string(min(string_split(a, '/')), '/') as a, b from pairs where verdict = 'same' group by b")(lambda s, d: compare.confirmed(*_ab(s, d)))
query("c4_removed", f"with {PAIRS} select a, b, case verdict when 'unknown' then 'no proof: one of them has no readable content' else case when film then 'not one film: other film data' else 'not one picture: other pixels' end end as reason from marked where not proven")(lambda s, d: compare.removed_pairs(*_ab(s, d)))


_CLS = "select shallow, bytes_hash, payload_hash, pixel_hash, video, count(*) as n, array_to_string(min(string_split(path, '/')), '/') as first from {t} where decoded group by 1, 2, 3, 4, 5"
query("c5_class_verdicts", f"""with {AB}, x as ({_CLS.format(t='a')}), y as ({_CLS.format(t='b')})
select x.shallow, x.first as a_first, y.first as b_first, x.n as a_n, y.n as b_n, {_VERDICT.format(a='x', b='y')} as verdict from x join y using (shallow)""")(lambda s, d: compare.class_pairs(*_ab(s, d)).select("shallow", "a_first", "b_first", "a_n", "b_n", "verdict"))
query("c4_removed_files", f"with {PAIRS} select b, count(*) as candidates from marked where not proven group by b")(lambda s, d: compare.removed_files(*_ab(s, d)))


def _dated_docs(files: DataFrame) -> DataFrame:
    return files.select("path", F.when(F.col("dated"), F.lit("2020-01-01")).alias("capture_date"))


_ORIGINALS = "select path from b where decoded and shallow not in (select shallow from a where decoded) union select path from b where not decoded and dated"
query("u3_originals", f"with {AB} {_ORIGINALS}")(lambda s, d: (lambda a, b: compare.originals(compare.compare_trees(a, b), _dated_docs(b)))(*_ab(s, d)))
query("u4_promotion", f"with {PAIRS} {_ORIGINALS} union select b from marked where not proven")(lambda s, d: (lambda a, b: compare.promoted(compare.originals(compare.compare_trees(a, b), _dated_docs(b)), compare.removed_files(a, b)))(*_ab(s, d)))

# --- duplicates -------------------------------------------------------------------------------------------------

query("c9_find_duplicates", f"with {CAT} select bytes_hash as key, path, count(*) over (partition by bytes_hash) as n from cat qualify n > 1")(lambda s, d: duplicates.find_duplicates(doc_catalog(s, d), F.col("bytes_hash")))

#: components of evidence classes by a recursive table
_GROUPS = f"""{CAT}, cls as (select distinct shallow, decoded, bytes_hash, payload_hash, pixel_hash, video, md5(concat_ws('|', shallow, decoded, bytes_hash, coalesce(payload_hash, '-'), coalesce(pixel_hash, '-'), video)) as id from cat),
links as (select x.id as a, y.id as b from cls x join cls y on x.shallow = y.shallow and x.decoded = y.decoded and x.id <> y.id where {_VERDICT.format(a='x', b='y')} = 'same'),
walk as (select id, id as label from cls union select walk.id, links.b from walk join links on walk.label = links.a),
lab as (select id, min(label) as label from walk group by id),
grp as (select cat.*, lab.label as grp from cat join cls on cat.shallow = cls.shallow and cat.decoded = cls.decoded and cat.bytes_hash = cls.bytes_hash and cat.payload_hash is not distinct from cls.payload_hash
    and cat.pixel_hash is not distinct from cls.pixel_hash and cat.video = cls.video join lab on lab.id = cls.id),
keep as (select *, row_number() over (partition by grp order by dated desc, size desc, strlen(string_split(path, '/')[-1]), string_split(path, '/')) as rank,
    first_value(path) over (partition by grp order by dated desc, size desc, strlen(string_split(path, '/')[-1]), string_split(path, '/')) as keeper, count(*) over (partition by grp) as members from grp)"""
query("a2_groups_keeper", f"with recursive {_GROUPS} select path, keeper, rank, members from keep")(lambda s, d: duplicates.confirmed_groups(doc_catalog(s, d)).select("path", "keeper", "rank", "members"))
query("a3_exact_extras", f"""with {CAT}, r as (select *, first_value(path) over (partition by shallow, payload_hash order by size desc, pixels desc, string_split(path, '/')) as keeper from cat where decoded and payload_hash is not null)
select keeper, path from r where path <> keeper""")(lambda s, d: duplicates.exact_extras(doc_catalog(s, d)))
query("w2_leader_rank", f"with {CAT} select path, row_number() over (partition by shallow, decoded order by strlen(string_split(path, '/')[-1]), string_split(path, '/')) as rank from cat")(lambda s, d: duplicates.rank_in(doc_catalog(s, d), ["shallow", "decoded"], duplicates.leader_order()).select("path", "rank"))
query("w3_extra_rank", f"with {CAT} select path, row_number() over (partition by bytes_hash order by size desc, pixels desc, string_split(path, '/')) as rank from cat")(lambda s, d: duplicates.rank_in(doc_catalog(s, d), ["bytes_hash"], duplicates.exact_extra_order()).select("path", "rank"))
query("c10_merge_flat", f"""with {AB}, u as (select *, 0 as side from a union all select *, 1 from b)
select path, bytes_hash as key, case when row_number() over (partition by bytes_hash order by size desc, strlen(string_split(path, '/')[-1]), side, string_split(path, '/')) = 1 then 'keep' else 'drop' end as action from u""")(lambda s, d: duplicates.merge_flat(*_ab(s, d), F.col("bytes_hash")))

# --- dates and names of folders ---------------------------------------------------------------------------------

#: (Spark format, DuckDB format, DuckDB expression of the date, of the description)
_D, _M = "strftime(d, '%Y-%m-%d')", "strftime(d, '%Y-%m')"
SHAPES = [
    ("'lake 'yyyy-MM-dd", "lake %Y-%m-%d", _D, "lake"),
    ("yyyy_MM_dd' lake'", "%Y_%m_%d lake", _D, "lake"),
    ("yyyy.MM.dd", "%Y.%m.%d", _D, ""),
    ("'CAM_'yyyyMMdd", "CAM_%Y%m%d", _D, "CAM"),
    ("dd-MM-yyyy' regatta'", "%d-%m-%Y regatta", f"case when day(d) > 12 or day(d) = month(d) then {_D} end", None),
    ("MM-dd-yyyy' regatta'", "%m-%d-%Y regatta", f"case when day(d) > 12 or day(d) = month(d) then {_D} end", None),
    ("d MMMM yyyy' - shore'", "%-d %B %Y - shore", _D, "shore"),
    ("'tour ('MMMM d', 'yyyy') shore'", "tour (%B %-d, %Y) shore", _D, "tour shore"),
    ("dd'-'MMM'-'yyyy", "%d-%b-%Y", _D, ""),
    ("yyyy-MM' tour'", "%Y-%m tour", _M, "tour"),
    ("MMMM yyyy' tour'", "%B %Y tour", _M, "tour"),
    ("MMM yyyy' - 'yyyy-MM-dd", "%b %Y - %Y-%m-%d", _D, None),
    ("'47 'MMMM yyyy", "47 %B %Y", "null", None),
    ("'CAM'yyyyMMdd", "CAM%Y%m%d", "null", None),
    ("yyyy-MM'_'dd", "%Y-%m_%d", "null", None),
    ("yyyy-'13'-dd", "%Y-13-%d", "null", None),
    ("MM-dd' walk'", "%m-%d walk", "null", "walk"),
    ("'storm 'yyyy", "storm %Y", "null", None),
    ("yyyy-MM-dd'x'", "%Y-%m-%dx", "null", None),
    ("yyyy' 'MM' 'dd", "%Y %m %d", "null", None),
]


def folder_names(spark: SparkSession, sf: str) -> DataFrame:
    """id, d, k, name, path: orders as folders named in one of SHAPES, and a file in each."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % len(SHAPES)).cast("int").alias("k"))
    name = F.lit(None).cast("string")
    for i, s in enumerate(SHAPES):
        name = F.when(F.col("k") == i, F.date_format("d", s[0])).otherwise(name)
    return o.withColumn("name", name).withColumn("path", F.concat(F.lit("/lib/"), "name", F.lit("/raw/f"), F.col("id").cast("string"), F.lit(".jpg")))


def _shape_case(i: int) -> str:
    return "case k " + " ".join(f"when {k} then {s[i]}" for k, s in enumerate(SHAPES)) + " end"


NAMES = (
    f"base as (select o_orderkey as id, o_orderdate::date as d, (o_orderkey % {len(SHAPES)})::int as k from orders), "
    + "nm as (select *, case k " + " ".join(f"when {k} then strftime(d, '{s[1]}')" for k, s in enumerate(SHAPES)) + f" end as name, {_shape_case(2)} as folder_date from base)"
)
query("t1_folder_date", f"with {NAMES} select id, name, folder_date from nm")(lambda s, d: folder_names(s, d).select("id", "name", dates.folder_date(F.col("name")).alias("folder_date")))
_FULL = f"case when day(d) > 12 or day(d) = month(d) then {_D} end"
#: by parser: what it finds in names of each shape; nothing in all others
FINDS = {
    "year_month_day": {0: _D, 1: _D, 2: _D, 11: _D}, "compact": {3: _D}, "day_month_year": {4: _FULL, 5: _FULL}, "day_name_year": {6: _D, 8: _D}, "name_day_year": {7: _D}, "year_month": {9: _M}, "name_year": {10: _M, 11: _M},
}
for _shape, _finds in FINDS.items():
    _parser = {"year_month": lambda n: dates.year_month(n)["date"], "name_year": lambda n: dates.name_year(n)["date"]}.get(_shape, lambda n, k=_shape: dates.folder_date_shape(n, k))
    query(f"t1_{_shape}", f"with {NAMES} select id, case k " + " ".join(f"when {k} then {x}" for k, x in _finds.items()) + " end as folder_date from nm")(lambda s, d, f=_parser: folder_names(s, d).select("id", f(F.col("name")).alias("folder_date")))
query("t2_calendar", """with p as (select l_orderkey, l_linenumber, 1890 + l_partkey % 220 as y, l_suppkey % 14 as m, l_orderkey % 33 as dd from lineitem)
select l_orderkey, l_linenumber, case when y between 1900 and 2100 then strftime(try_strptime(printf('%04d-%02d-%02d', y::int, m::int, dd::int), '%Y-%m-%d'), '%Y-%m-%d') end as folder_date from p""")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", dates.full_date((F.col("l_partkey") % 220 + 1890).cast("int"), (F.col("l_suppkey") % 14).cast("int"), (F.col("l_orderkey") % 33).cast("int")).alias("folder_date"))
)
query("t4_path_date", f"with {NAMES} select id, folder_date from nm")(lambda s, d: folder_names(s, d).select("id", dates.folder_date_of(F.col("path")).alias("folder_date")))
query("t4_month_day_under_year", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') as folder_date from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), dates.folder_date_of(F.concat(F.lit("/lib/"), F.date_format("o_orderdate", "yyyy/MM-dd"), F.lit(" walk/a.jpg"))).alias("folder_date"))
)
_RAW_STAMP = "case o_orderkey % 8 when 0 then strftime(o_orderdate, '%Y:%m:%d 10:11:12') when 1 then strftime(o_orderdate, '%Y-%m-%dT10:11:12.03+01:00') when 2 then strftime(o_orderdate, '%Y-%m-%dT10:11:12') when 3 then strftime(o_orderdate, '%Y-%m-%d 10:11:12+02:00') when 4 then strftime(o_orderdate, '%Y:%m:%d') when 5 then strftime(o_orderdate, ' %Y-%m-%d ') when 6 then strftime(o_orderdate, '%Y:%m:%d 25:11:12') else 'no date' end"


def stamps(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["yyyy:MM:dd' 10:11:12'", "yyyy-MM-dd'T10:11:12.03+01:00'", "yyyy-MM-dd'T10:11:12'", "yyyy-MM-dd' 10:11:12+02:00'", "yyyy:MM:dd", "' 'yyyy-MM-dd' '", "yyyy:MM:dd' 25:11:12'", "'no date'"]
    raw = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        raw = F.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", f)).otherwise(raw)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


query("t9_timestamp_normalise", "select o_orderkey as id, case when o_orderkey % 8 < 4 then strftime(o_orderdate, '%Y-%m-%d 10:11:12') when o_orderkey % 8 < 6 then strftime(o_orderdate, '%Y-%m-%d') end as stamp from orders")(lambda s, d: stamps(s, d).select("id", dates.timestamp_text(F.col("raw")).alias("stamp")))
query("t10_pick_tag", """select o_orderkey as id, case when o_orderkey % 8 < 4 then strftime(o_orderdate, '%Y-%m-%d 10:11:12') when o_orderkey % 8 < 6 then strftime(o_orderdate, '%Y-%m-%d')
    when o_orderkey % 3 = 0 then '2001-02-03 04:05:06' else '1999-09-09' end as stamp from orders""")(
    lambda s, d: stamps(s, d).select("id", dates.pick_tag(F.from_json(F.to_json(F.create_map(
        F.lit("XMP:DateTimeOriginal"), F.col("raw"), F.lit("ExifIFD:DateTimeOriginal"), F.lit("bad"), F.lit("QuickTime:CreateDate"), F.when(F.col("id") % 3 == 0, "2001:02:03 04:05:06").otherwise(""),
        F.lit("IPTC:DigitalCreationDate"), F.lit("1999:09:09"), F.lit("IPTC:DigitalCreationTime"), F.lit("x"))), "map<string,string>")).alias("stamp"))
)
query("t11_xmp_date", "select o_orderkey as id, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y-%m-%d 10:11:12') when 1 then strftime(o_orderdate, '%Y-%m-%d') else '2001-02-03' end as stamp from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), dates.xmp_date(F.concat(F.lit('<x xmp:CreateDate="2001-02-03" '), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "'exif:DateTimeOriginal=\"'yyyy-MM-dd'T10:11:12.5+01:00\"'")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "'photoshop:DateCreated=\"'yyyy-MM-dd'\"'")).otherwise(F.lit("")), F.lit("/>"))).alias("stamp"))
)
query("t6_date_parts", "select o_orderkey as id, year(o_orderdate)::int as y, month(o_orderdate)::int as m, case when o_orderkey % 8 <> 7 then day(o_orderdate)::int end as d from orders where o_orderkey % 8 <> 7")(
    lambda s, d: stamps(s, d).withColumn("p", dates.date_parts(F.col("raw"))).filter("p is not null").select("id", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("d"))
)
query("t17_carried_dates", """select o_orderkey as path, case when o_orderkey % 5 = 0 then null when o_orderkey % 5 = 1 then '2000-01-01' else strftime(o_orderdate, '%Y-%m-%d') end as capture_date from orders""")(
    lambda s, d: (lambda o: verify.carried_dates(o.select("path"), o.filter("path % 5 < 2").select("path", F.when(F.col("path") % 5 == 0, "unknown").otherwise("2000-01-01").alias("date")), o.select("path", F.col("day").alias("capture_date"))))(stamps(s, d).withColumnRenamed("id", "path"))
)
query("t15_resolve_dates", f"""with {NAMES} select id, case when id % 4 = 0 then '2011-01-01' when id % 4 = 1 then '2012-02-02' else folder_date end as capture_date,
    case when id % 4 = 0 then 'embedded' when id % 4 = 1 then 'tool' when folder_date is not null then 'folder' end as date_source from nm""")(
    lambda s, d: (lambda n: verify.resolve_dates(n.select("path", F.when(F.col("id") % 4 == 0, "2011-01-01").alias("embedded_date")), n.filter("id % 4 < 2").select("path", F.lit("2012-02-02").alias("capture_date"))).join(n.select("path", "id"), "path").select("id", "capture_date", "date_source"))(folder_names(s, d))
)
_DESC = "case when k in (4, 5) and (day(d) > 12 or day(d) = month(d)) then 'regatta' when k = 11 then strftime(d, '%b %Y') " + " ".join(f"when k = {k} then '{s[3]}'" for k, s in enumerate(SHAPES) if s[3] is not None) + " else name end"
query("p4_description", f"with {NAMES} select id, {_DESC} as description from nm")(lambda s, d: folder_names(s, d).select("id", templates.description(F.col("name")).alias("description")))
_MONTH_WORDS = ", ".join(f"'{m}'" for m in [*dates.MONTHS, *(m[:3] for m in dates.MONTHS)])
query("p5_event", f"""with {NAMES}, w as (select id, list_filter(string_split_regex(name, '[ _-]'), lambda x: x <> '') as ws from nm),
v as (select id, ws, list_position(list_transform(ws, lambda x: not (regexp_full_match(x, '[0-9]*') or lower(x) in ({_MONTH_WORDS}))), true) as k from w)
select id, case when k is null or k = 0 then '' else array_to_string(ws[k:], '-') end as event from v""")(lambda s, d: folder_names(s, d).select("id", templates.event_of(F.col("name")).alias("event")))
query("p6_event_name", f"with {NAMES} select id, k in (4, 5, 8, 16) and regexp_matches(name, '^[0-9][0-9]-[0-9][0-9]') as is_event from nm")(lambda s, d: folder_names(s, d).select("id", paths.is_event_name(F.col("name")).alias("is_event")))
query("p2_template", "select o_orderkey as id, strftime(o_orderdate, '%Y/%m-%d') || case when o_orderkey % 2 = 0 then ' MM walk' else '' end as folder from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), templates.render(F.lit(TEMPLATE), F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.when(F.col("o_orderkey") % 2 == 0, "MM walk").otherwise("")).alias("folder"))
)
query("p3_no_day", "select o_orderkey as id, case o_orderkey % 4 when 0 then 'YYYY/MM DESC' when 1 then 'YYYY-MM' when 2 then 'YYYY/MM' else 'YYYY/MM/' end as template from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), templates.without_day_token(F.element_at(F.array(*map(F.lit, ["YYYY/MM-DD DESC", "YYYY-MM-DD", "YYYY/DD-MM", "YYYY/MM/DD"])), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("template"))
)
_P1 = "'/all/' || strftime(d, '%Y/%m-%d') || ' raw/f' || id || '.jpg'"
query("p1_destination", f"with {NAMES} select id, {_P1} as target from nm")(lambda s, d: folder_names(s, d).select("id", templates.destination(F.col("path"), F.date_format("d", "yyyy-MM-dd"), F.lit("/all"), F.lit(TEMPLATE)).alias("target")))
query("p1_destination_year_root", f"with {NAMES} select id, '/all/1995/' || case when year(d) = 1995 then '' else strftime(d, '%Y/') end || strftime(d, '%m-%d raw/f') || id || '.jpg' as target from nm")(lambda s, d: folder_names(s, d).select("id", templates.destination(F.col("path"), F.date_format("d", "yyyy-MM-dd"), F.lit("/all/1995"), F.lit(TEMPLATE)).alias("target")))
query("p7_event_path", "select o_orderkey as id, case o_orderkey % 3 when 0 then '/all/unknown' when 1 then '/all/' || strftime(o_orderdate, '%Y/%m-%d-sun') else '/all/' || strftime(o_orderdate, '%Y/%m-sun') end as folder from orders")(
    lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), templates.event_folder(F.when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 2, F.date_format("o_orderdate", "yyyy-MM")), F.lit("/all"), F.lit("sun")).alias("folder"))
)
query("p9_names", "select page_id, coalesce(nullif(string_split(url, '/')[-1], ''), 'file') as name, strlen(string_split(url, '/')[-1])::int as bytes from pages")(lambda s, d: table(s, d, "pages").select("page_id", paths.file_name(F.col("url")).alias("name"), paths.name_length(F.col("url")).alias("bytes")))
query("p10_purgatory", "select page_id, case when url like 'http://%' then '/purg' || substr(url, 6) else '/purg/' || coalesce(nullif(string_split(url, '/')[-1], ''), 'file') end as target from pages")(lambda s, d: table(s, d, "pages").select("page_id", paths.rebase(F.col("url"), F.lit("http:"), F.lit("/purg")).alias("target")))
_EXTS = ["JPG", "cr2", "tiff", "txt", "mov", "M2TS", "heic", "qoi", "json", "avif", "mp3", "x3f"]
query("s2_supported", f"select p_partkey, (list_value({', '.join(repr(x) for x in _EXTS)}))[p_partkey % {len(_EXTS)} + 1] not in ('txt', 'json', 'mp3') and p_size <> 7 as supported, case when p_size = 7 then '' else lower((list_value({', '.join(repr(x) for x in _EXTS)}))[p_partkey % {len(_EXTS)} + 1]) end as ext from part")(
    lambda s, d: table(s, d, "part").withColumn("path", F.concat(F.lit("a.b/c"), F.when(F.col("p_size") == 7, "").otherwise("."), F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("p_partkey") % len(_EXTS) + 1).cast("int")))).select("p_partkey", paths.is_supported(F.col("path")).alias("supported"), paths.extension(F.col("path")).alias("ext"))
)
query("h11_lossy_family", "select p_partkey, case p_partkey % 5 when 0 then 0 when 1 then 0 when 2 then 1 when 3 then 1 end::int as family from part")(lambda s, d: table(s, d, "part").select("p_partkey", paths.lossy_family(F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ["jpg", "JPEG", "heic", "avif", "png"])), (F.col("p_partkey") % 5 + 1).cast("int")))).alias("family")))
query("l1_path_order", "select page_id, url, row_number() over (order by string_split(url, '/'), page_id) as place from pages")(lambda s, d: order.numbered(table(s, d, "pages").select("page_id", "url"), paths.parts(F.col("url")), F.col("page_id")).select("page_id", "url", "place"))
query("l4_top300", f"with {CAT} select path, size, greatest(count(*) over () - 300, 0) as more from cat order by size desc, string_split(path, '/') limit 300")(lambda s, d: verify.top_rows(doc_catalog(s, d).select("path", "size"), [F.desc("size"), paths.parts(F.col("path"))], 300))
query("l6_group_order", f"""with {CAT}, g as (select *, min(string_split(path, '/')) over (partition by shallow) as first from cat)
select shallow, path, dense_rank() over (order by first) as group_place, row_number() over (partition by shallow order by string_split(path, '/')) as member_place from g""")(lambda s, d: order.group_order(doc_catalog(s, d).select("shallow", "path"), "shallow", paths.parts(F.col("path"))).select("shallow", "path", "group_place", "member_place"))
query("l3_top20", f"with {CAT} select path, size, greatest(count(*) over () - 20, 0) as more from cat order by size desc, string_split(path, '/') limit 20")(lambda s, d: verify.top_rows(doc_catalog(s, d).select("path", "size"), [F.desc("size"), paths.parts(F.col("path"))]))
query("l5_page", f"with {CAT} select path, size from cat order by size desc, string_split(path, '/') limit 100 offset 200")(lambda s, d: verify.page_of(doc_catalog(s, d).select("path", "size"), [F.desc("size"), paths.parts(F.col("path"))], 2))
query("s5_event_files", "select o_orderkey as id, year(o_orderdate)::varchar as year, strftime(o_orderdate, '%m-%d') as event, 'f' || o_orderkey || '.jpg' as file from orders where o_orderkey % 3 > 0")(
    lambda s, d: catalog.event_files(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy/"), F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "MM-dd/")).otherwise(""), F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("rel"))).select("id", "event.year", "event.event", "event.file")
)
query("s8_pasted_pairs", "select conv_id, turn, role || '!' as a, conv_id::varchar as b from conversations where turn % 3 = 0")(
    lambda s, d: catalog.pasted(table(s, d, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit("!\t"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 == 1, "\tmore").when(F.col("turn") % 3 == 2, "\t").otherwise("\r"), F.lit("\t0\t"), F.col("turn").cast("string")).alias("all")).select(F.when(F.col("turn") % 3 == 0, F.concat(F.regexp_extract("all", "^[^\t]*\t[0-9]+", 0), F.lit("\t"), F.col("turn").cast("string"), F.lit("\r"))).otherwise(F.col("all")).alias("value")), "a", "b", "turn").select("a", "b", F.col("turn").cast("long").alias("turn"), F.col("b").cast("long").alias("conv_id"))
)


# --- verify -------------------------------------------------------------------------------------------------------


def dated_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """id, path, capture_date: line items shipped on the capture date, in their order's folder; every seventh folder is a month, every eleventh item undated, every thirteenth outside."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    folder = F.when(key % 13 == 0, F.lit("misc")).when(key % 7 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy/MM-dd' walk'"))
    return j.select(key.alias("id"), F.concat(F.lit("/lib/"), folder, F.lit("/f"), key.cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".jpg")).alias("path"), F.when(key % 11 > 0, F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")).alias("capture_date"))


VERIFY = """v0 as (select l_orderkey * 10 + l_linenumber as id, l_orderkey * 10 + l_linenumber || '-' || l_partkey || '-' || l_suppkey as nm, l_shipdate::date as s, o_orderdate::date as o from lineitem join orders on l_orderkey = o_orderkey),
v1 as (select id, nm, s, o, '/lib/' || case when id % 13 = 0 then 'misc' when id % 7 = 0 then strftime(o, '%Y-%m') else strftime(o, '%Y/%m-%d walk') end || '/f' || nm || '.jpg' as path,
    case when id % 11 > 0 then strftime(s, '%Y-%m-%d') end as exif_date, case when id % 13 = 0 then null when id % 7 = 0 then strftime(o, '%Y-%m') else strftime(o, '%Y-%m-%d') end as folder_date from v0),
v2 as (select *, case when exif_date is null then 'undated' when folder_date is null then 'outside' when exif_date = folder_date or strftime(s, '%Y-%m') = folder_date then 'ok' else 'mismatch' end as status from v1),
v as (select path, exif_date, folder_date, status, case status when 'ok' then 0 when 'mismatch' then abs(date_diff('day', case when id % 7 = 0 then date_trunc('month', o)::date else o end, s)) end as days_off, id, nm, s from v2)"""
query("c6_verify", f"with {VERIFY} select path, exif_date, folder_date, status, days_off from v")(lambda s, d: verify.verify_dates(dated_catalog(s, d)))
query("c6_counts", f"with {VERIFY} select status, count(*) as files from v group by status")(lambda s, d: verify.verify_counts(verify.verify_dates(dated_catalog(s, d))))
query("f7_days_off", f"with {VERIFY} select path, days_off from v where status = 'mismatch' and days_off >= 10")(lambda s, d: verify.far_off(verify.verify_dates(dated_catalog(s, d))).select("path", "days_off"))
query("f8_status", f"with {VERIFY} select path from v where status = 'ok'")(lambda s, d: verify.with_status(verify.verify_dates(dated_catalog(s, d)), "ok").select("path"))
query("f5_text_filter", f"with {CAT} select path from cat where contains(lower(path), 'src1/en/1')")(lambda s, d: verify.text_filter(doc_catalog(s, d), "SRC1/en/1").select("path"))
query("c18_rehome_plan", f"with {VERIFY} select path as source, '/new/' || strftime(s, '%Y/%m-%d') || case when id % 7 = 0 then '' else ' walk' end || '/f' || nm || '.jpg' as target, days_off from v where status = 'mismatch'")(lambda s, d: library.rehome_plan(verify.verify_dates(dated_catalog(s, d)), "/new", TEMPLATE))

# --- signatures ---------------------------------------------------------------------------------------------------


@query("h7_phash", """with q as (select vec_id, embedding, list_sort(embedding) as s, len(embedding) as n from embeddings),
m as (select *, (s[(n + 1) // 2]::double + s[n // 2 + 1]::double) / 2 as mid from q)
select vec_id, list_sum(list_transform(range(n), lambda i: case when embedding[i + 1]::double > mid then case when i = 63 then -9223372036854775808::hugeint else (1::hugeint << i::int) end else 0::hugeint end))::bigint as phash from m""")
def h7_phash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", signatures.median_hash(F.col("embedding")).alias("phash"))


query("h8_dhash", "select vec_id, list_sum(list_transform(range(len(embedding) - 1), lambda i: case when embedding[i + 1] < embedding[i + 2] then (1::hugeint << i::int) else 0::hugeint end))::bigint as dhash from embeddings")(lambda s, d: table(s, d, "embeddings").select("vec_id", signatures.gradient_hash(F.col("embedding")).alias("dhash")))
query("h9_mean_chroma", "select l_orderkey, floor(avg(greatest(l_partkey % 256, l_suppkey % 256, l_linenumber * 20) - least(l_partkey % 256, l_suppkey % 256, l_linenumber * 20)))::bigint as chroma from lineitem group by l_orderkey")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(signatures.mean_chroma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber") * 20).alias("chroma")))
query("h10_distance", "select l_orderkey, l_linenumber, bit_count(xor(l_partkey * 2654435761, l_suppkey * 40503))::bigint as distance from lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", signatures.distance(F.col("l_partkey") * 2654435761, F.col("l_suppkey") * 40503).alias("distance")))
query("f2_chroma_gate", """with c as (select l_orderkey, l_linenumber, case when l_linenumber % 7 = 0 then null else l_partkey % 256 end as a, l_suppkey % 256 as b from lineitem)
select l_orderkey, l_linenumber, coalesce(not ((least(a, b) <= 6 and greatest(a, b) >= 10) or (greatest(a, b) - least(a, b) >= 35 and greatest(a, b) >= least(2 * least(a, b), 255))), true) or a is null as passes from c""")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 7 == 0, True).otherwise(signatures.chroma_compatible(F.col("l_partkey") % 256, F.col("l_suppkey") % 256)).alias("passes")))


def signature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' catalog with kind (language), phash (SimHash of words), dhash (of words reversed), chroma."""
    d = table(spark, sf, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "").alias("words"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).alias("kind"))
    hashed = signatures.simhashes(d, "doc_id", {"phash": F.col("words"), "dhash": F.transform("words", F.reverse)})
    s = d.select("doc_id", "kind").join(hashed, "doc_id", "left").select("doc_id", "kind", F.coalesce("phash", F.lit(0)).alias("phash"), F.coalesce("dhash", F.lit(0)).alias("dhash"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 4).cast("int").alias("chroma"))
    items = doc_catalog(spark, sf).drop("payload").join(s, "doc_id")
    return stored(items, "signatures")  # the signature layer: computed once, then used


def signature_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = signature_catalog(spark, sf)
    return items.filter(F.col("tree").isin(A_TREES)), items.filter(F.col("tree").isin(B_TREES))


#: the same in SQL: sums of signed bits over words
SIG = CAT + """, ws as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) as w from documents),
wc as (select doc_id, w, count(*) as c from ws group by all),
wh as (select doc_id, c, ('0x' || substr(md5(w), 1, 15))::bigint as h, ('0x' || substr(md5(reverse(w)), 1, 15))::bigint as g from wc),
bt as (select doc_id, i, sum(c * (((h >> i::int) & 1) * 2 - 1)) as hs, sum(c * (((g >> i::int) & 1) * 2 - 1)) as gs from wh, range(60) t(i) group by doc_id, i),
sg as (select doc_id, sum(case when hs > 0 then 1::bigint << i::int else 0 end)::bigint as phash, sum(case when gs > 0 then 1::bigint << i::int else 0 end)::bigint as dhash from bt group by doc_id),
sc as (select cat.*, coalesce(phash, 0) as phash, coalesce(dhash, 0) as dhash, case split_part(path, '/', 3) when 'en' then 0 when 'fr' then 1 when 'de' then 2 end as kind, case when doc_id % 5 > 0 then (doc_id % 4)::int end as chroma from cat left join sg using (doc_id))"""
_SIM = "x.kind = y.kind and bit_count(xor(x.phash, y.phash)) <= 6 and bit_count(xor(x.dhash, y.dhash)) <= 6"
query("h7_simhash", f"with {SIG} select doc_id, phash, dhash from sc")(lambda s, d: signature_catalog(s, d).select("doc_id", "phash", "dhash"))
query("j6_similar_pairs", f"with {SIG} select x.path as a, y.path as b, bit_count(xor(x.phash, y.phash))::bigint as distance from sc x join sc y on {_SIM} where string_split(x.path, '/') < string_split(y.path, '/')")(lambda s, d: similar.similar_pairs(signature_catalog(s, d)))
query("j6_theta_pairs", """with q as (select vec_id, label, embedding, list_sort(embedding) as s, len(embedding) as n from embeddings), m as (select *, (s[(n + 1) // 2]::double + s[n // 2 + 1]::double) / 2 as mid from q),
p as (select vec_id, label, list_sum(list_transform(range(n), lambda i: case when embedding[i + 1]::double > mid then case when i = 63 then -9223372036854775808::hugeint else (1::hugeint << i::int) end else 0::hugeint end))::bigint as h from m)
select 'v/' || x.vec_id as a, 'v/' || y.vec_id as b, bit_count(xor(x.h, y.h))::bigint as distance from p x join p y on x.label = y.label and bit_count(xor(x.h, y.h)) <= 22 where 'v/' || x.vec_id < 'v/' || y.vec_id""")(
    lambda s, d: similar.similar_pairs(table(s, d, "embeddings").select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("path"), F.col("label").alias("kind"), signatures.median_hash(F.col("embedding")).alias("phash"), F.lit(0).cast("long").alias("dhash"), F.lit(None).cast("int").alias("chroma")), 22, 22)
)
_REST = "ex as (select *, first_value(path) over (partition by shallow, payload_hash order by size desc, pixels desc, string_split(path, '/')) as k from sc where decoded and payload_hash is not null), rest as (select * from sc where kind is not null and path not in (select path from ex where path <> k))"
_COMP = f"{SIG}, {_REST}, links as (select x.doc_id as a, y.doc_id as b from rest x join rest y on {_SIM} and x.doc_id <> y.doc_id), walk as (select doc_id, doc_id as label from rest union select walk.doc_id, links.b from walk join links on walk.label = links.a), lab as (select doc_id, min(label) as label from walk group by doc_id)"


@query("a4_components", f"with recursive {_COMP} select path, min(label) over (partition by label) as label from rest join lab using (doc_id)")
def a4_components(spark: SparkSession, sf: str) -> DataFrame:
    from trove.operators.graph import components

    items = signature_catalog(spark, sf)
    rest = items.join(duplicates.exact_extras(items).select("path"), "path", "left_anti").filter("kind is not null").withColumn("id", similar.class_id())
    labelled = rest.join(components(similar.similar_links(similar.signature_classes(rest))), "id", "left").withColumn("group", F.coalesce("label", "id"))
    return labelled.join(labelled.groupBy("group").agg(F.min("doc_id").alias("first")), "group").select("path", F.col("first").alias("label"))


query("c7_groups", f"""with recursive {_COMP}, g as (select rest.*, label, first_value(path) over w as keeper, first_value(phash) over w as kp from rest join lab using (doc_id)
    window w as (partition by label order by size desc, pixels desc, string_split(path, '/')))
select keeper, path, bit_count(xor(kp, phash))::bigint as distance, size, pixels from g where path <> keeper""")(lambda s, d: similar.similar_groups(signature_catalog(s, d)))
_BEST = f"""{SIG}, a as (select * from sc where tree in ({_IN_A}) and kind is not null), b as (select * from sc where tree in ({_IN_B}) and kind is not null),
fa as (select shallow, arg_min(path, string_split(path, '/')) as keeper, arg_min(payload_hash, string_split(path, '/')) as ph from a where decoded group by shallow),
ex as (select keeper, path from b join fa using (shallow) where decoded and payload_hash = ph)"""
query("j8_exact_between", f"with {_BEST} select keeper, path from ex")(lambda s, d: similar.exact_between(*signature_trees(s, d)))
query("c8_best_match", f"""with {_BEST}, c as (select x.path as a, y.path as b, bit_count(xor(x.phash, y.phash))::bigint as distance, x.pixels as a_pixels, y.pixels as b_pixels, x.size as a_bytes, y.size as b_bytes,
    row_number() over (partition by y.path order by bit_count(xor(x.phash, y.phash)), x.pixels desc, string_split(x.path, '/')) as r from a x join b y on {_SIM} where y.path not in (select path from ex)),
k as (select *, a_bytes > b_bytes or (a_bytes = b_bytes and a_pixels >= b_pixels) as a_is_better from c where r = 1)
select a, b, distance, a_pixels, b_pixels, a_bytes, b_bytes, a_is_better, not a_is_better as b_is_better, a_is_better as removable from k""")(lambda s, d: similar.best_matches(*signature_trees(s, d)))
query("f6_distance", f"with {SIG} select x.path as a, y.path as b from sc x join sc y on {_SIM} where string_split(x.path, '/') < string_split(y.path, '/') and bit_count(xor(x.phash, y.phash)) <= 2")(lambda s, d: verify.within_distance(similar.similar_pairs(signature_catalog(s, d)), 2).select("a", "b"))

# --- names and plans ----------------------------------------------------------------------------------------------


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.concat(F.lit("/d"), (F.col("p_partkey") % 50).cast("string")).alias("dir"), F.col("p_partkey").alias("seq"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "CAM_").otherwise("img_"), (F.col("p_size") % 5).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(".jpg")).alias("name"))


_CLAIMS = "c as (select '/d' || p_partkey % 50 as dir, p_partkey as seq, case when p_partkey % 2 = 0 then 'CAM_' else 'img_' end || p_size % 5 || case when p_partkey % 3 = 0 then '' else '.jpg' end as name from part)"
_NUMBERED = f"""with {_CLAIMS}, r as (select *, row_number() over (partition by dir, lower(name) order by seq) - 1 as n from c)
select dir, seq, name, case when n = 0 then name when contains(name, '.') then replace(name, '.jpg', ' (' || n || ').jpg') else name || ' (' || n || ')' end as given from r"""
query("p8_names_simple", _NUMBERED)(lambda s, d: naming.numbered_names(claims(s, d)))
query("p8_names_exact", _NUMBERED)(lambda s, d: naming.claim_names(claims(s, d)))


def library_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of two libraries in year/event folders."""
    c = doc_catalog(spark, sf)
    lib = F.when(F.col("tree").isin(A_TREES), "/lib-a").otherwise("/lib-b")
    event = F.concat(F.format_string("%02d-%02d", F.col("doc_id") % 12 + 1, F.col("doc_id") % 4 + 1), F.when(F.floor(F.col("doc_id") / 7) % 3 == 0, "").when(F.floor(F.col("doc_id") / 7) % 3 == 1, " lake").otherwise(" Party"))
    rel = F.concat(F.lit("2004/"), event, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return c.withColumns({"rel": rel, "path": F.concat(lib, F.lit("/"), rel), "tree": lib})


_LIB = f"""{CAT.replace("'/' || source || '/' || lang || '/' || doc_id || '.txt' as path", "case when source in (" + _IN_A + ") then '/lib-a' else '/lib-b' end || '/2004/' || printf('%02d-%02d', (doc_id % 12 + 1)::int, (doc_id % 4 + 1)::int) || case (doc_id // 7) % 3 when 0 then '' when 1 then ' lake' else ' Party' end || '/' || doc_id || '.txt' as path")}"""
_LIBGROUPS = _GROUPS.replace(CAT, _LIB)
_CANON = "cn as (select substr(event, 1, 5) as mmdd, arg_min(event, (-strlen(event), event)) as folder from (select string_split(path, '/')[4] as event from cat) group by 1)"
query("p12_canonical", f"with {_LIB}, {_CANON} select '2004' as year, mmdd, folder from cn")(lambda s, d: library.canonical_folders(catalog.event_files(library_files(s, d))))
query("c12_merge_plan", f"""with recursive {_LIBGROUPS}, {_CANON}
select path as source, case when path = keeper then '/all/2004/' || folder || '/' || doc_id || '.txt' else '/purg/2004/' || string_split(path, '/')[4] || '/' || doc_id || '.txt' end as target, case when path = keeper then 'keep' else 'purge' end as action
from keep join cn on mmdd = substr(string_split(path, '/')[4], 1, 5)""")(lambda s, d: library.merge_plan(library_files(s, d), "/all", "/purg").drop("group"))
query("c13_consolidate_plan", f"""with recursive {_LIBGROUPS.replace("as shallow,", "|| '|' || printf('%02d-%02d', (doc_id % 12 + 1)::int, (doc_id % 4 + 1)::int) as shallow,").replace("as path, n_chars", "as path, n_chars").replace("from documents)", f"from documents where source in ({_IN_A}))")}, {_CANON},
f as (select keep.*, string_split(path, '/')[4] as event, folder, mmdd from keep join cn on mmdd = substr(string_split(path, '/')[4], 1, 5)), n as (select mmdd, count(distinct event) as folders from f group by mmdd)
select path as source, case when path <> keeper then '/purg/' || event || '/' || doc_id || '.txt' else '/lib-a/2004/' || folder || '/' || doc_id || '.txt' end as target, case when path <> keeper then 'purge' else 'move' end as action, folder as keeper
from f join n using (mmdd) where folders > 1 and (path <> keeper or event <> folder)""")(lambda s, d: library.consolidate_plan(library_files(s, d).filter("tree = '/lib-a'"), "/lib-a/2004", "/purg"))


def organized(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """b's documents as sources with a capture date, a's as files in the dated folders that the template gives."""
    day = F.format_string("2005-01-%02d", F.col("doc_id") % 3 + 1)
    c = stored(doc_catalog(spark, sf), "catalog")
    a = c.filter(F.col("tree").isin(A_TREES)).withColumn("path", F.concat(F.lit("/all/2005/01-"), F.format_string("%02d", F.col("doc_id") % 3 + 1), F.lit(" en/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return c.filter(F.col("tree").isin(B_TREES)).withColumn("capture_date", F.when(F.col("doc_id") % 7 > 0, day)), a


_ORG = f"""{AB}, ax as (select * replace ('/all/2005/01-' || printf('%02d', (doc_id % 3 + 1)::int) || ' en/' || doc_id || '.txt' as path), '/all/2005/01-' || printf('%02d', (doc_id % 3 + 1)::int) || ' en' as dir from a),
bx as (select *, case when doc_id % 7 > 0 then '/all/2005/01-' || printf('%02d', (doc_id % 3 + 1)::int) || ' ' || split_part(path, '/', 3) end as dir from b),
fx as (select *, row_number() over (partition by dir, shallow order by string_split(path, '/')) as r from ax),
rj as (select bx.path as source, f.path as existing from bx join fx f on bx.dir = f.dir and bx.shallow = f.shallow and f.r = 1 where {_VERDICT.format(a='f', b='bx')} = 'same')"""
query("j9_organize_reject", f"with {_ORG} select source, existing from rj")(lambda s, d: library.organize_rejects(*organized(s, d), "/all", TEMPLATE))
query("c14_organize_plan", f"""with {_ORG} select path as source, case when dir is null then null when path in (select source from rj) then (select existing from rj where source = path) else dir || '/' || doc_id || '.txt' end as target,
    case when dir is null then 'undated' when path in (select source from rj) then 'reject' else 'move' end as action from bx""")(lambda s, d: library.organize_plan(*organized(s, d), "/all", TEMPLATE))
query("c15_event_plan", f"with {NAMES} select '/lib/' || name || '/raw/f' || id || '.jpg' as source, case when id % 3 = 0 then '/all/unknown' else '/all/' || strftime(d, '%Y/%m-%d') || '-lake-tour' end || '/f' || id || '.jpg' as target from nm")(lambda s, d: library.event_plan(folder_names(s, d).select("path", F.when(F.col("id") % 3 > 0, F.date_format("d", "yyyy-MM-dd")).alias("capture_date")), "/all", templates.event_of(F.lit("2001-02 lake tour"))))
query("c16_transfer_plan", f"with {NAMES} select '/lib/' || name || '/raw/f' || id || '.jpg' as source, {_P1} as target from nm where id % 3 > 0")(lambda s, d: library.transfer_plan(folder_names(s, d).select("path", F.when(F.col("id") % 3 > 0, F.date_format("d", "yyyy-MM-dd")).alias("capture_date")), "/all", TEMPLATE))
query("c17_flat_plan", f"with {CAT}, r as (select path, doc_id from cat) select path as source, '/flat/' || doc_id || '.txt' as target from r")(lambda s, d: library.flat_plan(doc_catalog(s, d), "/flat"))
query("c11_relocate_plan", f"with {CAT} select path as source, '/new/' || doc_id || '.txt' as target from cat where path like '/src1/en/%' union all select path, '/new/' || doc_id || '.txt' from cat where path not like '/src1/en/%'")(lambda s, d: library.relocate_plan(doc_catalog(s, d), "/src1/en", "/new"))
query("c19_purgatory_plan", f"with {CAT} select path as source, case when tree = 'src1' then '/purg' || substr(path, 6) end as target from cat")(lambda s, d: library.purgatory_plan(doc_catalog(s, d), "/src1", "/purg"))
_KEEPBEST = f"""{_BEST}, c as (select x.path as a, y.path as b, y.doc_id as b_doc, x.size as a_bytes, y.size as b_bytes, x.pixels as ap, y.pixels as bp, row_number() over (partition by y.path order by bit_count(xor(x.phash, y.phash)), x.pixels desc, string_split(x.path, '/')) as r
    from a x join b y on {_SIM} where y.path not in (select path from ex)), k as (select * from c where r = 1)"""
query("c21_swap_plan", f"""with {_KEEPBEST}, z as (select * from k where not (a_bytes > b_bytes or (a_bytes = b_bytes and ap >= bp)))
select 1 as step, a as source, '/purg' || substr(a, 2) as target from (select a, b from z) where false union all select 1, a, '/purg/' || string_split(a, '/')[-1] from z
union all select 2, b, array_to_string(string_split(a, '/')[:-2], '/') || '/' || string_split(b, '/')[-1] from z""")(lambda s, d: library.swap_plan(similar.best_matches(*signature_trees(s, d)), "/a", "/purg"))


@query("c22_decisions", f"""with {_KEEPBEST}, z as (select *, case b_doc % 3 when 0 then 'keep_both' when 1 then 'purgatory_both' else 'take_bigger' end as decision from k)
select a, b, decision, 1 as step, b as source, case when b_doc % 2 = 0 then '/lib/2020/05-06 ' || split_part(b, '/', 3) || '/' || b_doc || '.txt' end as target from z where decision = 'keep_both'
union all select a, b, decision, 1, a, '/purg/' || string_split(a, '/')[-1] from z where decision = 'purgatory_both' or (decision = 'take_bigger' and b_bytes > a_bytes)
union all select a, b, decision, 2, b, '/purg/' || string_split(b, '/')[-1] from z where decision = 'purgatory_both'
union all select a, b, decision, 2, b, array_to_string(string_split(a, '/')[:-2], '/') || '/' || string_split(b, '/')[-1] from z where decision = 'take_bigger' and b_bytes > a_bytes
union all select a, b, decision, 1, b, '/purg/' || string_split(b, '/')[-1] from z where decision = 'take_bigger' and b_bytes <= a_bytes""")
def c22_decisions(spark: SparkSession, sf: str) -> DataFrame:
    m = similar.best_matches(*signature_trees(spark, sf))
    doc = F.regexp_extract("b", "([0-9]+)[.]txt$", 1).cast("long")
    rows = m.select("a", "b", F.element_at(F.array(F.lit("keep_both"), F.lit("purgatory_both"), F.lit("take_bigger")), (doc % 3 + 1).cast("int")).alias("decision"), F.col("a_bytes").alias("a_size"), F.col("b_bytes").alias("b_size"), F.when(doc % 2 == 0, "2020-05-06").alias("b_date"))
    return library.decision_plan(rows, "/lib", "/lib-b", "/purg", TEMPLATE)


# --- layers -------------------------------------------------------------------------------------------------------


def layer_store(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """Documents as entries of a layer store, layers present by id; shift gives another store of the same items."""
    d = doc_catalog(spark, sf)
    i = F.col("doc_id") + shift
    some = lambda n, c: F.when(i % n == 0, c)
    return d.filter(i % 7 > 0).select(
        F.col("tree").alias("volume"), F.substr("path", F.length("tree") + 3).alias("rel_path"), (F.col("size") + F.when(F.lit(shift > 0) & (i % 5 == 0), 1).otherwise(0)).alias("size"), F.lit(1).cast("long").alias("modified"),
        some(1, F.col("shallow")).alias("shallow"), some(2, F.col("bytes_hash")).alias("bytes_hash"), some(3, F.col("payload_hash")).alias("content_hash"), F.lit(None).cast("string").alias("pixel_hash"),
        some(4, F.col("doc_id")).alias("phash"), F.lit(None).cast("int").alias("chroma"), some(4, F.col("doc_id")).alias("dhash"), some(5, F.lit(True)).alias("date_resolved"), some(10, F.lit("2020-01-01")).alias("capture_date"),
    )


def _store_sql(name: str, shift: int = 0) -> str:
    i = f"(doc_id + {shift})"
    grow = f"case when {i} % 5 = 0 then 1 else 0 end" if shift else "0"
    return f"""{name} as (select tree as volume, substr(path, strlen(tree) + 3) as rel_path, size + {grow} as size, 1::bigint as modified, shallow, case when {i} % 2 = 0 then bytes_hash end as bytes_hash,
    case when {i} % 3 = 0 then payload_hash end as content_hash, null::varchar as pixel_hash, case when {i} % 4 = 0 then doc_id end as phash, null::int as chroma, case when {i} % 4 = 0 then doc_id end as dhash,
    case when {i} % 5 = 0 then true end as date_resolved, case when {i} % 10 = 0 then '2020-01-01' end as capture_date from cat where {i} % 7 > 0)"""


_COVER = "count(*) as files, count(shallow) as shallow_done, count(*) filter (bytes_hash is not null or content_hash is not null) as deep_done, count(phash) as phash_done, count(*) filter (date_resolved) as dates_done"
query("a8_coverage", f"with {CAT}, {_store_sql('t')}, f as (select *, unnest(['', string_split(rel_path, '/')[1]]) as folder from t) select volume, folder, {_COVER} from f group by volume, folder")(lambda s, d: layers.coverage_by_folder(layer_store(s, d)))
query("a8_coverage_folder", f"with {CAT}, {_store_sql('t')} select {_COVER} from t where volume = 'src1' and rel_path like 'en/%'")(lambda s, d: layers.coverage(layer_store(s, d), "src1", "en"))
_L = layers.LAYERS
query("k6_merge_layers", f"with {CAT}, {_store_sql('t')}, {_store_sql('s', 1)} select " + ", ".join(f"coalesce(t.{c}, s.{c}) as {c}" for c in ("volume", "rel_path", "size", "modified", *_L)) + " from t full join s on t.volume = s.volume and t.rel_path = s.rel_path")(lambda s, d: layers.merge(layer_store(s, d), layer_store(s, d, 1)))
query("k5_upsert", f"with {CAT}, {_store_sql('t')}, {_store_sql('s', 1)} select " + ", ".join(f"case when s.rel_path is null then t.{c} else s.{c} end as {c}" for c in ("volume", "rel_path", "size", "modified")) + ", " + ", ".join(f"case when s.rel_path is null then t.{c} when s.size = t.size then coalesce(s.{c}, t.{c}) else s.{c} end as {c}" for c in _L) + " from t full join s on t.volume = s.volume and t.rel_path = s.rel_path")(lambda s, d: layers.upsert(layer_store(s, d), layer_store(s, d, 1)))


@query("j13_cache_lookup", f"with {CAT}, {_store_sql('t')}, {_store_sql('s', 1)} select s.volume, s.rel_path, coalesce(t.size = s.size, false) as valid, " + ", ".join(f"case when t.size = s.size then t.{c} end as {c}" for c in _L) + " from s left join t on t.volume = s.volume and t.rel_path = s.rel_path")
def j13_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return layers.lookup(layer_store(spark, sf, 1).select("volume", "rel_path", "size", "modified"), layer_store(spark, sf)).drop("size", "modified", "known")


query("a12_reuse", f"with {CAT}, {_store_sql('t')}, {_store_sql('s', 1)} select count(case when t.size = s.size then t.phash end) as reused, count(*) - count(case when t.size = s.size then t.phash end) as computed from s left join t on t.volume = s.volume and t.rel_path = s.rel_path")(lambda s, d: layers.reuse_counts(layers.lookup(layer_store(s, d, 1).select("volume", "rel_path", "size", "modified"), layer_store(s, d)), "phash"))
query("k7_invalidate", f"with {CAT}, {_store_sql('t')} select volume, rel_path from t where not (volume = 'src1' and rel_path like 'en/%')")(lambda s, d: layers.invalidate(layer_store(s, d), "src1", "en").select("volume", "rel_path"))
query("k8_rekey", f"with {CAT}, {_store_sql('t')} select case when volume = 'src1' and rel_path like 'en/%' then 'uuid-1' else volume end as volume, case when volume = 'src1' and rel_path like 'en/%' then substr(rel_path, 4) else rel_path end as rel_path from t")(lambda s, d: layers.rekey(layer_store(s, d), {"src1/en": "uuid-1"}).select("volume", "rel_path"))
query("p14_json", f"with {CAT} select path, '{{\"path\":\"' || path || '\",\"size\":' || size || '}}' as json from cat")(lambda s, d: doc_catalog(s, d).select("path", paths.json_row("path", "size").alias("json")))
query("p15_sizes", """select doc_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f KB', round(n / 1024.0, 1)) else printf('%.1f MB', round(n / 1048576.0, 1)) end as size_text,
    case when n_chars = 0 then '' else case when round((n - n_chars) * 100.0 / n_chars) > 0 then '+' else '' end || round((n - n_chars) * 100.0 / n_chars)::bigint || '%' end as delta from (select *, n_chars * (1 + doc_id % 700) as n from documents)""")(
    lambda s, d: table(s, d, "documents").withColumn("n", F.col("n_chars") * (F.col("doc_id") % 700 + 1)).select("doc_id", paths.bytes_text(F.col("n")).alias("size_text"), paths.size_delta_text(F.col("n_chars"), F.col("n")).alias("delta"))
)


# --- bytes of files -----------------------------------------------------------------------------------------------


def _hex(text: str) -> Column:
    return F.unhex(F.lit(text))


def _number(value: Column, size: int) -> Column:
    """A whole number as `size` bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def _box(kind: str, *body: Column) -> Column:
    """An ISO-BMFF box."""
    inner = F.concat(*body)
    return F.concat(_number(F.octet_length(inner) + 8, 4), F.encode(F.lit(kind), "utf-8"), inner)


def _segment(kind: str, *body: Column) -> Column:
    """A JPEG segment."""
    inner = F.concat(*body)
    return F.concat(_hex("FF" + kind), _number(F.octet_length(inner) + 2, 2), inner)


def _exif(date: Column) -> Column:
    """A TIFF structure (high byte first) whose EXIF directory holds the original's date."""
    return F.concat(_hex("4D4D002A00000008" + "0001" + "876900040000000100000" + "01A" + "00000000" + "0001" + "9003000200000014" + "0000002C" + "00000000"), F.encode(date, "utf-8"), _hex("00"))


def _chunk(kind: str, body: Column) -> Column:
    """A PNG chunk; its check sum is right."""
    named = F.concat(F.encode(F.lit(kind), "utf-8"), body)
    return F.concat(_number(F.octet_length(body), 4), named, _number(F.crc32(named), 4))


def _stored_zlib(data: Column) -> Column:
    """Bytes as a zlib stream of one stored block, without its check sum."""
    n = F.octet_length(data)
    low = lambda x: F.concat(_number(x % 256, 1), _number(F.floor(x / 256), 1))
    return F.concat(_hex("780101"), low(n), low(F.lit(65535) - n), data)


MEDIA_KINDS = ["jpg", "png", "mp4", "avi", "m2ts", "tif", "txt"]


def media_files(spark: SparkSession, sf: str) -> DataFrame:
    """id, day, k, ext, body, content: orders as media files of MEDIA_KINDS with their date inside, or without one (k = 6)."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 7).cast("int").alias("k"))
    body = F.encode(F.concat(F.lit("body"), (F.col("id") % 100).cast("string")), "utf-8")
    o = o.withColumn("body", body).withColumn("stamp", F.date_format("day", "yyyy:MM:dd 10:11:12"))
    exif = _exif(F.col("stamp"))
    jpeg = F.concat(_hex("FFD8"), _segment("E1", F.encode(F.lit("Exif"), "utf-8"), _hex("0000"), exif), _segment("DB", _hex("0102")), _hex("FFDA"), F.col("body"), _hex("FFD9"))
    png = F.concat(_hex("89504E470D0A1A0A"), _chunk("eXIf", exif), _chunk("IDAT", F.col("body")), _chunk("IEND", _hex("")))
    seconds = F.unix_seconds(F.to_timestamp(F.col("stamp"), "yyyy:MM:dd HH:mm:ss")) + 2082844800
    film = F.concat(_box("ftyp", F.encode(F.lit("isom"), "utf-8")), _box("moov", _box("mvhd", _hex("00000000"), _number(seconds, 4), _hex("00" * 12))), _box("mdat", F.col("body")))
    movi = F.concat(F.encode(F.lit("movi"), "utf-8"), F.col("body"))
    size = F.octet_length(movi)
    avi = F.concat(F.encode(F.lit("RIFF"), "utf-8"), _hex("00000000"), F.encode(F.lit("AVI LIST"), "utf-8"), _number(size, 1), _hex("000000"), movi, _hex("00"))
    packet = F.concat(_number(F.col("id"), 4), _hex("47"), F.unhex(F.rpad(F.hex("body"), 374, "0")))
    xmp = F.encode(F.concat(F.lit('<x:xmpmeta exif:DateTimeOriginal="'), F.date_format("day", "yyyy-MM-dd'T10:11:12'"), F.lit('"></x:xmpmeta>')), "utf-8")
    tiff = F.concat(_hex("4D4D002A00000008" + "0001" + "02BC0007"), _number(F.octet_length(xmp), 4), _hex("0000001A" + "00000000"), xmp)
    made = [jpeg, png, film, avi, F.concat(packet, packet), tiff, F.col("body")]
    content = F.coalesce(*[F.when(F.col("k") == i, c) for i, c in enumerate(made)])
    return o.withColumns({"ext": F.element_at(F.array(*map(F.lit, MEDIA_KINDS)), F.col("k") + 1), "content": content})


_MEDIA = "m as (select o_orderkey as id, o_orderkey % 7 as k, o_orderdate::date as day, 'body' || o_orderkey % 100 as body from orders)"


@query("d1_payloads", f"""with {_MEDIA} select id, md5(case k when 0 then from_hex('FFD8FFDB00040102FFDA') || body::blob || from_hex('FFD9') when 4 then from_hex(rpad(hex(body), 374, '0')) || from_hex(rpad(hex(body), 374, '0')) else body::blob end) as head_hash
from m where k in (0, 1, 2, 3, 4) union all select id, null from m where k in (5, 6)""")
def d1_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads of all kinds, from their bytes; a TIFF without a picture and a text have none."""
    return media_files(spark, sf).select("id", decoders.payload_hashes(F.col("content"), F.col("ext"))["head_hash"].alias("head_hash"))


@query("d10_sniffed", f"""with {_MEDIA} select id, case k when 0 then 'jpg' when 1 then 'png' when 2 then 'mp4' when 3 then 'avi' when 4 then 'm2ts' when 5 then 'tiff' end as kind from m""")
def d10_sniffed(spark: SparkSession, sf: str) -> DataFrame:
    return media_files(spark, sf).select("id", decoders.sniffed(F.col("content")).alias("kind"))


@query("t14_embedded_dates", f"with {_MEDIA} select id, case when k in (0, 1, 2, 5) then strftime(day, '%Y-%m-%d 10:11:12') end as embedded_date from m")
def t14_embedded_dates(spark: SparkSession, sf: str) -> DataFrame:
    """EXIF of JPEG and PNG, a film's header, a TIFF's XMP packet; the others carry none."""
    return media_files(spark, sf).select("id", embedded.embedded_date(F.col("content"), F.col("ext")).alias("embedded_date"))


@query("c3_capture_dates", f"""with {_MEDIA} select id, case when k in (0, 1, 2, 5) then strftime(day, '%Y-%m-%d 10:11:12') when id % 2 = 0 then strftime(day, '%Y-%m-%d') end as capture_date,
    case when k in (0, 1, 2, 5) then 'embedded' when id % 2 = 0 then 'folder' end as date_source from m""")
def c3_capture_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates from bytes, else from the folder: the whole resolver."""
    files = media_files(spark, sf).withColumn("path", F.concat(F.lit("/lib/"), F.when(F.col("id") % 2 == 0, F.date_format("day", "yyyy-MM-dd")).otherwise("box"), F.lit("/"), F.col("id").cast("string"), F.lit("."), "ext"))
    dated = embedded.dated_files(files, F.col("ext")).select("id", "path", "embedded_date")
    return verify.resolve_dates(dated.select("path", "embedded_date")).join(dated.select("id", "path"), "path").select("id", "capture_date", "date_source")


def pictures(spark: SparkSession, sf: str) -> DataFrame:
    """id, ext, content: parts as pictures of 2 x 2 pixels in four formats; those that agree in p_size and p_partkey % 3 have the same pixels."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s"), (F.col("p_partkey") % 3).alias("q"), F.floor(F.col("p_partkey") / 3 % 4).cast("int").alias("k"))
    rgb = lambda *order: [_number(x, 1) for x in order]
    r, g, b = F.col("s"), F.col("s") + F.col("q") * 50, F.lit(7)
    row = F.concat(*rgb(r, g, b), _hex("FF0080"))
    ppm = F.concat(F.encode(F.lit("P6 2 2 255\n"), "utf-8"), row, row)
    turned = F.concat(*rgb(b, g, r), _hex("8000FF"))
    bmp = F.concat(_hex("424D000000000000000036000000" + "28000000" + "02000000" + "02000000" + "01001800" + "00" * 24), turned, _hex("0000"), turned, _hex("0000"))
    tga = F.concat(_hex("000002" + "00" * 9 + "020002001800"), turned, turned)
    png = F.concat(_hex("89504E470D0A1A0A"), _chunk("IHDR", _hex("00000002000000020802000000")), _chunk("IDAT", _stored_zlib(F.concat(_hex("00"), row, _hex("00"), row))), _chunk("IEND", _hex("")))
    return p.withColumns({"ext": F.element_at(F.array(*map(F.lit, ("ppm", "bmp", "tga", "png"))), F.col("k") + 1), "content": F.coalesce(*[F.when(F.col("k") == i, c) for i, c in enumerate((ppm, bmp, tga, png))])})


@query("d9_pixels", """with p as (select p_partkey as id, p_size as s, p_size + p_partkey % 3 * 50 as g from part),
q as (select id, printf('%02X%02X07FF0080', s::int, g::int) as line, greatest(s, g, 7) - least(s, g, 7) as spread from p)
select id, '2x2x3:' || sha256(from_hex(line || line)) as pixel_hash, ((2 * spread + 2 * 255) // 4)::int as chroma, 4::bigint as pixels from q""")
def d9_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel key and chroma of decoded pictures: the same in every container."""
    return pictures(spark, sf).withColumn("p", pixels.pixel_layers(F.col("content"), F.col("ext"))).select("id", "p.pixel_hash", "p.chroma", "p.pixels")


query("s9_tool_rows", "select o_orderkey as id, '/lib/' || o_orderkey as path, strftime(o_orderdate, '%Y-%m-%d 10:11:12') as capture_date from orders where o_orderkey % 3 > 0")(
    lambda s, d: catalog.tool_rows(table(s, d, "orders").select(F.to_json(F.create_map(F.when(F.col("o_orderkey") % 3 > 0, "SourceFile").otherwise("Other"), F.concat(F.lit("/lib/"), F.col("o_orderkey").cast("string")), F.lit("ExifIFD:DateTimeOriginal"), F.date_format("o_orderdate", "yyyy:MM:dd' 10:11:12'"))).alias("value"))).select(F.substr("path", F.lit(6)).cast("long").alias("id"), "path", dates.pick_tag(F.col("tags")).alias("capture_date"))
)
query("a11_outcomes", "select count(*) as planned, count(*) filter (p_partkey % 4 > 0) as moved, count(*) filter (p_partkey % 4 > 0 and p_partkey % 3 = 0) as renamed, count(*) filter (p_partkey % 4 = 0) as failed from part")(
    lambda s, d: library.outcome_counts(table(s, d, "part").select(F.concat(F.lit("/a/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("source"), F.concat(F.lit("/b/"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, " (1).png").otherwise(".png")).alias("target"), (F.col("p_partkey") % 4 > 0).alias("moved"), F.when(F.col("p_partkey") % 4 == 0, "gone").alias("error")))
)
query("s6_event_folders", "select strftime(o_orderdate, '%m-%d') as mmdd, strftime(o_orderdate, '%m-%d') || case when o_orderkey % 2 = 0 then ' fog' else '' end as event, count(*) as files from orders where o_orderkey % 5 > 0 group by 1, 2")(
    lambda s, d: catalog.event_folders(table(s, d, "orders").select(F.concat(F.lit("/y/1987/"), F.when(F.col("o_orderkey") % 5 == 0, "loose").otherwise(F.concat(F.date_format("o_orderdate", "MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, " fog").otherwise(""))), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("path")), "/y/1987")
)
