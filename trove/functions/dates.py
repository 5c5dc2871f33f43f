"""Capture and folder dates: parsers, renderers and their validity rules, as column expressions.

A folder date is text, YYYY-MM-DD or, at month precision, YYYY-MM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trove.functions.binding import let

#: Month names, long and short.
MONTHS = "january february march april may june july august september october november december".split()
_NAMES = "|".join([*MONTHS, *(m[:3] for m in MONTHS), "sept"])
_GAP = r"(?: +[-_.,]? *|[-_.,] *)"
_START, _END = r"(?<![\p{IsAlphabetic}0-9])", r"(?![\p{IsAlphabetic}0-9])"
_SEP = "[-_.]"

#: Full-date shapes: pattern, and the groups of year, month and day.
FULL_SHAPES = {
    "year_month_day": (rf"{_START}([0-9]{{4}})({_SEP})([0-9]{{2}})\2([0-9]{{2}}){_END}", (1, 3, 4)),
    "compact": (rf"{_START}([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_END}", (1, 2, 3)),
    "day_month_year": (rf"{_START}([0-9]{{2}})({_SEP})([0-9]{{2}})\2([0-9]{{4}}){_END}", (4, 3, 1)),
    "day_name_year": (rf"(?i){_START}([0-9]{{1,2}}){_GAP}({_NAMES}){_GAP}([0-9]{{4}}){_END}", (3, 2, 1)),
    "name_day_year": (rf"(?i){_START}({_NAMES}){_GAP}([0-9]{{1,2}}){_GAP}([0-9]{{4}}){_END}", (3, 1, 2)),
}
_YEAR_MONTH = rf"{_START}([0-9]{{4}}){_SEP}([0-9]{{2}}){_END}(?!{_SEP}[0-9])"
_NAME_YEAR = rf"(?i)(?:(?<![0-9])([0-9]{{1,2}}){_GAP}|{_START})({_NAMES}){_GAP}([0-9]{{4}}){_END}"


def month_number(name: Column) -> Column:
    short = F.substring(F.lower(name), 1, 3)
    return F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), short).cast("int")


def full_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if it is on the calendar and in 1900 to 2100, else null."""
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.between(1900, 2100) & month.between(1, 12) & day.between(1, 31) & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def month_date(year: Column, month: Column) -> Column:
    return F.when(year.between(1900, 2100) & month.between(1, 12), F.format_string("%04d-%02d", year, month))


def _int(m: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(m, pattern, group).cast("int")


def shape_date(match: Column, shape: str) -> Column:
    """The date of one match of a full-date shape; null if it is none, or if day and month can't be told apart."""
    pattern, (y, m, d) = FULL_SHAPES[shape]
    year = _int(match, pattern, y)
    if shape in ("day_name_year", "name_day_year"):
        return full_date(year, month_number(F.regexp_extract(match, pattern, m)), _int(match, pattern, d))
    if shape != "day_month_year":
        return full_date(year, _int(match, pattern, m), _int(match, pattern, d))
    a, b = _int(match, pattern, d), _int(match, pattern, m)
    return F.when((a > 12) & (b <= 12) | (a <= 12) & (a == b), full_date(year, b, a)).when((a <= 12) & (b > 12), full_date(year, a, b))


def _found(name: Column, pattern: str, date) -> Column:  # noqa: ANN001
    """The first match with a date: (from, date, len), from being where it begins, from 1.

    Matches come in order and don't overlap, so the k-th one begins after the text up to it: what splitting at matches leaves
    before it, and the matches before.
    """
    found = F.regexp_extract_all(name, F.lit(pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        between = F.split(name, pattern, -1)
        at = lambda k: F.aggregate(F.slice(between, F.lit(1), k + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(ms, F.lit(1), k), F.lit(0), lambda s, x: s + F.length(x)) + 1
        dated = F.transform(ms, lambda m, k: F.struct(k.alias("k"), date(m).alias("date"), F.length(m).alias("len")))
        return let(F.get(F.filter(dated, lambda x: x["date"].isNotNull()), F.lit(0)), lambda first: F.when(first.isNotNull(), F.struct(at(first["k"]).alias("from"), first["date"].alias("date"), first["len"].alias("len"))))

    return let(found, placed)


def folder_date_shape(name: Column, shape: str) -> Column:
    """The first date of one full-date shape in a name."""
    return _found(name, FULL_SHAPES[shape][0], lambda m: shape_date(m, shape))["date"]


def year_month(name: Column) -> Column:
    return _found(name, _YEAR_MONTH, lambda m: month_date(_int(m, _YEAR_MONTH.replace(_END, ""), 1), _int(m, _YEAR_MONTH.replace(_END, ""), 2)))


def name_year(name: Column) -> Column:
    def date(m: Column) -> Column:
        return F.when(F.regexp_extract(m, _NAME_YEAR, 1) == "", month_date(_int(m, _NAME_YEAR, 3), month_number(F.regexp_extract(m, _NAME_YEAR, 2))))

    return _found(name, _NAME_YEAR, date)


def parse_folder_date(name: Column) -> Column:
    """(from, date, len) of the date in a folder name: the leftmost full date, else the leftmost month; null if there is none."""

    def parsed(n: Column) -> Column:
        full = [_found(n, p, lambda m, s=s: shape_date(m, s)) for s, (p, _) in FULL_SHAPES.items()]
        first = lambda xs: F.array_min(F.filter(F.array(*xs), lambda x: x.isNotNull()))
        found = F.coalesce(first(full), first([year_month(n), name_year(n)]))
        return F.when(n.rlike("[0-9]{4}"), found)  # no shape is without a year

    return let(name, parsed)


def folder_date(name: Column) -> Column:
    return parse_folder_date(name)["date"]


def month_day_under_year(name: Column, above: Column) -> Column:
    """The date of an MM-DD folder directly under a YYYY one."""
    pattern = "^([0-9]{2})-([0-9]{2})"
    year = F.when(above.rlike("^[0-9]{4}$"), above.cast("int"))
    return F.when(name.rlike(pattern), full_date(year, _int(name, pattern, 1), _int(name, pattern, 2)))


def folder_date_of(path: Column, levels: int = 3) -> Column:
    """The date that the nearest of a path's ancestor folders implies."""
    p = F.split(path, "/")
    found = []
    for k in range(2, 2 + levels):
        name, above = F.try_element_at(p, F.lit(-k)), F.try_element_at(p, F.lit(-k - 1))
        found.append(F.coalesce(folder_date(name), month_day_under_year(name, above)))
    return F.coalesce(*found)


def _groups(date: Column, body) -> Column:  # noqa: ANN001
    """body(numbers) of a text's groups of digits; a group too large for a number is null."""
    return let(F.transform(F.regexp_extract_all(date, F.lit("[0-9]+"), F.lit(0)), lambda g: g.try_cast("int")), body)


def _day_struct(n: Column, day: bool = True) -> Column:
    return F.struct(F.get(n, F.lit(0)).alias("year"), F.get(n, F.lit(1)).alias("month"), (F.get(n, F.lit(2)) if day else F.lit(None).cast("int")).alias("day"))


def date_parts(date: Column) -> Column:
    """(year, month, day) for placing: groups of digits, month and day in range, no calendar; two groups alone are a month."""

    def parts(n: Column) -> Column:
        good = ~F.exists(n, lambda x: x.isNull()) & F.get(n, F.lit(1)).between(1, 12)
        return F.when(good & (F.size(n) >= 3) & F.get(n, F.lit(2)).between(1, 31), _day_struct(n)).when(good & (F.size(n) == 2), _day_struct(n, day=False))

    return _groups(date, parts)


def date_triple(date: Column) -> Column:
    """(year, month, day) for verifying: the first three groups of digits, unchecked."""
    return _groups(date, lambda n: F.when((F.size(n) >= 3) & ~F.exists(F.slice(n, 1, 3), lambda x: x.isNull()), _day_struct(n)))


def days_between(a: Column, b: Column) -> Column:
    """Absolute difference of two YYYY-MM-DD texts in days; 0 if either is not on the calendar."""
    return F.coalesce(F.abs(F.datediff(F.try_to_date(a, "yyyy-MM-dd"), F.try_to_date(b, "yyyy-MM-dd"))), F.lit(0)).cast("long")


_CLOCK = r"([0-9]{2}):([0-9]{2}):([0-9]{2})"


def _clock(text: Column) -> Column:
    """HH:MM:SS if it is a time of day, else null."""
    p = rf"^{_CLOCK}$"
    return F.when(text.rlike(p) & (_int(text, p, 1) < 24) & (_int(text, p, 2) < 60) & (_int(text, p, 3) < 60), text)


def _day(text: Column) -> Column:
    day = F.translate(text, ":", "-")
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def timestamp_text(raw: Column, time: Column | None = None) -> Column:
    """A tool's timestamp as YYYY-MM-DD HH:MM:SS, or YYYY-MM-DD without a clock; offsets are dropped, the wall clock stays.

    Forms: colon dates with a space and dash dates with T or a space, fractions after T only; a date alone is completed
    by time if that is a clock.
    """
    raw = F.trim(raw)
    form = rf"^([0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})([T ]){_CLOCK}([.][0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$"
    g = lambda i: F.regexp_extract(raw, form, i)
    day, clock = _day(g(1)), _clock(F.concat_ws(":", g(3), g(4), g(5)))
    colon = g(1).contains(":")
    shape = (colon & (g(2) == " ") | ~colon) & ((g(6) == "") | (g(2) == "T"))
    stamp = F.when(raw.rlike(form) & shape & day.isNotNull() & clock.isNotNull(), F.concat_ws(" ", day, clock))
    alone = F.when(raw.rlike(r"^[0-9]{4}([:-])[0-9]{2}\1[0-9]{2}$"), _day(raw))
    with_time = F.concat(alone, F.lit(" "), _clock(F.trim(time))) if time is not None else F.lit(None).cast("string")
    return F.coalesce(stamp, with_time, alone)


#: Tag names, nearest to the shutter first; groups, nearest to the camera first; date tags with a clock beside them.
TAG_NAMES = ("DateTimeOriginal", "DateTimeCreated", "CreateDate", "DateCreated", "DigitalCreationDate")
TAG_GROUPS = ("ExifIFD:", "XMP:", "Composite:", "QuickTime:", "Track:", "M2TS:", "IPTC:")
TAG_CLOCKS = {"DateCreated": "TimeCreated", "DigitalCreationDate": "DigitalCreationTime"}


def pick_tag(tags: Column) -> Column:
    """The best timestamp of a map of tags (group:name to text): by name, then group, then key; the first that parses."""
    entries = F.map_entries(tags)
    name = lambda key: F.element_at(F.split(key, ":"), -1)

    def ranked(e: Column) -> Column:
        key = e["key"]
        group = F.coalesce(*[F.when(key.startswith(g), F.lit(i)) for i, g in enumerate(TAG_GROUPS)], F.lit(len(TAG_GROUPS)))
        clocks = F.coalesce(*[F.when(name(key) == n, F.lit(c)) for n, c in TAG_CLOCKS.items()])
        beside = F.when(key.contains(":"), F.try_element_at(tags, F.concat(F.regexp_replace(key, "[^:]*$", ""), clocks)))
        return F.struct((F.array_position(F.array(*map(F.lit, TAG_NAMES)), name(key)) - 1).alias("by_name"), group.alias("by_group"), key.alias("key"), timestamp_text(e["value"], beside).alias("date"))

    dated = F.filter(F.transform(F.filter(entries, lambda e: name(e["key"]).isin(*TAG_NAMES) & e["value"].isNotNull()), ranked), lambda x: x["date"].isNotNull())
    return F.array_min(dated)["date"]


def xmp_date(packet: Column) -> Column:
    """The shot date of an XMP packet's attributes: the original, then the creation, then the file's own date."""

    def stamp(tag: str) -> Column:
        value = F.regexp_extract(packet, rf"(?s){tag}[^=]*=[^\"]*\"([^\"]*)\"", 1)
        day = F.regexp_extract(value, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
        clock = F.regexp_extract(value, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
        return F.when(day != "", F.when(clock != "", F.concat_ws(" ", day, clock)).otherwise(day))

    return F.coalesce(*map(stamp, ("exif:DateTimeOriginal", "photoshop:DateCreated", "xmp:CreateDate")))


def resolve_date(*dates: Column) -> Column:
    """Reader chain: the first source that knows a date (embedded readers, the external tool, the folder)."""
    return F.coalesce(*dates)
