"""Names of events and destinations: descriptions, templates, target paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trove.functions.binding import let
from trove.functions.dates import MONTHS, date_parts, parse_folder_date
from trove.functions.paths import file_name, is_event_name, parent

_GLUE = r"[ \-_.,()\[\]]"


def description(name: Column) -> Column:
    """A folder name without its date, wherever that stands, or without its MM-DD prefix."""

    def rest(found: Column) -> Column:
        before = F.regexp_replace(F.substr(name, F.lit(1), found["from"] - 1), f"{_GLUE}+$", "")
        after = F.regexp_replace(F.substr(name, found["from"] + found["len"]), f"^{_GLUE}+", "")
        joined = F.trim(F.array_join(F.filter(F.array(before, after), lambda x: F.trim(x) != ""), " "))
        prefixed = is_event_name(name) & ~F.substring(name, 6, 1).isin("-", "_", ".")
        return F.when(found.isNotNull(), joined).when(prefixed, F.trim(F.substr(name, F.lit(6)))).otherwise(F.trim(name))

    return let(parse_folder_date(name), rest)


def event_of(source: Column) -> Column:
    """A source's name without leading dates, its words joined by dashes."""
    words = F.filter(F.split(source, "[ _-]"), lambda w: w != "")
    dates = [*MONTHS, *(m[:3] for m in MONTHS)]
    plain = F.transform(words, lambda w: ~(w.rlike("^[0-9]*$") | F.lower(w).isin(dates)))
    first = F.array_position(plain, F.lit(True)).cast("int")
    return F.when(first == 0, F.lit("")).otherwise(F.array_join(F.slice(words, F.greatest(first, F.lit(1)), F.size(words)), "-"))


def without_day(template: str) -> str:
    """A template without DD and the separator before it, or else the one after it."""
    out, rest = "", template
    while "DD" in rest:
        head, _, rest = rest.partition("DD")
        if head[-1:] in ("-", "_", ".", " ") and head:
            head = head[:-1]
        elif rest[:1] in ("-", "_", ".", " "):
            rest = rest[1:]
        out += head
    return out + rest


def without_day_token(template: Column) -> Column:
    """The same of a column of templates."""
    return F.regexp_replace(template, r"[-_. ]DD|DD[-_. ]?", "")


def render(template: Column, year: Column, month: Column, day: Column, about: Column) -> Column:
    """A folder from a template. Dates are bound before the description, so its own text is never taken for a token."""
    bound = F.when(day.isNull(), without_day_token(template)).otherwise(template)
    bound = F.replace(F.replace(bound, F.lit("YYYY"), F.format_string("%04d", year)), F.lit("MM"), F.format_string("%02d", month))
    bound = F.when(day.isNull(), bound).otherwise(F.replace(bound, F.lit("DD"), F.format_string("%02d", day)))
    fill = lambda text: F.replace(F.replace(F.replace(bound, F.lit("<folder description>"), text), F.lit("<desc>"), text), F.lit("DESC"), text)
    bare = F.array_join(F.transform(F.split(fill(F.lit("")), "/"), lambda s: F.regexp_replace(s, r"^[\s\-_]+|[\s\-_]+$", "")), "/")
    return F.when(about == "", bare).otherwise(fill(about))


def destination(path: Column, date: Column, root: Column, template: Column, about: Column | None = None) -> Column:
    """Where a file of that capture date goes; null without a date. A root that ends with the year is not given it again. about: its folder's description, if known."""
    folder = F.element_at(F.split(parent(path), "/"), -1)

    def placed(x: Column) -> Column:
        d, about = x["d"], x["about"]
        made = render(template, d["year"], d["month"], d["day"], about)
        twice = F.element_at(F.split(root, "/"), -1) == d["year"].cast("string")
        made = F.when(twice, F.regexp_replace(made, "^[^/]*/", "")).otherwise(made)
        return F.when(d.isNotNull(), F.concat_ws("/", root, F.when(made != "", made), file_name(path)))

    return let(F.struct(date_parts(date).alias("d"), (description(folder) if about is None else about).alias("about")), placed)


def event_folder(date: Column, root: Column, event: Column) -> Column:
    """root/YYYY/MM[-DD][-event], or root/unknown."""
    d = date_parts(date)
    day = F.concat(F.format_string("%02d", d["month"]), F.when(d["day"].isNull(), F.lit("")).otherwise(F.format_string("-%02d", d["day"])))
    name = F.when(event == "", day).otherwise(F.concat_ws("-", day, event))
    return F.when(d.isNull(), F.concat(root, F.lit("/unknown"))).otherwise(F.concat_ws("/", root, F.format_string("%04d", d["year"]), name))
