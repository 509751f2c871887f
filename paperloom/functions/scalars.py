"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that give no initial to an acronym, and the names of cognitive levels.
ACRONYM_STOP = ["and", "of", "to", "using", "with", "in", "the", "for", "&"]
LEVELS = {"L1": "Remember", "L2": "Understand", "L3": "Apply", "L4": "Analyse", "L5": "Evaluate", "L6": "Create"}


def acronym(title: Column) -> Column:
    """Upper-case initials of a title's words, small words left out."""
    w = F.filter(F.split(title, r"[\s\-/]+"), lambda x: (x != "") & ~F.lower(x).isin(ACRONYM_STOP) & x.rlike("^[A-Za-z]"))
    return F.array_join(F.transform(w, lambda x: F.upper(F.substring(x, 1, 1))), "")


def topic_slug(label: Column) -> Column:
    """Lower case, apostrophes gone, anything but letters, digits, + and # one hyphen."""
    x = F.regexp_replace(F.lower(label), "['’]", "")
    return F.regexp_replace(F.regexp_replace(x, "[^a-z0-9+#]+", "-"), "^-+|-+$", "")


def clip(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis if any are left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def describe_scope(course: Column, title: Column, semester: Column, exam_type: Column, year_from: Column, year_to: Column) -> Column:
    """A slice in words; the whole archive if nothing restricts it."""
    years = F.when(year_from == year_to, year_from.cast("string")).when(year_from.isNotNull() & year_to.isNotNull(), F.concat(year_from, F.lit("–"), year_to)).when(year_from.isNotNull(), F.concat(F.lit("from "), year_from)).when(year_to.isNotNull(), F.concat(F.lit("up to "), year_to))
    c = F.when(course.isNotNull() & title.isNotNull(), F.concat(title, F.lit(" ("), course, F.lit(")"))).otherwise(course)
    s = F.concat_ws(", ", c, F.concat(F.lit("semester "), semester), exam_type, years)
    return F.when(s == "", "the whole archive").otherwise(s)


def india_day(ts: Column) -> Column:
    """The day in India at an instant (session time zone UTC)."""
    return F.to_date(ts + F.expr("INTERVAL '5:30' HOUR TO MINUTE"))


def highlight(text: Column, terms: Column) -> Column:
    """The text with words that start with a term of three letters or more in double asterisks. ``terms``: array of strings."""
    long = F.transform(F.filter(terms, lambda t: F.length(t) > 2), lambda t: F.regexp_replace(t, r"([^\p{L}0-9])", r"\\$1"))
    pattern = F.concat(F.lit(r"(?i)(^|[^\p{L}0-9])((?:"), F.array_join(long, "|"), F.lit(r")[\p{L}0-9]*)"))
    return F.when(F.size(long) > 0, F.regexp_replace(text, pattern, F.lit("$1**$2**"))).otherwise(text)


def entity_decode(text: Column) -> Column:
    """Five character references, with white space squeezed."""
    for seen, char in (("&amp;", "&"), ("&#39;|&#x27;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        text = F.regexp_replace(text, seen, char)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def time_ago(ts: Column, now: Column) -> Column:
    """How long ago in words."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)
    return F.when(s < 60, "just now").when(s < 3600, F.concat(minutes, F.lit(" min ago"))).when(s < 86400, F.concat(hours, F.lit(" h ago"))).when(s < 172800, "yesterday").otherwise(F.concat(days, F.lit(" days ago")))


def level_name(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVELS.items()], level)


def unit_label(unit: Column) -> Column:
    return F.concat(F.lit("Unit "), unit)


def default_title(path: Column) -> Column:
    """A file's name without its extension, runs of _ and - as a space."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{2,5}$", ""), "[_-]+", " "))


def search_key(text: Column) -> Column:
    """One key for queries that differ in case and spacing only."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{2,5})$", 1))


def citation(code: Column, exam: Column, month: Column, year: Column, label: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", code, exam, month, year, label), r"\s+", " "))
