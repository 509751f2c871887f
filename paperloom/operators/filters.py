"""Slices and predicates over papers and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The exam types that a slice knows.
EXAM_TYPES = ("CIE", "SEE", "Makeup")


def course_list(csv: str | None) -> list[str]:
    """Codes of a comma-separated list: trimmed, upper case, sorted, without empty ones."""
    return sorted({c.strip().upper() for c in (csv or "").split(",") if c.strip()})


def slice_questions(df: DataFrame, year_from: int | None = None, year_to: int | None = None, courses: str | None = None, branch: str | None = None, semester: int | None = None, exam_type: str | None = None) -> DataFrame:
    """The questions (never notes) of a slice; what is None does not restrict. Filters reach the scan."""
    x = df.where(F.col("kind") == "question")
    if year_from is not None:
        x = x.where(F.col("year") >= year_from)
    if year_to is not None:
        x = x.where(F.col("year") <= year_to)
    if codes := course_list(courses):
        x = x.where(F.upper("course_code").isin(codes))
    if branch is not None:
        x = x.where(F.col("branch") == branch)
    if semester is not None:
        x = x.where(F.col("semester") == semester)
    if exam_type is not None:
        x = x.where(F.lower("exam_type") == exam_type.lower())
    return x


def lenient_parameters(params: DataFrame) -> DataFrame:
    """Parameters given as strings, each checked alone: a bad one becomes NULL, and only a missing limit gets its default.

    semester 1-8, years 1990-2100, limit 1-100 (20 where silent).
    """

    def number(name: str, low: int, high: int) -> Column:
        n = F.expr(f"try_cast(trim({name}) AS INT)")
        return F.when(n.between(low, high), n)

    exam = F.lower(F.trim("exam_type"))
    return params.select(
        "slice_id",
        number("year_from", 1990, 2100).alias("year_from"),
        number("year_to", 1990, 2100).alias("year_to"),
        number("semester", 1, 8).alias("semester"),
        F.when(F.col("limit").isNull(), F.lit(20)).otherwise(number("limit", 1, 100)).alias("limit"),
        F.coalesce(*[F.when(exam == e.lower(), F.lit(e)) for e in EXAM_TYPES]).alias("exam_type"),
        F.expr("nullif(array_join(array_sort(array_distinct(filter(transform(split(upper(course), ','), c -> trim(c)), c -> c <> ''))), ','), '')").alias("courses"),
    )


def known_courses(requests: DataFrame, known: DataFrame) -> DataFrame:
    """(request_id, codes): the requested codes that exist; a request of which none exists has an empty list, so no filter."""
    asked = requests.select("request_id", F.explode("codes").alias("code"))
    have = asked.join(known.select("code").distinct(), "code", "left_semi").groupBy("request_id").agg(F.array_sort(F.collect_set("code")).alias("known"))
    return requests.select("request_id").join(have, "request_id", "left").select("request_id", F.coalesce("known", F.array().cast("array<string>")).alias("codes"))


def passes(filters: str = "f") -> Column:
    """One search predicate for both retrievers: every filter that is set must hold (``filters`` is a struct column)."""

    def holds(name: str, test: Column) -> Column:
        return F.col(f"{filters}.{name}").isNull() | test

    return (
        holds("year_from", F.col("year") >= F.col(f"{filters}.year_from"))
        & holds("year_to", F.col("year") <= F.col(f"{filters}.year_to"))
        & holds("codes", F.array_contains(f"{filters}.codes", F.col("course_code")))
        & holds("branch", F.col("branch") == F.col(f"{filters}.branch"))
        & holds("semester", F.col("semester") == F.col(f"{filters}.semester"))
        & holds("marks", F.col("marks") == F.col(f"{filters}.marks"))
        & holds("min_marks", F.col("marks") >= F.col(f"{filters}.min_marks"))
        & holds("exam_type", F.col("exam_type") == F.col(f"{filters}.exam_type"))
        & holds("kind", F.col("kind") == F.col(f"{filters}.kind"))
    )


FILTER_FIELDS = {"year_from": "long", "year_to": "long", "codes": "array<string>", "branch": "string", "semester": "long", "marks": "long", "min_marks": "long", "exam_type": "string", "kind": "string"}


def override(explicit: str = "explicit", parsed: str = "parsed") -> Column:
    """A filter struct in which an explicit filter, where it is set, replaces the parsed one."""
    return F.struct(*[F.coalesce(F.col(f"{explicit}.{n}"), F.col(f"{parsed}.{n}")).cast(t).alias(n) for n, t in FILTER_FIELDS.items()])


def list_documents(papers: DataFrame, **equal) -> DataFrame:
    """Papers whose named columns have the given values; None does not restrict."""
    for name, value in equal.items():
        if value is not None:
            papers = papers.where(F.col(name) == value)
    return papers


def all_words(haystack: Column, query: Column, most: int = 6) -> Column:
    """Whether each of the first ``most`` words of the query is in the text, whatever the case; ``%`` and ``_`` don't count."""
    words = F.slice(F.filter(F.split(F.lower(F.regexp_replace(query, "[%_]", "")), r"\s+"), lambda w: w != ""), 1, most)
    hay = F.lower(haystack)
    return F.forall(words, lambda w: F.contains(hay, w))


def label_contains(label: Column, part: Column) -> Column:
    """Plain containment without regard to case; no character of the text is special."""
    return F.contains(F.lower(label), F.lower(part))
