"""Courses, branches, the review queue and the external library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.analytics import joined
from paperloom.tables import settled


def with_labels(topics_used: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """A ``topic`` column looked up in the vocabulary: ``label``, or the slug where there is none."""
    v = vocabulary.select(F.col("name").alias("v_name"), F.col("label").alias("v_label"))
    return topics_used.join(v, F.col("topic") == F.col("v_name"), "left").withColumn("label", F.coalesce("v_label", "topic")).drop("v_name", "v_label")


def topics_with_usage(vocabulary: DataFrame, questions: DataFrame) -> DataFrame:
    """name, label, status, n_questions of all live topics, 0 where unused."""
    used = questions.select(F.explode("topics").alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    live = vocabulary.where(F.col("merged_into").isNull())
    return live.join(used, F.col("name") == F.col("u"), "left").select("name", "label", "status", F.coalesce("n", F.lit(0)).alias("n_questions")).orderBy(F.asc_nulls_first("label"), "name")


def review_queue(reviews: DataFrame, papers: DataFrame, status: str = "open", kind: str | None = None, limit: int = 200) -> DataFrame:
    """The newest items with their documents; the limit is taken before the join, so only that many rows meet it."""
    x = reviews.where(F.col("status") == status)
    if kind:
        x = x.where(F.col("type") == kind)
    x = x.orderBy(F.desc("created_at"), F.desc("review_id")).limit(limit)
    p = papers.select(F.col("document_id").alias("p_id"), "title", F.col("status").alias("document_status"))
    return x.join(p, F.col("document_id") == F.col("p_id"), "left").drop("p_id")


def usual(df: DataFrame, key: str, value: str, prefer: list[Column]) -> DataFrame:
    """(key, value): the most frequent non-null value of each key, ties by ``prefer``."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), *prefer)
    return n.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, value)


def _union(lists: str) -> Column:
    """The distinct values of a group's lists."""
    return F.array_distinct(F.flatten(F.collect_set(lists)))


def courses_from_papers(questions: DataFrame) -> DataFrame:
    """One row for each course code: usual title (under 80 characters, ties to the shorter), branches, usual semester, papers, questions of all kinds, years."""
    x = questions.where("course_code IS NOT NULL AND course_code <> ''")
    titles = usual(x.where(F.length("course_title") < 80), "course_code", "course_title", [F.length("course_title").asc(), F.asc("course_title")]).select(F.col("course_code").alias("t_code"), F.col("course_title").alias("title"))
    semesters = usual(x, "course_code", "semester", [F.asc("semester")]).select(F.col("course_code").alias("s_code"), "semester")
    # Paper by paper first, where a paper's rows lie, so that no pairs of course and paper are shuffled.
    g = x.groupBy("document_id", "course_code").agg(F.sort_array(F.collect_set("branch")).alias("branches"), F.count(F.lit(1)).alias("n_questions"), F.sort_array(F.collect_set("year")).alias("years"))
    g = g.groupBy("course_code").agg(joined(_union("branches")).alias("branches"), F.count("document_id").alias("n_papers"), F.sum("n_questions").alias("n_questions"), joined(_union("years")).alias("year_list"))
    g = g.join(titles, F.col("course_code") == F.col("t_code"), "left").join(semesters, F.col("course_code") == F.col("s_code"), "left").drop("t_code", "s_code")
    return g.orderBy(F.desc("n_questions"), "course_code")


def branch_rollup(papers: DataFrame, questions: DataFrame) -> DataFrame:
    """Papers, courses and questions of each branch that has papers; no branch is COMMON."""
    b = F.coalesce("branch", F.lit("COMMON"))
    p = papers.groupBy(b.alias("branch")).agg(F.count(F.lit(1)).alias("n_papers"))
    q = questions.groupBy(b.alias("q_branch")).agg(F.countDistinct("course_code").alias("n_courses"), F.count_if(F.col("kind") == "question").alias("n_questions"))
    x = p.join(q, F.col("branch") == F.col("q_branch"), "left")
    return x.select("branch", "n_papers", F.coalesce("n_courses", F.lit(0)).alias("n_courses"), F.coalesce("n_questions", F.lit(0)).alias("n_questions")).orderBy(F.desc("n_questions"), "branch")


def branch_catalogue(courses: DataFrame, branch: str) -> DataFrame:
    """The courses of a branch; COMMON has those without any branch."""
    if branch == "COMMON":
        return courses.where(F.col("branches") == "")
    return courses.where(F.array_contains(F.split("branches", ","), branch))


def course_questions(questions: DataFrame, codes: list[str]) -> DataFrame:
    """A course's papers, each with its questions in order as one nested list."""
    x = questions.where(F.col("course_code").isin(codes))
    g = x.groupBy("document_id", "year", "exam_type").agg(F.array_sort(F.collect_list(F.struct("unit", "question_id", "text", "marks"))).alias("questions"))
    return g.orderBy(F.desc("year"), "exam_type", "document_id")


def semester_groups(courses: DataFrame) -> DataFrame:
    """Courses, papers and questions by semester (none is 0), with a grand total whose semester is NULL."""
    x = courses.select(F.coalesce("semester", F.lit(0)).alias("semester"), "n_papers", "n_questions")
    return x.rollup("semester").agg(F.count(F.lit(1)).alias("n_courses"), F.sum("n_papers").alias("n_papers"), F.sum("n_questions").alias("n_questions"))


def linked_papers(scheme: DataFrame, papers: DataFrame) -> DataFrame:
    """Each scheme course (code, title) with the papers under that code and title; 0 and no years where none."""
    p = papers.groupBy("document_id", F.col("course_code").alias("p_code"), F.col("course_title").alias("p_title")).agg(F.sort_array(F.collect_set("year")).alias("years"))
    p = p.groupBy("p_code", "p_title").agg(F.count("document_id").alias("n"), joined(_union("years")).alias("y"))
    x = scheme.join(p, (F.col("code") == F.col("p_code")) & (F.col("title") == F.col("p_title")), "left")
    return x.select("code", "title", F.coalesce("n", F.lit(0)).alias("n_papers"), F.coalesce("y", F.lit("")).alias("year_list"))


#: Words that say nothing about what a course is about.
GENERIC_WORDS = ["introduction", "foundations", "fundamentals", "advanced", "principles", "laboratory", "techniques", "systems", "theory", "applications", "concepts"]


def keywords(title: Column) -> Column:
    """The distinctive words of a title: four letters or more, not generic."""
    return F.filter(F.split(F.lower(title), "[^a-z]+"), lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC_WORDS))


def squashed(title: Column) -> Column:
    """The letters of a title."""
    return F.regexp_replace(F.lower(title), "[^a-z]", "")


def share_keyword(a: Column, b: Column) -> Column:
    """Whether a distinctive word of ``a`` is in ``b``, letters only."""
    letters = squashed(b)
    return F.exists(keywords(a), lambda w: F.contains(letters, w))


def reused_codes(scheme: DataFrame, papers: DataFrame, links: DataFrame) -> DataFrame:
    """Papers' titles under a scheme's code that are not linked to it and share no distinctive word with it."""
    p = papers.select(F.col("course_code").alias("p_code"), F.col("course_title").alias("p_title")).where("p_title <> ''").distinct()
    x = scheme.join(p, F.col("code") == F.col("p_code")).select("code", "title", "p_title")
    x = x.join(links.select("code", "p_title"), ["code", "p_title"], "left_anti")
    return x.where(~share_keyword(F.col("title"), F.col("p_title"))).select("code", "title", "p_title")


def moved_course(linked: DataFrame, reused: DataFrame) -> DataFrame:
    """The first course whose papers sit under a code that another course has now; else the first with papers under another code.

    ``linked`` has code, title, p_code; one row comes out.
    """
    again = reused.select(F.col("code").alias("r_code")).distinct()
    x = linked.where(F.col("code") != F.col("p_code")).join(again, F.col("p_code") == F.col("r_code"), "left")
    x = x.withColumn("choice", F.when(F.col("r_code").isNotNull(), 0).otherwise(1))
    return x.orderBy("choice", "code", "p_code", "title").limit(1).select("code", "title", "p_code")


def department_rollup(departments: DataFrame, counted: dict[str, DataFrame], rank: Column) -> DataFrame:
    """Each department with a count from each table (all have ``dept``), in the order of ``rank``, then questions."""
    x = departments
    for name, df in counted.items():
        c = df.groupBy(F.col("dept").alias(f"d_{name}")).agg(F.count(F.lit(1)).alias(f"c_{name}"))
        x = x.join(c, F.col("dept") == F.col(f"d_{name}"), "left").withColumn(name, F.coalesce(f"c_{name}", F.lit(0))).drop(f"d_{name}", f"c_{name}")
    return x.orderBy(rank, F.desc("n_questions"), "dept")


def shelves(library: DataFrame) -> DataFrame:
    """The library by study year and subject (whatever its case): papers, semesters, first code, branches."""
    x = library.withColumns({"y": F.coalesce("study_year", F.lit(0)), "s": F.lower("subject")})
    g = x.groupBy("y", "s").agg(
        F.count(F.lit(1)).alias("n_papers"),
        F.countDistinct("semester").alias("n_semesters"),
        F.min_by("course_code", "paper_id").alias("course_code"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("branch", ", "))))), ",").alias("branches"),
    )
    return g.select(F.col("y").alias("study_year"), F.col("s").alias("subject"), "n_papers", "n_semesters", "course_code", "branches").orderBy(F.when(F.col("study_year") == 0, 9).otherwise(F.col("study_year")), F.desc("n_papers"), "subject")


def library_stats(library: DataFrame) -> DataFrame:
    return library.agg(F.count(F.lit(1)).alias("n_papers"), F.countDistinct(F.struct(F.lower("subject"), F.coalesce("study_year", F.lit(0)))).alias("n_shelves"), F.countDistinct("source").alias("n_sources"))


def subjects(library: DataFrame, limit: int = 400) -> DataFrame:
    return library.groupBy(F.lower("subject").alias("subject")).agg(F.count(F.lit(1)).alias("n_papers")).orderBy(F.desc("n_papers"), "subject").limit(limit)


def text_source(pages: DataFrame, min_chars: int = 40) -> DataFrame:
    """Per document: where its text is from (a page with too few characters has none) and its number of pages."""
    own = F.length(F.regexp_replace("text", r"\s+", "")) >= min_chars
    g = pages.groupBy("document_id").agg(F.bool_or(own & (F.col("source") == "text-layer")).alias("t"), F.bool_or(own & (F.col("source") == "ocr")).alias("o"), F.count(F.lit(1)).alias("n_pages"))
    return g.select("document_id", F.when(F.col("t") & F.col("o"), "mixed").when(F.col("t"), "text-layer").when(F.col("o"), "ocr").otherwise("none").alias("text_source"), "n_pages")


def derived_status(papers: DataFrame, reviews: DataFrame) -> DataFrame:
    """needs_review while any open review that is not about topics is left, else ready."""
    o = reviews.where("status = 'open' AND type <> 'topic'").groupBy(F.col("document_id").alias("r_id")).agg(F.count(F.lit(1)).alias("n_open"))
    x = papers.select("document_id").join(o, F.col("document_id") == F.col("r_id"), "left")
    return x.select("document_id", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.when(F.col("n_open") > 0, "needs_review").otherwise("ready").alias("status"))


#: Pages that end within so many rows are taken as the first rows; a later page is looked for in a part of about PART_ROWS.
FIRST_ROWS = 10_000
PART_ROWS = 200_000


def page_of(df: DataFrame, order: list[Column], page: int, size: int, first_rows: int = FIRST_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """One page of an ordered table, with the total and the number of pages on each row; the page is kept in range.

    ``order`` is a total order. An early page is a top-k. For a late one the rows are dealt into ranges of the
    order, written, and counted by range; the counts (one row for each ``part_rows`` rows) say which ranges the page lies in, and only
    those are sorted. So no task holds the rows before the page.
    """
    total = df.count()
    n_pages = max(1, -(-total // size))
    skip = (min(max(1, page), n_pages) - 1) * size
    if skip + size > first_rows:
        ranged = settled(df.repartitionByRange(max(1, -(-total // part_rows)), *order).withColumn("__part", F.spark_partition_id()))
        df, skip = _ranges_with(ranged, skip, size)
    return df.orderBy(*order).offset(skip).limit(size).withColumns({"total": F.lit(total).cast("long"), "n_pages": F.lit(n_pages).cast("long")})


def _ranges_with(ranged: DataFrame, skip: int, size: int) -> tuple[DataFrame, int]:
    """The rows of the ranges that hold the places after ``skip``, and how many of those rows come before."""
    at, chosen, before = 0, [], 0
    for r in ranged.groupBy("__part").count().orderBy("__part").collect():
        if at < skip + size and at + r["count"] > skip:
            before = at if not chosen else before
            chosen.append(r["__part"])
        at += r["count"]
    return ranged.where(F.col("__part").isin(chosen)).drop("__part"), skip - before
