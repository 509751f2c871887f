"""Filtered aggregations over question rows.

All of them aggregate in the map tasks first and shuffle only partial results. Every limit stands behind a
total order, so results do not depend on how the rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(values: Column) -> Column:
    """A sorted list as one comma-separated string."""
    return F.array_join(F.array_sort(values).cast("array<string>"), ",")


def year_list(column: str = "year") -> Column:
    return joined(F.collect_set(column))


def topic_frequency(questions: DataFrame, limit: int = 20) -> DataFrame:
    """topic, n_questions, n_papers, total_marks, year_list: by papers, then questions, then topic."""
    x = questions.select("document_id", "marks", "year", F.explode("topics").alias("topic"))
    g = x.groupBy("topic").agg(F.count(F.lit(1)).alias("n_questions"), F.countDistinct("document_id").alias("n_papers"), F.sum(F.coalesce("marks", F.lit(0))).alias("total_marks"), year_list().alias("year_list"))
    return g.orderBy(F.desc("n_papers"), F.desc("n_questions"), "topic").limit(limit)


def distribution(questions: DataFrame, dimension: str) -> DataFrame:
    """key (NULL kept), n_questions, n_papers."""
    g = questions.groupBy(F.col(dimension).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_questions"), F.countDistinct("document_id").alias("n_papers"))
    return g.orderBy(F.asc_nulls_first("key"))


def _latest(column: str) -> Column:
    """The value of the latest year; of one year, that of the largest question id."""
    return F.max_by(column, F.struct(F.coalesce("year", F.lit(-1)), "question_id"))


def recurring_questions(questions: DataFrame, limit: int = 20, keep_null_groups: bool = True, count_questions: bool = False) -> DataFrame:
    """Groups asked in two papers or more: n_papers, year_list and the latest text, topics and title."""
    x = questions if keep_null_groups else questions.where(F.col("group_id").isNotNull())
    g = x.groupBy("group_id").agg(
        F.countDistinct("document_id").alias("n_papers"),
        F.count(F.lit(1)).alias("n_questions"),
        year_list().alias("year_list"),
        _latest("text").alias("text"),
        F.array_join(_latest("topics"), ",").alias("topics"),
        _latest("course_title").alias("course_title"),
    ).where(F.col("n_papers") >= 2)
    order = [F.desc("n_papers"), *([F.desc("n_questions")] if count_questions else []), F.asc_nulls_first("group_id")]
    out = g.orderBy(*order).limit(limit)
    return out if count_questions else out.drop("n_questions")


def recurring_count(questions: DataFrame) -> DataFrame:
    """How many groups are asked in two papers or more."""
    g = questions.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.countDistinct("document_id").alias("n"))
    return g.where("n >= 2").agg(F.count(F.lit(1)).alias("recurring"))


def kpis(questions: DataFrame) -> DataFrame:
    """One row: questions, marks, papers, non-empty courses, topics, first and last year."""
    a = questions.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.coalesce(F.sum("marks"), F.lit(0)).alias("total_marks"),
        F.countDistinct("document_id").alias("n_papers"),
        F.countDistinct(F.when(F.col("course_code") != "", F.col("course_code"))).alias("n_courses"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )
    t = questions.select(F.explode("topics").alias("t")).agg(F.countDistinct("t").alias("n_topics"))
    return a.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


def counted_by_paper(rows: DataFrame, *keys: str, marks: str | None = None) -> DataFrame:
    """The keys with n_questions, n_papers and, where ``marks`` is named, total_marks.

    A paper's rows are counted first, where they lie; what is then shuffled is one partial row a key and task, not every pair of key and paper.
    """
    total = [] if marks is None else [F.sum(F.coalesce(marks, F.lit(0))).alias("total_marks")]
    paper = rows.groupBy("document_id", *keys).agg(F.count(F.lit(1)).alias("n_questions"), *total)
    sums = [] if marks is None else [F.sum("total_marks").alias("total_marks")]
    return paper.groupBy(*keys).agg(F.sum("n_questions").alias("n_questions"), F.count("document_id").alias("n_papers"), *sums)


FACETS = ("year", "exam_type", "unit", "marks", "bloom")


def facets(questions: DataFrame) -> DataFrame:
    """dimension, key, n_questions, n_papers, total_marks for five dimensions in one pass over the rows.

    Empty keys go, and of the marks only those above 0 are keys. One Expand by dimension replaces five scans.
    """
    keys = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in FACETS])
    x = questions.select("document_id", F.coalesce("marks", F.lit(0)).alias("m"), F.explode(keys).alias("k")).where("k.key IS NOT NULL AND k.key <> '' AND NOT (k.dimension = 'marks' AND CAST(k.key AS BIGINT) <= 0)")
    return counted_by_paper(x.select("document_id", "m", F.col("k.dimension").alias("dimension"), F.col("k.key").alias("key")), "dimension", "key", marks="m")


def facets_by_grouping_sets(questions: DataFrame) -> DataFrame:
    """The same without paper counts, by GROUPING SETS."""
    g = questions.groupingSets([[F.col(d)] for d in FACETS], *[F.col(d) for d in FACETS]).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n_questions"), F.sum(F.coalesce("marks", F.lit(0))).alias("total_marks"))
    full = (1 << len(FACETS)) - 1
    which = [(full ^ (1 << (len(FACETS) - 1 - i)), d) for i, d in enumerate(FACETS)]
    dimension = F.coalesce(*[F.when(F.col("gid") == gid, F.lit(d)) for gid, d in which])
    key = F.coalesce(*[F.when(F.col("gid") == gid, F.col(d).cast("string")) for gid, d in which])
    out = g.select(dimension.alias("dimension"), key.alias("key"), "n_questions", "total_marks")
    return out.where("key IS NOT NULL AND key <> '' AND NOT (dimension = 'marks' AND CAST(key AS BIGINT) <= 0)")


def filter_options(questions: DataFrame) -> DataFrame:
    """code, first title, semesters, n_questions of each course, by least semester and code."""
    x = questions.where("course_code IS NOT NULL AND course_code <> ''")
    g = x.groupBy(F.col("course_code").alias("code")).agg(F.min_by("course_title", "question_id").alias("title"), joined(F.collect_set("semester")).alias("semesters"), F.count(F.lit(1)).alias("n_questions"), F.min("semester").alias("first_semester"))
    return g.orderBy(F.asc_nulls_first("first_semester"), "code")


def option_values(questions: DataFrame) -> DataFrame:
    """(name, value): the distinct non-empty years, semesters and exam types."""
    v = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in ("year", "semester", "exam_type")])
    return questions.select(F.explode(v).alias("v")).select("v.*").where("value IS NOT NULL AND value <> ''").distinct()


def corpus_stats(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """(metric, key, n): documents in all and by status, questions, notes, courses, topics and the year range of all kinds."""
    n = F.count(F.lit(1)).alias("n")
    none = F.lit(None).cast("string").alias("key")
    parts = [
        papers.groupBy(F.lit("documents").alias("metric"), F.col("status").alias("key")).agg(n),
        questions.groupBy(F.lit("rows").alias("metric"), F.col("kind").alias("key")).agg(n),
        questions.agg(F.countDistinct("course_code").alias("n")).select(F.lit("courses").alias("metric"), none, "n"),
        questions.select(F.explode("topics").alias("t")).agg(F.countDistinct("t").alias("n")).select(F.lit("topics").alias("metric"), none, "n"),
        questions.agg(F.min("year").alias("n")).select(F.lit("first_year").alias("metric"), none, "n"),
        questions.agg(F.max("year").alias("n")).select(F.lit("last_year").alias("metric"), none, "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def moderation_summary(counts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, counts): grouped counts of several tables, each as a sorted ``key=n`` list."""
    out = None
    for name, (df, column) in counts.items():
        g = df.groupBy(F.col(column).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        one = g.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce("k", F.lit("none")), F.lit("="), F.col("n")))), ",").alias("counts")).select(F.lit(name).alias("name"), "counts")
        out = one if out is None else out.unionByName(one)
    return out


def revision_ranking(questions: DataFrame, limit: int = 8) -> DataFrame:
    """Topics to revise: by papers, then marks; with the number of papers they could be in."""
    papers = questions.agg(F.countDistinct("document_id").alias("of_papers"))
    x = questions.select("document_id", "marks", F.explode("topics").alias("topic"))
    g = counted_by_paper(x, "topic", marks="marks").drop("n_questions")
    top = g.orderBy(F.desc("n_papers"), F.desc("total_marks"), "topic").limit(limit)
    return top.withColumn("k", F.lit(1)).join(papers.withColumn("k", F.lit(1)), "k").drop("k")


def group_recurrence(questions: DataFrame) -> DataFrame:
    """Each question with how many papers and years its group is in; without a group it is 1 and its own year."""
    g = questions.where(F.col("group_id").isNotNull()).groupBy("group_id").agg(F.countDistinct("document_id").alias("p"), year_list().alias("y"))
    x = questions.select("question_id", "group_id", "year").join(g, "group_id", "left")
    return x.select("question_id", F.coalesce("p", F.lit(1)).alias("recurrence"), F.coalesce("y", F.col("year").cast("string"), F.lit("")).alias("year_list"))


def takeaways(questions: DataFrame) -> DataFrame:
    """One row: the top topic and its share, the unit with most marks and its share, the most usual marks, how many groups repeat."""
    total = questions.agg(F.count(F.lit(1)).alias("all_questions"))
    t = questions.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    t = t.agg(F.max_by("topic", F.struct("n", "topic")).alias("top_topic"), F.max("n").alias("top_n"))
    u = questions.where("unit IS NOT NULL").groupBy("unit").agg(F.sum(F.coalesce("marks", F.lit(0))).alias("m")).where("m > 0")
    u = u.agg(F.max_by("unit", F.struct("m", "unit")).alias("u"), F.max("m").alias("m"), F.sum("m").alias("all_m"), F.count(F.lit(1)).alias("units"))
    u = u.select(F.when(F.col("units") > 1, F.col("u")).alias("top_unit"), F.when(F.col("units") > 1, F.floor(F.col("m") * 100 / F.col("all_m") + 0.5)).alias("unit_percent"))
    m = questions.where("marks > 0").groupBy("marks").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("marks", F.struct("n", F.expr("-marks"))).alias("usual_marks"))
    x = total
    for y in (t, u, m, recurring_count(questions)):
        x = x.withColumn("k", F.lit(1)).join(y.withColumn("k", F.lit(1)), "k").drop("k")  # one row each
    return x.select("top_topic", F.floor(F.col("top_n") * 100 / F.col("all_questions") + 0.5).alias("topic_percent"), "top_unit", "unit_percent", "usual_marks", "recurring")


def year_series(questions: DataFrame) -> DataFrame:
    """year, n_questions, n_papers for every year from the first to the last, zero where nothing was asked."""
    g = questions.where("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("q"), F.countDistinct("document_id").alias("p"))
    years = g.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    return years.join(g, "year", "left").select("year", F.coalesce("q", F.lit(0)).alias("n_questions"), F.coalesce("p", F.lit(0)).alias("n_papers"))


def result_facets(hits: DataFrame) -> DataFrame:
    """(query_id, facet, key, n) over returned hits: years, the top eight topics, and hits asked more than once."""
    n = F.count(F.lit(1)).alias("n")
    years = hits.groupBy("query_id", F.lit("year").alias("facet"), F.col("year").cast("string").alias("key")).agg(n)
    t = hits.select("query_id", F.explode("topics").alias("key")).groupBy("query_id", F.lit("topic").alias("facet"), "key").agg(n)
    t = t.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "key"))).where("r <= 8").drop("r")
    again = hits.where("recurrence > 1").groupBy("query_id", F.lit("repeated").alias("facet"), F.lit("").alias("key")).agg(n)
    return years.unionByName(t).unionByName(again)
