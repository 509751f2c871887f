"""Analytics queries over the whole archive (SRC: adapter views), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import analytics as A
from paperloom.operators import filters as FL
from paperloom.plans.registry import query
from paperloom.views import WITH, papers, questions

_Q = "SELECT * FROM questions WHERE kind = 'question'"
_S = f"{WITH}, s AS ({_Q})"


def _slice(spark, d):
    return FL.slice_questions(questions(spark, d))




def _list(column: str) -> str:
    """SQL: the distinct values of a group, sorted, joined by commas."""
    return f"array_to_string(list_sort(list_distinct(list({column}) FILTER ({column} IS NOT NULL))), ',')"


_TOPICS = """SELECT topic, count(*) AS n_questions, count(DISTINCT document_id) AS n_papers, sum(coalesce(marks, 0))::BIGINT AS total_marks, {years} AS year_list
FROM (SELECT *, unnest(topics) AS topic FROM {src}) GROUP BY topic ORDER BY n_papers DESC, n_questions DESC, topic LIMIT {n}"""


def topic_sql(src: str, n: int) -> str:
    return _TOPICS.format(years=_list("year"), src=src, n=n)


@query("agg1_topic_frequency", f"{_S} {topic_sql('s', 20)}")
def agg1(spark, d):
    return A.topic_frequency(_slice(spark, d))


@query("agg6_overview_topics", f"{_S} {topic_sql('s', 10)}")
def agg6(spark, d):
    return A.topic_frequency(_slice(spark, d), 10)


@query("flt1_slice_filter", f"""{WITH}, s AS ({_Q} AND year BETWEEN 1995 AND 1998 AND upper(course_code) IN ('BRAND#11', 'BRAND#2', 'BRAND#7') AND semester = 3 AND lower(exam_type) = '1-urgent')
SELECT question_id, year, course_code, branch FROM s""")
def flt1(spark, d):
    return FL.slice_questions(questions(spark, d), 1995, 1998, " brand#2,Brand#7,,brand#11", None, 3, "1-Urgent").select("question_id", "year", "course_code", "branch")


@query("flt1_branch_topics", f"{WITH}, s AS ({_Q} AND branch = 'NATION_3' AND year >= 1996) {topic_sql('s', 20)}")
def flt1b(spark, d):
    return A.topic_frequency(FL.slice_questions(questions(spark, d), year_from=1996, branch="NATION_3"))


for _dim in ("year", "branch", "exam_type", "semester", "unit", "course_code"):

    @query(f"agg2_distribution_{_dim}", f"{_S} SELECT {_dim}::VARCHAR AS key, count(*) AS n_questions, count(DISTINCT document_id) AS n_papers FROM s GROUP BY 1")
    def agg2(spark, d, dim=_dim):
        return A.distribution(_slice(spark, d), dim)


_REC = """SELECT group_id, count(DISTINCT document_id) AS n_papers, {count} {years} AS year_list,
arg_max(text, (coalesce(year, -1), question_id)) AS text, array_to_string(arg_max(topics, (coalesce(year, -1), question_id)), ',') AS topics, arg_max(course_title, (coalesce(year, -1), question_id)) AS course_title
FROM s GROUP BY group_id HAVING count(DISTINCT document_id) >= 2 ORDER BY n_papers DESC, {order} group_id LIMIT {n}"""


@query("agg3_recurring_questions", _S + _REC.format(count="", years=_list("year"), order="", n=20))
def agg3(spark, d):
    return A.recurring_questions(_slice(spark, d))


@query("agg7_overview_recurring", _S + _REC.format(count="count(*) AS n_questions,", years=_list("year"), order="n_questions DESC,", n=12))
def agg7(spark, d):
    return A.recurring_questions(_slice(spark, d), 12, keep_null_groups=False, count_questions=True)


_RECURRING = "(SELECT count(*) FROM (SELECT group_id FROM s WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT document_id) >= 2))"


@query("agg7_recurring_count", f"{_S} SELECT {_RECURRING} AS recurring")
def agg7c(spark, d):
    return A.recurring_count(_slice(spark, d))


@query(
    "agg4_slice_kpis",
    f"{_S} SELECT count(*) AS n_questions, coalesce(sum(marks), 0)::BIGINT AS total_marks, count(DISTINCT document_id) AS n_papers, count(DISTINCT nullif(course_code, '')) AS n_courses, min(year) AS min_year, max(year) AS max_year, (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM s)) AS n_topics FROM s",
)
def agg4(spark, d):
    return A.kpis(_slice(spark, d))


_DIMS = " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c}::VARCHAR AS key, document_id, coalesce(marks, 0) AS m FROM s WHERE {c} IS NOT NULL AND {c}::VARCHAR <> ''" + (" AND marks > 0" if c == "marks" else "") for c in A.FACETS)


@query("agg5_facets", f"{_S}, u AS ({_DIMS}) SELECT dimension, key, count(*) AS n_questions, count(DISTINCT document_id) AS n_papers, sum(m)::BIGINT AS total_marks FROM u GROUP BY ALL")
def agg5(spark, d):
    return A.facets(_slice(spark, d))


@query("agg5_grouping_sets", f"{_S}, u AS ({_DIMS}) SELECT dimension, key, count(*) AS n_questions, sum(m)::BIGINT AS total_marks FROM u GROUP BY ALL")
def agg5g(spark, d):
    return A.facets_by_grouping_sets(_slice(spark, d))


@query("agg8_filter_options", f"{_S} SELECT course_code AS code, arg_min(course_title, question_id) AS title, {_list('semester')} AS semesters, count(*) AS n_questions, min(semester) AS first_semester FROM s WHERE course_code <> '' GROUP BY course_code")
def agg8(spark, d):
    return A.filter_options(_slice(spark, d))


@query("agg8_option_values", f"{_S} SELECT DISTINCT * FROM (SELECT 'year' AS name, year::VARCHAR AS value FROM s UNION ALL SELECT 'semester', semester::VARCHAR FROM s UNION ALL SELECT 'exam_type', exam_type FROM s) WHERE value <> ''")
def agg8v(spark, d):
    return A.option_values(_slice(spark, d))


@query(
    "agg9_corpus_stats",
    f"""{WITH} SELECT 'documents' AS metric, status AS key, count(*) AS n FROM papers GROUP BY status UNION ALL SELECT 'rows', kind, count(*) FROM questions GROUP BY kind
UNION ALL SELECT 'courses', NULL, count(DISTINCT course_code) FROM questions UNION ALL SELECT 'topics', NULL, count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM questions)
UNION ALL SELECT 'first_year', NULL, min(year) FROM questions UNION ALL SELECT 'last_year', NULL, max(year) FROM questions""",
)
def agg9(spark, d):
    return A.corpus_stats(questions(spark, d), papers(spark, d))


def _counts_sql(name: str, src: str, column: str) -> str:
    return f"SELECT '{name}' AS name, array_to_string(list_sort(list(coalesce(k, 'none') || '=' || n)), ',') AS counts FROM (SELECT {column}::VARCHAR AS k, count(*) AS n FROM {src} GROUP BY 1)"


@query("agg10_moderation_summary", WITH + " " + " UNION ALL ".join([_counts_sql("documents", "papers", "status"), _counts_sql("questions", "questions", "kind"), _counts_sql("branches", "papers", "branch"), _counts_sql("activity", "events", "event_type")]))
def agg10(spark, d):
    from paperloom.views import events

    return A.moderation_summary({"documents": (papers(spark, d), "status"), "questions": (questions(spark, d), "kind"), "branches": (papers(spark, d), "branch"), "activity": (events(spark, d), "kind")})


@query("agg16_revision_ranking", f"{_S} SELECT topic, count(DISTINCT document_id) AS n_papers, sum(coalesce(marks, 0))::BIGINT AS total_marks, (SELECT count(DISTINCT document_id) FROM s) AS of_papers FROM (SELECT *, unnest(topics) AS topic FROM s) GROUP BY topic ORDER BY n_papers DESC, total_marks DESC, topic LIMIT 8")
def agg16(spark, d):
    return A.revision_ranking(_slice(spark, d))


@query("agg17_group_recurrence", f"{WITH}, g AS (SELECT group_id, count(DISTINCT document_id) AS p, {_list('year')} AS y FROM questions WHERE group_id IS NOT NULL GROUP BY group_id) SELECT question_id, coalesce(p, 1) AS recurrence, coalesce(y, year::VARCHAR, '') AS year_list FROM questions LEFT JOIN g USING (group_id)")
def agg17(spark, d):
    return A.group_recurrence(questions(spark, d))


@query(
    "agg19_takeaways",
    f"""{_S}, t AS (SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM s) GROUP BY 1), u AS (SELECT unit, sum(coalesce(marks, 0)) AS m FROM s WHERE unit IS NOT NULL GROUP BY 1 HAVING sum(coalesce(marks, 0)) > 0),
m AS (SELECT marks, count(*) AS n FROM s WHERE marks > 0 GROUP BY 1)
SELECT (SELECT topic FROM t ORDER BY n DESC, topic DESC LIMIT 1) AS top_topic, floor((SELECT max(n) FROM t) * 100 / (SELECT count(*) FROM s) + 0.5)::BIGINT AS topic_percent,
CASE WHEN (SELECT count(*) FROM u) > 1 THEN (SELECT unit FROM u ORDER BY m DESC, unit DESC LIMIT 1) END AS top_unit, CASE WHEN (SELECT count(*) FROM u) > 1 THEN floor((SELECT max(m) * 100 / sum(m) FROM u) + 0.5)::BIGINT END AS unit_percent,
(SELECT marks FROM m ORDER BY n DESC, marks LIMIT 1) AS usual_marks, {_RECURRING} AS recurring""",
)
def agg19(spark, d):
    return A.takeaways(_slice(spark, d))


@query("agg20_year_series", f"{WITH}, s AS ({_Q}), b AS (SELECT min(year) AS a, max(year) AS b FROM s), y AS (SELECT unnest(generate_series(a, b)) AS year FROM b) SELECT y.year, count(s.question_id) AS n_questions, count(DISTINCT document_id) AS n_papers FROM y LEFT JOIN s USING (year) GROUP BY y.year")
def agg20(spark, d):
    # Every third year is taken out, so that there are gaps to fill.
    return A.year_series(_slice(spark, d))


@query("agg26_distinct_courses", f"{WITH} SELECT count(DISTINCT course_code) AS n_courses FROM questions")
def agg26(spark, d):
    return questions(spark, d).agg(F.countDistinct("course_code").alias("n_courses"))


@query("set3_distinct_topics", f"{WITH} SELECT DISTINCT unnest(topics) AS topic FROM questions")
def set3(spark, d):
    return questions(spark, d).select(F.explode("topics").alias("topic")).distinct()


@query("srt1_mixed_direction_top", f"{WITH} SELECT question_id, year, marks, semester FROM questions ORDER BY year DESC, marks ASC NULLS FIRST, semester DESC, question_id LIMIT 50")
def srt1(spark, d):
    return questions(spark, d).select("question_id", "year", "marks", "semester").orderBy(F.desc_nulls_last("year"), F.asc_nulls_first("marks"), F.desc("semester"), "question_id").limit(50)


@query("win1_latest_of_group", f"{WITH} SELECT group_id, arg_max(question_id, (year, question_id)) AS question_id, max(year) AS year FROM questions GROUP BY group_id")
def win1(spark, d):
    g = questions(spark, d).groupBy("group_id").agg(F.max(F.struct("year", "question_id")).alias("m"))
    return g.select("group_id", "m.question_id", "m.year")
