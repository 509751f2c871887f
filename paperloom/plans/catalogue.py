"""Catalogue, review and library queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.operators import analytics as A
from paperloom.operators import catalogue as C
from paperloom.operators import filters as FL
from paperloom.plans.analytics import _list
from paperloom.plans.registry import query
from paperloom.views import LIBRARY, PAPERS, QUESTIONS, REVIEWS, TOPICS, WITH


def _scheme(spark, d):
    """Scheme courses: a (code, title) for each brand and type of small parts."""
    return V.table(spark, d, "part").where("p_size <= 10").select(F.col("p_brand").alias("code"), F.col("p_type").alias("title")).distinct()


_SCHEME = "scheme AS (SELECT DISTINCT p_brand AS code, p_type AS title FROM part WHERE p_size <= 10)"


@query("jn2_topic_labels", f"{WITH}, {TOPICS} SELECT topic, coalesce(label, topic) AS label, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM questions) LEFT JOIN topics ON topic = name GROUP BY ALL")
def jn2(spark, d):
    used = V.questions(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return C.with_labels(used, V.topics(spark, d)).select("topic", "label", "n")


@query("jn3_topics_with_usage", f"{WITH}, {TOPICS}, u AS (SELECT t, count(*) AS n FROM (SELECT unnest(topics) AS t FROM questions WHERE marks > 40) GROUP BY t) SELECT name, label, status, coalesce(n, 0) AS n_questions FROM topics LEFT JOIN u ON name = t WHERE merged_into IS NULL")
def jn3(spark, d):
    return C.topics_with_usage(V.topics(spark, d), V.questions(spark, d).where("marks > 40"))


@query("jn4_review_queue", f"WITH {PAPERS}, {REVIEWS}, r AS (SELECT * FROM reviews WHERE status = 'open' AND type = 'error' ORDER BY created_at DESC, review_id DESC LIMIT 200) SELECT r.review_id, r.type, r.status, r.document_id, r.created_at, p.title, p.status AS document_status FROM r LEFT JOIN papers p USING (document_id)")
def jn4(spark, d):
    return C.review_queue(V.reviews(spark, d), V.papers(spark, d), "open", "error")


@query("jn5_scheme_papers", f"{WITH}, {_SCHEME}, p AS (SELECT course_code, course_title, count(DISTINCT document_id) AS n, {_list('year')} AS y FROM questions WHERE marks > 30 GROUP BY ALL) SELECT code, title, coalesce(n, 0) AS n_papers, coalesce(y, '') AS year_list FROM scheme LEFT JOIN p ON code = course_code AND title = course_title")
def jn5(spark, d):
    return C.linked_papers(_scheme(spark, d), V.questions(spark, d).where("marks > 30"))


_WORDS = "', '".join(C.GENERIC_WORDS)


def _share(a: str, b: str) -> str:
    return f"len(list_filter(string_split_regex(lower({a}), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ('{_WORDS}') AND contains(regexp_replace(lower({b}), '[^a-z]', '', 'g'), w))) > 0"


_REUSED = f"reused AS (SELECT DISTINCT code, title, course_title AS p_title FROM scheme JOIN questions ON code = course_code WHERE course_title <> '' AND NOT (code = 'Brand#3' AND course_title = 'PROMO') AND NOT ({_share('title', 'course_title')}))"


def _reused(spark, d):
    links = spark.createDataFrame([("Brand#3", "PROMO")], "code string, p_title string")
    return C.reused_codes(_scheme(spark, d), V.questions(spark, d), links)


@query("jn6_code_reuse", f"{WITH}, {_SCHEME}, {_REUSED} SELECT * FROM reused")
def jn6(spark, d):
    return _reused(spark, d)


@query("jn15_moved_course", f"{WITH}, {_SCHEME}, {_REUSED}, l AS (SELECT DISTINCT s.code, s.title, q.course_code AS p_code FROM scheme s JOIN questions q ON s.title = q.course_title WHERE s.code <> q.course_code) SELECT code, title, p_code FROM l ORDER BY CASE WHEN p_code IN (SELECT code FROM reused) THEN 0 ELSE 1 END, code, p_code, title LIMIT 1")
def jn15(spark, d):
    q = V.questions(spark, d).select(F.col("course_code").alias("p_code"), "course_title").distinct()
    s = _scheme(spark, d)
    return C.moved_course(s.join(q, s.title == q.course_title).select("code", "title", "p_code"), _reused(spark, d))


@query("agg27_papers_per_scheme_course", f"{WITH}, {_SCHEME} SELECT code, count(DISTINCT (course_title, document_id)) AS n_papers FROM scheme LEFT JOIN questions ON code = course_code AND title = course_title GROUP BY code")
def agg27(spark, d):
    return C.linked_papers(_scheme(spark, d), V.questions(spark, d)).groupBy("code").agg(F.sum("n_papers").alias("n_papers"))


@query("jn11_papers_with_untagged", f"{WITH} SELECT document_id, status FROM papers WHERE status IN ('O', 'P') AND document_id IN (SELECT document_id FROM questions WHERE text LIKE '%ring%')")
def jn11(spark, d):
    # The words "ring" are taken out of the tags; questions left with none are untagged.
    q = V.questions(spark, d).where(F.size(F.filter("topics", lambda t: t != "ring")) < F.size("topics"))
    return V.papers(spark, d).where("status IN ('O', 'P')").join(q, "document_id", "left_semi").select("document_id", "status")


@query("jn14_department_rollup", f"WITH {LIBRARY}, d AS (SELECT DISTINCT course_code AS dept FROM library) SELECT dept, (SELECT count(*) FROM library WHERE course_code = dept) AS n_papers, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = dept) AS n_questions, (SELECT count(*) FROM library WHERE course_code = dept AND exam_type = 'SEE') AS n_notes FROM d")
def jn14(spark, d):
    lib, l = V.library(spark, d).withColumn("dept", F.col("course_code")), V.table(spark, d, "lineitem")
    part = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("dept"))
    counted = {"n_papers": lib, "n_questions": l.join(part, l.l_partkey == part.p_partkey), "n_notes": lib.where("exam_type = 'SEE'")}
    return C.department_rollup(lib.select("dept").distinct(), counted, F.when(F.col("n_papers") > 90, 0).when(F.col("n_papers") > 80, 1).otherwise(2))


_TITLES = "SELECT course_code, course_title, row_number() OVER (PARTITION BY course_code ORDER BY count(*) DESC, length(course_title), course_title) AS r FROM questions WHERE course_title IS NOT NULL AND length(course_title) < 80 GROUP BY 1, 2"
_SEMS = "SELECT course_code, semester, row_number() OVER (PARTITION BY course_code ORDER BY count(*) DESC, semester) AS r FROM questions WHERE semester IS NOT NULL GROUP BY 1, 2"
_COURSES = f"""courses AS (SELECT q.course_code, branches, n_papers, n_questions, year_list, t.course_title AS title, s.semester FROM
(SELECT course_code, {_list('branch')} AS branches, count(DISTINCT document_id) AS n_papers, count(*) AS n_questions, {_list('year')} AS year_list FROM questions WHERE course_code <> '' GROUP BY 1) q
LEFT JOIN (SELECT * FROM ({_TITLES}) WHERE r = 1) t USING (course_code) LEFT JOIN (SELECT * FROM ({_SEMS}) WHERE r = 1) s USING (course_code))"""


@query("agg11_courses_from_papers", f"{WITH}, {_COURSES} SELECT * FROM courses")
def agg11(spark, d):
    return C.courses_from_papers(V.questions(spark, d))


@query("agg12_branch_rollup", f"{WITH}, q AS (SELECT coalesce(branch, 'COMMON') AS branch, count(DISTINCT course_code) AS n_courses, count(*) FILTER (kind = 'question') AS n_questions FROM questions GROUP BY 1), p AS (SELECT coalesce(branch, 'COMMON') AS branch, count(*) AS n_papers FROM papers GROUP BY 1) SELECT branch, n_papers, coalesce(n_courses, 0) AS n_courses, coalesce(n_questions, 0) AS n_questions FROM p LEFT JOIN q USING (branch)")
def agg12(spark, d):
    return C.branch_rollup(V.papers(spark, d), V.questions(spark, d))


@query("agg13_branch_catalogue", f"{WITH}, {_COURSES} SELECT * FROM courses WHERE list_contains(string_split(branches, ','), 'NATION_7')")
def agg13(spark, d):
    return C.branch_catalogue(C.courses_from_papers(V.questions(spark, d)), "NATION_7")


@query("agg14_course_questions", f"{WITH} SELECT document_id, year, exam_type, array_to_string(list(unit || ':' || question_id ORDER BY unit, question_id), ';') AS questions FROM questions WHERE course_code IN ('Brand#4', 'Brand#9') GROUP BY ALL")
def agg14(spark, d):
    x = C.course_questions(V.questions(spark, d), ["Brand#4", "Brand#9"])
    return x.select("document_id", "year", "exam_type", F.array_join(F.transform("questions", lambda q: F.concat(q["unit"], F.lit(":"), q["question_id"])), ";").alias("questions"))


@query("agg14_course_topics", f"{WITH} SELECT topic, count(DISTINCT document_id) AS n_papers, count(*) AS n_questions FROM (SELECT *, unnest(topics) AS topic FROM questions WHERE course_code IN ('Brand#4', 'Brand#9')) GROUP BY 1 ORDER BY n_papers DESC, n_questions DESC, topic LIMIT 15")
def agg14t(spark, d):
    return A.topic_frequency(V.questions(spark, d).where(F.col("course_code").isin("Brand#4", "Brand#9")), 15).select("topic", "n_papers", "n_questions")


@query("agg15_semester_groups", f"{WITH}, {_COURSES} SELECT coalesce(semester, 0) AS semester, count(*) AS n_courses, sum(n_papers)::BIGINT AS n_papers, sum(n_questions)::BIGINT AS n_questions FROM courses GROUP BY 1 UNION ALL SELECT NULL, count(*), sum(n_papers)::BIGINT, sum(n_questions)::BIGINT FROM courses")
def agg15(spark, d):
    return C.semester_groups(C.courses_from_papers(V.questions(spark, d)))


@query("agg21_library_shelves", f"WITH {LIBRARY}, b AS (SELECT coalesce(study_year, 0) AS study_year, lower(subject) AS subject, array_to_string(list_sort(list(DISTINCT b)), ',') AS branches FROM (SELECT *, unnest(string_split(branch, ', ')) AS b FROM library) GROUP BY 1, 2) SELECT coalesce(l.study_year, 0) AS study_year, lower(l.subject) AS subject, count(*) AS n_papers, count(DISTINCT semester) AS n_semesters, arg_min(course_code, paper_id) AS course_code, any_value(b.branches) AS branches FROM library l JOIN b ON b.study_year = coalesce(l.study_year, 0) AND b.subject = lower(l.subject) GROUP BY 1, 2")
def agg21(spark, d):
    return C.shelves(V.library(spark, d))


@query("agg22_library_stats", f"WITH {LIBRARY} SELECT count(*) AS n_papers, count(DISTINCT (lower(subject), coalesce(study_year, 0))) AS n_shelves, count(DISTINCT source) AS n_sources FROM library")
def agg22(spark, d):
    return C.library_stats(V.library(spark, d))


@query("agg22_subjects", f"WITH {LIBRARY} SELECT lower(subject) AS subject, count(*) AS n_papers FROM library GROUP BY 1")
def agg22s(spark, d):
    return C.subjects(V.library(spark, d))


_PAGES = "pg AS (SELECT conv_id AS document_id, turn AS page, text, CASE WHEN role = 'user' THEN 'ocr' ELSE 'text-layer' END AS source FROM conversations)"


def _pages(spark, d):
    c = V.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text", F.when(F.col("role") == "user", "ocr").otherwise("text-layer").alias("source"))


@query("agg23_text_source", f"WITH {_PAGES}, g AS (SELECT document_id, bool_or(source = 'text-layer' AND ok) AS t, bool_or(source = 'ocr' AND ok) AS o, count(*) AS n_pages FROM (SELECT *, length(regexp_replace(text, '\\s+', '', 'g')) >= 120 AS ok FROM pg) GROUP BY 1) SELECT document_id, CASE WHEN t AND o THEN 'mixed' WHEN t THEN 'text-layer' WHEN o THEN 'ocr' ELSE 'none' END AS text_source, n_pages FROM g")
def agg23(spark, d):
    return C.text_source(_pages(spark, d), 120)


@query("agg24_document_status", f"WITH {PAPERS}, {REVIEWS}, o AS (SELECT document_id, count(*) AS n FROM reviews WHERE status = 'open' AND type <> 'topic' GROUP BY 1) SELECT document_id, coalesce(n, 0) AS n_open, CASE WHEN n > 0 THEN 'needs_review' ELSE 'ready' END AS status FROM papers LEFT JOIN o USING (document_id)")
def agg24(spark, d):
    return C.derived_status(V.papers(spark, d), V.reviews(spark, d))


@query("flt6_document_list", f"WITH {PAPERS} SELECT document_id, title, status FROM papers WHERE status = 'F' AND branch = 'NATION_8' AND year = 1997")
def flt6(spark, d):
    return FL.list_documents(V.papers(spark, d), status="F", branch="NATION_8", year=1997, month=None).select("document_id", "title", "status")


@query("flt7_all_words", f"WITH {LIBRARY} SELECT paper_id, title FROM library WHERE contains(lower(concat_ws(' ', subject, title, branch, course_code)), 'ring') AND contains(lower(concat_ws(' ', subject, title, branch, course_code)), 'b1') AND contains(lower(concat_ws(' ', subject, title, branch, course_code)), 'econ')")
def flt7(spark, d):
    return V.library(spark, d).where(FL.all_words(F.concat_ws(" ", "subject", "title", "branch", "course_code"), F.lit(" Ring  %b1 ECON_"))).select("paper_id", "title")


#: The exam types behind each choice of the library.
EXAM_GROUPS = {"internal": ["CIE", "CIE 1", "CIE 2", "CIE 3"], "final": ["SEE", "Makeup"]}


@query("flt8_library_facets", f"WITH {LIBRARY} SELECT paper_id FROM library WHERE study_year = 1 OR course_code = 'Brand#5' INTERSECT SELECT paper_id FROM library WHERE exam_type IN ('CIE', 'CIE 1', 'CIE 2', 'CIE 3')")
def flt8(spark, d):
    x = V.library(spark, d).where((F.col("course_code") == "Brand#5") | (F.col("study_year") == 1))
    return x.where(F.col("exam_type").isin(EXAM_GROUPS["internal"])).select("paper_id")


@query("flt9_label_contains", f"WITH {TOPICS} SELECT name, label FROM topics WHERE contains(lower(label), 'e')")
def flt9(spark, d):
    return V.topics(spark, d).where(FL.label_contains(F.col("label"), F.lit("E"))).select("name", "label")


@query("flt11_proposed_topics", f"WITH {TOPICS} SELECT name FROM topics WHERE status = 'proposed' AND (coalesce(contains(lower(label), 'brand#12'), false) OR len(list_filter(course_codes, lambda c: contains(lower(c), 'brand#12'))) > 0)")
def flt11(spark, d):
    q = F.lit("brand#12")
    return V.topics(spark, d).where((F.col("status") == "proposed") & (F.coalesce(FL.label_contains(F.col("label"), q), F.lit(False)) | F.exists("course_codes", lambda c: FL.label_contains(c, q)))).select("name")


@query("flt10_pruned_vectors", "SELECT vec_id AS id, label::BIGINT AS doc FROM embeddings")
def flt10(spark, d):
    return V.vectors(spark, d).drop("vec")  # the vectors are never read


@query("flt3_known_courses", f"{WITH}, r AS (SELECT c_custkey AS request_id, ['Brand#' || (c_custkey % 40), 'Brand#' || (c_custkey % 7)] AS codes FROM customer), x AS (SELECT request_id, unnest(codes) AS code FROM r) SELECT r.request_id, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT code FROM x WHERE x.request_id = r.request_id AND code IN (SELECT p_brand FROM part))), '') AS codes FROM r")
def flt3(spark, d):
    c = V.table(spark, d, "customer")
    r = c.select(F.col("c_custkey").alias("request_id"), F.array(F.concat(F.lit("Brand#"), F.col("c_custkey") % 40), F.concat(F.lit("Brand#"), F.col("c_custkey") % 7)).alias("codes"))
    known = V.table(spark, d, "part").select(F.col("p_brand").alias("code"))
    return FL.known_courses(r, known).select("request_id", F.array_join("codes", ",").alias("codes"))


@query("flt2_lenient_parameters", """WITH p AS (SELECT c_custkey AS slice_id, (1985 + c_custkey % 130)::VARCHAR AS yf, 'x' || c_custkey AS yt, (c_custkey % 12)::VARCHAR AS sem, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 150)::VARCHAR END AS lim, CASE c_custkey % 3 WHEN 0 THEN ' cie' WHEN 1 THEN 'Makeup' ELSE 'other' END AS ex FROM customer)
SELECT slice_id, CASE WHEN yf::INT BETWEEN 1990 AND 2100 THEN yf::INT END AS year_from, NULL::INT AS year_to, CASE WHEN sem::INT BETWEEN 1 AND 8 THEN sem::INT END AS semester, CASE WHEN lim IS NULL THEN 20 WHEN lim::INT BETWEEN 1 AND 100 THEN lim::INT END AS "limit", CASE trim(ex) WHEN 'cie' THEN 'CIE' WHEN 'Makeup' THEN 'Makeup' END AS exam_type, 'A,B' AS courses FROM p""")
def flt2(spark, d):
    k = F.col("c_custkey")
    p = V.table(spark, d, "customer").select(
        k.alias("slice_id"), (1985 + k % 130).cast("string").alias("year_from"), F.concat(F.lit("x"), k).alias("year_to"), (k % 12).cast("string").alias("semester"), F.when(k % 4 > 0, (k % 150).cast("string")).alias("limit"),
        F.when(k % 3 == 0, " cie").when(k % 3 == 1, "Makeup").otherwise("other").alias("exam_type"), F.lit(" b, a,,A ").alias("course"),
    )
    return FL.lenient_parameters(p)


@query("srt2_page_with_total", f"WITH {PAPERS} SELECT document_id, (SELECT count(*) FROM papers) AS total, ceil((SELECT count(*) FROM papers) / 25)::BIGINT AS n_pages FROM papers ORDER BY created_at DESC, document_id LIMIT 25 OFFSET 50")
def srt2(spark, d):
    return C.page_of(V.papers(spark, d).select("document_id", "created_at"), [F.desc("created_at"), F.asc("document_id")], 3, 25).select("document_id", "total", "n_pages")


@query("srt2_late_page", """SELECT l_orderkey, l_linenumber, l_shipdate, total, n_pages FROM (SELECT *, greatest(1, ceil(total / 25))::BIGINT AS n_pages FROM (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem))
WHERE r > 25 * (least(2000, n_pages) - 1) AND r <= 25 * least(2000, n_pages)""")
def srt2_late(spark, d):
    """Page 2,000, far behind the first rows, or the last page."""
    x = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    order = [F.desc("l_shipdate"), *map(F.asc, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return C.page_of(x, order, 2000, 25).drop("l_partkey", "l_suppkey")


@query("srt3_custom_order", f"WITH {LIBRARY} SELECT paper_id, year, exam_type FROM library ORDER BY CASE exam_type WHEN 'SEE' THEN 0 WHEN 'Makeup' THEN 1 ELSE 2 END, year DESC NULLS LAST, paper_id LIMIT 100")
def srt3(spark, d):
    rank = F.when(F.col("exam_type") == "SEE", 0).when(F.col("exam_type") == "Makeup", 1).otherwise(2)
    return V.library(spark, d).orderBy(rank, F.desc_nulls_last("year"), "paper_id").limit(100).select("paper_id", "year", "exam_type")


@query("srt4_top_of_each_key", f"{WITH} SELECT course_code, question_id, marks, r FROM (SELECT *, row_number() OVER (PARTITION BY course_code ORDER BY marks DESC NULLS LAST, question_id) AS r FROM questions) WHERE r <= 3")
def srt4(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("course_code").orderBy(F.desc_nulls_last("marks"), "question_id")
    return V.questions(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("course_code", "question_id", "marks", F.col("r").cast("long").alias("r"))


@query("set1_union_of_lists", f"{WITH}, {_SCHEME} SELECT code, title, NULL::BIGINT AS n_papers FROM scheme UNION ALL SELECT course_code, NULL, count(DISTINCT document_id) FROM questions GROUP BY 1")
def set1(spark, d):
    p = A.counted_by_paper(V.questions(spark, d).withColumnRenamed("course_code", "code"), "code").drop("n_questions")
    return _scheme(spark, d).unionByName(p, allowMissingColumns=True)


@query("set2_codes_without_scheme", f"{WITH}, {_SCHEME} SELECT course_code AS code, course_title AS title FROM questions EXCEPT SELECT code, title FROM scheme")
def set2(spark, d):
    return V.questions(spark, d).select(F.col("course_code").alias("code"), F.col("course_title").alias("title")).subtract(_scheme(spark, d))
