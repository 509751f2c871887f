"""Fields read out of lines, names and words: texts are made of the tables' values, and SQL says what has to come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.functions import scalars as S
from paperloom.operators import catalogue as C
from paperloom.operators import documents as D
from paperloom.operators import listing as L
from paperloom.operators import retrieval as R
from paperloom.plans.listings import _listing, _sql_without, _sql_words
from paperloom.plans.registry import query
from paperloom.plans.retrieval import _dot
from paperloom.views import VECTORS

_ROMAN = list(D.ROMAN)
_EXAMS = ["SEMESTER END EXAMINATIONS", "MAKE UP EXAMINATION", "Internal Assessment - Test 1", "SEMESTER END / SUPPLEMENTARY EXAMINATIONS"]
_PROGRAMS = ["Program : B.E. Computer Science and Engineering", "Branch : Civil", "Programme : Mechanical Engineering", "Branch : Common to all branches", "Course & Branch : B.E. / Cyber Security"]


def _pick(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


@query("doc2_headers", f"""SELECT o_orderkey AS document_id, 'XY' || (o_orderkey % 90 + 10) AS course_code, 'Theory of ' || initcap_ AS course_title, (o_orderkey % 8 + 1)::INT AS semester,
CASE o_orderkey % 4 WHEN 0 THEN 'SEE' WHEN 2 THEN 'CIE' ELSE 'Makeup' END AS exam_type, CASE WHEN o_orderkey % 2 = 0 AND month(o_orderdate) < 12 THEN monthname(o_orderdate) || '–' || monthname(make_date(2001, month(o_orderdate) + 1, 1)) ELSE monthname(o_orderdate) END AS month,
year(o_orderdate)::INT AS year, (50 + 50 * (o_orderkey % 2))::INT AS max_marks, CASE o_orderkey % 5 WHEN 0 THEN 'CSE' WHEN 1 THEN 'CV' WHEN 2 THEN 'ME' WHEN 4 THEN 'CY' END AS branch
FROM (SELECT *, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS initcap_ FROM orders JOIN customer ON o_custkey = c_custkey)""")
def doc2(spark, d):
    """A header for each order, with a title on one line, around its label, or with the marks in between."""
    k = F.col("o_orderkey")
    x = V.table(spark, d, "orders").join(V.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    name, marks = F.initcap("c_mktsegment"), F.concat(F.lit("Max. Marks : "), 50 + 50 * (k % 2))
    semester = F.concat(F.lit("Semester : "), F.when(k % 3 == 0, (k % 8 + 1).cast("string")).otherwise(_pick(_ROMAN, k % 8)))
    month, after = _pick(D.MONTHS, F.month("o_orderdate") - 1), _pick(D.MONTHS, F.month("o_orderdate") % 12)
    when = F.when((k % 2 == 0) & (F.month("o_orderdate") < 12), F.concat_ws(" / ", month, after)).otherwise(F.upper(month))
    exam = F.when((k % 4 == 2) & (k % 2 == 1), _EXAMS[2]).otherwise(_pick(_EXAMS, k % 4))
    title = F.when(k % 3 == 0, F.concat(F.lit("Course Name : Theory of "), name, F.lit("\n"), marks)).when(k % 3 == 1, F.concat(F.lit("Theory of\nCourse Name : : "), marks, F.lit("\n"), name)).otherwise(F.concat(F.lit("Course Name  Theory of\n"), marks, F.lit("\n"), name))
    code = F.concat(F.when(k % 2 == 0, "Course Code : 21/22/").otherwise("Subject Code: "), F.lit("XY"), k % 90 + 10)
    header = F.concat_ws("\n", F.concat(exam, F.lit(" - "), when, F.lit(" "), F.year("o_orderdate")), _pick(_PROGRAMS, k % 5), semester, code, title, F.lit("Duration : 3 Hrs"))
    return D.header_metadata(x.select(k.alias("document_id"), header.alias("header")))


@query("doc4_line_tails", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Explain item ' || l_partkey || ' now' AS text, CASE WHEN l_linenumber % 5 < 4 THEN l_quantity::INT % 20 + 1 END AS marks, CASE WHEN l_linenumber % 5 < 3 THEN 'CO' || (l_suppkey % 6 + 1) END AS co, CASE WHEN l_linenumber % 5 < 2 THEN 'L' || (l_partkey % 6 + 1) END AS bloom FROM lineitem""")
def doc4(spark, d):
    """Question lines with outcome, level and marks behind them, in several orders and spellings."""
    n = F.col("l_linenumber") % 5
    marks, co, level = (F.col("l_quantity").cast("int") % 20 + 1).cast("string"), F.col("l_suppkey") % 6 + 1, F.col("l_partkey") % 6 + 1
    tail = F.when(n == 0, F.concat(F.lit("\tCO"), co, F.lit("\tL"), level, F.lit("\t"), marks)).when(n == 1, F.concat(F.lit("  "), marks, F.lit("  BL-"), level, F.lit(" co "), co))
    tail = tail.when(n == 2, F.concat(F.lit(" CO-"), co, F.lit(", ("), marks, F.lit(" marks)"))).when(n == 3, F.concat(F.lit(" ["), marks, F.lit("M]"))).otherwise("")
    line = F.concat(F.lit("Explain  item "), "l_partkey", F.lit(" now"), tail)
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.tail_cells(line).alias("t")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t.*")


_SHARED = f"len(list_filter(string_split_regex(lower(a.p_name), '[^a-z]+'), lambda w: length(w) >= 4 AND w NOT IN ('{"', '".join(C.GENERIC_WORDS)}') AND contains(regexp_replace(lower(b.p_name || ' ' || b.p_type), '[^a-z]', '', 'g'), w))) > 0"


@query("fn3_shared_keywords", f"SELECT a.p_partkey, {_SHARED} AS shared FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def fn3(spark, d):
    p = V.table(spark, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.concat_ws(" ", "p_name", "p_type").alias("other"))
    return p.join(b, F.col("p_partkey") == F.col("k")).select("p_partkey", C.share_keyword(F.col("p_name"), F.col("other")).alias("shared"))


@query("fn4_cosines", f"WITH {VECTORS} SELECT a.id, round({_dot('a.vec', 'b.vec')}, 6) AS cosine FROM v a JOIN v b ON b.id = a.id + 1")
def fn4(spark, d):
    v = V.vectors(spark, d)
    b = v.select((F.col("id") - 1).alias("k"), F.col("vec").alias("other"))
    return v.join(b, F.col("id") == F.col("k")).select("id", F.round(R.dot("vec", "other"), 6).alias("cosine"))


@query("fn5_numerals", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN NULL ELSE (l_suppkey % 10 + 1)::INT END AS n FROM lineitem")
def fn5(spark, d):
    n, at = F.col("l_linenumber") % 3, F.col("l_suppkey") % 10
    text = F.when(n == 0, F.concat(F.lit("x"), at)).when(n == 1, F.when(at % 2 == 0, F.lower(_pick(_ROMAN, at))).otherwise(_pick(_ROMAN, at))).otherwise((at + 1).cast("string"))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", D.roman_to_int(text).alias("n"))


@query("fn6_course_codes", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'AB' || (s_suppkey % 90 + 10) WHEN 1 THEN '21CSE' || (s_suppkey % 900 + 100) || 'L' WHEN 2 THEN 'AL' || (s_suppkey % 90 + 10) END AS code FROM supplier")
def fn6(spark, d):
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("code ab"), k % 90 + 10, F.lit("/AB99(O)"))).when(k % 4 == 1, F.concat(F.lit("of 21cse"), k % 900 + 100, F.lit("L, CS11"))).when(k % 4 == 2, F.concat(F.lit("21/22/AL"), k % 90 + 10)).otherwise("no code, A1 or ABCDEFG22")
    return V.table(spark, d, "supplier").select("s_suppkey", D.first_course_code(text).alias("code"))


@query("fn11_words", f"SELECT doc_id, array_to_string(w, ' ') AS words, array_to_string(list_distinct_, ' ') AS keys FROM (SELECT doc_id, w, list_sort(list_distinct({_sql_without('w', L.KEY_STOP)})) AS list_distinct_ FROM (SELECT doc_id, {_sql_words('text')} AS w FROM documents))")
def fn11(spark, d):
    t = V.table(spark, d, "documents")
    return t.select("doc_id", F.array_join(L.listing_words(F.col("text")), " ").alias("words"), F.array_join(F.array_sort(L.key_words(F.col("text"))), " ").alias("keys"))


@query("fn12_file_names", "SELECT p_partkey, replace(p_name, ' ', '_') AS bare, 'pdf' AS ext, replace(p_name, ' ', ' ') AS spaced, p_name AS clean FROM part")
def fn12(spark, d):
    p = V.table(spark, d, "part")
    file = F.concat(F.translate("p_name", " ", "_"), F.lit(".PDF"))
    folder = F.concat((F.col("p_partkey") % 30).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " (a) ").otherwise(""), F.lit(". "), F.regexp_replace("p_name", " ", "__ "))
    return p.select("p_partkey", L.strip_extension(file).alias("bare"), L.extension(file).alias("ext"), L.spaced(F.translate("p_name", " ", "_")).alias("spaced"), L.clean(folder).alias("clean"))


@query("fn13_time_ago", """SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' h ago' WHEN s < 172800 THEN 'yesterday' ELSE s // 86400 || ' days ago' END AS ago
FROM (SELECT event_id, (CASE event_id % 4 WHEN 0 THEN floor(epoch(TIMESTAMP '2024-02-15') - floor(epoch(ts))) ELSE event_id % (60 * 60 ** (event_id % 4 - 1)) END)::BIGINT AS s FROM events)""")
def fn13(spark, d):
    e, k = V.events(spark, d), F.col("event_id")
    now = F.lit("2024-02-15").cast("timestamp")
    near = F.timestamp_seconds(F.unix_timestamp(now) - k % F.pow(F.lit(60), k % 4).cast("long"))
    return e.select("event_id", S.time_ago(F.when(k % 4 == 0, F.col("ts")).otherwise(near), now).alias("ago"))


@query("fn14_entities", "SELECT doc_id, trim(regexp_replace(replace(replace(text, '. ', ' & '), ', ', ' <\"''> '), '\\s+', ' ', 'g')) AS text FROM documents")
def fn14(spark, d):
    made = F.regexp_replace(F.regexp_replace("text", r"\. ", " &amp; "), ", ", " &lt;&quot;&#39;&gt; ")
    return V.table(spark, d, "documents").select("doc_id", S.entity_decode(made).alias("text"))


@query("cls3_exam_types", "SELECT page_id, CASE WHEN page_id % 8 IN (0, 7) THEN 'CIE' WHEN page_id % 8 = 1 THEN 'SEE' WHEN page_id % 8 = 5 THEN 'Makeup' END AS exam_type FROM pages WHERE page_id % 8 IN (0, 1, 5)")
def cls3(spark, d):
    x = L.evidence(_listing(spark, d))
    return x.where("page_id % 8 IN (0, 1, 5)").select("page_id", F.regexp_replace(L.exam_type(F.col("texts")), " .*", "").alias("exam_type"))


@query("cls4_exam_dates", "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 2021 WHEN 1 THEN 2019 WHEN 4 THEN 2022 WHEN 5 THEN 2020 END::INT AS year, CASE page_id % 8 WHEN 0 THEN 'May' WHEN 4 THEN 'Jun' END AS month FROM pages")
def cls4(spark, d):
    return L.evidence(_listing(spark, d)).select("page_id", L.exam_year(F.col("texts")).alias("year"), F.left(L.exam_month(F.col("base")), F.lit(3)).alias("month"))


@query("cls5_semesters", "SELECT page_id, 5 AS semester FROM pages")
def cls5(spark, d):
    """The folder nearest to a file says its fifth semester, whatever the listing or a folder above says."""
    x = L.evidence(_listing(spark, d))
    folder = F.transform(F.reverse(F.col("path")), L.spaced)
    return x.select("page_id", L.semester(folder, F.col("semester"), F.col("year"), F.col("path")).alias("semester"))


@query("cls6_subjects", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Database Management Systems' WHEN 1 THEN upper(a[1]) || a[2:] || ' and ' || upper(b[1]) || b[2:] WHEN 2 THEN upper(a[1]) || a[2:] || ' of ' || upper(b[1]) || b[2:] ELSE 'Theory of ' || b END AS subject FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b FROM part)""")
def cls6(spark, d):
    """Folders named by short names, in small letters, in capitals, and as they should be."""
    p, k = V.table(spark, d, "part"), F.col("p_partkey")
    a, b = F.lower(F.split("p_name", " ")[0]), F.lower(F.split("p_name", " ")[1])
    name = F.when(k % 4 == 0, "3. D.B.M.S").when(k % 4 == 1, F.concat(F.lit("2) "), a, F.lit(" & "), b)).when(k % 4 == 2, F.upper(F.concat(a, F.lit(" of "), b))).otherwise(F.concat(F.lit("Theory_of "), b))
    return p.select("p_partkey", L.subject(F.array(F.lit("CIE papers"), F.lit("x"), name, F.lit("other subject"))).alias("subject"))
