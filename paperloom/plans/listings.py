"""Listing, understanding, assistant and stream queries over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.document_table import DocumentTable
from paperloom.functions import scalars as S
from paperloom.operators import activity as ACT
from paperloom.operators import analytics as A
from paperloom.operators import assistant as AST
from paperloom.operators import listing as L
from paperloom.operators.understanding import understand
from paperloom.plans.registry import query
from paperloom.sources import intake as I
from paperloom.streaming import intake
from paperloom.tables import shared_folder


def _pages(spark, d):
    return V.table(spark, d, "pages")


@query("src9_page_links", r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS t FROM pages), l AS (SELECT page_id, unnest(h) AS href, unnest(t) AS title FROM p)
SELECT page_id, href, trim(regexp_replace(replace(replace(replace(replace(title, '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g')) AS title, count(*) AS n FROM l GROUP BY ALL""")
def src9(spark, d):
    return I.links(_pages(spark, d)).groupBy("page_id", "href", "title").agg(F.count(F.lit(1)).alias("n"))


_TOKEN = '(<h[123][^>]*>[^<]*</h[123]>|<a[^>]*href="[^"]*"[^>]*>[^<]*</a>)'
_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&amp;', '&'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '\s+', ' ', 'g'))"""


@query("src10_links_under_headings", f"""WITH p AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(<h1>[^<]*</h1>)', 1) || '<h2>Links</h2>' || html, '{_TOKEN}', 1) AS ts FROM pages),
t AS (SELECT page_id, unnest(ts) AS t, (generate_subscripts(ts, 1) - 1)::INT AS pos FROM p),
h AS (SELECT page_id, pos, t, {_PLAIN} AS title, {', '.join(f"last_value(CASE WHEN starts_with(t, '<h{n}') THEN {_PLAIN} END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS h{n}" for n in (1, 2, 3))} FROM t)
SELECT page_id, pos, h1, h2, h3, regexp_extract(t, 'href="([^"]*)"', 1) AS href, title FROM h WHERE starts_with(t, '<a')""")
def src10(spark, d):
    # The pages' lists stand above their headings; they are put below, so that links have some to inherit.
    p = _pages(spark, d).select("page_id", F.concat(F.regexp_extract("html", "(<h1>[^<]*</h1>)", 1), F.lit("<h2>Links</h2>"), "html").alias("html"))
    return I.links_under_headings(p)


def _listing(spark, d):
    """Urls of the pages as a file listing: their words make folders and file names of every kind."""
    p = _pages(spark, d)
    k = F.col("page_id")
    name = F.get(F.array(*[F.lit(x) for x in ("CIE_2 may 2021.pdf", "see-2019.jpg", "model paper.docx", "Module 1 notes.pdf", "june 2022.pdf", "makeup 2020.pdf", "unit 3.pdf", "quiz_1.exe")]), (k % 8).cast("int"))
    host = F.regexp_extract("url", r"//([^/]+)/", 1)
    folder = F.get(F.array(F.lit("4. dbms"), F.lit("DATA COMMUNICATION AND THEORY"), F.lit("3rd sem"), F.regexp_extract("url", r"//(?:[a-z]+\.)?([a-z]+)\.", 1)), (k % 4).cast("int"))
    return p.select(
        "page_id", host.alias("source"), F.when(k % 5 == 0, None).when(k % 2 == 0, "CSE").otherwise("Civil").alias("branch"), F.when(k % 7 == 0, 1).otherwise(2).cast("int").alias("year"), F.when(k % 3 == 0, (k % 8 + 1).cast("int")).alias("semester"), (k % 11 == 0).alias("question_bank"),
        F.array(F.lit("Year"), F.lit("Branch"), folder, F.when(k % 6 == 0, "question papers").otherwise(F.concat(F.lit("notes of "), folder)), F.lit("5th sem 2018 batch")).alias("path"), name.alias("name"), F.regexp_replace("url", r"[?#].*$", "").alias("url"),
    )


@query("cls1_papers_of_listing")
def cls1(spark, d):
    return L.classify(_listing(spark, d))


@query("cls9_shared_links")
def cls9(spark, d):
    return L.merge_shared(L.classify(_listing(spark, d)))


def _matched(spark, d):
    p = V.table(spark, d, "part")
    courses = p.select(F.concat("p_brand", F.lit("-"), "p_partkey").alias("code"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), F.concat(F.lit("D"), F.col("p_size") % 5).alias("dept"), (F.col("p_size") % 8 + 1).alias("semester"), F.col("p_partkey").alias("place"))
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    asked = c.join(p.select(F.col("p_partkey").alias("pk"), "p_name"), k == F.col("pk")).select(k.alias("paper_id"), F.when(k % 3 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" & economy"))).alias("subject"), F.concat(F.lit("D"), k % 5).alias("dept"), F.when(k % 4 > 0, (k % 8 + 1).cast("int")).alias("semester"))
    return asked, L.match_courses(asked, courses)


def _sql_words(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def _sql_without(words: str, stop: list[str]) -> str:
    return f"list_filter({words}, lambda w: w NOT IN ('{"', '".join(stop)}'))"


#: The same by all pairs of a department.
_MATCHED = f"""co AS (SELECT p_brand || '-' || p_partkey AS code, p_name || ' ' || lower(p_type) AS title, 'D' || (p_size % 5) AS dept, p_size % 8 + 1 AS c_sem, p_partkey AS place FROM part),
pa AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN upper(p_name) ELSE p_name || ' & economy' END AS subject, 'D' || (c_custkey % 5) AS dept, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 8 + 1)::INT END AS semester FROM customer JOIN part ON c_custkey = p_partkey),
cw AS (SELECT code, dept, c_sem, place, array_to_string(w, ' ') AS ct, list_distinct({_sql_without('w', L.KEY_STOP)}) AS ck, array_to_string(list_transform({_sql_without('w', L.NO_INITIAL)}, lambda v: v[1]), '') AS ci FROM (SELECT *, {_sql_words('title')} AS w FROM co)),
pw AS (SELECT *, array_to_string(w, ' ') AS st, list_distinct({_sql_without('w', L.KEY_STOP)}) AS sk, CASE WHEN regexp_full_match(trim(subject), '[A-Za-z]{{2,6}}') THEN lower(trim(subject)) END AS ab FROM (SELECT *, {_sql_words('subject')} AS w FROM pa)),
sc AS (SELECT paper_id, code, place, CASE WHEN contains(st, ct) OR contains(ct, st) THEN 1 WHEN ab = ci OR ab = ci || 'a' THEN 0.9 ELSE len(list_intersect(sk, ck)) / greatest(len(sk), len(ck), 1) END AS score
  FROM pw JOIN cw ON pw.dept = cw.dept AND (semester IS NULL OR abs(semester - c_sem) <= 1)),
be AS (SELECT paper_id, arg_min(code, (-score, place)) AS course_code FROM sc WHERE score >= {L.LEAST_SCORE} GROUP BY 1)"""


@query("jn10_course_matching", f"WITH {_MATCHED} SELECT paper_id, subject, dept, semester, course_code FROM pa LEFT JOIN be USING (paper_id)")
def jn10(spark, d):
    return _matched(spark, d)[1].select("paper_id", "subject", "dept", "semester", "course_code")


@query("cls10_match_rate", f"WITH {_MATCHED} SELECT (SELECT count(*) FROM customer) AS n_files, count(*) AS n_papers, count(course_code) AS n_matched FROM pa LEFT JOIN be USING (paper_id)")
def cls10(spark, d):
    return L.match_rate(V.table(spark, d, "customer"), _matched(spark, d)[1])


@query("cls7_file_kinds", "SELECT page_id % 8 AS k, CASE page_id % 8 WHEN 1 THEN 'image' WHEN 2 THEN 'doc' WHEN 7 THEN 'file' ELSE 'pdf' END AS kind, count(*) AS n FROM pages GROUP BY ALL")
def cls7(spark, d):
    x = _listing(spark, d).withColumn("page", F.lit(1))
    names = ["CIE_2 may 2021.pdf", "see-2019.jpg", "model paper.docx", "Module 1 notes.pdf", "june 2022.pdf", "makeup 2020.pdf", "unit 3.pdf", "quiz_1.exe"]
    k = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name")) - 1
    return x.groupBy(k.alias("k"), L.file_kind(F.col("name"), F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("cls8_departments", "SELECT CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 2 = 0 THEN 'CSE' ELSE 'CV' END AS dept, count(*) AS n FROM pages GROUP BY 1")
def cls8(spark, d):
    return _listing(spark, d).groupBy(L.department(F.col("branch")).alias("dept")).agg(F.count(F.lit(1)).alias("n"))


@query("ret1_query_understanding")
def ret1(spark, d):
    """Customers ask about parts, with filters of every kind in their words."""
    p = V.table(spark, d, "part")
    cat = p.where("p_size <= 5").select(F.concat(F.lit("BR"), F.regexp_extract("p_brand", r"(\d+)", 1)).alias("code"), F.concat_ws(" of ", "p_name", "p_type").alias("title")).groupBy("title").agg(F.min("code").alias("code"))
    cat = cat.select("code", "title", F.array("code").alias("filter_codes"))
    k = F.col("c_custkey")
    asked = V.table(spark, d, "customer").join(p.select(F.col("p_partkey").alias("pk"), "p_name", "p_type", "p_size"), k == F.col("pk"))
    tail = F.get(F.array(*[F.lit(t) for t in ("last 3 years", "2019-2021 SEE", "above 8 marks", "sem 4 notes", "after 2020 10 marks", "in CSE make-up", "before 2018")]), (k % 7).cast("int"))
    raw = F.concat_ws(" ", F.when(k % 2 == 0, F.concat_ws(" of ", "p_name", "p_type")).otherwise(F.lit("trees and graphs")), tail)
    return understand(asked.select(k.alias("query_id"), raw.alias("raw"), F.to_date(F.lit("2026-03-01")).alias("now")), cat).withColumn("course_codes", F.array_join("course_codes", ",")).withColumn("understood", F.array_join("understood", "; "))


@query("ast1_slice_contexts")
def ast1(spark, d):
    """One context for each course: what its slice says and its own most repeated questions."""
    q = V.questions(spark, d).where("kind = 'question'").withColumn("slice_id", F.col("course_code"))
    g = q.groupBy("slice_id").agg(F.countDistinct("document_id").alias("n_papers"), F.count(F.lit(1)).alias("n_questions"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    t = q.select("slice_id", "document_id", "marks", "year", F.explode("topics").alias("label")).groupBy("slice_id", "label").agg(F.countDistinct("document_id").alias("n_papers"), F.count(F.lit(1)).alias("n_questions"), F.sum(F.coalesce("marks", F.lit(0))).alias("total_marks"), A.year_list().alias("year_list"))
    from pyspark.sql import Window

    t = t.withColumn("place", F.row_number().over(Window.partitionBy("slice_id").orderBy(F.desc("n_papers"), F.desc("n_questions"), "label")))
    nt = t.groupBy("slice_id").agg(F.count(F.lit(1)).alias("n_topics"))
    keys = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("key")) for n in ("unit", "exam_type", "marks")])
    b = q.select("slice_id", "document_id", "marks", F.explode(keys).alias("k")).where("k.key IS NOT NULL").groupBy("slice_id", "k.dimension", "k.key").agg(F.count(F.lit(1)).alias("n_questions"), F.countDistinct("document_id").alias("n_papers"), F.sum(F.coalesce("marks", F.lit(0))).alias("total_marks"))
    r = q.groupBy("slice_id", "group_id").agg(F.countDistinct("document_id").alias("n_papers"), A.year_list().alias("year_list"), F.max("text").alias("text"))
    r = r.where("n_papers >= 2").withColumn("place", F.row_number().over(Window.partitionBy("slice_id").orderBy(F.desc("n_papers"), "group_id")))
    nr = r.groupBy("slice_id").agg(F.count(F.lit(1)).alias("recurring"))
    top = q.withColumn("rank", F.row_number().over(Window.partitionBy("slice_id").orderBy(F.desc_nulls_last("marks"), "question_id"))).where("rank <= 6")
    hits = top.select("slice_id", "rank", S.citation(F.col("course_code"), F.col("exam_type"), F.col("month"), F.col("year"), F.lit("")).alias("cite"), "marks", F.lit(1).alias("recurrence"), F.array_join("topics", ", ").alias("topics"), "text")
    slices = g.join(nt, "slice_id", "left").join(nr, "slice_id", "left").select("slice_id", S.describe_scope(F.col("slice_id"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("min_year"), F.col("max_year")).alias("scope"), "n_papers", "n_questions", F.coalesce("n_topics", F.lit(0)).alias("n_topics"), "min_year", "max_year", F.coalesce("recurring", F.lit(0)).alias("recurring"))
    return AST.contexts(slices, t, b, AST.numbered_sources(hits, r.withColumn("course", F.col("slice_id"))))


@query("ast3_tidy_answers", r"""WITH l AS (SELECT doc_id, string_split('## Answer' || chr(10) || '- ' || replace(replace(text, chr(13), ''), '. ', ' [1, 7]. ') || repeat(chr(10), 4) || '[9]', chr(10)) AS ls FROM documents),
m AS (SELECT doc_id, list_transform(ls, lambda x: rtrim(CASE WHEN regexp_matches(x, '^#{1,6}') THEN regexp_replace(x, '^#{1,6}\s*', '') ELSE regexp_replace(x, '^\s*[-*]\s+', '• ') END, ' ' || chr(9))) AS ls FROM l)
SELECT doc_id, trim(replace(replace(array_to_string(list_filter(ls, lambda x, i: x <> '' OR i = 1 OR ls[i - 1] <> ''), chr(10)), '[1, 7]', '[1]'), '[9]', ''), ' ') AS answer FROM m""")
def ast3(spark, d):
    t = V.table(spark, d, "documents")
    made = F.concat(F.lit("## Answer\n- "), F.regexp_replace("text", r"\. ", " [1, 7]. "), F.lit("\n\n\n\n[9]"))
    return t.select("doc_id", AST.tidy(made, F.lit(3)).alias("answer"))


@query("ast7_answer_rows", "SELECT conv_id AS slice_id, string_agg('• ' || CASE WHEN length(text) > 260 THEN left(text, 259) || '…' ELSE text END || ' (turn ' || turn || ')' || CASE WHEN turn % 3 > 1 THEN ', asked in ' || turn % 3 || ' papers' ELSE '' END, chr(10) ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1")
def ast7(spark, d):
    c = V.table(spark, d, "conversations").where("role = 'assistant'")
    hits = c.select(F.col("conv_id").alias("slice_id"), F.col("turn").alias("rank"), F.concat(F.lit("turn "), "turn").alias("cite"), "text", (F.col("turn") % 3).alias("recurrence"))
    return AST.answer_lines(hits)


@query("str2_rate_stream", "SELECT user_id AS key, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM events GROUP BY 1, 2")
def str2s(spark, d):
    """The rate audit run as a stream over the event table's files; its result is the batch's."""
    e = V.table(spark, d, "events")
    s = spark.readStream.schema(e.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    s = s.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    log = intake.RateLog(spark, f"{shared_folder(spark)}/paperloom-rates-{uuid.uuid4().hex}", "user_id", "15 minutes", "1 hour")
    log.run(s)
    # Files need not be in the order of time: late requests count in their window here.
    rates = log.closed().unionByName(log.open()).unionByName(log.late()).groupBy("key", "start").agg(F.sum("n").alias("n"))
    return rates.select("key", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.greatest(F.col("n") - 1, F.lit(0)).alias("over"))


@query("str1_intake", "SELECT document_id, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM (SELECT doc_id AS document_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY 1")
def str1(spark, d):
    """Documents taken in as a stream over the table's files, merged into a document table and read back."""
    t = V.table(spark, d, "documents")
    s = spark.readStream.schema(t.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{d}/documents.parquet*")
    base = f"{shared_folder(spark)}/paperloom-intake-{uuid.uuid4().hex}"
    target = DocumentTable(spark, f"{base}/lines")

    def process(pages):
        kept = F.filter(F.transform(F.split("text", "\n"), lambda l: F.trim(l)), lambda l: l != "")
        return pages.select("document_id", F.posexplode(kept).alias("at", "line"))

    intake.ingest(s.select(F.col("doc_id").alias("document_id"), "text"), process, target, f"{base}/checkpoint").awaitTermination()
    rows = target.read()
    rows = rows if rows is not None else process(t.limit(0).select(F.col("doc_id").alias("document_id"), "text"))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


@query("str4_live_allowance_batch", "SELECT event_id AS request_id, place, place <= 2 AS ok FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, (ts + INTERVAL '330 minutes')::DATE ORDER BY ts, event_id) AS place FROM events)")
def str4(spark, d):
    """What the live allowance says of each request, worked out as a batch (the stream itself is tested against it)."""
    from pyspark.sql import Window

    e = V.events(spark, d)
    w = Window.partitionBy("user_id", S.india_day(F.col("ts"))).orderBy("ts", "event_id")
    return e.select(F.col("event_id").alias("request_id"), F.row_number().over(w).cast("long").alias("place")).withColumn("ok", F.col("place") <= 2)

