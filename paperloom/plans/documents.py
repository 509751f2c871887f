"""Document-to-rows queries, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.operators import documents as D
from paperloom.plans.registry import query
from paperloom.views import WITH


def _pages(spark, d):
    """Conversations play scanned documents: a turn is a page."""
    c = V.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text", F.when(F.col("role") == "user", "ocr").otherwise("text-layer").alias("source"), ((F.col("turn") % 10) / 10).alias("ocr_confidence"))


def _segments(spark, d):
    """Line items play segments: in order of part and supplier within their paper."""
    q = V.questions(spark, d)
    w = Window.partitionBy("document_id").orderBy("unit", "question_id")
    return q.select("question_id", "document_id", F.row_number().over(w).alias("ord"), F.col("unit").cast("int").alias("q"), "text", F.col("marks").cast("int").alias("marks"), "bloom", F.round(F.col("confidence") * 10, 1).alias("confidence"), "topics")


_SEG = "seg AS (SELECT question_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY unit, question_id) AS ord, unit::INT AS q, text, marks::INT AS marks, bloom, round(confidence * 10, 1) AS confidence, topics FROM questions)"
_PG = "pg AS (SELECT conv_id AS document_id, turn AS page, text, (turn % 10) / 10 AS ocr_confidence FROM conversations)"


@query("doc1_lines", f"""WITH {_PG}, l0 AS (SELECT document_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM pg), l AS (SELECT document_id, page, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS "at", len(ls) AS n FROM l0),
e AS (SELECT *, "at" < 3 OR "at" >= n - 3 AS edge FROM l), np AS (SELECT document_id, count(*) AS n_pages FROM pg GROUP BY 1), r AS (SELECT document_id, line FROM (SELECT document_id, line, count(DISTINCT page) AS c FROM e WHERE edge AND length(line) < 60 GROUP BY 1, 2) JOIN np USING (document_id) WHERE n_pages >= 2 AND c >= greatest(2, ceil(n_pages / 2)))
SELECT document_id, page, "at", line FROM e LEFT JOIN (SELECT document_id, line, true AS running FROM r) USING (document_id, line) WHERE NOT (edge AND coalesce(running, false))""")
def doc1(spark, d):
    return D.lines(_pages(spark, d))


@query("doc3_marker_repair", r"""WITH m AS (SELECT doc_id, unnest(['| ' || text, '(C) ' || text, '© ) x', 'marks CO1', 'see coi here', 'CoZ']) AS line, generate_subscripts([1,2,3,4,5,6], 1) AS k FROM documents)
SELECT doc_id, k, CASE k WHEN 1 THEN CASE WHEN regexp_matches(t, '^\s*\(?\s*[A-H]\s*\)\s') THEN 'never' ELSE t END WHEN 2 THEN 'c) ' || ltrim(substr(line, 5)) WHEN 3 THEN '© ) x' WHEN 4 THEN 'marks CO1' WHEN 5 THEN 'see CO1 here' ELSE 'CO2' END AS line FROM (SELECT *, substr(line, 3) AS t FROM m)""".replace("WHEN 3 THEN '© ) x'", "WHEN 3 THEN 'c) x'").replace("'c) ' || ltrim(substr(line, 5))", "'c) ' || substr(line, 5)"))
def doc3(spark, d):
    t = V.table(spark, d, "documents")
    made = F.array(F.concat(F.lit("| "), F.col("text")), F.concat(F.lit("(C) "), F.col("text")), F.lit("© ) x"), F.lit("marks CO1"), F.lit("see coi here"), F.lit("CoZ"))
    x = t.select("doc_id", F.posexplode(made).alias("k", "line"))
    return x.select("doc_id", (F.col("k") + 1).alias("k"), D.repair_markers(F.col("line")).alias("line"))


_MISMATCH = "t AS (SELECT document_id, q, sum(marks) AS total FROM seg WHERE marks IS NOT NULL GROUP BY 1, 2), f AS (SELECT document_id, total, count(*) AS n, min(q) AS first FROM t GROUP BY 1, 2), m AS (SELECT document_id, arg_max(total, (n, -first)) AS usual, max(n) AS n, sum(n) AS a FROM f GROUP BY 1)"


@query("doc7_marks_mismatch", f"{WITH}, {_SEG.replace('marks::INT AS marks', '(marks // 18)::INT AS marks')}, {_MISMATCH} SELECT t.document_id, q FROM t JOIN m USING (document_id) WHERE a >= 4 AND m.n / a >= 0.6 AND total <> usual")
def doc7(spark, d):
    return D.marks_mismatch(_segments(spark, d).withColumn("marks", F.floor(F.col("marks") / 18).cast("int")))


_FRAG = "(len(tk) >= 8 AND sg >= 3 AND sg / len(tk) > 0.2)"
_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS tk, len(list_filter(string_split_regex(text, '\\s+'), lambda t: regexp_full_match(t, '[A-Za-z0-9]') AND t NOT IN ('a', 'A', 'I'))) AS sg"


@query("doc9_fragmented", f"SELECT doc_id, {_FRAG} AS fragmented FROM (SELECT doc_id, {_TOKENS} FROM (SELECT doc_id, regexp_replace(text, '([aeiou])', ' \\1', 'g') AS text FROM documents))")
def doc9(spark, d):
    # Texts broken at every vowel, as a bad text layer would be.
    t = V.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "([aeiou])", " $1").alias("text"))
    return t.select("doc_id", D.fragmented(F.col("text")).alias("fragmented"))


@query("doc8_confidence", f"""{WITH}, {_SEG}, {_MISMATCH}, b AS (SELECT t.document_id, q, true AS bad FROM t JOIN m USING (document_id) WHERE a >= 4 AND m.n / a >= 0.6 AND total <> usual),
x AS (SELECT seg.*, length(text) AS n, coalesce(bad, false) AS bad, avg((marks IS NOT NULL)::INT) OVER (PARTITION BY document_id) AS marked FROM seg LEFT JOIN b USING (document_id, q))
SELECT question_id, (100 - CASE WHEN n < 15 THEN 45 ELSE 0 END - CASE WHEN marks IS NULL AND marked > 0.5 THEN 20 ELSE 0 END - CASE WHEN marks > 25 OR marks <= 0 THEN 20 ELSE 0 END - CASE WHEN bad THEN 45 ELSE 0 END) AS percent,
concat_ws(',', CASE WHEN n < 15 THEN 'too-short' END, CASE WHEN marks IS NULL AND marked > 0.5 THEN 'no-marks' END, CASE WHEN marks > 25 OR marks <= 0 THEN 'odd-marks' END, CASE WHEN bad THEN 'marks-dont-add-up' END) AS flags FROM x""".replace("(100 -", "greatest(0, 100 -"))
def doc8(spark, d):
    x = D.scored(_segments(spark, d).withColumn("flags", F.array().cast("array<string>")))
    return x.select("question_id", F.round(F.col("confidence") * 100).cast("long").alias("percent"), F.array_join("flags", ",").alias("flags"))


@query("doc10_parsed_verdict", f"{WITH}, {_SEG}, s AS (SELECT document_id, count(*) AS n, sum(length(text)) AS c FROM seg GROUP BY 1) SELECT o_orderkey AS document_id, coalesce(n, 0) >= 4 AND (o_custkey % 90 = 0 OR coalesce(c / (o_custkey % 90) > 0.5, false)) AS parsed FROM orders LEFT JOIN s ON o_orderkey = document_id")
def doc10(spark, d):
    body = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 90).alias("body_chars"))
    return D.parsed_verdict(_segments(spark, d), body)


def _sql_passages(pages: str) -> str:
    """Passages of ``pages`` (document_id, page, text, source): paragraphs are put on the last passage, split off by chr(2), while it stays short enough."""
    marked = r"regexp_replace(regexp_replace(replace(text, chr(9), ' '), '\n([A-Z0-9•\-–])', chr(1) || '\1', 'g'), '\n\s*\n', chr(1), 'g')"
    paras = rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'), ' ')), lambda p: p <> '')"
    packed = f"list_reduce(list_prepend('', {paras}), lambda a, p: CASE WHEN a = '' THEN p WHEN length(string_split(a, chr(2))[-1]) + length(p) > 800 THEN a || chr(2) || p ELSE a || ' ' || p END)"
    kept = f"list_filter(string_split({packed}, chr(2)), lambda p: length(p) >= 40)"
    return f"SELECT document_id, page, n, 'p.' || page || ' §' || n AS label, text, CASE WHEN source = 'ocr' THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT document_id, page, source, unnest(k) AS text, generate_subscripts(k, 1)::INT AS n FROM (SELECT document_id, page, source, {kept} AS k FROM {pages}))"


@query("doc11_passages", _sql_passages("(SELECT doc_id AS document_id, 1 AS page, text, 'text-layer' AS source FROM documents)"))
def doc11(spark, d):
    t = V.texts(spark, d).select("document_id", F.lit(1).alias("page"), "text", F.lit("text-layer").alias("source"))
    return D.passages(t)


@query("doc12_fallback_passages", f"SELECT document_id, page, n, label, text, 0.3::DOUBLE AS confidence, ['unsegmented'] AS flags FROM ({_sql_passages('(SELECT conv_id AS document_id, turn AS page, text, role AS source FROM conversations WHERE conv_id % 3 <> 0)')})")
def doc12(spark, d):
    done = V.table(spark, d, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").alias("document_id"))
    return D.fallback_passages(_pages(spark, d), done)


@query("doc13_weak_regions", f"{WITH}, {_SEG}, w AS (SELECT *, ord - row_number() OVER (PARTITION BY document_id ORDER BY ord) AS island FROM seg WHERE confidence < 0.6), g AS (SELECT document_id, island, min(ord) AS first, max(ord) AS last, string_agg(text, chr(10) ORDER BY ord) AS text FROM w GROUP BY 1, 2) SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY first) AS region, first, last, text FROM g")
def doc13(spark, d):
    return D.weak_regions(_segments(spark, d))


@query("doc14_reconciliation", """SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'C' || (o_custkey % 5) ELSE 'c' || (o_custkey % 7) END AS course_code, (1990 + o_orderkey % 5)::VARCHAR AS year, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'SEE' END, CASE WHEN o_orderkey % 4 <> 3 THEN 'CIE' END) AS exam_type,
concat_ws(',', CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 7 <> o_custkey % 5 THEN 'course_code' END, CASE WHEN o_orderkey % 5 <> o_orderkey % 4 AND o_orderkey % 4 <> 3 THEN 'year' END) AS conflicts FROM orders""")
def doc14(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = V.table(spark, d, "orders")
    uploads = o.select(k.alias("document_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c"), c % 7)).alias("course_code"), (1990 + k % 5).alias("year"), F.when(k % 2 == 0, "SEE").alias("exam_type"))
    parsed = o.select(k.alias("document_id"), F.concat(F.lit("C"), c % 5).alias("course_code"), F.when(k % 4 != 3, 1990 + k % 4).alias("year"), F.when(k % 4 != 3, "CIE").alias("exam_type"))
    return D.reconcile(uploads, parsed)


@query("doc15_review_items", f"{WITH}, {_SEG}, {_PG} SELECT 'segment' AS type, document_id, ord AS place, 'low, ' || bloom AS reason, left(text, 500) AS preview FROM seg WHERE confidence < 0.3 UNION ALL SELECT 'ocr', document_id, page, 'read with ' || round(ocr_confidence * 100)::INT || '% confidence', left(text, 500) FROM pg WHERE ocr_confidence < 0.3")
def doc15(spark, d):
    return D.review_items(_segments(spark, d).withColumn("flags", F.array(F.lit("low"), "bloom")), _pages(spark, d), 0.3)


@query("doc16_search_text", f"{WITH}, {_SEG} SELECT question_id, left('Topics: ' || array_to_string(topics, ', ') || '. ' || text, 2000) AS search_text FROM seg")
def doc16(spark, d):
    return _segments(spark, d).select("question_id", D.search_text(F.col("text"), F.col("topics")).alias("search_text"))


@query("doc17_text_vectors")
def doc17(spark, d):
    x = D.vectorise(V.texts(spark, d).select(F.col("document_id").alias("id"), "text"))
    return x.select("id", F.size("vec").alias("dims"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v), 6).alias("norm"))


@query("doc18_labels", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'Q' || (l_suppkey % 20 + 1) || CASE WHEN l_linenumber % 3 > 0 THEN '(' || chr((97 + l_linenumber)::INT) || ')' ELSE '' END || CASE WHEN l_linenumber % 3 = 2 THEN '(ii)' ELSE '' END AS label FROM lineitem")
def doc18(spark, d):
    n = F.col("l_linenumber")
    made = F.concat(F.when(n % 2 == 0, "Q").otherwise(""), F.col("l_suppkey") % 20 + 1, F.when(n % 3 > 0, F.concat(F.when(n % 2 == 0, " ").otherwise("("), F.char(97 + n), F.when(n % 2 == 0, "").otherwise(")"))).otherwise(""), F.when(n % 3 == 2, "(II)").otherwise(""))
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", D.parse_label(made)["label"].alias("label"))


@query("doc19_corrections", f"{WITH}, {_SEG} SELECT question_id, CASE WHEN h THEN 'fixed ' || text ELSE text END AS text, CASE WHEN h THEN coalesce(ord::INT, marks) ELSE marks END AS marks, CASE WHEN h THEN 1.0 ELSE confidence END AS confidence, 'Topics: ' || array_to_string(topics, ', ') || '. ' || CASE WHEN h THEN 'fixed ' || text ELSE text END AS search_text FROM (SELECT *, document_id % 7 = 0 AS h FROM seg)")
def doc19(spark, d):
    s = _segments(spark, d).withColumns({"label": F.lit("Q1"), "co": F.lit(None).cast("string")})
    none = lambda t: F.lit(None).cast(t)
    p = s.where("document_id % 7 = 0").select("question_id", F.concat(F.lit("fixed "), "text").alias("text"), none("string").alias("label"), F.col("ord").alias("marks"), none("string").alias("co"), none("string").alias("bloom"), none("array<string>").alias("topics"))
    return D.apply_corrections(s, p).select("question_id", "text", "marks", "confidence", "search_text")


@query("doc5_numbered_items")
def doc5(spark, d):
    """Texts whose lines are given numbers and parts become papers; what the scan accepts comes out as question rows."""
    t = V.texts(spark, d)
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.concat(F.when(i % 2 == 0, F.concat(F.floor(i / 2) + 1, F.lit(". "))).otherwise("a) "), l, F.lit("\t(05)"))), "\n")
    pages = t.select("document_id", F.lit(1).alias("page"), numbered.alias("text"))
    x = D.leaves(D.nodes(D.accepted_lines(D.lines(pages))))
    return x.select("document_id", "ord", "label", "marks", F.length("text").alias("n_chars"))
