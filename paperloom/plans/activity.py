"""Activity, curation and intake queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.functions import scalars as S
from paperloom.operators import activity as A
from paperloom.operators import curation as C
from paperloom.plans.registry import query
from paperloom.views import TOPICS, WITH

_EV = "ev AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'focus' ELSE event_type END AS kind, floor(value)::BIGINT AS amount FROM events)"
_DAYS = f"{_EV}, days AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (kind = 'visit') AS visits, coalesce(sum(amount) FILTER (kind = 'focus'), 0)::BIGINT AS focus FROM ev GROUP BY 1, 2)"
_TODAY = "DATE '2024-01-20'"


def _events(spark, d):
    e = V.events(spark, d)
    kind = F.when(F.col("kind") == "view", "visit").when(F.col("kind") == "click", "focus").otherwise(F.col("kind"))
    return e.select("event_id", "ts", "user_id", kind.alias("kind"), F.floor("amount").alias("amount"))


def _today():
    return F.to_date(F.lit("2024-01-20"))


def _days(spark, d):
    return A.daily(_events(spark, d))


@query("act1_daily_activity", f"WITH {_DAYS} SELECT * FROM days")
def act1(spark, d):
    return _days(spark, d)


@query("act2_streaks", f"""WITH {_DAYS}, t AS (SELECT * FROM days), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM t), r AS (SELECT user_id, island, count(*) AS n, max(day) AS e FROM i GROUP BY 1, 2)
SELECT user_id, coalesce((SELECT max(n) FROM r WHERE r.user_id = t.user_id AND e >= {_TODAY} - 1), 0) AS current, (SELECT max(n) FROM r WHERE r.user_id = t.user_id) AS longest, bool_or(day = {_TODAY}) AS active_today, coalesce(sum(focus) FILTER (day = {_TODAY}), 0)::BIGINT AS focus_today, coalesce(sum(focus) FILTER (day > {_TODAY} - 7), 0)::BIGINT AS focus_week FROM t GROUP BY user_id""")
def act2(spark, d):
    return A.streaks(_days(spark, d), _today())


@query("act3_activity_grid", f"WITH {_DAYS}, c AS (SELECT user_id, unnest(generate_series({_TODAY} - 83, {_TODAY}, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT user_id FROM days)) SELECT user_id, day, CASE WHEN focus >= 50 THEN 3 WHEN focus > 0 OR visits >= 4 THEN 2 WHEN days.visits IS NOT NULL THEN 1 ELSE 0 END AS level FROM c LEFT JOIN days USING (user_id, day)")
def act3(spark, d):
    return A.grid(_days(spark, d), _today())


@query("act4_recent_items", f"WITH {_EV}, g AS (SELECT user_id, event_id % 23 AS item, max(ts) AS ts FROM ev WHERE kind = 'visit' GROUP BY 1, 2) SELECT user_id, item, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS place FROM g) WHERE place <= 8")
def act4(spark, d):
    return A.recent_items(_events(spark, d).where("kind = 'visit'").withColumn("item", F.col("event_id") % 23)).select("user_id", "item", "place")


@query("act5_saved_items", f"WITH {_EV} SELECT user_id, event_id % 23 AS item, count(*) % 2 AS odd FROM ev GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def act5(spark, d):
    return A.saved(_events(spark, d).withColumn("item", F.col("event_id") % 23)).select("user_id", "item", F.lit(1).cast("long").alias("odd"))


@query("ast6_daily_allowance", f"WITH {_EV}, x AS (SELECT event_id AS request_id, user_id, ts, (ts + INTERVAL '330 minutes')::DATE AS day FROM ev), m AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, request_id) AS mine FROM x), g AS (SELECT *, row_number() OVER (PARTITION BY day, mine <= 2 ORDER BY ts, request_id) AS site FROM m) SELECT request_id, day, CASE WHEN mine > 2 THEN 'user-limit' WHEN site > 100 THEN 'global-limit' ELSE 'ok' END AS verdict FROM g")
def ast6(spark, d):
    return A.allowance(_events(spark, d).withColumnRenamed("event_id", "request_id"), 2, 100)


@query("str2_rate_audit", f"WITH {_EV} SELECT user_id AS key, time_bucket(INTERVAL '15 minutes', ts) AS start, count(*) AS n, greatest(count(*) - 1, 0) AS over FROM ev GROUP BY 1, 2")
def str2(spark, d):
    return A.rate_audit(_events(spark, d), "user_id", "15 minutes", 1).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("str3_expiring_rows", f"WITH {_EV} SELECT event_id FROM ev WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 3 DAY")
def str3(spark, d):
    return A.unexpired(_events(spark, d), F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("ast5_shared_answers", f"WITH {_EV} SELECT event_id % 400 AS key, count(DISTINCT user_id) AS n_askers, count(DISTINCT user_id) >= 2 AS shared FROM ev WHERE ts > TIMESTAMP '2024-01-28' - INTERVAL 3 DAY GROUP BY 1")
def ast5(spark, d):
    return A.shared_answers(_events(spark, d).withColumn("key", F.col("event_id") % 400), F.lit("2024-01-28").cast("timestamp"))


@query("fn9_india_day", f"WITH {_EV} SELECT event_id, (ts + INTERVAL '330 minutes')::DATE AS day FROM ev")
def fn9(spark, d):
    return _events(spark, d).select("event_id", S.india_day(F.col("ts")).alias("day"))


@query("src3_duplicate_rejection", "SELECT doc_id AS id, sha256(text) AS hash, (doc_id % 10 <> 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)) OR doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents WHERE doc_id % 10 <> 0".replace("doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM documents WHERE doc_id % 10 <> 0", "doc_id <> min(doc_id) OVER (PARTITION BY sha256(text)) AS duplicate FROM (SELECT * FROM documents WHERE doc_id % 10 <> 0)"))
def src3(spark, d):
    # A tenth of the documents is stored already; the others arrive.
    t = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    stored = t.where("id % 10 = 0").select(F.sha2("content", 256).alias("hash"))
    return C.new_documents(t.where("id % 10 <> 0"), stored).select("id", "hash", "duplicate")


@query("src5_default_titles", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[A-Za-z0-9]{2,5}$', ''), '[_-]+', ' ', 'g')) AS title FROM pages")
def src5(spark, d):
    return V.table(spark, d, "pages").select("page_id", S.default_title(F.col("url")).alias("title"))


@query("src7_seed_papers", f"{WITH} SELECT n, count(*) AS papers FROM (SELECT course_code, exam_type, year, month, count(*) AS n FROM questions GROUP BY ALL) GROUP BY 1")
def src7(spark, d):
    q = V.questions(spark, d).select("question_id", "course_code", "exam_type", "year", "month")
    _, rows = C.find_or_create(q, ["course_code", "exam_type", "year", "month"])
    return rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("papers"))


@query("src11_listing_dedupe", "SELECT url, page_id FROM (SELECT page_id, split_part(url, '?', 1) AS url, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id DESC) AS r FROM pages) WHERE r = 1")
def src11(spark, d):
    p = V.table(spark, d, "pages").select("page_id", F.split("url", r"\?")[0].alias("url"))
    return p.groupBy("url").agg(F.max_by("page_id", "page_id").alias("page_id"))


@query("snk1_replace_by_document", f"{WITH} SELECT question_id, marks FROM questions WHERE document_id % 5 <> 0 UNION ALL SELECT question_id, 1 FROM questions WHERE document_id % 5 = 0 AND kind = 'note'")
def snk1(spark, d):
    q = V.questions(spark, d).select("document_id", "question_id", "kind", "marks")
    # Every fifth document comes again with its notes only; documents that have none lose all rows when listed.
    again = q.where("document_id % 5 = 0 AND kind = 'note'").withColumn("marks", F.lit(1).cast("long"))
    listed = q.where("document_id % 5 = 0").select("document_id").distinct()
    return C.replace_by_key(q.join(listed.join(again, "document_id", "left_anti"), "document_id", "left_anti"), again, "document_id").select("question_id", "marks")


_CUST = "a AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS ver FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, c_acctbal + 1 AS v, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END AS ver FROM customer WHERE c_custkey % 4 > 0)"


def _old_new(spark, d):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    c = V.table(spark, d, "customer")
    return c.where(k % 3 > 0).select(k.alias("k"), v.alias("v"), F.lit(1).alias("ver")), c.where(k % 4 > 0).select(k.alias("k"), (v + 1).alias("v"), F.when(k % 2 == 0, 2).otherwise(0).alias("ver"))


@query("snk2_upsert", f"WITH {_CUST} SELECT k, v, ver FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ver DESC, n DESC) AS r FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM b)) WHERE r = 1")
def snk2(spark, d):
    return C.upsert(*_old_new(spark, d), ["k"], "ver")


@query("snk2_insert_missing", f"WITH {_CUST} SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a)")
def snk2i(spark, d):
    return C.insert_missing(*_old_new(spark, d), ["k"])


@query("snk3_cascading_delete", f"{WITH} SELECT 'papers' AS name, count(*) AS n FROM papers WHERE status <> 'P' UNION ALL SELECT 'questions', count(*) FROM questions JOIN papers USING (document_id) WHERE status <> 'P'")
def snk3(spark, d):
    p, q = V.papers(spark, d), V.questions(spark, d).select("document_id", "question_id")
    t = C.cascade_delete({"papers": p.select("document_id"), "questions": q}, p.where("status = 'P'"))
    return t["papers"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("papers").alias("name"), "n").unionByName(t["questions"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("questions").alias("name"), "n"))


@query("snk4_file_prune", "SELECT count(*) FILTER (ok) AS n_files, coalesce(sum(s) FILTER (ok), 0)::BIGINT AS bytes, count(*) FILTER (st AND NOT ok) AS n_left FROM (SELECT o_orderkey % 4 > 0 AS st, floor(o_totalprice)::BIGINT AS s, o_orderstatus = 'F' AND o_orderkey % 4 > 0 AND o_orderkey % 3 <> 1 AS ok FROM orders)")
def snk4(spark, d):
    k = F.col("o_orderkey")
    p = V.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("queued").alias("status"), (k % 4 > 0).alias("stored"), F.floor("o_totalprice").alias("file_size"), F.when(k % 3 == 0, "HTTPS://x/y").when(k % 3 == 1, "ftp://x").otherwise("http://x").alias("source_url"))
    return C.prunable(p)


@query("cur1_topic_merge", f"{WITH} SELECT question_id, array_to_string(list_sort(CASE WHEN list_contains(topics, 'ring') THEN list_distinct(list_concat(list_filter(topics, lambda t: t <> 'ring'), ['widget'])) ELSE topics END), ',') AS topics FROM questions")
def cur1(spark, d):
    return C.merge_topic(V.questions(spark, d), "ring", "widget").select("question_id", F.array_join(F.array_sort("topics"), ",").alias("topics"))


@query("cur1_vocabulary_merge", f"WITH {TOPICS} SELECT name, CASE WHEN name = 'ring' THEN 'widget' ELSE merged_into END AS merged_into, array_to_string(CASE WHEN name = 'widget' THEN list_sort(list_distinct(list_concat(course_codes, (SELECT course_codes FROM topics WHERE name = 'ring')))) ELSE course_codes END, ',') AS course_codes, CASE WHEN name = 'widget' THEN 'ring' ELSE '' END AS aliases FROM topics")
def cur1v(spark, d):
    return C.merge_vocabulary(V.topics(spark, d), "ring", "widget").select("name", "merged_into", F.array_join("course_codes", ",").alias("course_codes"), F.array_join("aliases", ",").alias("aliases"))


@query("cur2_bulk_approve", f"WITH {TOPICS} SELECT name, CASE WHEN status = 'proposed' AND merged_into IS NULL AND name > 'm' THEN 'approved' ELSE status END AS status FROM topics")
def cur2(spark, d):
    t = V.topics(spark, d)
    return C.approve(t, t.where("name > 'm'").select("name")).select("name", "status")


@query("cur3_course_memory", f"{WITH}, {TOPICS}, u AS (SELECT t, list(DISTINCT course_code) AS u FROM (SELECT unnest(topics) AS t, course_code FROM questions WHERE unit = 1) GROUP BY 1) SELECT name, array_to_string(list_sort(list_distinct(list_concat(course_codes[1:1], coalesce(u, [])))), ',') AS course_codes FROM topics LEFT JOIN u ON name = t")
def cur3(spark, d):
    t = V.topics(spark, d).withColumn("course_codes", F.slice("course_codes", 1, 1))
    return C.remember_courses(t, V.questions(spark, d).where("unit = 1")).select("name", F.array_join("course_codes", ",").alias("course_codes"))


@query("cur4_open_by_type", f"WITH {V.REVIEWS} SELECT type, count(*) AS n FROM reviews WHERE status = 'open' GROUP BY 1")
def cur4(spark, d):
    return V.reviews(spark, d).where("status = 'open'").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_cascade_update", f"{WITH} SELECT question_id, CASE WHEN document_id % 6 = 0 THEN year + 1 ELSE year END AS year, CASE WHEN document_id % 6 = 0 AND document_id % 4 = 0 THEN 'FIXED' ELSE exam_type END AS exam_type FROM questions")
def jn13(spark, d):
    p = V.papers(spark, d).where("document_id % 6 = 0").select("document_id", (F.col("year") + 1).alias("year"), F.when(F.col("document_id") % 4 == 0, "FIXED").alias("exam_type"))
    return C.cascade_update(V.questions(spark, d), p, ["year", "exam_type"]).select("question_id", "year", "exam_type")


@query("jn12_new_review_items", f"WITH {V.REVIEWS} SELECT DISTINCT document_id, type FROM reviews WHERE status = 'resolved' EXCEPT SELECT document_id, type FROM reviews WHERE status = 'open'")
def jn12(spark, d):
    r = V.reviews(spark, d)
    return r.where("status = 'resolved'").select("document_id", "type").distinct().join(r.where("status = 'open'").select("document_id", "type"), ["document_id", "type"], "left_anti")


@query("syl1_version_diff", "WITH o AS (SELECT DISTINCT p_brand AS unit, string_split(p_name, ' ')[1] AS topic FROM part WHERE p_size < 12 AND p_brand > 'Brand#15'), n AS (SELECT DISTINCT p_brand AS unit, string_split(p_name, ' ')[2] AS topic FROM part WHERE p_size > 40 OR p_size = 3) SELECT 'added' AS change, unit, topic FROM n WHERE topic NOT IN (SELECT topic FROM o) UNION ALL SELECT 'removed', unit, topic FROM o WHERE topic NOT IN (SELECT topic FROM n) UNION ALL SELECT 'kept', unit, topic FROM n WHERE topic IN (SELECT topic FROM o) UNION ALL SELECT DISTINCT 'new-unit', unit, NULL FROM n WHERE unit NOT IN (SELECT unit FROM o)")
def syl1(spark, d):
    p = V.table(spark, d, "part")
    w = lambda i: F.split("p_name", " ")[i].alias("topic")
    return C.version_diff(p.where("p_size < 12 AND p_brand > 'Brand#15'").select(F.col("p_brand").alias("unit"), w(0)), p.where("p_size > 40 OR p_size = 3").select(F.col("p_brand").alias("unit"), w(1)))


def _sql_first(value: str, where: str, most: int) -> str:
    """SQL: question_id and the first ``most`` different values in the order of the labels, joined."""
    return f"SELECT question_id, string_agg(v, ',' ORDER BY first) AS v FROM (SELECT question_id, v, first, row_number() OVER (PARTITION BY question_id ORDER BY first) AS r FROM (SELECT question_id, {value} AS v, min(pos) AS first FROM named WHERE {where} GROUP BY 1, 2)) WHERE r <= {most} GROUP BY 1"


@query("ret14_reply_reconciliation", rf"""{WITH}, said AS (SELECT question_id, topics, unnest([upper(topics[1]), 'x', ' new   topic ' || unit, 'another label', 'third one', lower(topics[1])]) AS raw, unnest([1, 2, 3, 4, 5, 6]) AS pos FROM questions),
named AS (SELECT question_id, pos, label, list_filter(topics, lambda t: lower(t) = lower(label))[1] AS name FROM (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS label FROM said))
SELECT question_id, coalesce(t.v, '') AS tags, coalesce(p.v, '') AS proposals FROM (SELECT DISTINCT question_id FROM questions) LEFT JOIN ({_sql_first('name', 'name IS NOT NULL', 3)}) t USING (question_id) LEFT JOIN ({_sql_first('label', 'name IS NULL AND length(label) BETWEEN 3 AND 60', 2)}) p USING (question_id)""")
def ret14(spark, d):
    q = V.questions(spark, d)
    choices = q.select("question_id", F.array(F.upper(F.col("topics")[0]), F.lit("x"), F.concat(F.lit(" new   topic "), F.col("unit")), F.lit("another label"), F.lit("third one"), F.lower(F.col("topics")[0])).alias("labels"))
    r = C.reconcile_replies(choices, q.select("question_id", F.explode("topics").alias("name")))
    return r.select("question_id", F.array_join("tags", ",").alias("tags"), F.array_join("proposals", ",").alias("proposals"))


@query("fn1_acronyms", "SELECT DISTINCT p_type, p_name, upper(p_name[1]) || upper(split_part(p_name, ' ', 2)[1]) AS acronym FROM part")
def fn1(spark, d):
    return V.table(spark, d, "part").select("p_type", "p_name", S.acronym(F.concat_ws(" of the ", F.split("p_name", " ")[0], F.split("p_name", " ")[1])).alias("acronym")).distinct()


@query("fn2_topic_slugs", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9+#]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def fn2(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.topic_slug(F.col("text")).alias("slug"))


@query("fn7_clipped_texts", "SELECT doc_id, CASE WHEN length(text) > 320 THEN left(text, 319) || '…' ELSE text END AS clipped FROM documents")
def fn7(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.clip(F.col("text"), 320).alias("clipped"))


@query("fn8_scopes", f"{WITH} SELECT DISTINCT course_title || ' (' || course_code || ')' || ', semester ' || semester || CASE WHEN unit % 2 = 0 THEN ', from ' || year ELSE ', ' || year || '–' || (year + 1) END AS scope FROM questions")
def fn8(spark, d):
    q = V.questions(spark, d)
    return q.select(S.describe_scope(F.col("course_code"), F.col("course_title"), F.col("semester"), F.lit(None).cast("string"), F.col("year"), F.when(F.col("unit") % 2 != 0, F.col("year") + 1)).alias("scope")).distinct()


@query("fn10_highlight", r"SELECT doc_id, regexp_replace(text, '(?i)(^|[^\p{L}0-9])((?:the|tion)[\p{L}0-9]*)', '\1**\2**', 'g') AS text FROM documents")
def fn10(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.highlight(F.col("text"), F.array(F.lit("the"), F.lit("tion"), F.lit("of"))).alias("text"))


@query("fn15_junk_ratio", "SELECT doc_id, round(length(regexp_replace(text, '[A-Za-z0-9\\s.,;:()''\"?!\\-+*/=<>%&_\\[\\]{}^|$#@~`’‘“”–—…→←≤≥≠∑√π∞∈∪∩θλμσΣΔ]', '', 'g')) / greatest(1, length(text)), 6) AS ratio FROM documents")
def fn15(spark, d):
    from paperloom.operators.documents import junk_ratio

    return V.table(spark, d, "documents").select("doc_id", F.round(junk_ratio(F.col("text")), 6).alias("ratio"))


@query("fn16_level_names", f"{WITH} SELECT bloom, CASE bloom WHEN 'L1' THEN 'Remember' WHEN 'L2' THEN 'Understand' WHEN 'L3' THEN 'Apply' WHEN 'L4' THEN 'Analyse' WHEN 'L5' THEN 'Evaluate' ELSE 'Create' END AS level, 'Unit ' || unit AS unit_label, count(*) AS n FROM questions GROUP BY ALL")
def fn16(spark, d):
    return V.questions(spark, d).groupBy("bloom", S.level_name(F.col("bloom")).alias("level"), S.unit_label(F.col("unit")).alias("unit_label")).agg(F.count(F.lit(1)).alias("n"))


@query("fn17_search_keys", "SELECT sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, count(*) AS n FROM documents GROUP BY 1")
def fn17(spark, d):
    return V.table(spark, d, "documents").groupBy(S.search_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("ast2_citations", f"{WITH} SELECT question_id, course_code || ' ' || exam_type || ' ' || month || ' ' || year || ' U' || unit AS citation FROM questions")
def ast2(spark, d):
    return V.questions(spark, d).select("question_id", S.citation(F.col("course_code"), F.col("exam_type"), F.col("month"), F.col("year"), F.concat(F.lit(" U"), "unit")).alias("citation"))


@query("ast4_question_keys", "SELECT count(DISTINCT key) AS n_keys FROM (SELECT rtrim(lower(regexp_replace(text, '\\s+', ' ', 'g')), '?.! ') || '|' || source AS key FROM documents)")
def ast4(spark, d):
    t = V.table(spark, d, "documents").withColumn("q", F.concat(F.upper(F.col("text")), F.lit(" ?!")))
    return t.agg(F.countDistinct(C.question_key(F.col("q"), F.col("source"))).alias("n_keys"))
