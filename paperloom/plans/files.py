"""Queries over files: the tables are written as folders, manifests, scheme and catalogue files and read back; also what a listing's names and a paper's parts come to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.operators import curation as C
from paperloom.operators import documents as D
from paperloom.operators import listing as L
from paperloom.plans.listings import _listing
from paperloom.plans.registry import query
from paperloom.sources import intake as I
from paperloom.tables import shared_folder

#: Entries of one manifest or catalogue file.
PER_FILE = 2000


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/paperloom-{name}-{uuid.uuid4().hex}"


def _saved(x: DataFrame, name: str) -> str:
    """The folder in which each row's ``content`` is a file of its own, in the directory that its ``place`` names."""
    path = _folder(x.sparkSession, name)
    x.select("place", "content").repartition("place").write.partitionBy("place").text(path)
    return path


@query("src1_folder_scan", "SELECT CASE doc_id % 3 WHEN 0 THEN 'papers' ELSE 'scans' END AS folder, doc_id, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT DISTINCT 'office', NULL::BIGINT, NULL FROM documents WHERE doc_id % 3 = 2")
def src1(spark, d):
    """Three folders of files, of which office files are named and not read."""
    t = V.table(spark, d, "documents")
    path = _folder(spark, "folders")
    for i, (folder, kind) in enumerate((("papers", "pdf"), ("scans", "PNG"), ("office", "doc"))):
        lines = t.where(F.col("doc_id") % 3 == i).select(F.concat_ws(" ", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"))
        lines.write.option("extension", kind).option("quote", "").option("maxRecordsPerFile", 100_000).csv(f"{path}/{folder}")
    files = I.scan_folder(spark, path)
    name = lambda: F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("folder")
    read = I.wanted(files).select(name(), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    parts = F.split("line", " ")
    taken = read.select("folder", parts[0].cast("long").alias("doc_id"), parts[1].alias("hash"))
    return taken.unionByName(I.skipped(files).select(name(), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("hash")).distinct())


_HEADS = ["255044462D312E370A", "89504E470D0A1A0A", "FFD8FFE0", "504B0304"]


@query("src2_type_gate", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS mime, trim(lang || ' ' || doc_id) AS title,
CASE WHEN doc_id % 4 = 3 THEN 'type' WHEN strlen(coalesce(text, '')) + list_extract([{', '.join(str(len(h) // 2) for h in _HEADS)}], doc_id % 4 + 1) > 5000 THEN 'size' END AS refused FROM documents""")
def src2(spark, d):
    """Documents behind the first bytes of four types; all are called .pdf, and what is over 5,000 bytes is refused."""
    t = V.table(spark, d, "documents")
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % 4).cast("int")))
    content = F.concat(head, F.coalesce("text", F.lit("")).cast("binary"))
    files = t.select("doc_id", F.concat(F.lit("in/"), "lang", F.lit("_"), "doc_id", F.lit(".pdf")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return I.gate(files, 5000).select("doc_id", "mime", "title", "refused")


@query("src4_manifest_join", "SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url END AS source_url FROM pages")
def src4(spark, d):
    """A listing's files get their links from manifests of some thousand files each, which begin with a byte-order mark."""
    k = F.col("page_id")
    file = F.concat_ws("/", k % 10, F.concat(k, F.lit(".pdf")))
    p = V.table(spark, d, "pages").select("page_id", "url", file.alias("file"))
    entries = p.where("page_id % 3 > 0").groupBy(F.floor(k / PER_FILE).alias("place")).agg(F.to_json(F.collect_list(F.struct("file", "url"))).alias("content"))
    manifest = _saved(entries.select("place", F.concat(F.lit("﻿"), "content").alias("content")), "manifest")
    files = p.select("page_id", F.concat(F.lit("file:/archive/"), "file").alias("path"))
    return I.with_manifest(files, spark, manifest, "archive").select("page_id", "source_url")


@query("src6_scheme_files", """WITH n AS (SELECT 'C' || p_partkey AS code, 'S' || p_partkey // 10000 AS scheme, p_brand[:7] AS program, (p_size % 8 + 1)::INT AS semester, p_name AS title, p_size % 4 + 1 AS total, p_partkey FROM part)
SELECT code, scheme, program, semester, title, total FROM n UNION ALL SELECT code, scheme, 'earlier', 1, 'old', 9 FROM n WHERE p_partkey % 5 = 0""")
def src6(spark, d):
    """A third of the courses is there already and is replaced by what the scheme files say; those of an earlier program stay."""
    p = V.table(spark, d, "part")
    size = F.col("p_size")
    credits = F.struct((size % 4).alias("L"), F.lit(0).alias("T"), F.lit(1).alias("P"), (size % 4 + 1).alias("total"))
    scheme = F.concat(F.lit("S"), F.floor(F.col("p_partkey") / 10000))
    x = p.select(scheme.alias("scheme"), F.left("p_brand", F.lit(7)).alias("program"), (size % 8 + 1).alias("semester"), F.struct(F.concat(F.lit("c"), "p_partkey").alias("code"), F.col("p_name").alias("title"), credits.alias("credits")).alias("c"))
    x = x.groupBy("scheme", "program", "semester").agg(F.collect_list("c").alias("courses"))
    path = _saved(x.select(F.concat_ws("-", "scheme", "program", "semester").alias("place"), F.to_json(F.struct("scheme", "program", "semester", "courses")).alias("content")), "schemes")
    new = I.scheme_courses(spark, path).select("code", "scheme", "program", "semester", "title", F.col("credits.total").cast("long").alias("total"), F.lit(1).alias("version"))
    old = p.select(F.concat(F.lit("C"), "p_partkey").alias("code"), scheme.alias("scheme"), F.explode(F.array(F.when(F.col("p_partkey") % 3 == 0, F.left("p_brand", F.lit(7))), F.when(F.col("p_partkey") % 5 == 0, F.lit("earlier")))).alias("program"), F.lit(1).alias("semester"), F.lit("old").alias("title"), F.lit(9).cast("long").alias("total"), F.lit(0).alias("version"))
    return C.upsert(old.where("program IS NOT NULL"), new, ["code", "scheme", "program"], "version").drop("version")


@query("src8_external_catalogue", "SELECT url, CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 3) END AS subject, CASE WHEN page_id % 3 = 0 THEN (2000 + page_id % 25)::INT END AS year FROM pages")
def src8(spark, d):
    """Catalogue files whose papers leave out what is not known."""
    k = F.col("page_id")
    paper = F.struct("url", F.when(k % 2 == 0, F.split("url", "/")[2]).alias("subject"), F.when(k % 3 == 0, 2000 + k % 25).alias("year"))
    x = V.table(spark, d, "pages").groupBy(F.floor(k / PER_FILE).alias("place")).agg(F.collect_list(paper).alias("papers"))
    path = _saved(x.select("place", F.to_json(F.struct("papers")).alias("content")), "catalogue")
    return I.external_papers(spark, path, "url: string, subject: string, year: int")


@query("cls2_evidence", r"""WITH l AS (SELECT page_id, page_id % 7 = 0 AND page_id % 11 <> 0 AS deep, ['CIE 2 may 2021', 'see-2019', 'model paper', 'Module 1 notes', 'june 2022', 'makeup 2020', 'unit 3', 'quiz 1'][page_id % 8 + 1] AS base,
CASE page_id % 4 WHEN 0 THEN '4. dbms' WHEN 1 THEN 'DATA COMMUNICATION AND THEORY' WHEN 2 THEN '3rd sem' ELSE regexp_extract(url, '//(?:[a-z]+\.)?([a-z]+)\.', 1) END AS folder FROM pages)
SELECT page_id, concat_ws('|', base, '5th sem 2018 batch', CASE WHEN page_id % 6 = 0 THEN 'question papers' ELSE 'notes of ' || folder END, CASE WHEN NOT deep THEN folder END) AS texts FROM l""")
def cls2(spark, d):
    return L.evidence(_listing(spark, d)).select("page_id", F.array_join("texts", "|").alias("texts"))


def _tree(spark, d) -> DataFrame:
    """A question of each order: alone, with two marked parts, of several choices, or with sub-parts that carry marks."""
    k = F.col("o_orderkey")
    own = (k % 10 + 1).cast("int")
    none, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")

    def node(at, part, sub, text, marks, co=none):
        return F.struct(F.lit(at).alias("at"), part.alias("part"), sub.alias("sub"), text.alias("text"), marks.alias("marks"), co.alias("co"))

    a, b, i, ii = (F.lit(x) for x in ("a", "b", "i", "ii"))
    stem, status, level = F.concat(F.lit("order "), k), F.concat(F.lit("status "), "o_orderstatus"), F.concat(F.lit("level "), "o_orderpriority")
    alone = F.array(node(0, none, none, stem, own, F.lit("CO1")))
    parts = F.array(node(0, none, none, stem, no_int), node(1, a, none, status, own, F.lit("CO2")), node(2, b, none, level, own + 1))
    choice = F.array(node(0, none, none, stem, own), node(1, a, none, status, no_int), node(2, b, none, level, no_int))
    deep = F.array(node(0, none, none, stem, no_int), node(1, a, none, status, no_int), node(2, a, i, level, own), node(3, a, ii, F.lit("say why"), own + 2, F.lit("CO3")), node(4, b, none, F.lit("draw it"), no_int), node(5, b, i, F.lit("in ink"), own))
    tree = F.when(k % 4 == 0, alone).when(k % 4 == 1, parts).when(k % 4 == 2, choice).otherwise(deep)
    x = V.table(spark, d, "orders").select(k.alias("document_id"), F.explode(tree).alias("n"))
    flags = F.when(F.col("n.at") == 0, F.array(F.lit("numbering-gap"))).otherwise(F.array().cast("array<string>"))
    return x.select("document_id", F.lit(1).alias("q"), "n.part", "n.sub", "n.text", "n.marks", "n.co", F.lit(None).cast("string").alias("bloom"), F.lit(1).alias("page"), F.lit(2).alias("unit"), flags.alias("flags"), F.struct(F.lit(1).alias("page"), F.col("n.at").alias("at")).alias("seq"))


@query("doc6_leaves", """WITH o AS (SELECT o_orderkey AS k, 'order ' || o_orderkey AS s, 'status ' || o_orderstatus AS t, 'level ' || o_orderpriority AS l, (o_orderkey % 10 + 1)::INT AS m FROM orders), r AS (
SELECT k, 1 AS ord, 'Q1' AS label, s AS text, m AS marks, 'CO1' AS co FROM o WHERE k % 4 = 0
UNION ALL SELECT k, 1, 'Q1(a)', s || ' — ' || t, m, 'CO2' FROM o WHERE k % 4 = 1 UNION ALL SELECT k, 2, 'Q1(b)', s || ' — ' || l, m + 1, NULL FROM o WHERE k % 4 = 1
UNION ALL SELECT k, 1, 'Q1', s || ' (a) ' || t || ' (b) ' || l, m, NULL FROM o WHERE k % 4 = 2
UNION ALL SELECT k, 1, 'Q1(a)(i)', s || ' ' || t || ' — ' || l, m, NULL FROM o WHERE k % 4 = 3 UNION ALL SELECT k, 2, 'Q1(a)(ii)', s || ' ' || t || ' — say why', m + 2, 'CO3' FROM o WHERE k % 4 = 3
UNION ALL SELECT k, 3, 'Q1(b)', s || ' — draw it (i) in ink', m, NULL FROM o WHERE k % 4 = 3)
SELECT k AS document_id, ord, label, text, marks, co, 'numbering-gap' AS flags FROM r""")
def doc6(spark, d):
    return D.leaves(_tree(spark, d)).select("document_id", "ord", "label", "text", "marks", "co", F.array_join("flags", ",").alias("flags"))
