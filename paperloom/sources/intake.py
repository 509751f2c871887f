"""Reading folders, manifests, scheme files and saved listing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.scalars import default_title, entity_decode

MAX_BYTES = 25 * 1024 * 1024


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def wanted(files: DataFrame) -> DataFrame:
    """PDF and picture files by name."""
    return files.where(F.col("path").rlike(r"(?i)\.(pdf|png|jpe?g)$"))


def skipped(files: DataFrame) -> DataFrame:
    """Office files, which are reported and not read."""
    return files.where(F.col("path").rlike(r"(?i)\.(docx?|pptx?|xlsx?)$")).select("path")


def mime_type(content: Column) -> Column:
    """Type by the first bytes; NULL for anything that is not taken."""
    h = F.hex(F.substring(content, 1, 8))
    return F.when(h.startswith("25504446"), "application/pdf").when(h == "89504E470D0A1A0A", "image/png").when(h.startswith("FFD8FF"), "image/jpeg")


def gate(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Files with mime, title and the reason why one is not taken (NULL if it is)."""
    x = files.withColumn("mime", mime_type(F.col("content"))).withColumn("title", default_title(F.col("path")))
    return x.withColumn("refused", F.when(F.col("mime").isNull(), "type").when(F.col("length") > most, "size"))


def with_manifest(files: DataFrame, spark: SparkSession, manifest: str, root: str) -> DataFrame:
    """Files with the source link that a JSON manifest [{file, url}] gives by relative path; a byte-order mark is no matter."""
    m = spark.read.option("multiLine", True).schema("file string, url string").json(manifest).select(F.regexp_replace("file", "^﻿", "").alias("m_file"), F.col("url").alias("source_url"))
    rel = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return files.withColumn("rel", rel).join(m, F.col("rel") == F.col("m_file"), "left").drop("m_file", "rel")


SCHEME = "scheme string, program string, semester int, courses array<struct<code: string, title: string, credits: struct<L: int, T: int, P: int, total: int>>>"


def scheme_courses(spark: SparkSession, path: str, schema: str = SCHEME) -> DataFrame:
    """code (upper case), scheme, program, semester, title, credits of every course in scheme files; what a course does not say is NULL."""
    s = spark.read.option("multiLine", True).schema(schema).json(path)
    return s.select("scheme", "program", "semester", F.explode("courses").alias("c")).select(F.upper("c.code").alias("code"), "scheme", "program", "semester", "c.title", "c.credits")


def external_papers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The papers of an external catalogue file; what a paper does not say is NULL."""
    return spark.read.option("multiLine", True).schema(f"papers array<struct<{schema}>>").json(path).select(F.explode("papers").alias("p")).select("p.*")


def links(pages: DataFrame) -> DataFrame:
    """page_id, pos, href, title, folder_id, is_folder of every link of saved pages. ``pages``: page_id, html."""
    pattern = r'<a[^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
    x = pages.select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("t"))).alias("pos", "l"))
    folder = F.nullif(F.regexp_extract("l.href", r"/folders/([\w-]+)", 1), F.lit(""))
    return x.select("page_id", "pos", entity_decode(F.col("l.href")).alias("href"), entity_decode(F.col("l.t")).alias("title"), folder.alias("folder_id"), folder.isNotNull().alias("is_folder"))


def links_under_headings(pages: DataFrame) -> DataFrame:
    """page_id, pos, h1, h2, h3, href, title: links with the last heading of each level above them."""
    token = r'(<h[123][^>]*>[^<]*</h[123]>|<a[^>]*href="[^"]*"[^>]*>[^<]*</a>)'
    x = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(token), F.lit(1))).alias("pos", "t"))
    w = Window.partitionBy("page_id").orderBy("pos")
    text = entity_decode(F.regexp_replace("t", "<[^>]*>", ""))
    for level in "123":
        x = x.withColumn(f"h{level}", F.last(F.when(F.col("t").startswith(f"<h{level}"), text), ignorenulls=True).over(w))
    return x.where(F.col("t").startswith("<a")).select("page_id", "pos", "h1", "h2", "h3", F.regexp_extract("t", r'href="([^"]*)"', 1).alias("href"), text.alias("title"))
