"""Archive tables seen through the star-schema test tables, in Spark and as SQL for the checks.

Orders play papers, line items play questions, parts play what they ask about. Both forms read the whole
tables; column pruning and filters reach the Parquet scans because nothing here caches or collects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Question rows of a partition of the join with their papers.
PARTITION_ROWS = 250_000
#: So few of them may meet in one task; small tables are left to Spark, since hundreds of tasks would cost more than they save.
FEW_PARTITIONS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each paper; every fifth branch is unknown, to exercise the common shelf."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # The nation table has a fixed 25 rows.
    x = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return x.select(
        F.col("o_orderkey").alias("document_id"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"),
        F.year("o_orderdate").cast("long").alias("year"),
        F.month("o_orderdate").cast("long").alias("month"),
        F.col("o_orderpriority").alias("exam_type"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("branch"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("file_size"),
        F.col("c_mktsegment").alias("segment"),
    )


PAPERS = """papers AS (SELECT o_orderkey AS document_id, 'order ' || o_orderkey AS title, year(o_orderdate) AS year, month(o_orderdate) AS month,
  o_orderpriority AS exam_type, o_orderstatus AS status, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS branch, o_orderdate AS created_at,
  o_totalprice AS file_size, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question or note passage, with its paper's metadata copied onto it."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    d = papers(spark, sf_dir).select("document_id", "year", "month", "exam_type", "branch")
    x = l.join(p, l.l_partkey == p.p_partkey)
    # The join by paper takes partitions of a bounded size; counts by paper and windows over a paper run in them without a shuffle.
    # Both sides are dealt into a stated number (Spark takes its own where that is larger): what a join deals for itself is coalesced to a few as it runs.
    parts = -(-l.count() // PARTITION_ROWS)
    if parts > min(FEW_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        x, d = x.repartition(parts, "l_orderkey"), d.repartition(parts, "document_id")
    x = x.join(d, x.l_orderkey == d.document_id)
    marks = F.col("l_quantity").cast("long")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("question_id"),
        "document_id",
        F.when(F.col("l_returnflag") == "N", "note").otherwise("question").alias("kind"),
        F.col("l_linenumber").cast("long").alias("unit"),
        F.when(marks % 7 != 0, marks).alias("marks"),
        F.concat(F.lit("L"), F.lit(1) + F.col("p_size") % 6).alias("bloom"),
        F.col("p_brand").alias("course_code"),
        F.col("p_type").alias("course_title"),
        (F.lit(1) + F.col("l_suppkey") % 8).cast("long").alias("semester"),
        F.array_distinct(F.split("p_name", " ")).alias("topics"),
        F.col("l_partkey").alias("group_id"),
        F.col("p_name").alias("text"),
        "year",
        "month",
        "exam_type",
        "branch",
        F.col("l_discount").alias("confidence"),
    )


QUESTIONS = """questions AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS question_id, document_id,
  CASE WHEN l_returnflag = 'N' THEN 'note' ELSE 'question' END AS kind, l_linenumber::BIGINT AS unit,
  CASE WHEN l_quantity::BIGINT % 7 <> 0 THEN l_quantity::BIGINT END AS marks, 'L' || (1 + p_size % 6) AS bloom, p_brand AS course_code, p_type AS course_title,
  1 + l_suppkey % 8 AS semester, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN [split_part(p_name, ' ', 1)] ELSE string_split(p_name, ' ') END AS topics, l_partkey AS group_id, p_name AS text, year, month, exam_type, branch,
  l_discount AS confidence
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN papers ON l_orderkey = document_id)"""

WITH = f"WITH {PAPERS}, {QUESTIONS}"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the documents, for retrieval and for turning into rows."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", "lang", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("doc"))


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label::BIGINT AS doc FROM embeddings)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity log; the tables' times have no zone and are read as UTC."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("kind"), F.col("value").alias("amount"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary made of the words of part names; some labels are missing, some topics still proposed."""
    t = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name"), F.col("p_brand").alias("code")).groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("course_codes"))
    return t.select("name", F.when(F.length("name") != 4, F.initcap("name")).alias("label"), F.when(F.length("name") % 2 == 0, "approved").otherwise("proposed").alias("status"), F.when(F.col("name") == "tiny", "small").alias("merged_into"), "course_codes")


TOPICS = """topics AS (SELECT name, CASE WHEN length(name) <> 4 THEN upper(name[1]) || name[2:] END AS label, CASE WHEN length(name) % 2 = 0 THEN 'approved' ELSE 'proposed' END AS status,
  CASE WHEN name = 'tiny' THEN 'small' END AS merged_into, course_codes FROM (SELECT name, list_sort(list(DISTINCT code)) AS course_codes FROM (SELECT unnest(string_split(p_name, ' ')) AS name, p_brand AS code FROM part) GROUP BY name))"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items made of events."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("value") < 20, "open").when(F.col("value") < 40, "resolved").otherwise("dismissed")
    return e.select(F.col("event_id").alias("review_id"), F.col("event_type").alias("type"), status.alias("status"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"))


REVIEWS = """reviews AS (SELECT event_id AS review_id, event_type AS type, CASE WHEN value < 20 THEN 'open' WHEN value < 40 THEN 'resolved' ELSE 'dismissed' END AS status, user_id AS document_id, ts AS created_at FROM events)"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The external-paper library, made of parts."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("paper_id"),
        F.when(size % 5 != 0, (size % 5).cast("long")).alias("study_year"),
        F.when(size % 8 != 0, (size % 8).cast("long")).alias("semester"),
        F.when(size % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("subject"),
        F.col("p_brand").alias("course_code"),
        F.col("p_name").alias("title"),
        F.concat_ws(", ", F.concat(F.lit("B"), size % 3), F.concat(F.lit("B"), size % 4)).alias("branch"),
        F.when(size % 6 == 0, "CIE 1").when(size % 6 == 1, "CIE 2").when(size % 6 == 2, "SEE").when(size % 6 == 3, "Makeup").otherwise("Paper").alias("exam_type"),
        F.when(size % 7 != 0, F.lit(2015) + size % 10).cast("long").alias("year"),
        F.concat(F.lit("s"), size % 3).alias("source"),
    )


LIBRARY = """library AS (SELECT p_partkey AS paper_id, CASE WHEN p_size % 5 <> 0 THEN p_size % 5 END::BIGINT AS study_year, CASE WHEN p_size % 8 <> 0 THEN p_size % 8 END::BIGINT AS semester,
  CASE WHEN p_size % 2 = 0 THEN upper(p_type) ELSE p_type END AS subject, p_brand AS course_code, p_name AS title, 'B' || (p_size % 3) || ', B' || (p_size % 4) AS branch,
  CASE p_size % 6 WHEN 0 THEN 'CIE 1' WHEN 1 THEN 'CIE 2' WHEN 2 THEN 'SEE' WHEN 3 THEN 'Makeup' ELSE 'Paper' END AS exam_type,
  CASE WHEN p_size % 7 <> 0 THEN 2015 + p_size % 10 END::BIGINT AS year, 's' || (p_size % 3) AS source FROM part)"""
