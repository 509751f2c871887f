"""Counts of papers, taken paper by paper, against distinct counts; joins by paper in partitions of a bounded size."""

from pyspark.sql import functions as F

from paperloom import views as V
from paperloom.operators import analytics as A
from paperloom.operators import catalogue as C


def test_join_by_paper_grows_by_partitions_not_by_their_size(spark, sf_dir, monkeypatch):
    whole = sorted(A.facets(V.questions(spark, sf_dir)).collect(), key=str)
    monkeypatch.setattr(V, "PARTITION_ROWS", 200)
    q = V.questions(spark, sf_dir)
    assert "REPARTITION_BY_NUM" in q._jdf.queryExecution().toString()
    assert sorted(A.facets(q).collect(), key=str) == whole


def test_partitions_of_the_join_by_paper_are_not_coalesced(spark, sf_dir, monkeypatch):
    rows = V.table(spark, sf_dir, "lineitem").count()
    # Twenty partitions, fewer than the session's forty.
    monkeypatch.setattr(V, "PARTITION_ROWS", -(-rows // 20))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        sizes = [r["count"] for r in V.questions(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == rows and max(sizes) <= 2 * V.PARTITION_ROWS


def test_counts_by_paper_are_distinct_counts(spark):
    rows = [(None if i % 9 == 0 else i % 7, "ab"[i % 2] if i % 5 else None, None if i % 4 == 0 else i) for i in range(200)]
    x = spark.createDataFrame(rows, "document_id long, key string, m long")
    want = x.groupBy("key").agg(F.count(F.lit(1)).alias("n_questions"), F.countDistinct("document_id").alias("n_papers"), F.sum(F.coalesce("m", F.lit(0))).alias("total_marks"))
    assert sorted(A.counted_by_paper(x, "key", marks="m").collect(), key=str) == sorted(want.collect(), key=str)


def test_no_pairs_of_key_and_paper_are_shuffled(spark, sf_dir):
    q = V.questions(spark, sf_dir)
    scheme = spark.createDataFrame([("Brand#1", "LARGE")], "code string, title string")
    for x in (A.facets(q), A.revision_ranking(q), C.linked_papers(scheme, q), C.courses_from_papers(q)):
        aggregates = [l for l in x._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in l]
        assert not [l for l in aggregates if "distinct document_id" in l.lower() and "n_papers" in l]


def test_courses_and_linked_papers(spark):
    rows = [(i % 6, "C" + str(i % 2), "T" + str(i % 3), "B" + str(i % 4) if i % 5 else None, 2000 + i % 6 if i % 6 else None, i % 3) for i in range(90)]
    q = spark.createDataFrame(rows, "document_id long, course_code string, course_title string, branch string, year long, semester long")
    got = {r.course_code: (r.branches, r.n_papers, r.n_questions, r.year_list) for r in C.courses_from_papers(q).collect()}
    for c in ("C0", "C1"):
        mine = [r for r in rows if r[1] == c]
        listed = lambda k: ",".join(sorted({str(r[k]) for r in mine if r[k] is not None}))
        assert got[c] == (listed(3), len({r[0] for r in mine}), len(mine), listed(4))
    s = spark.createDataFrame([("C0", "T0"), ("C1", "T1"), ("C9", "T1")], "code string, title string")
    for r in C.linked_papers(s, q).collect():
        mine = [x for x in rows if x[1] == r.code and x[2] == r.title]
        assert (r.n_papers, r.year_list) == (len({x[0] for x in mine}), ",".join(sorted({str(x[4]) for x in mine if x[4] is not None})))
